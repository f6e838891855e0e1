"""Word and quoted-word counts over a corpus.

Words are counted raw; case folding and accent stripping run over distinct words, which are then counted again. Counts are
exact: partial aggregation, one shuffle of distinct words. The statistics of a scan come from the pass that counts
(``stored``; ``counted`` by Spark's observed metrics) or from one of their own without a shuffle of words (``scan_stats``); both look at the
words after folding and filters, as the counts do.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import quotes, text as T
from ..sources import io


@dataclass(frozen=True)
class Options:
    """What is counted. max_documents counts scanned documents, in id order, before any other filter."""

    text: str = "text"
    order: str = "doc_id"
    normalization: str = "NFKC"
    lowercase: bool = False
    strip_accents: bool = False
    min_length: int = 1
    script: str | None = None
    min_quality: float | None = None
    quality: str = "quality_score"
    max_documents: int | None = None

    def __post_init__(self):
        if self.normalization not in T.FORMS:
            raise ValueError(f"normalization must be one of {', '.join(T.FORMS)}")
        if self.min_length < 1:
            raise ValueError("min_length must be at least 1")
        if self.max_documents is not None and self.max_documents < 1:
            raise ValueError("max_documents must be at least 1")
        if self.script is not None and self.script not in T.SCRIPTS:
            raise ValueError(f"script must be one of {', '.join(T.SCRIPTS)}")


def scanned(corpus: DataFrame, o: Options) -> DataFrame:
    """The documents that are counted, after the cap, the quality filter and the blank test."""
    if o.max_documents is not None:
        corpus = corpus.orderBy(o.order).limit(o.max_documents)
    if o.min_quality is not None:
        corpus = corpus.where(F.col(o.quality) >= o.min_quality)
    return corpus.where(T.nonblank(F.col(o.text)))


def folded(word: Column, o: Options) -> Column:
    word = T.casefold(word) if o.lowercase else word
    return T.strip_accents(word) if o.strip_accents else word


def survives(word: Column, o: Options) -> Column:
    """Whether a folded word passes the filters."""
    keep = F.length(word) >= o.min_length
    return keep & T.has_script(word, o.script) if o.script else keep


def kept(words: DataFrame, o: Options) -> DataFrame:
    """(word, count, ...) rows after folding and filters, in that order; counts of equal words are added."""
    others = [c for c in words.columns if c not in ("word", "count")]
    if o.lowercase or o.strip_accents:
        words = words.withColumn("word", folded(F.col("word"), o)).groupBy(*others, "word").agg(F.sum("count").alias("count"))
    return words.where(survives(F.col("word"), o))


def _grouped(rows: DataFrame, words: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of the elements of an array of words. The array is made in the explode itself: as a column before it, it would be made
    once more for the filter that Spark infers from an explode."""
    return rows.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"))


def raw_counts(corpus: DataFrame, o: Options = Options(), by: tuple[str, ...] = ()) -> DataFrame:
    """word, count of the words as they stand, before folding and filters (``kept``)."""
    rows = T.normalized(scanned(corpus, o).select(*by, o.text), o.text, o.normalization)
    return _grouped(rows, T.words(F.col(o.text)), by)


def word_counts(corpus: DataFrame, o: Options = Options(), by: tuple[str, ...] = ()) -> DataFrame:
    """word, count (by further columns, if given)."""
    return kept(raw_counts(corpus, o, by), o)


def quoted_segments(corpus: DataFrame, o: Options = Options()) -> DataFrame:
    """id, position, segment."""
    return quotes.segment_rows(scanned(corpus, o).select(o.order, o.text), o.text, o.normalization)


def quoted_word_counts(corpus: DataFrame, o: Options = Options()) -> DataFrame:
    return kept(_grouped(quoted_segments(corpus, o), T.words(F.col("segment"))), o)


def ranked(counts: DataFrame, min_count: int = 1, limit: int = 0) -> DataFrame:
    """Most frequent first, ties by word; no limit if it is 0."""
    rows = counts.where(F.col("count") >= min_count).orderBy(F.desc("count"), "word")
    return rows.limit(limit) if limit else rows


def preview(counts: DataFrame, limit: int = 0, most: int = 25) -> DataFrame:
    return ranked(counts, 1, min(most, limit) if limit else most)


def _documents(corpus: DataFrame, o: Options) -> DataFrame:
    """One row for each scanned document; its text is null if it isn't counted."""
    capped = corpus.orderBy(o.order).limit(o.max_documents) if o.max_documents is not None else corpus
    counts = T.nonblank(F.col(o.text))
    if o.min_quality is not None:
        counts = counts & F.coalesce(F.col(o.quality) >= o.min_quality, F.lit(False))
    return capped.select(F.when(counts, F.col(o.text)).alias(o.text))


def _with_words(corpus: DataFrame, o: Options, whole: bool = True) -> DataFrame:
    """words and n of every scanned document: the words as they stand, and how many of them survive folding and filters; unless
    whole, n is 1 if any does, for which no word beyond the first of these is folded."""
    rows = T.normalized(_documents(corpus, o), o.text, o.normalization)
    rows = rows.select(F.coalesce(T.words(F.col(o.text)), F.array().cast("array<string>")).alias("words"))
    passes = lambda w: survives(folded(w, o), o)
    return rows.withColumn("n", (F.size(F.filter("words", passes)) if whole else F.exists("words", passes)).cast("long"))


def _with_quotes(corpus: DataFrame, o: Options) -> DataFrame:
    """words, n and segments of every scanned document: the words of its quoted segments, how many survive, how many segments."""
    rows = quotes.with_segments(_documents(corpus, o), o.text, o.normalization)
    rows = rows.select("segments", F.flatten(F.transform("segments", T.words)).alias("words"))
    n = F.size(F.filter("words", lambda w: survives(folded(w, o), o)))
    return rows.select("words", n.cast("long").alias("n"), F.size("segments").cast("long").alias("segments"))


def _total(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def _scan_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("documents_scanned"), F.count_if(F.col("n") > 0).alias("documents_counted"), _total("n").alias("total_words")]


def _quote_metrics() -> list[Column]:
    return [F.count(F.lit(1)).alias("documents_scanned"), F.count_if(F.col("segments") > 0).alias("documents_with_quotes"), _total("segments").alias("total_segments"), _total("n").alias("total_words")]


def scan_stats(corpus: DataFrame, o: Options = Options()) -> DataFrame:
    """One row: documents scanned, documents with a surviving word, and all surviving words. No word is shuffled."""
    return _with_words(corpus, o).agg(*_scan_metrics())


def quoted_stats(corpus: DataFrame, o: Options = Options()) -> DataFrame:
    """One row: documents scanned, documents with a segment, all segments, and all surviving words in them."""
    return _with_quotes(corpus, o).agg(*_quote_metrics())


def counted(corpus: DataFrame, o: Options = Options(), quoted: bool = False) -> tuple[DataFrame, Observation]:
    """word, count of words or quoted words, and the statistics of the same pass: a dict as the observation's ``get``, once an action
    has run over the counts. A stage that runs again adds to what was observed; ``stored`` doesn't have that weakness."""
    seen = Observation()
    rows = _with_quotes(corpus, o) if quoted else _with_words(corpus, o)
    metrics = _quote_metrics() if quoted else _scan_metrics()
    return kept(_grouped(rows.observe(seen, *metrics), F.col("words")), o), seen


def stored(corpus: DataFrame, path: str, o: Options = Options(), quoted: bool = False) -> tuple[DataFrame, dict]:
    """Counts as a Parquet table at a path, read back, and the statistics of the same pass, as ``scan_stats`` or ``quoted_stats``
    have them. Documents are counted as rows among the words, each kind of row by a key of its own, so the statistics are exact
    also when an executor is lost and a stage runs again, which an observation's sums are not."""
    spark = corpus.sparkSession
    rows = _with_quotes(corpus, o) if quoted else _with_words(corpus, o, whole=False)
    mark = lambda name: F.array(F.struct(F.lit(name).alias("mark"), F.lit(None).cast("string").alias("word")))
    when = lambda holds, marks: F.when(holds, marks).otherwise(F.slice(marks, 1, 0))
    words = F.transform("words", lambda w: F.struct(F.lit(None).cast("string").alias("mark"), w.alias("word")))
    if quoted:
        marks = [when(F.col("segments") > 0, mark("documents_with_quotes")), F.flatten(F.array_repeat(mark("total_segments"), F.col("segments").cast("int")))]
    else:
        marks = [when(F.col("n") > 0, mark("documents_counted"))]
    each = rows.select(F.explode(F.concat(words, mark("documents_scanned"), *marks)).alias("x")).select("x.mark", "x.word")
    table = io.stored(each.groupBy("mark", "word").agg(F.count(F.lit(1)).alias("count")), "scan")
    kept(table.where("mark is null").select("word", "count"), o).write.parquet(path)
    counts = spark.read.schema("word string, count long").parquet(path)
    names = ("documents_scanned", *(("documents_with_quotes", "total_segments") if quoted else ("documents_counted",)))
    seen = dict.fromkeys(names, 0) | {r.mark: r["count"] for r in table.where("mark is not null").collect()}
    return counts, seen | {"total_words": counts.agg(_total("count")).first()[0]}


def unique_stats(counts: DataFrame, min_count: int = 1) -> DataFrame:
    return counts.agg(F.count(F.lit(1)).alias("unique_words"), F.count_if(F.col("count") >= min_count).alias("exported_words"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("total_words"))


def merge(*tables: DataFrame) -> DataFrame:
    """Counts of several tables added up: the keyed upsert of batches."""
    rows = tables[0].select("word", "count")
    for t in tables[1:]:
        rows = rows.unionByName(t.select("word", "count"))
    return rows.groupBy("word").agg(F.sum("count").alias("count"))
