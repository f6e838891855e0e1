"""Quality rules by distribution divergence.

Each text has two histograms: its characters by class, and its common words (the listed ones, and all others). Each
language has the same two as sums over all its documents of enough words and few symbols and capitals: the reference. A text is rejected
when the Jensen-Shannon distance (square root of the divergence in bits, 0 to 1) of either histogram to its language's
reference is beyond that distance's own limit, or when both are beyond lower limits. Short texts have noisy histograms,
so the limits fall with the length of the text, and text and reference have minimum lengths; below them there is no
verdict by divergence.

Base rules: fewer than 50 words, or more than half of all words in 3-word windows that occur twice, fail.

Texts are scanned once: that scan writes each document's counts (some 55 numbers), references are sums over this table,
and the verdict is a join of the two. No shuffle but that of the sums, which are partial and by language. ``report``
carries only ids along; ``passed`` has to carry the rows, so that repeated rows and ids need no join.

Cases. A null or empty text has no words and fails. A null language is a language of its own. Repeated rows are judged
one by one and all kept or all rejected. Distances at a limit pass (ties). Texts of any length are one row of work; their
words are an array in memory. An empty table gives an empty result. Columns of the input may have any names, those used
here included: they travel in a struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, bind, words, written

MIN_WORDS, MAX_REPEATED = 50, 50
#: Limits of both distances together (NOISE / words comes to the first), and the words that a text and a reference need.
MAX_CLASS, NOISE, MAX_COMMON = 0.175, 1.5, 0.18
MIN_DIVERGENT, MIN_REFERENCE = 50, 1000
#: What comes to the limits of a distance that rejects alone: by words, by the square root of words, and by the share of
#: digits and symbols in the reference, where these are ordinary.
CLASS_ALONE, COMMON_ALONE, MIXED = 5.0, 2.0, 2.0
#: Frequent words of four languages.
COMMON = (
    "the", "of", "and", "to", "in", "is", "that", "for", "with", "was",
    "de", "la", "le", "les", "et", "des", "en", "un", "une", "que",
    "der", "die", "und", "den", "das", "von", "zu", "mit", "ist", "nicht",
    "el", "los", "las", "del", "se", "por", "con", "para", "no", "y",
)
#: Classes of characters, counted one after the other; what is left is of no class.
CLASSES = (r"[a-z\p{Ll}\p{Lo}\p{Lm}\p{M}]+", SPACE, r"\p{Lu}+", r"[.,;:!?'\"()-]+", r"\p{Nd}+", r"[#*$%&|<>]+")
CAPITAL_CLASS, DIGIT_CLASS, SYMBOL_CLASS = 2, 4, 5
SYMBOLS = r"[#*$%&|<>]"
#: Documents with more symbols or capitals than this share of their characters are no part of a reference.
MAX_SYMBOLS, MAX_CAPITALS = 0.01, 0.2


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines of a text whose words are in column __words."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": bind(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def windows(ws: Column) -> Column:
    """64-bit hashes of the 3-word windows of an array of words."""
    window = lambda i: F.xxhash64(F.get(ws, i - 1), F.get(ws, i), F.get(ws, i + 1))
    return F.when(F.size(ws) >= 3, F.transform(F.sequence(F.lit(1), F.size(ws) - 2), window)).otherwise(F.array().cast("array<bigint>"))


def repeated(hashes: Column) -> Column:
    """Words covered by windows that occur twice or more: sorted hashes show equal neighbours, and the starts of those
    windows, in order, cover up to three words each."""
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def flagged(rows: Column) -> Column:
        twin = lambda x, j: (F.get(rows, j - 1)["h"] == x["h"]) | (F.get(rows, j + 1)["h"] == x["h"])
        return F.filter(F.transform(rows, lambda x, j: F.when(twin(x, j), x["i"])), lambda i: i.isNotNull())

    return F.aggregate(
        F.sort_array(bind(placed, flagged)),
        F.struct(F.lit(-3).alias("at"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, i: F.struct(i.alias("at"), (acc["n"] + F.least(F.lit(3), i - acc["at"])).alias("n")),
        lambda acc: acc["n"],
    )


def class_counts(text: Column) -> Column:
    """Characters of each class, and of none."""

    def counted(left: Column, k: int) -> Column:
        if k == len(CLASSES):
            return F.array(F.length(left).cast("bigint"))
        return bind(F.regexp_replace(left, CLASSES[k], ""), lambda rest: F.concat(F.array((F.length(left) - F.length(rest)).cast("bigint")), counted(rest, k + 1)))

    return counted(F.coalesce(text, F.lit("")), 0)


def common_counts(ws: Column) -> Column:
    """Occurrences of each common word, and of all other words. One expression runs over the list of words: forty copies
    of it would be a plan too large for the compiler."""
    listed = F.array(*[F.lit(f" {w} ") for w in COMMON])
    times = lambda line, w: ((F.length(line) - F.length(F.replace(line, w, F.lit("")))) / F.length(w)).cast("bigint")
    counted = lambda line: F.transform(listed, lambda w: times(line, w))
    known = F.filter(ws, lambda w: w.isin(*COMMON))
    line = lambda x: F.concat(F.lit(" "), F.array_join(x, "  "), F.lit(" "))
    return bind(known, lambda x: F.concat(bind(line(x), counted), F.array((F.size(ws) - F.size(x)).cast("bigint"))))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms; 0 when one of them is empty."""
    part = lambda a, mid: F.when(a > 0, a * F.log2(a / mid)).otherwise(0.0)

    def over(totals: Column) -> Column:
        def both(x, y):
            a, b = x / totals["n"], y / totals["m"]
            return (part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2

        total = F.aggregate(F.zip_with(p, q, both), F.lit(0.0), lambda s, x: s + x)
        return F.when((totals["n"] > 0) & (totals["m"] > 0), F.sqrt(F.greatest(total, F.lit(0.0)))).otherwise(0.0)

    return bind(F.struct(_total(p).cast("double").alias("n"), _total(q).cast("double").alias("m")), over)


def base_failed(n: Column, n_repeat: Column) -> Column:
    return (n < MIN_WORDS) | (100 * n_repeat > MAX_REPEATED * n)


def counts(docs: DataFrame, kept: Column, *, text="text", lang="lang") -> DataFrame:
    """One row per document, from one scan: kept, key (of the language), common, classes, and the measures."""
    rows = docs.select(kept.alias("kept"), F.col(text).alias("text"), F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit("")).alias("key"))
    rows = rows.withColumn("__words", words(F.col("text")))
    rows = rows.select("*", windows(F.col("__words")).alias("__w"), common_counts(F.col("__words")).alias("common"), class_counts(F.col("text")).alias("classes"), *[c.alias(n) for n, c in measures(F.col("text")).items()])
    again = F.when(F.size(F.array_distinct("__w")) < F.size("__w"), repeated(F.col("__w"))).otherwise(0)
    return rows.select("kept", "key", "common", "classes", "n_words", "word_chars", "n_symbols", "n_dup_lines", again.cast("long").alias("n_repeat_words"))


def references(counted: DataFrame) -> DataFrame:
    """One row per language of a table of counts: key, and the histograms over its documents of enough words."""
    share = lambda c: F.get("classes", F.lit(c)) / _total(F.col("classes"))
    fit = (F.col("n_words") >= MIN_WORDS) & (share(SYMBOL_CLASS) <= MAX_SYMBOLS) & (share(CAPITAL_CLASS) <= MAX_CAPITALS)
    each = counted.where(fit).select("key", F.posexplode(F.concat("common", "classes")).alias("at", "n"))
    sums = each.groupBy("key", "at").agg(F.sum("n").alias("n"))
    n = len(COMMON) + 1
    whole = sums.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("all"))
    return whole.select("key", F.slice("all", 1, n).alias("ref_common"), F.slice("all", n + 1, len(CLASSES) + 1).alias("ref_classes"))


def _judged(docs: DataFrame, kept: Column, text: str, lang: str) -> DataFrame:
    counted = written(counts(docs, kept, text=text, lang=lang), "quality-counts")
    found = written(references(counted), "quality-references")
    rows = counted.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words"))).join(found, "key", "left")
    by_class = distance(F.col("classes"), F.col("ref_classes"))
    by_common = distance(F.col("common"), F.col("ref_common"))
    enough = (F.col("n_words") >= MIN_DIVERGENT) & (_total(F.col("ref_common")) >= MIN_REFERENCE)
    rows = rows.select("*", F.when(enough, by_class).alias("class_distance"), F.when(enough, by_common).alias("common_distance"))
    n, one, two = F.greatest(F.col("n_words"), F.lit(1)), F.coalesce("class_distance", F.lit(0.0)), F.coalesce("common_distance", F.lit(0.0))
    far = (one > MAX_CLASS + NOISE / n) & (two > MAX_COMMON)
    mixed = (F.get("ref_classes", F.lit(DIGIT_CLASS)) + F.get("ref_classes", F.lit(SYMBOL_CLASS))) / _total(F.col("ref_classes"))
    far = far | (one > MAX_CLASS + CLASS_ALONE / n + MIXED * mixed) | (two > MAX_COMMON + COMMON_ALONE / F.sqrt(n))
    far = F.coalesce(far, F.lit(False))
    return rows.withColumn("verdict", ~F.col("base_failed") & ~far)


def report(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang") -> DataFrame:
    """The measures, distances and verdict of every document."""
    rows = _judged(docs, F.col(doc_id), text, lang)
    return rows.select(F.col("kept").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("verdict").alias("kept"), "class_distance", "common_distance")


def passed(docs: DataFrame, *, text="text", lang="lang") -> DataFrame:
    """The documents that are kept, with all their columns."""
    row = F.struct(*[F.col(c) for c in docs.columns])
    return _judged(docs, row, text, lang).where("verdict").select("kept.*")
