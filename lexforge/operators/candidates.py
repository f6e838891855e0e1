"""Candidate selection: filter ladder, case collapse, scores, ranks, and static lists.

The order of steps is part of the result: minimum count, then the most frequent input rows, then length and script,
then case collapse, then scores and ranks, then the cap, then static entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import io
from .counts import ranked
from .ordering import numbered
from .tokenization import bounded

MIN_COUNT, TOP_INPUT, MAX_SELECTED, MIN_PIECES, MIN_LENGTH, MAX_LENGTH = 5, 200_000, 5000, 3, 4, 40


def validate(min_count=MIN_COUNT, top_input=TOP_INPUT, max_selected=MAX_SELECTED, min_pieces=MIN_PIECES, min_length=MIN_LENGTH, max_length=MAX_LENGTH) -> None:
    if min_count < 1 or min_length < 1 or min_pieces < 1:
        raise ValueError("min_count, min_length and min_pieces must be at least 1")
    if top_input < 0 or max_selected < 0 or max_length < 0:
        raise ValueError("top_input, max_selected and max_length must not be negative")
    if max_length and max_length < min_length:
        raise ValueError("max_length must be 0 or at least min_length")


def reasons(counts: DataFrame, min_length=MIN_LENGTH, max_length=MAX_LENGTH, script: str | None = "greek") -> DataFrame:
    """counts with reason: why a word is filtered out, the first rule that fails; kept if none does."""
    reason = F.when(F.length("word") < min_length, "too_short")
    if max_length:
        reason = reason.when(F.length("word") > max_length, "too_long")
    if script:
        reason = reason.when(~T.has_script(F.col("word"), script), "other_script")
    return counts.withColumn("reason", reason.otherwise("kept"))


def filtered(counts: DataFrame, **options) -> DataFrame:
    return reasons(counts, **options).where("reason = 'kept'").drop("reason")


def reason_counts(counts: DataFrame, **options) -> DataFrame:
    return reasons(counts, **options).groupBy("reason").agg(F.count(F.lit(1)).alias("words"))


def collapsed(counts: DataFrame, exact: bool = True) -> DataFrame:
    """One row per case-folded group: its representative (a lower-case variant before others, then the most frequent,
    then the first), summed count, number of variants, and the variants by count. exact folds in Python."""
    key = T.casefold(F.col("word")) if exact else T.case_key(F.col("word"))
    rows = counts.withColumn("key", key)
    best = F.min(F.struct((F.col("word") != F.lower("word")).alias("upper"), (-F.col("count")).alias("less"), F.col("word")))
    variants = F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("less"), F.col("word"), F.col("count"))))
    found = rows.groupBy("key").agg(best.alias("best"), F.sum("count").alias("count"), F.count(F.lit(1)).alias("source_variant_count"), variants.alias("v"))
    return found.select(F.col("best.word").alias("word"), "count", "source_variant_count", F.transform("v", lambda v: F.struct(v["word"].alias("word"), v["count"].alias("count"))).alias("source_variants"))


def uncollapsed(counts: DataFrame) -> DataFrame:
    """Each word as a group of its own."""
    return counts.select("word", "count", F.lit(1).cast("long").alias("source_variant_count"), F.array(F.struct("word", "count")).alias("source_variants"))


def collapse_stats(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("source_variant_count") > 1).alias("groups_with_variants"), F.coalesce(F.sum(F.col("source_variant_count") - 1), F.lit(0)).cast("long").alias("merged_rows"))


def scored(counts: DataFrame, tokenizer) -> DataFrame:
    """counts with base_token_count of the bare word, base_fragmentation and utility_score."""
    if hasattr(tokenizer, "counted"):
        rows = tokenizer.counted(counts, "word", "base_token_count")
    else:
        rows = counts.withColumn("base_token_count", tokenizer.piece_count(F.col("word")))
    rows = rows.withColumn("base_fragmentation", F.greatest(F.col("base_token_count") - 1, F.lit(0)))
    return rows.withColumn("utility_score", F.col("count") * F.col("base_fragmentation").cast("long"))


def selected(counts: DataFrame, tokenizer, min_pieces=MIN_PIECES, max_selected=MAX_SELECTED) -> DataFrame:
    """Words of enough pieces, by utility, pieces, count and word, up to the cap (0: none); token has a leading space."""
    rows = scored(counts, tokenizer).where(F.col("base_token_count") >= min_pieces)
    rows = rows.withColumn("token", F.concat(F.lit(" "), F.col("word"))).orderBy(F.desc("utility_score"), F.desc("base_token_count"), F.desc("count"), "word")
    return rows.limit(max_selected) if max_selected else rows


def selection_stats(counts: DataFrame, tokenizer, min_pieces=MIN_PIECES, max_selected=MAX_SELECTED) -> DataFrame:
    rows = scored(counts, tokenizer).agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.col("base_token_count") < min_pieces).alias("below_threshold"))
    before = F.col("scored") - F.col("below_threshold")
    return rows.withColumn("before_cap", before).withColumn("after_cap", F.least(before, F.lit(max_selected).cast("long")) if max_selected else before)


def static_groups(entries: DataFrame) -> DataFrame:
    """Entries (raw, file) by their text without hyphens: entry_count, raw_entries, source_files."""
    word = F.replace("raw", F.lit("-"), F.lit(""))
    rows = entries.withColumn("word", word).where(T.nonblank(F.col("raw")) & (F.col("word") != ""))
    return rows.groupBy("word").agg(F.count(F.lit(1)).alias("entry_count"), F.sort_array(F.collect_set("raw")).alias("raw_entries"), F.sort_array(F.collect_set("file")).alias("source_files"))


def static_stats(groups: DataFrame) -> DataFrame:
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum(F.col("entry_count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def static_candidates(groups: DataFrame, tokenizer, taken: DataFrame) -> DataFrame:
    """Static groups whose text isn't a selected token, even if one piece covers them; by pieces, then text."""
    rows = groups.join(bounded(taken.select("token")), F.col("word") == F.col("token"), "left_anti")
    rows = rows.withColumn("count", F.lit(0).cast("long"))
    rows = scored(rows, tokenizer).withColumn("utility_score", F.lit(0).cast("long"))
    return rows.withColumn("token", F.col("word")).orderBy(F.desc("base_token_count"), "word")


def static_candidate_stats(groups: DataFrame, tokenizer, taken: DataFrame) -> DataFrame:
    """One row: groups, how many of them the base has as an exact single token, how many are among the selected tokens, and
    how many are left to add."""
    known = bounded(taken.select(F.col("token").alias("_taken")).distinct())
    rows = groups.join(known, F.col("word") == F.col("_taken"), "left")
    if hasattr(tokenizer, "covered"):
        rows = rows.withColumn("_exact", tokenizer.covered(F.col("word"))["exact"])
    else:
        rows = tokenizer.counted(rows, "word", "_pieces").withColumn("_exact", F.col("_pieces") == 1)
    there = F.col("_taken").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("input_groups"), F.count_if("_exact").alias("exact_single_token_in_base"), F.count_if(there).alias("already_selected"), F.count_if(~there).alias("missing"))


def final(corpus: DataFrame, static: DataFrame) -> DataFrame:
    """Corpus candidates, then static ones, each in its own order: section, place and the columns of the TSV."""
    by_use = [F.desc("utility_score"), F.desc("base_token_count"), F.desc("count"), "word"]
    head = ["word", "token", "count"]
    tail = ["source_variant_count", "base_token_count", "base_fragmentation", "utility_score"]
    a = corpus.select(F.lit(0).alias("section"), *head, F.lit("corpus").alias("source_type"), F.lit("").alias("static_source_files"), *tail)
    names = F.array_join("source_files", ",").alias("static_source_files")
    b = static.withColumn("source_variant_count", F.size("raw_entries").cast("long")).select(F.lit(1).alias("section"), *head, F.lit("static").alias("source_type"), names, *tail)
    return numbered(a.unionByName(b), "section", by_use, "place").withColumn("place", F.col("place").cast("int"))


def select(counts: DataFrame, tokenizer, entries: DataFrame | None = None, *, min_count=MIN_COUNT, top_input=TOP_INPUT, max_selected=MAX_SELECTED, min_pieces=MIN_PIECES, min_length=MIN_LENGTH, max_length=MAX_LENGTH, script="greek", collapse=True) -> DataFrame:
    """The whole selection, from counts to the final list."""
    validate(min_count, top_input, max_selected, min_pieces, min_length, max_length)
    rows = filtered(ranked(counts, min_count, top_input), min_length=min_length, max_length=max_length, script=script)
    # written: the list itself and the static entries that it leaves are made of the same selection
    chosen = io.stored(selected(collapsed(rows) if collapse else uncollapsed(rows), tokenizer, min_pieces, max_selected), "chosen")
    if entries is None:
        entries = counts.sparkSession.createDataFrame([], "raw string, file string")
    return final(chosen, static_candidates(static_groups(entries), tokenizer, chosen))


def examples(chosen: DataFrame, limit: int = 25, tokenizer=None) -> DataFrame:
    """The first candidates; with a subword tokenizer also base_decoded_pieces, what each piece of the word spells."""
    rows = chosen.orderBy("section", "place").limit(limit)
    return rows.withColumn("base_decoded_pieces", tokenizer.pieces(tokenizer.encode(F.col("word")))) if tokenizer else rows
