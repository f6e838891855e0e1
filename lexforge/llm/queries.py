"""The queries of this subpackage and, where SQL can express them, their DuckDB form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, chat_repair, decontaminate, mix, ngram_jaccard, oracle, oracle_chat, prefix_trie, quality, repeats, sharding, token_counts, token_store, toxicity, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_source_mix(spark, sf_dir):
    return mix.report(_read(spark, sf_dir, "documents"))


def op2_url_filter(spark, sf_dir):
    pages = _read(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("day", url_filter.fetch_day(F.col("url")))
    found = url_filter.judged(captures, url_filter.drawn_entries(pages))
    return found.select("row.page_id", "host", F.col("row.day").alias("fetched_on"), "filtered", "n_entries", "first_list", "since")


def op3_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard.report(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op4_token_counts(spark, sf_dir):
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op5_token_store(spark, sf_dir):
    path = token_store.write(_read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return token_store.digest(spark, path)


def op6_toxicity(spark, sf_dir):
    found = toxicity.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


#: Bytes of a shard: small enough that the smallest test tables have several, of several depths.
SHARD = 1 << 17


def op7_sharding(spark, sf_dir):
    return sharding.report(_read(spark, sf_dir, "documents"), limit=SHARD)


def op8_quality_rules(spark, sf_dir):
    found = quality.report(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_repeated_substrings(spark, sf_dir):
    found = repeats.repeats(_read(spark, sf_dir, "documents"))
    return found.select(F.col("row").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_decontamination(spark, sf_dir):
    found = decontaminate.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_chat_format(spark, sf_dir):
    return chat_format.digest(chat_format.formatted(chat_format.with_probe(_read(spark, sf_dir, "conversations"))))


def op12_chat_repair(spark, sf_dir):
    return chat_repair.repairs(chat_repair.damaged(_read(spark, sf_dir, "conversations")), present=F.col("present"))


def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.nodes(prefix_trie.rebuilt(prefix_trie.turns(_read(spark, sf_dir, "conversations"))))


def queries() -> dict:
    return {f.__name__: f for f in (op1_source_mix, op2_url_filter, op3_ngram_jaccard, op4_token_counts, op5_token_store, op6_toxicity, op7_sharding, op8_quality_rules, op9_repeated_substrings, op10_decontamination, op11_chat_format, op12_chat_repair, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_source_mix": f"WITH {oracle.SIZED}{mix.SQL}SELECT doc_id, size, source_size, target, CASE WHEN size = 0 THEN 0 ELSE (times + CAST(extra AS BIGINT)) * size END AS taken FROM x{mix.FILLS}",
        "op2_url_filter": url_filter.SQL,
        "op3_ngram_jaccard": oracle.JACCARD,
        "op8_quality_rules": oracle.QUALITY,
        "op9_repeated_substrings": oracle.REPEATS,
        "op10_decontamination": oracle.DECONTAMINATION,
        "op11_chat_format": oracle_chat.formatting(),
        "op12_chat_repair": oracle_chat.repair(),
        "op13_prefix_trie": oracle_chat.TRIE,
        "op7_sharding": f"""WITH docs AS (SELECT doc_id, text FROM documents), {sharding.sql(SHARD)}
SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, x.d) AS shard, CAST(x.d AS INTEGER) AS depth, x.s AS shard_bytes, x.s > {SHARD} AS over_limit FROM f""",
    }
