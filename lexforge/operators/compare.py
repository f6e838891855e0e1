"""Comparison of segmentations by two or three tokenizers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

NAMES = ("base", "extended", "reference")


def samples(lines: DataFrame, limit: int | None = 20, text: str = "text", position: str = "position") -> DataFrame:
    """Stripped nonblank lines, each at its first position, up to the limit."""
    rows = lines.where(T.nonblank(F.col(text))).withColumn(text, T.stripped(F.col(text)))
    rows = rows.groupBy(text).agg(F.min(position).alias(position)).orderBy(position)
    return rows.limit(limit) if limit else rows


def parse_samples(df: DataFrame, text: str = "text") -> DataFrame:
    """(position, text) of the lines of a text."""
    return df.select(F.posexplode(T.lines(F.col(text))).alias("position", "text"))


def counted(rows: DataFrame, tokens: dict[str, Column], text: str = "text") -> DataFrame:
    """rows with <name>_tokens and <name>_chars_per_token for each tokenizer's token count."""
    for name, n in tokens.items():
        rows = rows.withColumn(f"{name}_tokens", n.cast("long"))
    for name in tokens:
        rows = rows.withColumn(f"{name}_chars_per_token", T.chars_per_token(F.col(text), F.col(f"{name}_tokens")))
    return rows


def analysed(rows: DataFrame, tokenizers: dict, text: str = "text", pieces: bool = True) -> DataFrame:
    """rows with <name>_tokens, <name>_chars_per_token and, if wanted, <name>_decoded_pieces of each subword tokenizer."""
    if not pieces:
        return counted(rows, {name: t.piece_count(F.col(text)) for name, t in tokenizers.items()}, text)
    for name, t in tokenizers.items():
        rows = rows.withColumn(f"_{name}", t.segmented(F.col(text)))
    out = counted(rows, {name: F.col(f"_{name}.token_count") for name in tokenizers}, text)
    for name in tokenizers:
        out = out.withColumn(f"{name}_decoded_pieces", F.col(f"_{name}.decoded_pieces")).drop(f"_{name}")
    return out


def _pairs(names) -> list[tuple[str, str]]:
    known = [n for n in NAMES if n in names]
    return [(a, b) for i, a in enumerate(known) for b in known[i + 1 :]]


def compared(rows: DataFrame, names=("base", "reference")) -> DataFrame:
    """Counted rows with the difference and the relative reduction in percent of each pair of tokenizers."""
    for a, b in _pairs(names):
        rows = rows.withColumn(f"{a}_minus_{b}", F.col(f"{a}_tokens") - F.col(f"{b}_tokens"))
        rows = rows.withColumn(f"{b}_reduction_vs_{a}", T.percentage(F.col(f"{a}_minus_{b}"), F.col(f"{a}_tokens")))
    return rows


def summary(rows: DataFrame, names=("base", "reference")) -> DataFrame:
    """One row over all counted samples: totals, means, and reductions of each pair."""
    sums = [F.coalesce(F.sum(f"{n}_tokens"), F.lit(0)).cast("long").alias(f"{n}_total") for n in names]
    out = rows.agg(F.count(F.lit(1)).alias("samples"), *sums)
    for n in names:
        out = out.withColumn(f"{n}_mean_tokens", F.when(F.col("samples") == 0, 0.0).otherwise(F.round(F.col(f"{n}_total").cast("double") / F.col("samples").cast("double"), 4)))
    for a, b in _pairs(names):
        out = out.withColumn(f"{a}_minus_{b}", F.col(f"{a}_total") - F.col(f"{b}_total"))
        out = out.withColumn(f"{b}_reduction_vs_{a}", T.percentage(F.col(f"{a}_minus_{b}"), F.col(f"{a}_total")))
    return out


#: What tokenizers are called in a summary.
LABELS = {"base": "Base", "extended": "Extended", "reference": "Reference"}


def _plain(number: Column) -> Column:
    """A rounded number as text, never with an exponent and with one digit after the point at least."""
    digits = F.regexp_replace(number.cast("decimal(38,4)").cast("string"), "0+$", "")
    return F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)


def rendered_summary(totals: DataFrame, names=("base", "reference"), labels: dict[str, str] = LABELS) -> DataFrame:
    """text: the one row of a summary as lines, for two or three tokenizers."""
    known = [n for n in NAMES if n in names]
    between = lambda a, b, word: f"{labels[a]} -> {labels[b]} {word}" if len(known) > 2 else {"delta": "Token delta", "reduction": "Relative reduction"}[word]
    lines = [("Samples", F.col("samples").cast("string"))]
    lines += [(f"{labels[n]} total tokens", F.col(f"{n}_total").cast("string")) for n in known]
    lines += [(between(a, b, "delta"), F.col(f"{a}_minus_{b}").cast("string")) for a, b in _pairs(names)]
    lines += [(f"Avg {labels[n]} tokens/sample", _plain(F.col(f"{n}_mean_tokens"))) for n in known]
    lines += [(between(a, b, "reduction"), F.concat(_plain(F.col(f"{b}_reduction_vs_{a}")), F.lit("%"))) for a, b in _pairs(names)]
    return totals.select(F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in lines]).alias("text"))


def rendered(rows: DataFrame, names=("base", "reference"), text: str = "text", order: str = "position") -> DataFrame:
    """A Markdown section for each compared sample: nth and markdown, with the pieces where rows have
    <name>_decoded_pieces."""
    place = F.row_number().over(Window.orderBy(order))
    parts = [F.format_string(f"- {n}: %d tokens, %.4f characters per token", F.col(f"{n}_tokens"), F.col(f"{n}_chars_per_token")) for n in names]
    parts += [F.format_string(f"- {b} against {a}: %d fewer, %.2f %%", F.col(f"{a}_minus_{b}"), F.col(f"{b}_reduction_vs_{a}")) for a, b in _pairs(names)]
    shown = [n for n in names if f"{n}_decoded_pieces" in rows.columns]
    parts += [F.concat_ws("\n", F.lit(f"**{n} tokenization**"), F.lit("```text"), F.concat_ws(" | ", f"{n}_decoded_pieces"), F.lit("```")) for n in shown]
    return rows.withColumn("nth", place).select("nth", F.concat_ws("\n", F.format_string("### Sample %d", "nth"), F.concat(F.lit("> "), F.col(text)), *parts).alias("markdown"))
