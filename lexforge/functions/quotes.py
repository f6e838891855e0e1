"""Quoted segments of a text, as one expression of the engine.

Three kinds of spans are sought apart from each other. A pattern's matches have no places in Spark's functions, but what stands between
them has a length: places are running sums of these. All spans are sorted by place, the longest first of those that begin
together, and one fold with the running end as its state takes each that begins where or after the last taken one ends.
Sums and folds go by blocks of the square root of their number, so that no array is copied once for each element. The expression is
built as SQL text, so that DataFrames and SQL functions (``functions.sql``) have the same one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WHITE, normalized

# Quotation marks, and what they are folded to; the three kinds of quoted spans. A letter or digit beside a
# single mark makes it an apostrophe.
FOLD = ("‘’‚‛′“”„«»ʼ", "'''''\"\"\"\"\"'")
KINDS = (r'"([^"\n]+)"', r"`([^`\n]+)`", r"(?<![\p{L}\p{N}_])'([^'\n]+)'(?![\p{L}\p{N}_])")


def fold(text: Column) -> Column:
    return F.translate(text, *FOLD)


def literal(text: str) -> str:
    """text as an SQL literal in which a backslash is a backslash."""
    return "r'" + text + "'" if "'" not in text else 'r"' + text + '"' if '"' not in text else "concat(" + ", ".join(literal(x) for x in text.replace("'", "\0'\0").split("\0") if x) + ")"


def let(name: str, value: str, body: str) -> str:
    """body with a name for a value that is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _sum(numbers: str) -> str:
    return f"aggregate({numbers}, 0L, (sum, one) -> sum + one)"


def _block(array: str) -> str:
    return f"greatest(cast(ceil(sqrt(size({array}))) as int), 1)"


def _firsts(array: str, block: str) -> str:
    """The first place of every block of an array."""
    return f"if(size({array}) > 0, sequence(0, size({array}) - 1, {block}), cast(array() as array<int>))"


def before(sizes: str) -> str:
    """The sum of the elements before each one of an array of numbers."""
    blocks = f"transform({_firsts('z', 'b')}, s -> {_sum('slice(z, s + 1, b)')})"
    whole = let("e", blocks, f"transform(e, (x, k) -> {_sum('slice(e, 1, k)')})")
    rest = _sum("slice(z, i - i % b + 1, i % b)")
    each = f"transform(z, (x, i) -> get(c, cast(floor(i / b) as int)) + {rest})"
    return let("z", sizes, let("b", _block("z"), let("c", whole, each)))


def stripped_sql(text: str) -> str:
    return f"regexp_replace({text}, {literal(f'^[{WHITE}]+|[{WHITE}]+$')}, '')"


def nonblank_sql(text: str) -> str:
    return f"coalesce({text} rlike {literal(f'[^{WHITE}]')}, false)"


def _spans(text: str, kind: str) -> str:
    """start, less (minus the end) and inner text of the nonblank spans of a kind."""
    at = "get(p, i) + length(get(between, i))"
    span = f"named_struct('start', {at}, 'less', -({at} + length(m) + 2), 'inner', m)"
    found = f"filter(transform(inner, (m, i) -> {span}), x -> {nonblank_sql('x.inner')})"
    sizes = "transform(inner, (m, i) -> cast(length(get(between, i)) + length(m) + 2 as bigint))"
    found = let("p", before(sizes), found)
    return let("between", f"split({text}, {literal(kind)}, -1)", let("inner", f"regexp_extract_all({text}, {literal(kind)}, 1)", found))


def segments_sql(text: str) -> str:
    """The segments of a text whose marks are folded, as SQL; null for null."""
    none = "cast(array() as array<string>)"
    # spans of one kind never overlap
    double = f"transform(filter(regexp_extract_all({text}, {literal(KINDS[0])}, 1), x -> {nonblank_sql('x')}), x -> {stripped_sql('x')})"
    take = f"if(x.start >= s.until, named_struct('until', -x.less, 'kept', array_append(s.kept, {stripped_sql('x.inner')})), s)"
    inner = f"aggregate(block, named_struct('until', t.until, 'kept', {none}), (s, x) -> {take})"
    step = let("r", inner, "named_struct('until', r.until, 'kept', array_append(t.kept, r.kept))")
    blocks = f"transform({_firsts('spans', 'n')}, f -> slice(spans, f + 1, n))"
    folded = f"aggregate({blocks}, named_struct('until', -1L, 'kept', cast(array() as array<array<string>>)), (t, block) -> {step}, t -> flatten(t.kept))"
    spans = f"array_sort(concat({', '.join(_spans(text, k) for k in KINDS)}))"
    any_ = let("spans", spans, let("n", _block("spans"), folded))
    return f"case when {text} is null then null when {text} rlike {literal("[`']")} then {any_} when contains({text}, '\"') then {double} else {none} end"


def _folded(df: DataFrame, text: str, form: str) -> tuple[DataFrame, Column]:
    """df with its text in a normal form and with folded marks, and the segments of that; null for null."""
    df = normalized(df, text, form).withColumn(text, fold(F.col(text)))
    return df, F.expr(segments_sql("`" + text.replace("`", "``") + "`"))


def with_segments(df: DataFrame, text: str, form: str = "NFKC", out: str = "segments") -> DataFrame:
    """df with the quoted segments of its text, from one scan; none for null."""
    df, segments = _folded(df, text, form)
    return df.withColumn(out, F.coalesce(segments, F.array().cast("array<string>")))


def segment_rows(df: DataFrame, text: str, form: str = "NFKC") -> DataFrame:
    """df's other columns, position and segment, a row for each. The segments are made in the explode itself: as a column before it,
    they would be made once more for the filter that Spark infers from an explode."""
    others = [c for c in df.columns if c != text]
    df, segments = _folded(df, text, form)
    return df.select(*others, F.posexplode(segments).alias("position", "segment"))
