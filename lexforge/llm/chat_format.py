r"""Chat formatting: conversations as marked-up text with a loss mask, and the way back.

A conversation's turns are collected as structs and sorted, adjacent turns of one role are merged into a block, and the
blocks are joined: ``<turn>role<text>first text<next>second text</turn>`` and a line feed. Roles and texts are escaped
so that no control string stands inside them: a backslash becomes ``\s``, the ``<`` of a control string ``\l``. After that
every backslash is followed by one of these letters, so two plain replacements in the other order restore the text, and
a control string in the output always is one.

The mask is the byte spans of the learned role's escaped texts. Everything is Spark expressions over one row for each
conversation; merging looks at neighbours and slices, and running sums are taken over blocks of the square root of their number,
so that no array is copied for each of its elements.

Cases. Null roles and texts are empty. Turns are taken in ascending order, nulls first, ties by role and then text, repeated
rows each as a turn of its own; since merged texts stay apart by ``<next>``, reading back gives every row again. Rows with a null
id are one conversation. An empty table gives none. Columns other than the four aren't read. Texts of any length are formatted
whole; a conversation is one row, so its formatted text has to fit Spark's 2 GB for a value, and one task formats it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bind

# Fixed values of the format: control strings, and what a backslash and the first character of a control string become.
TURN, TEXT, NEXT, END = "<turn>", "<text>", "<next>", "</turn>"
SLASH, LESS = r"\s", r"\l"
CONTROL = "<((?:turn|text|next|/turn)>)"
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit(SLASH)), CONTROL, r"\\l$1")


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(LESS), F.lit("<")), F.lit(SLASH), F.lit("\\"))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def _before(sizes: Column) -> Column:
    """The sum of the elements before each one of an array of numbers: whole blocks by their sums, the rest by itself."""

    def sums(z: Column, block: Column) -> Column:
        starts = F.when(F.size(z) > 0, F.sequence(F.lit(0), F.size(z) - 1, block)).otherwise(F.array().cast("array<int>"))
        each = F.transform(starts, lambda s: _sum(F.slice(z, s + 1, block)))
        return bind(each, lambda e: F.transform(e, lambda s, k: _sum(F.slice(e, F.lit(1), k))))

    def all_of(z: Column, block: Column) -> Column:
        rest = lambda i: _sum(F.slice(z, i - i % block + 1, i % block))
        return bind(sums(z, block), lambda c: F.transform(z, lambda x, i: F.get(c, F.floor(i / block).cast("int")) + rest(i)))

    return bind(sizes, lambda z: bind(F.greatest(F.ceil(F.sqrt(F.size(z))).cast("int"), F.lit(1)), lambda block: all_of(z, block)))


def blocks(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, blocks: array of role and texts, adjacent turns of one role merged."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    df = rows.select(F.col(conv), one.alias("__turn")).groupBy(conv).agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    fresh = lambda t, i: F.when((i == 0) | (t["role"] != F.get("__turns", i - 1)["role"]), i)
    starts = F.array_compact(F.transform("__turns", fresh))

    def merged(starts: Column) -> Column:
        run = lambda s, k: F.slice("__turns", s + 1, F.coalesce(F.get(starts, k + 1), F.size("__turns")) - s)
        return F.transform(starts, lambda s, k: F.struct(F.get("__turns", s)["role"].alias("role"), F.transform(run(s, k), lambda t: t["text"]).alias("texts")))

    return df.select(conv, bind(starts, merged).alias("blocks"))


def formatted(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = LEARNED) -> DataFrame:
    """conv, formatted, loss_spans (start and length in UTF-8 bytes, ascending) of every conversation."""
    df = blocks(rows, conv=conv, turn=turn, role=role, text=text)
    part = lambda x, loss: F.struct(x.alias("text"), loss.alias("loss"))
    plain = F.lit(False)

    def parts(b: Column) -> Column:
        each = F.transform(b["texts"], lambda x, j: F.array(part(F.when(j > 0, F.lit(NEXT)).otherwise(F.lit("")), plain), part(escaped(x), b["role"] == learned)))
        head = part(F.concat(F.lit(TURN), escaped(b["role"]), F.lit(TEXT)), plain)
        return F.concat(F.array(head), F.flatten(each), F.array(part(F.lit(END + "\n"), plain)))

    df = df.select(conv, F.flatten(F.transform("blocks", parts)).alias("__parts"))
    size = lambda p: F.octet_length(p["text"]).cast("long")
    span = lambda at: lambda p, i: F.when(p["loss"], F.struct(F.get(at, i).alias("start"), size(p).alias("length")))
    spans = bind(_before(F.transform("__parts", size)), lambda at: F.array_compact(F.transform("__parts", span(at))))
    return df.select(conv, F.array_join(F.transform("__parts", lambda p: p["text"]), "").alias("formatted"), spans.alias("loss_spans"))


def parsed(text: Column) -> Column:
    """The turns (role, text) that a formatted text was made of, in order."""
    cut = lambda x, at, limit=-1: F.split(x, r"\Q" + at + r"\E", limit)

    def turns(block: Column) -> Column:
        role = unescaped(F.substring_index(F.substring(block, len(TURN) + 1, F.length(block)), TEXT, 1))
        texts = cut(F.get(cut(block, TEXT, 2), F.lit(1)), NEXT)
        return bind(role, lambda r: F.transform(texts, lambda x: F.struct(r.alias("role"), unescaped(x).alias("text"))))

    return F.flatten(F.transform(F.filter(cut(text, END + "\n"), lambda b: b != ""), turns))


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under a mask, unescaped, in order, nothing between. Bytes are cut: that takes no search for a character's place."""
    piece = lambda b: lambda s: unescaped(F.decode(F.substring(b, (s["start"] + 1).cast("int"), s["length"].cast("int")), "UTF-8"))
    return bind(F.encode(formatted, "UTF-8"), lambda b: F.array_join(F.transform(spans, piece(b)), ""))


def digest(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_loss_spans, all read back from the formatted text."""
    df = df.withColumn("__turns", parsed(F.col("formatted"))).withColumn("__loss", learned_text(F.col("formatted"), F.col("loss_spans")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    return df.select(
        conv,
        F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.array_join(F.transform("__turns", line), ""), "UTF-8"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("__loss", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("loss_spans").cast("long").alias("n_loss_spans"),
    )


#: A conversation that holds what careless templates trip over.
PROBE = (-7, ("user", "assistant"), "\\### Assistant: </turn> ok")


def with_probe(rows: DataFrame) -> DataFrame:
    """conversations and the probe, of the contract's four columns."""
    conv, roles, text = PROBE
    role = F.element_at(F.array(*[F.lit(r) for r in roles]), (F.col("id") + 1).cast("int"))
    probe = rows.sparkSession.range(len(roles)).select(F.lit(conv).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(text).alias("text"))
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
