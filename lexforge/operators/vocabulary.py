"""Vocabulary algebra: partition of new tokens, extension, differences, readable export, embedding initialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .ordering import spread_join
from .tokenization import bounded

EXACT = "already_present_as_exact_single_token"
SHADOW = "would_shadow_existing_leading_space_single_token"


def first_seen(lines: DataFrame, token: str = "token", position: str = "position") -> DataFrame:
    """Distinct nonblank tokens at their first position."""
    rows = lines.where(T.nonblank(F.col(token)))
    return rows.groupBy(token).agg(F.min(position).alias(position))


def input_stats(lines: DataFrame, token: str = "token") -> DataFrame:
    rows = lines.where(T.nonblank(F.col(token)))
    return rows.agg(F.count(F.lit(1)).alias("input_tokens"), F.count_distinct(token).alias("unique_tokens")).withColumn("duplicate_tokens", F.col("input_tokens") - F.col("unique_tokens"))


def partition(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """tokens with action (add or skip), reason, conflicting_token and conflicting_token_id. Only the base vocabulary
    counts: a token that it covers is skipped, and so is one whose form with a leading space it covers."""
    base = bounded(vocabulary.groupBy("decoded").agg(F.min("id").alias("id")))
    own = base.select(F.col("decoded").alias("_own"), F.col("id").alias("_own_id"))
    spaced = base.select(F.col("decoded").alias("_spaced"), F.col("id").alias("_spaced_id"))
    rows = tokens.join(own, F.col(token) == F.col("_own"), "left")
    rows = rows.join(spaced, (F.concat(F.lit(" "), F.col(token)) == F.col("_spaced")) & ~F.col(token).startswith(" "), "left")
    exact, shadow = F.col("_own").isNotNull(), F.col("_spaced").isNotNull()
    pick = lambda a, b: F.when(exact, a).when(shadow, b)
    rows = rows.withColumn("action", F.when(exact | shadow, "skip").otherwise("add")).withColumn("reason", pick(F.lit(EXACT), F.lit(SHADOW)))
    rows = rows.withColumn("conflicting_token", pick(F.col("_own"), F.col("_spaced"))).withColumn("conflicting_token_id", pick(F.col("_own_id"), F.col("_spaced_id")))
    return rows.drop("_own", "_own_id", "_spaced", "_spaced_id")


def partition_by(tokens: DataFrame, tokenizer, token: str = "token") -> DataFrame:
    """The same by a subword tokenizer itself: a token is covered if it is encoded as one id that spells it, which an entry
    that no merge leads to doesn't do. source_ids: its pieces in the base, for the tokens to add."""
    spaced = F.when(~F.col(token).rlike(f"^[{T.WHITE}]") & (F.col(token) != ""), F.concat(F.lit(" "), F.col(token)))
    rows = tokens.withColumn("_own", tokenizer.covered(F.col(token))).withColumn("_text", spaced).withColumn("_spaced", tokenizer.covered(spaced))
    exact, shadow = F.col("_own.exact"), F.col("_text").isNotNull() & F.col("_spaced.exact")
    first = lambda c: F.get(c, F.lit(0))
    rows = rows.withColumn("action", F.when(exact | shadow, "skip").otherwise("add")).withColumn("reason", F.when(exact, EXACT).when(shadow, SHADOW))
    rows = rows.withColumn("conflicting_token", F.when(exact, F.col(token)).when(shadow, F.col("_text")))
    rows = rows.withColumn("conflicting_token_id", F.when(exact, first("_own.token_ids")).when(shadow, first("_spaced.token_ids")))
    return rows.withColumn("source_ids", F.when(F.col("action") == "add", F.col("_own.token_ids"))).drop("_own", "_text", "_spaced")


def initialisation_samples(parts: DataFrame, tokenizer, limit: int = 50, token: str = "token", position: str = "position") -> DataFrame:
    """The first tokens to add, with the number, the ids and the spelling of their pieces in the base."""
    rows = parts.where("action = 'add'").orderBy(position).limit(limit)
    return rows.select(token, F.size("source_ids").alias("source_token_count"), F.col("source_ids").alias("source_token_ids"), tokenizer.pieces(F.col("source_ids")).alias("source_decoded_pieces"))


def extended(parts: DataFrame, vocabulary: DataFrame, token: str = "token", position: str = "position") -> DataFrame:
    """The added tokens with ids that go on after the base, in order of position. New tokens are few: one window."""
    last = vocabulary.agg(F.coalesce(F.max("id"), F.lit(-1)).alias("last"))
    added = parts.where("action = 'add'").withColumn("nth", F.row_number().over(Window.orderBy(position)))
    return added.crossJoin(F.broadcast(last)).withColumn("id", (F.col("last") + F.col("nth")).cast("int")).drop("last", "nth")


def extension_stats(parts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    size = vocabulary.agg(F.count(F.lit(1)).alias("initial_size"))
    done = parts.agg(F.count_if(F.col("action") == "add").alias("added"), F.count_if(F.col("reason") == EXACT).alias("skipped_exact"), F.count_if(F.col("reason") == SHADOW).alias("skipped_shadow"))
    return size.crossJoin(done).withColumn("final_size", F.col("initial_size") + F.col("added"))


def mutual_shadows(parts: DataFrame, token: str = "token") -> DataFrame:
    """Added tokens that are also added with a leading space: both stay, and are worth a report."""
    added = parts.where("action = 'add'").select(F.col(token).alias("token"))
    spaced = added.select(F.expr("substring(token, 2)").alias("bare"), F.col("token").alias("spaced")).where(F.col("spaced").startswith(" "))
    return added.join(spaced, F.col("token") == F.col("bare")).select("token", "spaced")


def initialisation_sources(parts: DataFrame, tokenizer, token: str = "token") -> DataFrame:
    """The base pieces of each added token, before it is added."""
    return parts.where("action = 'add'").withColumn("source_ids", tokenizer.encode(F.col(token)))


def source_histogram(rows: DataFrame, ids: str = "source_ids") -> DataFrame:
    return rows.groupBy(F.size(ids).cast("long").alias("pieces")).agg(F.count(F.lit(1)).alias("tokens"))


#: Tokens that one copy of a matrix row is joined with: a piece of more tokens than that is dealt out to several copies.
SHARE = 2048


def _partial_sums(batches):
    """_key, _sum, _n: the matrix rows of a batch, as often as they count, added up for each token."""
    import numpy as np
    import pyarrow as pa

    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column("_key").dictionary_encode()
        code = np.nan_to_num(keys.indices.to_numpy(zero_copy_only=False), nan=len(keys.dictionary)).astype(np.int64)
        vectors = b.column("_vec").combine_chunks() if isinstance(b.column("_vec"), pa.ChunkedArray) else b.column("_vec")
        lengths = np.diff(vectors.offsets.to_numpy())
        if (lengths != lengths[0]).any():
            raise ValueError("rows of the matrix have different lengths")
        times = b.column("_times").to_numpy(zero_copy_only=False)
        rows = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(code), -1) * times[:, None]
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        sums, n = np.add.reduceat(rows[order], first), np.add.reduceat(times[order], first)
        offsets = np.arange(len(first) + 1, dtype=np.int32) * sums.shape[1]
        yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(order[first])), pa.ListArray.from_arrays(offsets, sums.ravel()), pa.array(n)], names=["_key", "_sum", "_n"])


def mean_rows(sources: DataFrame, matrix: DataFrame, key: str, ids: str = "source_ids", row_id: str = "id", vector: str = "vec", share: int = SHARE) -> DataFrame:
    """key and the element-wise mean (in double precision) of the matrix rows of its ids, repeated ids counted.

    A piece that is in most tokens, as a space is, would be one join key of all of them. Pieces of more than ``share`` tokens are
    dealt out by a hash of the token, and their matrix row is copied as often. What a task has joined it adds up by token
    before the sums are shuffled.
    """
    one = F.transform(F.array_distinct(ids), lambda x: F.struct(x.alias("_row"), F.size(F.filter(ids, lambda y: y == x)).cast("long").alias("_times")))
    pairs = sources.select(F.col(key).alias("_key"), F.explode(one).alias("x")).select("_key", "x._row", "x._times")
    rows = matrix.select(F.col(row_id).alias("_id"), F.col(vector).alias("_vec"))
    each = spread_join(pairs, rows, "_row", "_id", F.col("_key"), share).select("_key", "_times", "_vec")
    kind = dict(pairs.dtypes)["_key"]
    sums = each.mapInArrow(_partial_sums, f"_key {kind}, _sum array<double>, _n long")
    # at most one sum for each piece of a token
    found = sums.groupBy("_key").agg(F.collect_list("_sum").alias("_sums"), F.sum("_n").alias("_n"))
    total = F.aggregate(F.slice("_sums", 2, F.size("_sums")), F.get("_sums", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return found.select(F.col("_key").alias(key), F.transform(total, lambda x: x / F.col("_n")).alias("mean"))


def initialised(sources: DataFrame, inputs: DataFrame, outputs: DataFrame | None = None, *, tied: bool = False, key: str = "id", **columns) -> tuple[DataFrame, DataFrame | None, dict]:
    """New rows of the input matrix and of the output matrix (the same if they are tied, none if there is none), and how
    many tokens were initialised in each; tokens without pieces are in neither."""
    given = sources.where(F.size(columns.get("ids", "source_ids")) > 0)
    new = mean_rows(given, inputs, key, **columns)
    out = new if tied else mean_rows(given, outputs, key, **columns) if outputs is not None else None
    n = given.count()
    return new, out, {"initialized_input_embeddings": n, "initialized_output_embeddings": 0 if out is None else n, "output_embeddings_share_storage": tied}


def diff(base: DataFrame, reference: DataFrame, token: str = "token", *, script: str | None = None, decoded: str = "decoded") -> DataFrame:
    """One row: whole sizes, sizes in a script (of the decoded form; whole ones without one), common and exclusive tokens,
    and overlap in percent of each side."""
    full = [df.agg(F.count_distinct(token).alias(f"full_{n}_size")) for n, df in (("base", base), ("reference", reference))]
    if script:
        base, reference = in_script(base, script, decoded), in_script(reference, script, decoded)
    a = base.select(token).distinct().withColumn("_a", F.lit(1))
    b = reference.select(token).distinct().withColumn("_b", F.lit(1))
    rows = full[0].crossJoin(full[1]).crossJoin(_overlap(a, b, token))  # one row each
    return rows.withColumn("common_percent_of_base", T.percentage(F.col("common"), F.col("base_size"))).withColumn("common_percent_of_reference", T.percentage(F.col("common"), F.col("reference_size")))


def diff_examples(base: DataFrame, reference: DataFrame, limit: int = 100) -> DataFrame:
    """kind (common, only_base, only_reference), id, raw, decoded: the first tokens of each kind, common ones as the base
    has them. Both sides: token, id, decoded."""
    parts = {"common": common(base, reference), "only_base": only(base, reference), "only_reference": only(reference, base)}
    each = [examples(rows, limit).select(F.lit(kind).alias("kind"), "id", F.col("token").alias("raw"), "decoded") for kind, rows in parts.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


def _overlap(a: DataFrame, b: DataFrame, token: str) -> DataFrame:
    return a.join(b, token, "full").agg(
        F.count("_a").alias("base_size"), F.count("_b").alias("reference_size"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"),
        F.count_if(F.col("_b").isNull()).alias("only_base"), F.count_if(F.col("_a").isNull()).alias("only_reference"),
    )


def common(base: DataFrame, reference: DataFrame, token: str = "token") -> DataFrame:
    return base.join(reference.select(token).distinct(), token, "left_semi")


def only(base: DataFrame, reference: DataFrame, token: str = "token") -> DataFrame:
    return base.join(reference.select(token).distinct(), token, "left_anti")


def examples(rows: DataFrame, limit: int = 100, token: str = "token") -> DataFrame:
    return rows.orderBy(token).limit(limit)


def in_script(vocabulary: DataFrame, script: str = "greek", decoded: str = "decoded") -> DataFrame:
    return vocabulary.where(T.has_script(F.col(decoded), script))


def readable(vocabulary: DataFrame) -> DataFrame:
    """vocabulary with collisions (entries of the same decoded form), shown (the decoded form if no other entry has it,
    else the raw token) and clash (the raw form is what another entry shows)."""
    same = Window.partitionBy("decoded")
    rows = vocabulary.withColumn("collisions", F.count(F.lit(1)).over(same))
    rows = rows.withColumn("shown", F.when(F.col("collisions") == 1, F.col("decoded")).otherwise(F.col("token")))
    return rows.withColumn("clash", F.count(F.lit(1)).over(Window.partitionBy("shown")) > 1)


def relabelled(merges: DataFrame, shown: DataFrame) -> DataFrame:
    """merges (rank, left, right) with their pieces in readable form; unknown pieces stay."""
    names = bounded(shown.select("token", "shown"))
    a, b = names.toDF("_l", "_left"), names.toDF("_r", "_right")
    rows = merges.join(a, F.col("left") == F.col("_l"), "left").join(b, F.col("right") == F.col("_r"), "left")
    return rows.select("rank", F.coalesce("_left", "left").alias("left"), F.coalesce("_right", "right").alias("right"))


def aligned(vocabulary: DataFrame, matrix: DataFrame) -> None:
    """Raises if the matrix has not a row for each token."""
    tokens, rows = vocabulary.count(), matrix.count()
    if tokens > rows:
        raise ValueError(f"the vocabulary has {tokens} tokens, the matrix {rows} rows")


def by_id(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.orderBy("id")


def readable_document(spark, tokenizer) -> tuple[str, dict]:
    """A tokenizer's document with its tokens, merges and added tokens in readable form, and a report: tokens, entries
    that share their decoded form with another (they stay raw), and clashes of raw forms with what others show."""
    import json

    document = json.loads(tokenizer.document)
    known = set(document["model"]["vocab"])
    names = spark.createDataFrame([(t,) for t in sorted(known)], "token string")
    table = readable(tokenizer.vocabulary(spark).join(names, "token", "left_semi"))
    rows = by_id(table).collect()  # as many as the document has tokens
    shown = {r.token: r.shown for r in rows}
    single = {r.decoded for r in rows if r.collisions == 1}
    document["model"]["vocab"] = {r.shown: r.id for r in rows}
    pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in document["model"].get("merges", [])]
    document["model"]["merges"] = [[shown.get(a, a), shown.get(b, b)] for a, b in pairs]
    model = tokenizer.model()
    for added in document.get("added_tokens", []):
        decoded = model.decode([added["id"]], skip_special_tokens=False)
        if decoded in single:
            added["content"] = decoded
    stats = {"tokens": len(rows), "kept_raw": sum(r.collisions > 1 for r in rows), "clashes": sum(r.clash for r in rows)}
    return json.dumps(document, ensure_ascii=False, indent=2), stats
