"""Training mixtures: seeded interleaving of sources, encoding to a fixed length, and the plan of a run."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..sources import files, io
from .ordering import numbered
from .tokenization import labels, truncate_pad, windows

# Defaults of a run.
WEIGHTS = (0.9, 0.1)
LENGTH, SMOKE_LENGTH = 2048, 1024
STEPS = {"warmup": (2000, 1e-4, 0), "full": (50_000, 2e-5, 1000)}
SMOKE_STEPS = {"warmup": (20, 1e-4, 0), "full": (40, 2e-5, 5)}
BATCH, SMOKE_BATCH = (16, 4), (1, 1)
INTERVALS = (10, 1000)


def effective_length(length: int = LENGTH, smoke: bool = False, smoke_length: int = SMOKE_LENGTH) -> int:
    return smoke_length if smoke else length


#: Draws whose numbers within a source are found together; all that a window over draws holds.
BLOCK = 1 << 16


def _edges(weights: dict[str, float]) -> list[tuple[str, int]]:
    """The upper end of each source's share of the 32-bit numbers. A share without a number would never be drawn."""
    total, edges, at = math.fsum(weights.values()), [], []
    for name, w in weights.items():
        at.append(w)
        edges.append((name, round(math.fsum(at) / total * (1 << 32))))
        if edges[-1][1] <= (edges[-2][1] if len(edges) > 1 else 0):
            raise ValueError(f"the weight of {name} is below one in 2**32 of all")
    return edges


def _draws(spark: SparkSession, edges: list[tuple[str, int]], begin: int, end: int, seed: int) -> DataFrame:
    """i, source, block of the draws from begin to before end. The first 32 bits of md5 of seed and i choose the source."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("i").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    source = F.when(u < edges[0][1], edges[0][0])
    for name, edge in edges[1:-1]:
        source = source.when(u < edge, name)
    rows = spark.range(begin, end).withColumnRenamed("id", "i").withColumn("source", source.otherwise(edges[-1][0]))
    return rows.withColumn("block", F.floor(F.col("i") / BLOCK).cast("long"))


def _bound(sizes: dict[str, int], weights: dict[str, float], stop: str) -> int:
    """Draws within which the end lies, but for one case in a milliard: six standard deviations beyond the mean number that takes
    all rows of the source that is used up first (or last, if all are to be)."""
    total = math.fsum(weights.values())
    each = []
    for name, n in sizes.items():
        p = weights[name] / total
        each.append(math.ceil(n / p + 6 * math.sqrt(n * (1 - p)) / p) + 20)
    return min(each) if stop == "first_exhausted" else max(each)


def _sums(draws: DataFrame) -> DataFrame:
    """block, source, n and before: how many draws of a block, and of all blocks before, take a source."""
    each = draws.groupBy("block", "source").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    return io.stored(each.withColumn("before", F.coalesce(before, F.lit(0))), "draws")


def _last(spark: SparkSession, sums: DataFrame, edges, sizes: dict[str, int], bound: int, seed: int) -> dict[str, int]:
    """The draw that takes the last row of each source whose rows are all drawn: its block by the sums, its place in that."""
    size = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n).cast("long"))])[F.col("source")]
    found = {}
    for r in sums.where((F.col("before") < size) & (size <= F.col("before") + F.col("n"))).collect():
        draws = _draws(spark, edges, r.block * BLOCK, min((r.block + 1) * BLOCK, bound), seed).where(F.col("source") == r.source)
        found[r.source] = draws.orderBy("i").limit(sizes[r.source] - r.before).agg(F.max("i")).first()[0]
    return found


def interleave(rows: DataFrame, weights: dict[str, float], *, source: str = "source", order: str = "doc_id", seed: int = 42, stop: str = "first_exhausted") -> DataFrame:
    """The rows of the sources in the order of the draws, as column i.

    first_exhausted ends with the first draw that takes the last row of a source; all_exhausted starts used-up sources
    again and ends when each was read once. Sources of weight 0 are skipped; a single source passes as it is.

    Draws are numbered within their source by blocks: sums over the blocks before, and a window within each block. The row
    that a draw takes is found by source and number; where (source, order) is a key, only these columns are numbered and
    joined, and all others come last.
    """
    if stop not in ("first_exhausted", "all_exhausted"):
        raise ValueError("stop must be first_exhausted or all_exhausted")
    if any(w < 0 for w in weights.values()) or not any(weights.values()):
        raise ValueError("weights must not be negative, and not all 0")
    spark = rows.sparkSession
    weights = {k: w for k, w in weights.items() if w > 0}
    edges = _edges(weights)
    rows = rows.where(F.col(source).isin(*weights))
    columns = rows.columns
    ids = rows.select(source, order)
    more = len(columns) > len(ids.columns)
    if more and not ids.groupBy(source, order).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        ids, more = rows, False
    placed = numbered(ids, source, [order])

    def whole(taken: DataFrame) -> DataFrame:
        if not more:
            return taken.select("i", *columns)
        keys = taken.select("i", F.col(source).alias("_source"), F.col(order).alias("_order"))
        return keys.join(rows, (F.col("_source") == F.col(source)) & F.col("_order").eqNullSafe(F.col(order))).select("i", *columns)

    if len(weights) == 1:
        return whole(placed.withColumn("i", F.col("k") - 1))
    sizes = {r[0]: r[1] for r in ids.groupBy(source).count().collect()}
    if len(sizes) < len(weights):
        return rows.select(F.lit(0).cast("long").alias("i"), *columns).limit(0)
    bound = _bound(sizes, weights, stop)
    while True:
        sums = _sums(_draws(spark, edges, 0, bound, seed))
        last = _last(spark, sums, edges, sizes, bound, seed)
        if stop == "first_exhausted" and last or len(last) == len(sizes):
            break
        bound *= 2
    end = min(last.values()) if stop == "first_exhausted" else max(last.values())
    before = sums.select(F.col("block").alias("_block"), F.col("source").alias("_of"), "before")
    draws = _draws(spark, edges, 0, end + 1, seed).join(before, (F.col("block") == F.col("_block")) & (F.col("source") == F.col("_of")))
    k = F.col("before") + F.row_number().over(Window.partitionBy("block", "source").orderBy("i"))
    size = F.create_map(*[x for s, n in sizes.items() for x in (F.lit(s), F.lit(n).cast("long"))])[F.col("source")]
    taken = draws.select("i", F.col("source").alias("_source"), ((k - 1) % size + 1).alias("_k"))
    return whole(taken.join(placed, (F.col("_source") == F.col(source)) & (F.col("_k") == F.col("k"))))


def encoded(rows: DataFrame, tokenizer, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, pad: int = 0) -> DataFrame:
    """key, input_ids, attention_mask, labels of the rows with text, at a fixed length; other columns are dropped, and so are the ids of a
    text beyond its first example, as by a tokenizer that truncates (``examples`` keeps all)."""
    kept = rows.where(T.nonblank(F.col(text))).select(key, tokenizer.encode(F.col(text), most=length).alias("_ids"))
    return padded(kept, key=key, length=length, pad=pad)


def examples(rows: DataFrame, tokenizer, *, text: str = "text", key: str = "doc_id", length: int = LENGTH, pad: int = 0) -> DataFrame:
    """key, part, input_ids, attention_mask, labels: whole texts as consecutive examples of a fixed length, part 0 the one of ``encoded``."""
    kept = rows.where(T.nonblank(F.col(text))).select(key, tokenizer.encode(F.col(text)).alias("_ids"))
    # outer: no filter is inferred, for which texts would be encoded once more
    parts = kept.select(key, F.posexplode_outer(windows(F.col("_ids"), length)).alias("part", "_ids"))
    return padded(parts, key=key, others=("part",), length=length, pad=pad)


def padded(rows: DataFrame, *, ids: str = "_ids", key: str = "doc_id", others: tuple[str, ...] = (), length: int = LENGTH, pad: int = 0) -> DataFrame:
    cut, mask = truncate_pad(F.col(ids), length, pad)
    out = rows.select(key, *others, cut.alias("input_ids"), mask.alias("attention_mask"))
    return out.withColumn("labels", labels(F.col("input_ids"), F.col("attention_mask")))


def accumulation(global_batch: int, per_device: int, world: int) -> int:
    """Steps of accumulation that give the global batch exactly."""
    if per_device < 1 or world < 1 or global_batch % (per_device * world):
        raise ValueError("the global batch is not a multiple of per-device batch times devices")
    return global_batch // (per_device * world)


def run_plan(spark: SparkSession, *, world: int = 4, smoke: bool = False, skip_warmup: bool = False, per_device: int | None = None, accumulate: int | None = None, steps=None, intervals=INTERVALS) -> DataFrame:
    """One row per phase: phase, max_steps, learning_rate, warmup_steps (at most max_steps), effective_batch, and the
    logging and saving intervals, between 1 and max_steps."""
    if world < 1 or min(intervals) < 1:
        raise ValueError("world and intervals must be at least 1")
    steps = dict(steps or (SMOKE_STEPS if smoke else STEPS))
    if skip_warmup:
        steps["warmup"] = (0, *steps["warmup"][1:])
    a, b = SMOKE_BATCH if smoke else BATCH
    batch = (per_device or a) * (accumulate or b) * world
    rows = [(phase, n, rate, min(warm, n), batch, *(max(1, min(x, n)) for x in intervals)) for phase, (n, rate, warm) in steps.items()]
    return spark.createDataFrame(rows, "phase string, max_steps long, learning_rate double, warmup_steps long, effective_batch long, logging_steps long, save_steps long")


def coverage(plan: DataFrame, rows: DataFrame, *, text: str = "text") -> DataFrame:
    """The plan over a corpus: examples (rows with text), steps_per_epoch (the last batch may be short), examples_seen in all steps
    of a phase, and epochs, how often it goes through the corpus; 0 for an empty one."""
    n = rows.where(T.nonblank(F.col(text))).agg(F.count(F.lit(1)).alias("examples"))
    seen = F.col("max_steps") * F.col("effective_batch")
    epochs = F.when(F.col("examples") == 0, 0.0).otherwise(F.round(seen.cast("double") / F.col("examples").cast("double"), 4))
    return plan.crossJoin(n).withColumn("steps_per_epoch", F.ceil(F.col("examples") / F.col("effective_batch"))).withColumn("examples_seen", seen).withColumn("epochs", epochs)


def run_config(spark: SparkSession, arguments: dict, *, vocabulary_size: int, world: int = 4, smoke: bool = False, **options) -> dict:
    """What a run was started with, as a report: arguments, devices, length, vocabulary size and the plan of phases."""
    phases = run_plan(spark, world=world, smoke=smoke, **options).collect()
    return {
        "arguments": dict(sorted(arguments.items())),
        "world_size": world,
        "smoke_test": smoke,
        "max_length": effective_length(smoke=smoke),
        "vocabulary_size": vocabulary_size,
        "effective_batch": phases[0]["effective_batch"] if phases else 0,
        "phases": {r["phase"]: {k: v for k, v in r.asDict().items() if k != "phase"} for r in phases},
    }


def latest_checkpoint(folder: str, overwrite: bool = False) -> str | None:
    """The checkpoint (a folder named checkpoint-<step>) of the most steps that a phase goes on from; none if the phase
    is to be overwritten or has no checkpoint."""
    import re

    place = files.Place(folder)
    if overwrite or not place.is_folder():
        return None
    found = [(int(m.group(1)), str(place.inside(name))) for name, _, inner in place.entries() if inner and (m := re.fullmatch(r"checkpoint-(\d+)", name))]
    return max(found)[1] if found else None


def resumed(plan: DataFrame, folders: dict[str, str], overwrite: bool = False) -> DataFrame:
    """The plan with checkpoint (of each phase's folder, null where it starts anew) and the steps that are left."""
    import re

    at = {phase: latest_checkpoint(folder, overwrite) for phase, folder in folders.items()}
    rows = [(phase, path, int(re.search(r"(\d+)$", path).group(1)) if path else 0) for phase, path in at.items()]
    known = plan.sparkSession.createDataFrame(rows, "phase string, checkpoint string, done long")
    out = plan.join(F.broadcast(known), "phase", "left").withColumn("done", F.coalesce("done", F.lit(0)))
    return out.withColumn("steps_left", F.greatest(F.col("max_steps") - F.col("done"), F.lit(0)))
