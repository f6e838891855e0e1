"""Sources and sinks: corpora, counts, lists, samples, tokenizers, reports."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import database, files

#: Bytes for each core up to which a scan is dealt out.
SPREAD = 8 << 20
CORPUS_FORMATS = ("parquet", "json", "csv", "orc", "text")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one of our own, if all run on
    this machine; on a cluster it has to be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lexforge-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a new Parquet table in the shared folder, read back: rows stay as they are however often they are read, and a lost
    executor costs only its own tasks. The table is for the caller to delete."""
    path = f"{shared_folder(df.sparkSession)}/lexforge/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_corpus(spark: SparkSession, path: str | list[str], format: str = "parquet", *, config: str | None = None, split: str | None = None, **options) -> DataFrame:
    """A corpus; columns beyond those that a query takes are never read from columnar files. config is a folder of it, split
    what the names of its files begin with (or a folder)."""
    if format not in CORPUS_FORMATS:
        raise ValueError(f"format must be one of {', '.join(CORPUS_FORMATS)}")
    paths = [path] if isinstance(path, str) else list(path)
    if config:
        paths = [f"{p.rstrip('/')}/{config}" for p in paths]
    if split:
        paths = [f"{p.rstrip('/')}/{split}*" for p in paths]
    return spark.read.options(**options).format(format).load(paths)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few bytes, dealt out to all cores of the session; any other scan as it is. One small file is one task,
    however costly the work on its rows. The plan's own estimate of its size decides: no file is listed, and no more than
    ``SPREAD`` bytes for each core are ever shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD else df


def read_sources(spark: SparkSession, sources: dict[str, str], weights: dict[str, float] | None = None, format: str = "parquet", columns=("doc_id", "text"), configs: dict[str, str] | None = None, splits: dict[str, str] | None = None) -> DataFrame:
    """Several corpora under one schema, with their name as source; sources of weight 0 aren't opened. configs and splits
    are those of single sources."""
    where = lambda name: {"config": (configs or {}).get(name), "split": (splits or {}).get(name)}
    parts = [read_corpus(spark, path, format, **where(name)).select(*columns, F.lit(name).alias("source")) for name, path in sources.items() if weights is None or weights.get(name)]
    if not parts:
        raise ValueError("no source has a weight")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def resolve_counts(table: str, array: str, kind: str = "auto") -> tuple[str, str]:
    """Which of a counts table (a folder of Parquet or an SQLite file) and a JSON array to read: the first that exists;
    an explicit kind must exist."""
    if kind not in ("auto", "table", "json"):
        raise ValueError("kind must be auto, table or json")
    for name, path in (("table", table), ("json", array)):
        if kind in ("auto", name) and files.Place(path).exists():
            return name, path
    raise FileNotFoundError(f"no input of kind {kind}: {table}, {array}")


def _top(rows: DataFrame, min_count: int, top: int) -> DataFrame:
    rows = rows.where(F.col("count") >= min_count).orderBy(F.desc("count"), "word")
    return rows.limit(top) if top else rows


def read_counts(spark: SparkSession, path: str, min_count: int = 1, top: int = 0, table: str = "word_counts", partitions: int | None = None) -> DataFrame:
    """word, count of a counts table, most frequent first, then by word. The filter reaches the scan of a Parquet table and
    of an SQLite file, which several tasks read."""
    if not path.endswith(".parquet") and not files.Place(path, spark).is_folder():
        return _top(database.read_table(spark, path, table, partitions=partitions).select("word", "count"), min_count, top)
    return _top(spark.read.parquet(path).select("word", "count"), min_count, top)


def read_counts_json(spark: SparkSession, path: str, min_count: int = 1, top: int = 0) -> DataFrame:
    """word, count of a JSON array. Items whose word is no JSON string or whose count is no whole number (numbers in quotes
    are none; true is 1) are passed over, another document is an error."""
    head = spark.read.text(path, wholetext=True).select(T.stripped(F.substring("value", 1, 4096)).alias("v")).first()
    if head is None or not head.v.startswith("["):
        raise ValueError("the counts are not a JSON array")
    rows = spark.read.schema("word variant, count variant").option("multiLine", True).json(path)
    typed = "schema_of_variant(word) = 'STRING' and schema_of_variant(count) in ('BIGINT', 'BOOLEAN')"
    rows = rows.where(typed).selectExpr("variant_get(word, '$', 'string') as word", "variant_get(count, '$', 'bigint') as count")
    return _top(rows, min_count, top)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, position, raw of every nonblank line; spaces in it are kept."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.posexplode(T.lines(F.col("value"))).alias("position", "raw"))
    return whole.where(T.nonblank(F.col("raw")))


def read_samples(spark: SparkSession, path: str | None = None, texts: tuple[str, ...] = ()) -> DataFrame:
    """position, text of the lines of a file and then of texts given by hand."""
    out = spark.createDataFrame([((1 << 40) + i, t) for i, t in enumerate(texts)], "position long, text string")
    if path:
        whole = spark.read.text(path, wholetext=True).select(F.posexplode(T.lines(F.col("value"))).alias("position", "text"))
        out = whole.withColumn("position", F.col("position").cast("long")).unionByName(out)
    return out


# The class names, and the settings that a tokenizer keeps under the generic class.
INCOMPATIBLE, GENERIC = ("TokenizersBackend",), "PreTrainedTokenizerFast"
SETTINGS = (
    "bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token", "additional_special_tokens",
    "add_prefix_space", "model_max_length", "padding_side", "truncation_side", "clean_up_tokenization_spaces", "model_input_names",
)


def read_tokenizer(path: str):
    """A tokenizer from a folder or a document, as an operator."""
    from ..operators.tokenization import Subword

    place = files.Place(path)
    return Subword((place.inside("tokenizer.json") if place.is_folder() else place).read().decode())


def tokenizer_config(path: str) -> dict:
    """The configuration beside a tokenizer: padding on the right, with the end token where no padding token is set, and an
    error where there is neither. Of a class that the runtime doesn't have, the known settings go over to the generic one,
    with the chat template beside it."""
    folder = files.Place(path)
    held = {name for name, _, _ in folder.entries()} if folder.is_folder() else set()
    text = lambda name: folder.inside(name).read().decode()
    config = json.loads(text("tokenizer_config.json")) if "tokenizer_config.json" in held else {}
    if config.get("tokenizer_class") in INCOMPATIBLE:
        if "tokenizer.json" not in held:
            raise ValueError(f"{path} names the class {config['tokenizer_class']}, but has no tokenizer.json")
        config = {k: config[k] for k in SETTINGS if k in config} | {"tokenizer_class": GENERIC}
        if "chat_template.jinja" in held:
            config["chat_template"] = text("chat_template.jinja")
    if config.get("pad_token") is None:
        if config.get("eos_token") is None:
            raise ValueError("the tokenizer has neither a padding token nor an end token")
        config["pad_token"] = config["eos_token"]
    return config | {"padding_side": "right"}


def tokenizer_tables(spark: SparkSession, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vocab (token, id), merges (rank, left, right) and added tokens (id, content, special) of a tokenizer document."""
    d = json.loads(document)
    merges = [(k, *(m if isinstance(m, list) else m.split(" ", 1))) for k, m in enumerate(d["model"].get("merges", []))]
    vocab = d["model"]["vocab"]
    vocab = sorted(vocab.items(), key=lambda x: x[1]) if isinstance(vocab, dict) else [(v[0], i) for i, v in enumerate(vocab)]
    added = [(a["id"], a["content"], bool(a.get("special"))) for a in d.get("added_tokens", [])]
    return (
        spark.createDataFrame(vocab, "token string, id int"),
        spark.createDataFrame(merges, "rank int, left string, right string"),
        spark.createDataFrame(added, "id int, content string, special boolean"),
    )


def write_counts(counts: DataFrame, path: str, overwrite: bool = False) -> None:
    """A counts table (Parquet); an old one stays until the new one is whole."""
    with files.replacing(path, overwrite, counts.sparkSession) as staged:
        counts.write.parquet(str(staged))


def _quoted(text: Column) -> Column:
    """A string as JSON writes it."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNull(), "null").otherwise(F.substring(whole, F.lit(6), F.length(whole) - 6))


def write_counts_json(counts: DataFrame, path: str, overwrite: bool = False, parts: bool = False) -> int:
    """One JSON array, an object per line, in the order of counts; with parts a folder of JSON lines in that order."""
    line = F.concat(F.lit('{"word": '), _quoted(F.col("word")), F.lit(', "count": '), F.coalesce(F.col("count").cast("string"), F.lit("null")), F.lit("}"))
    rows = counts.select(line)
    if parts:
        return files.write_lines(rows, path, overwrite=overwrite, parts=True)
    return files.write_lines(rows, path, overwrite=overwrite, between=",\n", head="[\n", tail="\n]\n")


def write_lines(rows: DataFrame, column: str, path: str, overwrite: bool = False, parts: bool = False) -> int:
    """One value per line, in the order of rows; with parts a folder of files in that order."""
    return files.write_lines(rows.select(F.col(column).cast("string")), path, overwrite=overwrite, parts=parts)


# The columns of the candidate table, in file order.
TSV = ("word", "token", "count", "source_type", "static_source_files", "source_variant_count", "base_token_count", "base_fragmentation", "utility_score")


def write_candidates(rows: DataFrame, path: str, overwrite: bool = False, parts: bool = False) -> int:
    """The candidates in their order, tab-separated, with a header (in a folder of parts, without one). A field is quoted if it
    holds a tab, a quotation mark or a line's end."""

    def field(c: str) -> Column:
        value = F.coalesce(F.col(c).cast("string"), F.lit(""))
        return F.when(value.rlike('[\t"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)

    lines = rows.orderBy("section", "place").select(F.concat_ws("\t", *[field(c) for c in TSV]))
    head = "" if parts else "\t".join(TSV) + "\r\n"
    return files.write_lines(lines, path, overwrite=overwrite, between="\r\n", head=head, parts=parts)


def report(row: DataFrame) -> dict:
    """The one row of a report as a nested dict."""
    found = row.limit(2).collect()
    if len(found) != 1:
        raise ValueError("a report has one row")
    return found[0].asDict(recursive=True)


def write_report(payload: dict, path: str, overwrite: bool = True) -> str:
    text = json.dumps(payload, ensure_ascii=False, indent=2) + "\n"
    files.write_text(text, path, overwrite)
    return text


def save_tokenizer(document: str, folder: str, config: dict | None = None, overwrite: bool = False) -> None:
    """A tokenizer document and its configuration; a class that the runtime doesn't have becomes the generic one."""
    config = dict(config or {})
    if config.get("tokenizer_class") in INCOMPATIBLE:
        config["tokenizer_class"] = GENERIC
    with files.replacing(folder, overwrite) as staged:
        files.write_text(document, f"{staged}/tokenizer.json")
        write_report(config, f"{staged}/tokenizer_config.json")


def as_json(row: Column) -> Column:
    return F.to_json(row, {"pretty": "true"})
