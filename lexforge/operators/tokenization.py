"""Tokenizers as operators: a vocabulary with byte fallback in SQL, and subword tokenizers in Arrow batches."""

from __future__ import annotations

import json
import os
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import io
from .ordering import spread_join

#: A vocabulary below this many rows is sent to every executor; a larger one is joined by a shuffle.
SENT_ROWS = 200_000


def bounded(df: DataFrame, rows: int = SENT_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most that many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class ByteFallback:
    """A word is one piece if the vocabulary (token, id) has it, else one piece for each byte."""

    def __init__(self, vocabulary: DataFrame):
        self.vocabulary = vocabulary.select(F.col("token").alias("_token")).distinct()

    def counted(self, df: DataFrame, word: str = "word", out: str = "base_token_count") -> DataFrame:
        known = bounded(self.vocabulary).withColumn("_known", F.lit(True))
        rows = df.join(known, F.col(word) == F.col("_token"), "left")
        n = F.when(F.col("_known"), 1).otherwise(F.octet_length(word)).cast("int")
        return rows.withColumn(out, n).drop("_token", "_known")


class Subword:
    """A tokenizer document (JSON text) of the tokenizers library; it goes to the executors as text and is read once
    by each worker."""

    def __init__(self, document: str):
        self.document = document

    @classmethod
    def load(cls, path: str) -> Subword:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def model(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.document)

    def _batches(self, kind: str, body):
        document = self.document

        @F.pandas_udf(kind)
        def run(batches: pd.Series) -> pd.Series:
            return pd.Series(body(_cached(document), batches))

        return run

    def piece_count(self, text: Column) -> Column:
        return self._batches("int", lambda t, b: [len(e) for part in _encoded(t, b.fillna("").tolist()) for e in part])(text)

    def encode(self, text: Column, special: bool = False, most: int | None = None) -> Column:
        """The ids of a text, or the first ``most`` of them."""
        document = self.document

        @F.arrow_udf("array<int>")
        def run(texts: pa.Array) -> pa.Array:
            ids = [np.array(e.ids[:most], np.int32) for part in _encoded(_cached(document), [x or "" for x in texts.to_pylist()], special) for e in part]
            return _lists([len(x) for x in ids], pa.array(np.concatenate([np.empty(0, np.int32), *ids])))

        return run(text)

    def decode(self, ids: Column) -> Column:
        return self._batches("string", lambda t, b: [t.decode([int(i) for i in x], skip_special_tokens=False) for x in b])(ids)

    def segmented(self, text: Column) -> Column:
        """token_ids, tokens, decoded_pieces, token_count of a text."""
        document = self.document
        kind = "struct<token_ids:array<int>,tokens:array<string>,decoded_pieces:array<string>,token_count:int>"

        @F.arrow_udf(kind)
        def run(texts: pa.Array) -> pa.Array:
            t, sizes, ids, tokens, spelt = _cached(document), [], [], [], []
            piece = _pieces(document)
            for part in _encoded(t, [x or "" for x in texts.to_pylist()], tokens=True):
                found = [i for e in part for i in e.ids]
                sizes += [len(e) for e in part]
                ids.append(pa.array(found, pa.int32()))
                tokens.append(pa.array([x for e in part for x in e.tokens], pa.string()))
                spelt.append(pa.array([piece(i) for i in found], pa.string()))
            whole = lambda parts, kind: pa.concat_arrays(parts) if parts else pa.array([], kind)
            columns = [_lists(sizes, whole(ids, pa.int32())), _lists(sizes, whole(tokens, pa.string())), _lists(sizes, whole(spelt, pa.string())), pa.array(sizes, pa.int32())]
            return pa.StructArray.from_arrays(columns, ["token_ids", "tokens", "decoded_pieces", "token_count"])

        return run(text)

    def covered(self, text: Column) -> Column:
        """token_ids of a text, and exact: it is one id, and that id alone spells the text."""
        document = self.document

        @F.pandas_udf("struct<token_ids:array<int>,exact:boolean>")
        def run(texts: pd.Series) -> pd.DataFrame:
            t, given = _cached(document), texts.fillna("").tolist()
            ids = [e.ids for part in _encoded(t, given) for e in part]
            exact = [len(x) == 1 and t.decode(x, skip_special_tokens=False) == g for x, g in zip(ids, given, strict=True)]
            return pd.DataFrame({"token_ids": ids, "exact": exact})

        return run(text)

    def pieces(self, ids: Column) -> Column:
        """What each of the ids spells by itself."""
        return self._batches("array<string>", lambda t, b: [[t.decode([int(i)], skip_special_tokens=False) for i in x] for x in b])(ids)

    def vocabulary(self, spark) -> DataFrame:
        """token, id, decoded, special of the whole vocabulary, by id."""
        t = self.model()
        added = {x["id"]: x for x in json.loads(self.document).get("added_tokens", [])}
        rows = [(token, i, t.decode([i], skip_special_tokens=False), bool(added.get(i, {}).get("special", False))) for token, i in t.get_vocab().items()]
        return spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "token string, id int, decoded string, special boolean")


#: Tokenizers that a worker keeps: reading one costs more than encoding a batch, and queries use two or three side by side.
KEPT = 4
#: Characters of the texts that are encoded at once: what the library holds of a text is many times the text.
SLICE = 1 << 18


@lru_cache(KEPT)
def _cached(document: str):
    from tokenizers import Tokenizer

    # a task has one core
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Tokenizer.from_str(document)


@lru_cache(KEPT)
def _pieces(document: str):
    """What an id spells by itself, as a function that looks each id of the vocabulary up once."""
    t = _cached(document)
    return cache(lambda i: t.decode([i], skip_special_tokens=False))


def _encoded(t, texts: list[str], special: bool = False, tokens: bool = False):
    """The encodings of texts, in lists: of texts of ``SLICE`` characters in all, or of a single longer one. They hold tokens only
    if asked for, else ids alone."""
    encode = t.encode_batch if tokens else t.encode_batch_fast
    begin = size = 0
    for i, text in enumerate(texts):
        if i > begin and size + len(text) > SLICE:
            yield encode(texts[begin:i], add_special_tokens=special)
            begin, size = i, 0
        size += len(text)
    if begin < len(texts):
        yield encode(texts[begin:], add_special_tokens=special)


def _lists(sizes: list[int], values: pa.Array) -> pa.Array:
    """Values as lists of these sizes."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def decoded(df: DataFrame, vocabulary: DataFrame, ids: str = "ids", key: str = "doc_id", out: str = "pieces") -> DataFrame:
    """key and the decoded pieces of its ids, in order, by a join with the vocabulary."""
    each = df.select(key, F.posexplode(ids).alias("_pos", "_id"))
    rows = each.join(bounded(vocabulary.select(F.col("id").alias("_id"), "decoded")), "_id", "left")
    sorted_ = F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("decoded", F.lit("")).alias("decoded"))))
    return rows.groupBy(key).agg(F.transform(sorted_, lambda x: x["decoded"]).alias(out))


# The pattern by which byte-level tokenizers part a text before merging, with the white space of Unicode spelled out.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PARTS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: Documents that one copy of a part's token count is joined with.
SHARE = 10_000
#: Characters of a part that may be sent to all executors.
SHORT = 64


def splits_by_parts(tokenizer: Subword) -> bool:
    """Whether a tokenizer's document parts texts by the byte-level pattern and does nothing before."""
    d = json.loads(tokenizer.document)
    part = d.get("pre_tokenizer") or {}
    return d.get("normalizer") is None and part.get("type") == "ByteLevel" and part.get("use_regex", True) and not part.get("add_prefix_space", False)


def corpus_token_counts(docs: DataFrame, tokenizer: Subword, *, key: str = "doc_id", text: str = "text", share: int = SHARE, sent: int = SENT_ROWS) -> DataFrame:
    """key, tokens of every row, without encoding texts: no merge crosses a part of the byte-level pattern, so a text has the tokens of
    its parts. Parts are cut in the engine and counted by text, each distinct one of the corpus is encoded once, and the counts are
    joined and added up. The counts of parts that are one in ``sent`` of all or more (so at most that many) are broadcast and added
    up where their document is; only the others are shuffled, with keys that are still frequent (long ones) dealt out. Texts that
    hold an added token's string, which is matched across parts, are encoded whole; the keys have to be distinct, and null texts
    have no tokens."""
    if not splits_by_parts(tokenizer):
        raise ValueError("the tokenizer doesn't part texts by the byte-level pattern")
    added = [a["content"] for a in json.loads(tokenizer.document).get("added_tokens", [])]
    held = F.lit(False)
    for content in added:
        held = held | F.contains(F.col("_text"), F.lit(content))
    rows = docs.select(F.col(key).alias("_doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    whole = rows.where(held).select("_doc", tokenizer.piece_count(F.col("_text")).cast("long").alias("_n"))
    parts = rows.where(~held).select("_doc", F.explode(F.regexp_extract_all("_text", F.lit(PARTS), F.lit(0))).alias("_part"))
    known = parts.groupBy(F.col("_part").alias("_known")).agg(F.count(F.lit(1)).alias("_seen"))
    costs = io.stored(known.withColumn("_cost", tokenizer.piece_count(F.col("_known"))), "parts")
    total = costs.agg(F.coalesce(F.sum("_seen"), F.lit(0))).first()[0]
    common = costs.where((F.col("_seen") * sent >= total) & (F.length("_known") <= SHORT)).select("_known", "_cost")
    # a row for what the common parts of a document have, and one for each other part
    other = F.when(F.col("_cost").isNull(), F.col("_part")).alias("_part")
    met = parts.join(F.broadcast(common), F.col("_part") == F.col("_known"), "left").groupBy("_doc", other).agg(F.count(F.lit(1)).alias("_times"), F.sum("_cost").alias("_n"))
    met = io.stored(met, "met")
    sums = met.where("_part is null").select("_doc", "_n")
    rest = spread_join(met.where("_part is not null").select("_doc", "_part", "_times"), costs.select("_known", "_cost"), "_part", "_known", F.col("_doc"), share)
    none = rows.select("_doc", F.lit(0).cast("long").alias("_n"))  # rows without parts stay
    each = none.unionByName(sums).unionByName(rest.select("_doc", (F.col("_times") * F.col("_cost")).alias("_n"))).unionByName(whole)
    return each.groupBy(F.col("_doc").alias(key)).agg(F.sum("_n").alias("tokens"))


def truncate_pad(ids: Column, length: int, pad: int = 0) -> tuple[Column, Column]:
    """ids cut or padded on the right to a length, and their attention mask."""
    if length < 1:
        raise ValueError("length must be at least 1")
    kept = F.slice(ids, 1, length)
    rest = F.lit(length) - F.size(kept)
    return F.concat(kept, F.array_repeat(F.lit(pad), rest)), F.concat(F.array_repeat(F.lit(1), F.size(kept)), F.array_repeat(F.lit(0), rest))


def windows(ids: Column, length: int) -> Column:
    """ids as consecutive arrays of a length, the last one shorter; one empty array if there are none."""
    if length < 1:
        raise ValueError("length must be at least 1")
    last = F.greatest(F.ceil(F.size(ids) / F.lit(length)), F.lit(1)).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(ids, k * length + 1, length))


def labels(ids: Column, mask: Column, ignored: int = -100) -> Column:
    """ids where the mask is 1, the ignored value elsewhere (by mask, so that a real end token keeps its label)."""
    return F.zip_with(ids, mask, lambda i, m: F.when(m == 1, i).otherwise(F.lit(ignored)))
