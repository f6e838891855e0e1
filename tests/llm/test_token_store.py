import zlib

import numpy as np
import pyarrow as pa
import pytest

from lexforge.llm import queries, token_store


def reference():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))


def expected(docs):
    t, start, out = reference(), 0, []
    for d, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=str)


def test_coder_round_trip(monkeypatch):
    rng = np.random.default_rng(1)
    for block, n in ((1, 7), (64, 1000), (700, 6333), (2048, 30_000)):
        monkeypatch.setattr(token_store, "BLOCK", block)
        for ids in (rng.zipf(1.3, n) % 49_408, rng.integers(0, 1 << 32, n), np.zeros(n), np.arange(n) % 7 + 60_000, np.cumsum(rng.integers(0, 3, n)), np.repeat(rng.integers(0, 9, n), 5)[:n], np.zeros(0)):
            ids = ids.astype(np.uint32)
            lengths, back = token_store.unframe(token_store.frame(np.array([len(ids)]), ids))
            assert lengths.tolist() == [len(ids)] and (back == ids).all()


def test_orders_are_learned():
    """Text that each order foresees costs what it should: nothing, or the entropy of its ids."""
    rng = np.random.default_rng(2)
    n = 200_000
    size = lambda ids: len(token_store.frame(np.array([len(ids)]), ids.astype(np.uint32))) / len(ids)
    assert size(np.arange(n) % 50) < 0.03  # order 1
    pairs = np.stack([rng.integers(0, 8, n // 4) + 100, rng.integers(0, 8, n // 4) + 200], 1)
    third = pairs[:, 0] * 8 + pairs[:, 1]  # order 2 alone foresees it
    assert size(np.concatenate([pairs, third[:, None], np.zeros((n // 4, 1), int)], 1).ravel()) < 2 * 5 / 8 / 4 * 1.06  # five bits for each of two ids by order 0, nothing for the others
    assert size(rng.integers(0, 16, n)) < 0.53  # order 0: half a byte
    half = np.concatenate([np.arange(n // 2) % 50, rng.integers(0, 50, n // 2)])  # the mixing adapts
    assert size(half) < 0.5 * np.log2(50) / 8 * 1.12


def test_smaller_than_general_compression():
    import zlib

    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].combine_chunks()
    ids, counts = token_store.Encoder(queries.tokenizer("word_bpe_49k.json")).ids(texts)
    p = np.bincount(ids) / len(ids)
    entropy = -(p[p > 0] * np.log2(p[p > 0])).sum() / 8
    packed = len(token_store.frame(counts, ids)) / len(ids)
    assert packed < entropy and packed < len(zlib.compress(ids.astype("<u2"), 9)) / len(ids)


def test_damage_is_seen():
    ids = np.arange(5000, dtype=np.uint32)
    data = token_store.frame(np.array([2500, 2500]), ids)
    lengths, back = token_store.unframe(data)
    assert lengths.tolist() == [2500, 2500] and (back == ids).all()
    bad = bytearray(data)
    bad[-100] ^= 1
    with pytest.raises(ValueError):
        token_store.unframe(bytes(bad))


def test_any_damage_of_a_block_is_seen(monkeypatch):
    monkeypatch.setattr(token_store, "BLOCK", 256)
    rng = np.random.default_rng(3)
    for ids in (rng.zipf(1.3, 9000) % 500, np.arange(9000) % 50, rng.integers(0, 3000, 9000), np.full(9000, 7)):
        data = token_store.frame(np.array([9000]), ids.astype(np.uint32))
        n, total, index, held = np.frombuffer(data, "<u4", 6, 8)[[0, 1, 3, 4]].tolist()
        coded = 28 + index + held + 8 * n
        assert total == 9000 and coded < len(data)
        for at in (*range(coded, coded + 8), *rng.integers(coded, len(data) - 8, 40).tolist()):
            bad = bytearray(data)
            bad[at] ^= int(rng.integers(1, 256))
            try:
                assert (token_store.unframe(bytes(bad))[1] == ids).all()  # the last bits of a block may say nothing
            except ValueError as e:
                assert "damaged" in str(e)


def test_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op5_token_store(spark, sf).collect()), key=str)
    assert got == expected(docs)


def test_odd_rows_and_many_frames(spark, monkeypatch):
    monkeypatch.setattr(token_store, "LANES", 1)
    monkeypatch.setattr(token_store, "BLOCK", 64)
    rows = [(3, None), (1, ""), (2, "a<|endoftext|>b <|startoftext|> C#\x0b##\x1c x"), (None, "né́ ﬁ"), (7, "z" * 5000), (7, "Ab " * 100), (7, "Ab " * 100), (-5, " \n")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 id", "2 t", "3 part")
    path = token_store.write(d, queries.tokenizer("word_bpe_49k.json"), part=300, least=300)
    assert sorted((tuple(r) for r in token_store.digest(spark, path).collect()), key=str) == expected(rows)
    t = reference()
    assert sorted((r.doc_id or 0, list(r.ids)) for r in token_store.read(spark, path).collect()) == sorted((d or 0, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for d, x in rows)


def test_string_ids(spark):
    rows = [("b", "x y"), ("a", "z"), (None, "first"), ("10", "t"), ("9", "u")]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = token_store.digest(spark, token_store.write(d, queries.tokenizer("word_bpe_49k.json"), part=4, least=4)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "10", "9", "a", "b"]


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op5_token_store(spark, "/root/testdata/sf0.01").collect()), key=str) == expected(docs)


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    path = token_store.write(d, queries.tokenizer("word_bpe_49k.json"))
    assert token_store.digest(spark, path).count() == 0


def test_parts_between_white_space_against_whole_texts():
    import random

    rnd, encoder = random.Random(4), token_store.Encoder(queries.tokenizer("word_bpe_49k.json"))
    assert encoder.short
    letters = "aBcÉéßøÿµªŒœ.,;:!?'\"-$123 \n\t\x0b\x0cİΣςſǅ́ﬁ中😀\x85\xa0"
    for _ in range(3000):
        text = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 14))) + rnd.choice(["", "<|endoftext|>"])
        assert encoder.ids(pa.array([text]))[0].tolist() == encoder.model.encode(text, add_special_tokens=False).ids


def test_simple_words_are_not_taken_one_by_one(monkeypatch):
    """Neither made Python's nor given to the library: marks, digits, and words met before, in later texts too."""
    encoder = token_store.Encoder(queries.tokenizer("word_bpe_49k.json"))
    texts = ["geie*** (der&&& x86_64 a-b", "", "geie*** $3.14 \"Straße\" {[#%]}", "der&&& geie***"]
    want = [encoder.model.encode(t, add_special_tokens=False).ids for t in texts]
    taken = []
    monkeypatch.setattr(token_store, "raw", lambda column, made=token_store.raw: taken.extend(made(column)) or made(column))
    for _ in range(2):
        for t, w in zip(texts, want, strict=True):
            assert encoder.ids(pa.array([t]))[0].tolist() == w
    assert taken == []
    assert encoder.ids(pa.array(["don't der&&&"]))[0].tolist() == encoder.model.encode("don't der&&&", add_special_tokens=False).ids
    assert taken == [b"don't"]


def test_words_of_all_sizes_and_forgotten_ones(monkeypatch):
    import random

    rnd, encoder = random.Random(5), token_store.Encoder(queries.tokenizer("word_bpe_49k.json"))
    monkeypatch.setattr(token_store, "KEPT", 50)
    monkeypatch.setattr(token_store, "_TOGETHER", 7)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice(rnd.choice(("etaoinSR", "éÜß", "#*$%&|>-_.", "0123456789"))) for _ in range(rnd.randrange(60))) for _ in range(40)) for _ in range(5)]
        ids, counts = encoder.ids(pa.array(texts))
        want = [e.ids for e in encoder.model.encode_batch(texts, add_special_tokens=False)]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == sum(want, [])
