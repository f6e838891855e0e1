import hashlib
import random

import pytest

from lexforge.llm import queries, repeats


def brute(docs, width):
    """docs in order: [(key, bytes)]; equal keys and texts are one document."""
    seen, out, last = set(), {}, None
    for key, data in docs:
        if (key, data) == last:
            continue
        last = (key, data)
        cover = bytearray(len(data))
        for i in range(len(data) - width + 1):
            s = data[i : i + width]
            if s in seen:
                cover[i : i + width] = b"\x01" * width
            seen.add(s)
        kept = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        runs = sum(c and not (i and cover[i - 1]) for i, c in enumerate(cover))
        out[(key, data)] = (len(data), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def check(spark, rows, width, gram, block, parts):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    got = sorted((r.row is not None, r.row or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.repeats(d, width=width, gram=gram, block=block).collect())
    data = sorted(((r[0] is not None, r[0] or 0), (r[1] or "").encode()) for r in rows)
    want = brute(data, width)
    assert got == sorted((*k, *want[(k, t)]) for k, t in data)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    text = lambda n, abc="abcdefgh é": "".join(rnd.choice(abc) for _ in range(n))
    shared = [text(rnd.randrange(10, 60)) for _ in range(8)]
    rows = []
    for i in range(150):
        t = "".join(rnd.choice(shared) if rnd.random() < 0.5 else text(rnd.randrange(0, 40)) for _ in range(rnd.randrange(0, 6)))
        rows.append((i, t))
    rows += [(200, "a" * 300), (201, "ab" * 200), (202, "a" * 40), (203, None), (204, ""), (205, rows[3][1] * 4), (None, rows[5][1]), (206, text(3000, "ab"))]
    rnd.shuffle(rows)
    for width, gram, block, parts in ((20, 6, 1 << 20, 1), (20, 6, 700, 5), (12, 5, 3000, 3), (10, 10, 500, 2)):
        check(spark, rows, width, gram, block, parts)


def test_repeated_rows(spark):
    same = "the same text that stands twice under one id and once more under another " * 2
    check(spark, [(1, same), (1, same), (2, same), (2, "x" + same)], 20, 6, 1 << 20, 2)


def test_empty_and_extra_columns(spark):
    d = spark.createDataFrame([(1, "abc")], "doc_id long, text string").selectExpr("*", "1 id", "2 t", "3 places", "4 row")
    assert repeats.repeats(d.limit(0)).count() == 0
    assert [tuple(r)[1:4] for r in repeats.repeats(d).collect()] == [(3, 0, 0)]


def test_whole_table(spark, sf):
    docs = sorted((r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    want = brute(docs, 100)
    got = {r.doc_id: tuple(r)[1:] for r in queries.op9_repeated_substrings(spark, sf).collect()}
    assert got == {k: v for (k, _), v in want.items()}


def test_triggers_in_strides(monkeypatch):
    import numpy as np

    rnd = random.Random(9)
    block = repeats.Block([bytes(rnd.choice(b"ab") for _ in range(n)) for n in (500, 0, 30, 3, 700)])
    whole = block.phrases(20, 6)
    monkeypatch.setattr(repeats, "STRIDE", 37)
    assert all((a == b).all() for a, b in zip(whole, block.phrases(20, 6), strict=True))
    assert isinstance(whole[0], np.ndarray)


def test_wide_windows(spark):
    rnd = random.Random(11)
    text = lambda n: "".join(rnd.choice("abcdefghij klmnop") for _ in range(n))
    passage, long = text(520), text(3300)
    rows = [(1, text(300) + passage + text(200)), (2, text(100) + passage + text(90)), (3, long), (4, "x" + long + "y"), (5, passage[:390])]
    for width, gram in ((400, 32), (3000, 50), (288, 32), (287, 32)):
        check(spark, rows, width, gram, 1 << 20, 2)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for width, gram in ((5000, 32), (20, 30), (20, 0)):
        with pytest.raises(ValueError):
            repeats.repeats(d, width=width, gram=gram)


def test_long_text_and_string_ids(spark):
    rnd = random.Random(12)
    passage = "".join(rnd.choice("abcdefghij klmnop") for _ in range(150))
    whole = "".join(rnd.choice("abcdefghij klmnop") for _ in range(400_000))
    rows = [("b10", whole[:300_000] + passage + whole[300_000:]), ("b9", "q" + passage + "z"), (None, passage), ("b10", "twin " + passage)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.n_bytes, r.row, r.n_removed) for r in repeats.repeats(d).collect())
    assert got == [(150, None, 0), (152, "b9", 150), (155, "b10", 150), (400_150, "b10", 150)]
