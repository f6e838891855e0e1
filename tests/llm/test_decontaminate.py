import hashlib
import random
import re

from lexforge.llm import decontaminate


def brute(docs, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = []
    for i, t in items:
        ws = words(t)
        if ws:
            windows += [(str(i), ws[k : k + 13]) for k in range(max(1, len(ws) - 12))]
    out = {}
    for d, t in docs:
        ws, hit, ids = words(t), set(), set()
        for i, w in windows:
            for k in range(len(ws) - len(w) + 1):
                if ws[k : k + len(w)] == w:
                    hit |= set(range(k, k + len(w)))
                    ids.add(i)
        n = len(hit)
        out.setdefault(d, []).append((len(ws), n, len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), n > 0 and 20 * n >= len(ws)))
    return {d: sorted(x) for d, x in out.items()}


def cases():
    rnd = random.Random(7)
    vocab = ["a", "B", "é", "x1", "日本", "zz", "Q"]
    text = lambda n: "".join(rnd.choice(vocab) + rnd.choice([" ", "-", "\n", ". ", "\x00"]) for _ in range(n))
    items = [(k, text(rnd.choice([1, 3, 12, 13, 14, 20]))) for k in range(12)] + [(12, None), (13, ""), (14, "...")]
    docs = [(k, text(rnd.randrange(0, 60))) for k in range(60)] + [(90, None), (91, ""), (92, "!!"), (None, "a b")]
    docs += [(100 + k, text(rnd.randrange(0, 200)) + items[k % 12][1].upper() + text(5)) for k in range(30)]
    return docs + docs[:3], items


def result(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
    return {d: sorted(x) for d, x in out.items()}


def test_against_brute_force_and_in_blocks(spark):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 n_words", "2 t", "3 k0")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert result(decontaminate.contamination(d, b)) == want
    assert result(decontaminate.contamination(d, b, max_windows=20)) == want
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns
    assert left.count() == sum(not x[-1] for xs in want.values() for x in xs)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert result(decontaminate.contamination(d, b)) == brute([(1, "a b")], [])
    assert decontaminate.contamination(d.limit(0), b).count() == 0


def test_spans_are_offsets_in_the_original():
    data = "Hé A-b  c".encode()
    import numpy as np

    assert [data[a:b].decode() for a, b in decontaminate.spans(data, np.array([True, False, True, True]))] == ["Hé", "b  c"]


def test_whole_table(spark, sf):
    from lexforge.llm.queries import op10_decontamination

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = result(op10_decontamination(spark, sf))
    assert set(got) == {d for d, _ in docs}
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {}
    for i, t in items:
        ws = words(t)
        for k in range(max(1, len(ws) - 12) if ws else 0):
            windows.setdefault(tuple(ws[k : k + 13]), set()).add(str(i))
    sizes = {len(w) for w in windows}
    want = {}
    for d, t in docs:  # every document, whole
        ws, hit, ids = words(t), set(), set()
        for n in sizes:
            for k in range(len(ws) - n + 1):
                if (at := windows.get(tuple(ws[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    ids |= at
        want[d] = [(len(ws), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(ws))]
    assert got == want and any(x[0][-1] for x in want.values())


def test_long_text(spark):
    """An item inside a text of 400,000 words, and a node bound that holds."""
    item = " ".join(f"q{i}" for i in range(30))
    d = spark.createDataFrame([(1, "w " * 300_000 + item + " w" * 100_000)], "doc_id long, text string")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in decontaminate.contamination(d, b).collect()] == [(400_030, 30)]
    w = decontaminate.Windows([("1", " ".join(f"q{i}" for i in range(2000)).encode())])
    assert w.trie.get_stats()["nodes_count"] <= 13 * (2000 - 12) + 1


def test_null_item_ids(spark):
    text = lambda k: " ".join(f"{k}x{i}" for i in range(20))
    items = [(None, text("a")), (None, text("b")), (1, text("b")), (2, text("c")), (None, None)]
    docs = [(k, f"so {text(w)} there") for k, w in enumerate("abcd")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {0: [(22, 20, 0, sha(""), True)], 1: [(22, 20, 1, sha("1"), True)], 2: [(22, 20, 1, sha("2"), True)], 3: [(22, 0, 0, sha(""), False)]}
    for size in (decontaminate.MAX_WINDOWS, 8):
        assert result(decontaminate.contamination(d, b, max_windows=size)) == want
        assert [r.doc_id for r in decontaminate.clean(d, b, max_windows=size).collect()] == [3]
