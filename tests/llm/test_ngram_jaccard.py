import random
import re

import numpy as np

from lexforge.llm import ngram_jaccard, queries


def sets_of(rows, width):
    out = []
    for _, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set())
    return out


def brute(rows, width, percent):
    sets = sets_of(rows, width)
    distinct = list(dict.fromkeys(map(frozenset, sets)))
    label = list(range(len(distinct)))
    by = {}
    for k, s in enumerate(distinct):
        for x in s:
            by.setdefault(x, []).append(k)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, s in enumerate(distinct):
        for b in {k for x in s for k in by[x] if k > a}:
            both = len(s & distinct[b])
            if 100 * both >= percent * (len(s) + len(distinct[b]) - both):
                label[root(a)] = root(b)
    at = {s: root(k) for k, s in enumerate(distinct)}
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        k = at[frozenset(s)]
        least[k] = min(least.get(k, (2, 0)), (d is not None, d or 0))
    component = lambda d, s: d if not s else least[at[frozenset(s)]][1] if least[at[frozenset(s)]][0] else None
    return sorted((z(d), len(s), z(component(d, s))) for (d, _), s in zip(rows, sets, strict=True))


def z(v):
    return -1 if v is None else v


def result(df):
    return sorted((z(r.doc_id), r.n_shingles, z(r.component_id)) for r in df.collect())


def corpus(seed, n=260):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["É", "ß", "Big"]
    text = lambda k: [rnd.choice(vocab) for _ in range(k)]
    rows = []
    for i in range(n):
        if rows and rnd.random() < 0.7:
            ws = rnd.choice(rows)[:]
            for _ in range(rnd.choice([0, 1, 1, 2, 3, 5])):
                if ws:
                    k = rnd.randrange(len(ws))
                    ws[k : k + rnd.randrange(2)] = text(rnd.randrange(2))
        else:
            ws = text(rnd.choice([0, 1, 2, 3, 5, 8, 20, 40, 80, 150, 400]))
        rows.append(ws)
    return [(i, " ".join(ws).upper() if i % 5 == 0 else "\n".join(ws)) for i, ws in enumerate(rows)] + [(9001, None), (9002, ""), (9003, " \t"), (None, "alone here")]


def test_link_against_brute_force():
    rnd = random.Random(5)
    for percent in (90, 80, 50):
        base = [rnd.sample(range(10**6), 30) for _ in range(12)]
        sets = []
        for _ in range(220):
            s = set(rnd.choice(base))
            for _ in range(rnd.randrange(0, 9)):
                s.discard(rnd.choice(sorted(s)))
                s.add(rnd.randrange(10**6))
            sets.append(s)
        label = ngram_jaccard.link([np.array(sorted(s), np.uint64) for s in sets], percent)
        want = list(range(len(sets)))
        for a in range(len(sets)):
            for b in range(a):
                if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and want[a] != want[b]:
                    old, new = want[a], want[b]
                    want = [new if x == old else x for x in want]
        assert len({(a, b) for a, b in zip(label, want, strict=True)}) == len(set(label)) == len(set(want))


def test_components(spark):
    rnd = random.Random(8)
    for nodes, edges in ((50, 30), (200, 190), (30, 200)):
        pairs = [(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(edges)] + [(i, i + 1) for i in range(1000, 1040)]
        want = {}
        for a, b in pairs:
            x, y = want.setdefault(a, {a}), want.setdefault(b, {b})
            if x is not y:
                x |= y
                want.update(dict.fromkeys(y, x))
        got = {}
        for r in ngram_jaccard.components(spark.createDataFrame(pairs, "a long, b long")).collect():
            got.setdefault(r.label, set()).add(r.node)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, {id(x): x for x in want.values()}.values()))
    assert ngram_jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark, monkeypatch):
    for seed, width, percent in ((1, 3, 90), (2, 5, 80), (3, 3, 80)):
        rows = corpus(seed)
        d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).selectExpr("*", "1 id", "2 node", "3 n")
        assert result(ngram_jaccard.report(d, width=width, percent=percent)) == brute(rows, width, percent)


def test_pivots_part_regions():
    """In a chain of clusters pivots leave most pairs uncompared, at any size."""
    rnd = random.Random(3)
    sets = []
    for c in range(40):
        base = set(range(60 * c, 60 * c + 60))
        sets += [base - set(rnd.sample(sorted(base), 2)) for _ in range(6)]
    region = ngram_jaccard.Region([np.array(sorted(s), np.uint64) for s in sets], 80)
    compared = []
    one = region.compare
    region.compare = lambda x, members: compared.append(len(members)) or one(x, members)
    region.solve(np.arange(region.m))
    assert region.pivots >= 40 and len(set(region.label)) == 40 and sum(compared) < region.m**2 / 3
    for few in (2, 3, 9, 48):  # no size has a way of its own
        region = ngram_jaccard.Region([np.array(sorted(s), np.uint64) for s in sets[:few]], 80)
        region.solve(np.arange(few))
        assert region.pivots and len(set(region.label)) == -(-few // 6)


def test_distributed_pivots_of_large_regions(spark, monkeypatch):
    """Regions beyond one task: parted by rounds of pivots, or, of near copies, dealt into blocks."""
    ran = []
    one = ngram_jaccard._distributed
    monkeypatch.setattr(ngram_jaccard, "_distributed", lambda sets, percent: ran.append((found := one(sets, percent))) or found)
    monkeypatch.setattr(ngram_jaccard, "REGION", 6)
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    chain = [" ".join(base[3 * i : 3 * i + 45]) for i in range(25)]  # neighbours share much, the ends nothing
    near = [" ".join(["n" + w for w in base[:60]] + [f"x{i}"] * (i % 4)) for i in range(25)]
    far = [" ".join("n" + (w if rnd.random() < 0.9 else "y") for w in base[:60]) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(chain + near + far)] + corpus(4, 60)[:60]
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for sent, width, percent in ((10**6, 3, 80), (0, 2, 60)):
        monkeypatch.setattr(ngram_jaccard, "SENT", sent)
        assert result(ngram_jaccard.report(d, width=width, percent=percent)) == brute(rows, width, percent)
    assert len(ran) == 2 and all(links and parts for links, parts in ran)


def test_string_ids(spark):
    rows = [("b10", "a b c d"), ("b9", "a b c d"), (None, "q r s t"), ("z", "q r s t"), ("y", None)]
    d = spark.createDataFrame(rows, "doc_id string, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.report(d, width=3, percent=90).collect()}
    assert got == {("b10", "b10"), ("b9", "b10"), (None, None), ("z", None), ("y", "y")}
    assert sorted(str(r.doc_id) for r in ngram_jaccard.representatives(d).collect()) == ["None", "b10", "y"]


def test_long_text(spark):
    ws = [f"w{i % 9973}x{i}" for i in range(120_000)]
    rows = [(2, " ".join(ws)), (1, " ".join(ws[:-50])), (3, " ".join(ws[:60_000]))]
    got = result(ngram_jaccard.report(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90))
    assert got == [(1, 119_948, 1), (2, 119_998, 1), (3, 59_998, 3)]


def test_representatives(spark):
    rows = corpus(6, 120)
    rows += [rows[0], (3, "other words under the same id")]
    d = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 row", "2 h")
    got = ngram_jaccard.representatives(d)
    assert got.columns == d.columns
    left = sorted(z(r.doc_id) for r in got.collect())
    want = {a for a, _, c in brute(rows, 5, 80) if a == c}
    assert set(left) == want and len(left) == len(set(left))
    assert ngram_jaccard.representatives(d.limit(0)).count() == 0


def test_representatives_of_null_and_repeated_ids(spark):
    text = lambda k: " ".join(f"{k}x{i}" for i in range(60))
    near = lambda k: text(k) + " more"
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, near("c")), (None, ""), (None, None)]
    rows += [(1, text("d")), (5, near("d")), (5, text("e")), (5, text("f")), (5, text("f")), (6, near("f")), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_jaccard.representatives(d, by_id=False).collect()
    want = [(None, text("a")), (None, text("b")), (None, text("c")), (None, ""), (None, None), (1, text("d")), (5, text("e")), (5, text("f")), (8, "")]
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    nulls = [r.text for r in ngram_jaccard.representatives(d).where("doc_id is null").collect()]
    assert sorted(map(str, nulls)) == sorted(map(str, (t for i, t in want if i is None)))


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert result(queries.op3_ngram_jaccard(spark, sf)) == brute(rows, 3, 90)


def test_rows_without_an_id_are_dealt_out(spark):
    """A third of all rows without an id, half of these one text: no task gets them all."""
    rows = [(None if i % 3 == 0 else i, f"one two three {i if i % 2 else 0}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    seen = []
    repartition = type(docs).repartition

    def watched(df, *by):
        out = repartition(df, *by)
        if by == ("p", "key", "apart"):
            seen.append([r.n for r in repartition(df.where("p"), 16, *by).groupBy(ngram_jaccard.F.spark_partition_id().alias("at")).agg(ngram_jaccard.F.count("*").alias("n")).collect()])
        return out

    type(docs).repartition = watched
    try:
        found = ngram_jaccard.report(docs, width=3, percent=90)
    finally:
        type(docs).repartition = repartition
    assert sum(seen[0]) == 3000 and max(seen[0]) < 2 * sorted(seen[0])[len(seen[0]) // 2]
    assert result(found) == brute(rows, 3, 90)
