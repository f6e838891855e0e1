import hashlib
import random
import zlib

import pytest

from lexforge.llm import oracle_chat
from lexforge.llm import prefix_trie as P
from tests.llm.helpers import duck, over, same

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(talks):
    """The nodes of {id: [(role, text), ...]} by plain Python."""
    members = {}
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    least = {k: min((c for c in m if c is not None), default=None) for k, m in members.items()}
    children = {k: 0 for k in members}
    leaves, saved = dict(children), dict(children)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    ends = {k: ",".join(str(c) for c in sorted(c for c in m if c is not None and len(talks[c]) == len(k))) for k, m in members.items()}
    return sorted(((least[k], len(k), least[k[:-1]] if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends[k].encode()).hexdigest()) for k, m in members.items()), key=str)


def table(spark, talks, parts=3):
    rows = [(c, i, *t) for c, turns in talks.items() for i, t in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def found(df):
    return sorted((tuple(r) for r in df.select(*P.NODE).collect()), key=str)


def drawn(rng, n, depth, words=2):
    talks = {}
    for c in range(n):
        talks[c] = [("user", rng.choice(["é", "bb", "ccc"][:words])) for _ in range(rng.randint(1, depth))]
    return talks


@pytest.mark.parametrize("parts", [1, 2, 7, 40])
@pytest.mark.parametrize("shape", ["bushy", "hot", "deep", "one path"])
def test_brute_force(spark, parts, shape):
    rng = random.Random(parts)
    talks = {
        "bushy": lambda: drawn(rng, 60, 6),
        # a third of all conversations are the same, and another third begin so
        "hot": lambda: drawn(rng, 20, 3) | {c: [("user", "é"), ("assistant", "hot")] for c in range(100, 130)} | {c: [("user", "é"), ("assistant", "hot"), ("user", str(c % 4))] for c in range(200, 230)},
        "deep": lambda: {c: [("user", str(i)) for i in range(rng.randint(1, 60))] for c in range(25)},
        "one path": lambda: {c: [("user", "x")] * (c + 1) for c in range(20)},
    }[shape]()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(P.trie(table(spark, talks))) == brute(talks)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sweeps_of_any_cut():
    """The stitched sweeps of any cut of the sorted rows are the sweep of all of them."""
    rng = random.Random(2)
    for _ in range(200):
        rows = sorted((b"".join(bytes([rng.randint(0, 1)] * P.SIZE) for _ in range(rng.randint(0, 4))), c) for c in range(rng.randint(1, 12)))
        rows = [(path, [1 + d for d in range(len(path) // P.SIZE)], c) for path, c in rows]

        def result(cuts, rows=rows):
            out, opened = [], []
            for part, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
                for r in P.sweep(part, iter(rows[a:b])):
                    (opened if r[0] == P.OPEN else out).append(r)
            names = [f.name for f in P.ROW]
            last = list(P.stitch(dict(zip(names, r, strict=True)) for r in sorted(opened, key=lambda r: r[9:12])))
            at = {r[9:12]: r[1] for r in last if r[0] == P.SETTLED}
            nodes = [r[1:9] for r in out + last if r[0] == P.CLOSED] + [(*r[1:8], at[r[9:12]]) for r in out if r[0] == P.POINTING]
            return sorted(nodes, key=str)

        whole = result([])
        assert all(result(sorted(rng.choices(range(len(rows) + 1), k=rng.randint(1, 5)))) == whole for _ in range(5))


def rebuilt(talks):
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = talks.get(c - c % 100, [])[:h] + own[h:]
    return out


def test_rebuilt(spark):
    rng = random.Random(6)
    talks = {c: [("user" if i % 2 else "assistant", f"{c % 3} {i}") for i in range(rng.randint(1, 9))] for c in [*range(0, 40), *range(150, 180), *range(200, 230)]}  # 100 is absent
    assert found(P.nodes(P.rebuilt(P.turns(table(spark, talks))))) == brute(rebuilt(talks))
    assert any(not t for t in rebuilt(talks).values())


def test_nulls_ties_repeats_and_long_texts_against_sql(spark):
    rows = [(1, None, None, "n"), (1, 0, "user", None), (2, None, "", "n"), (2, 0, "user", ""), (3, 0, "a", "x" * 2_000_000), (4, 0, "a", "x" * 2_000_000), (5, 1, "u", "t"), (5, 1, "u", "t"), (100, 0, "user", "q"), (101, 0, "user", "r"), (101, 3, "b", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    c = over(duck("/root/testdata/sf0.001"), spark, df, "conversations")
    c.sql("CREATE OR REPLACE VIEW conversations AS SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations_rows")
    assert same(P.nodes(P.rebuilt(P.turns(df))), c.sql(oracle_chat.TRIE))


def test_null_ids_empty_table_and_clashing_columns(spark):
    talks = {None: [("user", "x"), ("user", "y")], 3: [("user", "x")]}
    assert found(P.trie(table(spark, talks))) == brute(talks)
    assert P.trie(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([(1, 0, "user", "x", 5, b"")], "id int, n int, who string, said string, path int, kind binary")
    assert [tuple(r)[:4] for r in P.trie(df, conv="id", turn="n", role="who", text="said").orderBy("depth").collect()] == [(1, 0, None, 1), (1, 1, 1, 1)]
    alone = P.nodes(P.rebuilt(P.turns(table(spark, {None: [("user", "x")]}))))
    assert sorted((r.depth, r.conv_id, r.n_convs) for r in alone.collect()) == [(0, None, 1), (1, None, 1)]
