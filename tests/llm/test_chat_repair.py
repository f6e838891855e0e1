import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from lexforge.llm import chat_repair as R
from lexforge.llm import oracle_chat
from tests.llm.helpers import duck, over, same

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.rstrip(SPACE)
        out.append(R.BLANK if not kept.strip(SPACE) else R.REPEATED if (role, text) in seen else R.CUT if kept[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def brute(rows, costs=R.Costs()):
    """Cost, audit and repaired text by trying all edits of a few ordered rows (turn, role, text), with up to 3 insertions anywhere."""
    fault, best = faults(rows), None
    options = [[("D", None, costs.delete)] + ([] if f in (R.BLANK, R.REPEATED) else [("K", r, costs.truncated * (f == R.CUT)), *(("R", x, costs.rerole + costs.truncated * (f == R.CUT)) for x in ("user", "assistant"))]) for (_, r, _), f in zip(rows, fault, strict=True)]
    for chosen in itertools.product(*options):
        for n in range(4):
            for at in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                edits = []
                for i in range(len(rows) + 1):
                    edits += ["I"] * at.count(i) + ([i] if i < len(rows) else [])
                for put in itertools.product(("user", "assistant"), repeat=n):
                    put, lines, audit = list(put), [], ""
                    for e in edits:
                        if e == "I":
                            lines.append((put.pop(0), ""))
                            audit += "I"
                        else:
                            audit += chosen[e][0]
                            if chosen[e][1] is not None:
                                lines.append((chosen[e][1], rows[e][2]))
                    if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in lines)):
                        key = (sum(c[2] for c in chosen) + costs.insert * n, audit, "\n".join(f"{r}:{t}" for r, t in lines))
                        best = key if best is None else min(best, key)
    return best


def plain(rows, costs):
    """The whole result of a conversation's ordered rows."""
    turns = {t for t, _, _ in rows if t is not None}
    f = faults(rows)
    illegal = sum((a[1][:1], b[1][:1]) not in R.LEGAL for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, text = brute(rows, costs) if rows else (0, "", "")
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count(R.BLANK), f.count(R.REPEATED), f.count(R.CUT), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def drawn(rng, n):
    role = lambda: rng.choice(["user", "assistant", "system", "user", "assistant", " ", "", "unknown", "sys"])
    return [(rng.choice([None, 0, 1, 2, 5]), role(), rng.choice(["a.", "b!", "c", "", " \n", "d? ", "a."])) for _ in range(n)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))


@pytest.mark.parametrize("costs", [R.Costs(), R.Costs(rerole=3, delete=4, insert=2, truncated=3), R.Costs(1, 3, 1, 0)])
def test_brute_force(spark, costs):
    rng = random.Random(3)
    talks = {i: in_order(drawn(rng, rng.randint(1, 4))) for i in range(70)}
    rows = [(c, *r) for c, talk in talks.items() for r in talk]
    rng.shuffle(rows)
    got = {r.conv_id: tuple(r)[1:] for r in R.repairs(spark.createDataFrame(rows, SCHEMA), costs=costs).collect()}
    assert got == {c: plain(talk, costs) for c, talk in talks.items()}
    assert len({g[6] for g in got.values()}) > 20 and (costs.insert > 2 or any("I" in g[6] for g in got.values()))


def long_rows(rng, convs, n):
    talk = [(rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "c!", "", "d?"]) + rng.choice(["", "x.", "y?"])) for _ in range(200)]
    return [(c, i, *rng.choice(talk)) for c in range(convs) for i in range(n)]


def test_longer_conversations_against_sql(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, *range(9)]), rng.choice([None, "user", "assistant", "system", "x"]), rng.choice([None, "", "a.", "b", "long. " * 20_000])) for _ in range(120)]
    df = spark.createDataFrame(rows + long_rows(rng, 9, 40), SCHEMA)
    c = over(duck("/root/testdata/sf0.001"), spark, df, "conversations")
    c.sql("CREATE OR REPLACE VIEW conversations AS SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, text FROM conversations_rows")
    assert same(R.repairs(R.damaged(df), present=F.col("present")), c.sql(oracle_chat.repair()))


@pytest.mark.parametrize("costs", [R.Costs(), R.Costs(rerole=3, delete=4, insert=1, truncated=3)])
def test_repaired_rows(spark, costs):
    rng = random.Random(4)
    df = spark.createDataFrame(long_rows(rng, 6, 30) + [(50, 0, "assistant", "only."), (51, 0, "system", "s."), (52, 0, "user", "")], SCHEMA)
    plans = {r.conv_id: r for r in R.repairs(df, costs=costs).collect()}
    got = {}
    for r in sorted(R.repaired(df, costs=costs).collect(), key=lambda r: (r.conv_id, r.place)):
        got.setdefault(r.conv_id, []).append(r)
    for c, p in plans.items():
        rows = got.get(c, [])
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in rows).encode()).hexdigest() == p.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows)) and "".join(r.edit for r in rows) == p.audit.replace("D", "")
        assert [r.place for r in rows] == list(range(len(rows))) and all((r.turn is None) == (r.edit == "I") for r in rows)
    assert plans[52].audit == "D" and 52 not in got and plans[50].audit == ("D" if costs == R.Costs() else "IK")


def test_damage(spark):
    rows = [(c, t, "system" if t else None, "a.b!c?") for c in range(40) for t in (None, 0, 1)]
    got = {}
    for r in R.damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.present))
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role = "user" if fate == 4 else role or " "
        text = {1: "", 2: "abc"}.get(fate, text)
        assert got[c, t] == [(role, text, fate != 0)] * (2 if fate == 3 else 1)


def test_nothing_left_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, "user", "x.", 7, False), ("b", 1, "user", "x.", 7, True)], "id string, n int, who string, said string, fault int, there boolean")
    got = {r.id: tuple(r)[1:] for r in R.repairs(df, conv="id", turn="n", role="who", text="said", present=F.col("there")).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert got["a"] == (0, 0, 0, 0, 0, 0, "", nothing) and got["b"][5:7] == (2, "D")
    assert R.repairs(spark.createDataFrame([], SCHEMA)).collect() == [] and R.repaired(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("n", [20_000])
def test_one_long_conversation(n):
    r = R.Repair()
    for i in range(n):
        r.add(i, "user" if i % 2 == 0 else "assistant", b"x.", 0)
    assert r.plan()[5:7] == (0, "K" * n)
