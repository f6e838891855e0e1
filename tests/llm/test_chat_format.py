import hashlib
import random

import pytest

from lexforge.llm import chat_format as C
from lexforge.llm import oracle_chat, queries
from tests.llm.helpers import duck, over, same

SCHEMA = "conv_id long, turn long, role string, text string"
ODD = ["", "\\", "<turn>", "</turn>\n", "<text>", "<next>", "\\s\\l", "<</turn>", "\\l/turn>", "é\U0001f600", "\n", "a </turn", "$1 \\1", "\x00\x1f", " "]


def rows_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def brute(rows):
    """turns and learned text of every conversation, by plain Python."""
    key = lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(5)
    text = lambda: rng.choice([None, "".join(rng.choices(ODD, k=rng.randint(0, 6)))])
    role = lambda: rng.choice(["user", "assistant", "assistant", "system", None, "<turn>", "a</turn>\n"])
    rows = [(rng.choice([None, 1, 2, 3, 4]), rng.choice([None, 0, 1, 2, 3]), role(), text()) for _ in range(400)]
    return rows + rows[:20] + [(9, 0, "assistant", "long \\ <turn> é" * 200_000), (9, 1, "assistant", "x")]


def test_round_trip(spark, odd):
    got = C.formatted(rows_of(spark, odd)).select("*", C.parsed(C.F.col("formatted")).alias("turns"), C.learned_text(C.F.col("formatted"), C.F.col("loss_spans")).alias("loss")).collect()
    want = brute(odd)
    assert {r.conv_id for r in got} == set(want) and len(got) == len(want)
    for r in got:
        turns = want[r.conv_id]
        assert [(t.role, t.text) for t in r.turns] == turns
        assert r.loss == "".join(t for role, t in turns if role == "assistant")
        whole, blocks = r.formatted.encode(), 1 + sum(a[0] != b[0] for a, b in zip(turns, turns[1:], strict=False))
        assert whole.count(b"<turn>") == whole.count(b"</turn>\n") == whole.count(b"<text>") == blocks
        assert whole.count(b"<next>") == len(turns) - blocks
        # spans are the learned texts as they stand in the output, and nothing of a control string
        assert len(r.loss_spans) == sum(role == "assistant" for role, _ in turns)
        assert not any(c in whole[s.start : s.start + s.length] for s in r.loss_spans for c in (b"<turn>", b"<text>", b"<next>", b"</turn>"))


def test_digest_of_odd_rows_against_sql(spark, odd):
    df = rows_of(spark, odd)
    c = over(duck("/root/testdata/sf0.001"), spark, df, "conversations")
    assert same(C.digest(C.formatted(C.with_probe(df))), c.sql(oracle_chat.formatting()))


def test_probe(spark, sf):
    r = queries.op11_chat_format(spark, sf).where("conv_id = -7").collect()
    text = C.PROBE[2]
    assert len(r) == 1 and (r[0].n_turns, r[0].loss_chars, r[0].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
    assert r[0].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()


def test_merges_adjacent_turns(spark):
    rows = [(1, 2, "assistant", "c"), (1, 0, "user", "a"), (1, 1, "user", "b")]
    r = C.formatted(rows_of(spark, rows)).collect()[0]
    assert r.formatted == "<turn>user<text>a<next>b</turn>\n<turn>assistant<text>c</turn>\n"
    assert [(s.start, s.length) for s in r.loss_spans] == [(r.formatted.index("c</"), 1)]


def test_empty_table_other_types_and_clashing_columns(spark):
    assert C.digest(C.formatted(rows_of(spark, []))).collect() == []
    df = spark.createDataFrame([("x", "b", "user", "2", 1, 1), ("x", "a", "user", "1", 1, 1)], "id string, n string, who string, said string, formatted int, __turns int")
    r = C.formatted(df, conv="id", turn="n", role="who", text="said", learned="user").collect()
    assert [(x.id, x.formatted) for x in r] == [("x", "<turn>user<text>1<next>2</turn>\n")]


def test_many_turns_of_one_conversation(spark):
    df = spark.range(20_000).selectExpr("5L conv_id", "id turn", "if(id % 3 = 0, 'user', 'assistant') role", "concat('t', id) text")
    r = C.formatted(df).select("formatted", "loss_spans").collect()[0]
    whole = r.formatted.encode()
    assert [whole[s.start : s.start + s.length].decode() for s in r.loss_spans] == [f"t{i}" for i in range(20_000) if i % 3]
