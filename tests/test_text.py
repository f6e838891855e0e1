import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexforge.functions import quotes
from lexforge.functions import text as T
from lexforge.operators import counts


def one(spark, values, body, kind="string"):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r.x for r in df.select("i", body(F.col("t")).alias("x")).orderBy("i").collect()]


def machine(text):
    """Words by a plain state machine."""
    out, word, pending = [], "", ""
    for c in text:
        if unicodedata.category(c).startswith("L"):
            word += pending + c
            pending = ""
        elif c in "'-" and word and not pending:
            pending = c
        else:
            if word:
                out.append(word)
            word = pending = ""
    return [*out, word] if word else out


WORDS = {
    "a--b c-d- 'e' f'g'h 1a2": ["a", "b", "c-d", "e", "f'g'h", "a"],
    "x́y -z-": ["x", "y", "z"],
    "άβ": ["άβ"],
    "ʰabc ªº Ⅳ": ["ʰabc", "ªº"],
    "\U0001d518nicode 中文": ["\U0001d518nicode", "中文"],
}
QUOTED = {
    "«Καλημέρα κόσμε» και “δεύτερο”": ["Καλημέρα κόσμε", "δεύτερο"],
    '"a ` b" c ` d ` e': ["a ` b"],
    "don't 'ναι' it's": ["ναι"],
    "«α 'β' γ»": ["α 'β' γ"],
    '" " x "y"': ["y"],
    '"\n"': [],
    '"ανοιχτό': [],
    "„γερμανικά“ ‘απλά’": ["γερμανικά", "απλά"],
    "l'été 'ένα' ''δύο''": ["ένα", "δύο"],
    "λ'ναι'": [],
}


def test_words(spark):
    assert one(spark, list(WORDS), T.words) == list(WORDS.values())


def test_words_equal_a_state_machine(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice("ab'- é1́ß") for _ in range(rnd.randrange(0, 30))) for _ in range(500)]
    assert one(spark, texts, T.words) == [machine(t) for t in texts]


def test_quoted_segments(spark):
    df = spark.createDataFrame(list(enumerate(QUOTED)), "doc_id int, text string")
    rows = {r.doc_id: r.segments for r in quotes.with_segments(df, "text").collect()}
    assert [rows[i] for i in range(len(QUOTED))] == list(QUOTED.values())


def spans(text):
    """Segments by plain Python: all spans of each kind, the first of those that overlap."""
    kinds = (r'"([^"\n]+)"', r"`([^`\n]+)`", r"(?<!\w)'([^'\n]+)'(?!\w)")
    found = [m for kind in kinds for m in re.finditer(kind, text) if m.group(1).strip()]
    kept, end = [], -1
    for m in sorted(found, key=lambda m: (m.start(), -m.end())):
        if m.start() >= end:
            kept.append(m.group(1).strip())
            end = m.end()
    return kept


def test_segments_equal_plain_python(spark):
    rnd = random.Random(7)
    texts = ["".join(rnd.choices("ab'\"` \n'\"`é\U0001f600_7½\xa0", k=rnd.randint(0, 30))) for _ in range(8000)] + ["x 'a' `b` \"c\" \"d 'e'\" " * 2000]
    df = spark.createDataFrame([*enumerate(texts), (-1, None)], "i int, t string")
    got = {r.i: r.segments for r in quotes.with_segments(df, "t", "none").collect()}
    assert [t for i, t in enumerate(texts) if got[i] != spans(t)] == [] and got[-1] == []
    assert "Python" not in quotes.with_segments(df, "t", "none")._jdf.queryExecution().executedPlan().toString()


def test_sql_functions(spark):
    from lexforge.functions import sql

    names = sql.register(spark, "t_")
    assert len(names) == len(set(names)) == 9 + len(T.SCRIPTS)
    spark.createDataFrame([(0, "«Καλημέρα κόσμε» και 'να' -- a-b"), (1, " \xa0"), (2, None)], "i int, t string").createOrReplaceTempView("t_rows")
    one = lambda q: [tuple(r) for r in spark.sql(q).collect()]
    assert one("SELECT i, t_words(t), t_quoted_segments(t), t_nonblank(t), t_contains_greek(t), t_contains_latin1(t), t_stripped(t) FROM t_rows ORDER BY i") == [
        (0, ["Καλημέρα", "κόσμε", "και", "να", "a-b"], ["Καλημέρα κόσμε", "να"], True, True, False, "«Καλημέρα κόσμε» και 'να' -- a-b"),
        (1, [], [], False, False, False, ""),
        (2, None, None, False, None, None, None),
    ]
    assert one("SELECT i, q.position, q.segment FROM t_rows, LATERAL t_quoted_rows(t) q ORDER BY 1, 2") == [(0, 0, "Καλημέρα κόσμε"), (0, 1, "να")]
    assert one("SELECT w.word FROM t_rows, LATERAL t_word_rows(t) w WHERE w.position > 2 ORDER BY w.position") == [("να",), ("a-b",)]
    assert one("SELECT t_percentage(1, 3), t_percentage(1, 0), t_chars_per_token('abc', 7), t_chars_per_token('', 0), t_static_entry(' -a-b ')") == [(33.33, 0.0, 0.4286, 0.0, " ab ")]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab'\"` \n", max_size=25))
def test_spans_never_overlap_and_stand_in_the_text(text):
    found = spans(text)
    assert all(s in text and s.strip() for s in found)
    assert sum(len(s) + 2 for s in found) <= len(text)


def test_case_and_accents(spark):
    words = ["ΣΑΣ", "σας", "Σας", "Straße", "STRASSE", "ᾳ", None]
    assert one(spark, words, T.casefold) == ["σασ", "σασ", "σασ", "strasse", "strasse", "αι", None]
    assert one(spark, words[:5], T.case_key) == ["σασ", "σασ", "σασ", "strasse", "strasse"]
    words = ["άέήίόύώ", "ϊΐ", "ϋΰ", "ᾳ", "ἁγιο", "ñ", "ç", "ü", "ß"]
    assert one(spark, words, T.strip_accents) == ["αεηιουω", "ιι", "υυ", "α", "αγιο", "n", "c", "u", "ß"]


def test_normalisation(spark):
    df = spark.createDataFrame([(1, "ﬁ it’s é"), (2, "plain é"), (3, None), (4, "½ ʼx")], "i int, t string")
    for form in T.FORMS:
        got = {r.i: r.t for r in T.normalized(df, "t", form).collect()}
        want = {i: (unicodedata.normalize(form, t) if form != "none" else t).replace("’", "'").replace("ʼ", "'") if t else t for i, t in [(1, "ﬁ it’s é"), (2, "plain é"), (3, None), (4, "½ ʼx")]}
        assert got == want
    with pytest.raises(ValueError):
        T.normalized(df, "t", "NFD")


def test_white_space_and_lines(spark):
    texts = ["", " \t\x1c\x85\xa0 　", "x", None, "\x1fa\xa0 ", "a\r\nb\x0bc d\n", "\n", "a\n\nb"]
    assert one(spark, texts, T.nonblank) == [bool(t and t.strip()) for t in texts]
    assert one(spark, texts, T.stripped) == [t.strip() if t is not None else None for t in texts]
    assert one(spark, texts, T.lines) == [t.splitlines() if t is not None else None for t in texts]


def test_scripts(spark):
    assert one(spark, ["abc", "αβ", "ἁ", "é", ""], T.has_script) == [False, True, True, False, False]
    assert one(spark, ["abc", "é"], lambda c: T.has_script(c, "latin1")) == [False, True]


def corpus(spark):
    rows = [(0, "Αθήνα Αθήνα ΑΘΉΝΑ it's", 0.9), (1, "σας ΣΑΣ Σας «δύο λέξεις»", 0.5), (2, " \n", 0.9), (3, None, None), (4, "one Αθήνα", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, quality_score double")


def test_counts_and_options(spark):
    c = corpus(spark)
    get = lambda o: {r["word"]: r["count"] for r in counts.word_counts(c, o).collect()}
    assert get(counts.Options())["Αθήνα"] == 3
    assert get(counts.Options(lowercase=True, script="greek")) == {"αθήνα": 4, "σασ": 3, "δύο": 1, "λέξεισ": 1}
    assert get(counts.Options(lowercase=True, strip_accents=True, min_length=5)) == {"αθηνα": 4, "λεξεισ": 1}
    assert get(counts.Options(min_quality=0.8)) == {"Αθήνα": 2, "ΑΘΉΝΑ": 1, "it's": 1}
    assert get(counts.Options(max_documents=1, min_quality=0.95)) == {}
    assert {r["word"]: r["count"] for r in counts.quoted_word_counts(c).collect()} == {"δύο": 1, "λέξεις": 1}
    assert tuple(counts.scan_stats(c, counts.Options(script="greek")).first()) == (5, 3, 9)
    assert tuple(counts.quoted_stats(c).first()) == (5, 1, 1, 2)
    ranked = counts.ranked(counts.word_counts(c), 1, 2).collect()
    assert [(r["word"], r["count"]) for r in ranked] == [("Αθήνα", 3), ("it's", 1)]
    for bad in (dict(min_length=0), dict(max_documents=0), dict(script="runes"), dict(normalization="x")):
        with pytest.raises(ValueError):
            counts.Options(**bad)


ODD = [
    (0, "ΐ ß straße Αΐ", 0.9), (1, "«δύο ΛΈΞΕΙΣ» and 'one two' `x` ŉ", 0.5), (2, " ", 0.9), (3, None, None), (4, '"α" "" "β γ"', None), (5, 'say "Ünïcödé wörds" ﬁ', 0.2), (6, "12 34 \"5\"", 0.9),
]


@pytest.mark.parametrize(("lowercase", "accents", "more"), [(False, False, {"min_length": 3}), (True, False, {"min_length": 3}), (False, True, {"script": "greek"}), (True, True, {"min_quality": 0.5}), (True, False, {"max_documents": 5, "min_quality": 0.4, "min_length": 2})])
def test_statistics_agree_with_the_counts(spark, tmp_path, lowercase, accents, more):
    c = spark.createDataFrame(ODD, "doc_id long, text string, quality_score double")
    o = counts.Options(lowercase=lowercase, strip_accents=accents, **more)
    total = lambda df: sum(r["count"] for r in df.collect())
    alone = {i: total(counts.word_counts(c.where(f"doc_id = {i}"), counts.Options(lowercase=lowercase, strip_accents=accents, **{k: v for k, v in more.items() if k != "max_documents"}))) for i in range(min(7, more.get("max_documents", 7)))}
    s = counts.scan_stats(c, o).first()
    assert (s.documents_scanned, s.documents_counted, s.total_words) == (len(alone), sum(n > 0 for n in alone.values()), total(counts.word_counts(c, o)))
    q = counts.quoted_stats(c, o).first()
    segments = counts.quoted_segments(c, o).collect()
    assert tuple(q) == (len(alone), len({r.doc_id for r in segments}), len(segments), total(counts.quoted_word_counts(c, o)))
    # one pass gives both
    for quoted, want, rows in ((False, s, counts.word_counts(c, o)), (True, q, counts.quoted_word_counts(c, o))):
        table, seen = counts.stored(c, str(tmp_path / f"{quoted}"), o, quoted)
        assert seen == want.asDict() and sorted(map(tuple, table.collect())) == sorted(map(tuple, rows.collect()))
        observed, seen = counts.counted(c, o, quoted)
        assert sorted(map(tuple, observed.collect())) == sorted(map(tuple, table.collect())) and seen.get == want.asDict()
    empty = counts.stored(c.limit(0), str(tmp_path / "none"), o)
    assert empty[1] == counts.scan_stats(c.limit(0), o).first().asDict() and empty[0].count() == 0


def test_statistics_of_folded_words(spark):
    c = spark.createDataFrame(ODD[:1], "doc_id long, text string, quality_score double")
    o = counts.Options(lowercase=True, min_length=3)
    assert counts.scan_stats(c, o).first().total_words == sum(r["count"] for r in counts.word_counts(c, o).collect()) == 3
    rows = [(0, 'a "b" c', 0.9), (1, 'a "b" c "d"', 0.1), (2, '"e"', None), (3, 'x', 0.9)]
    c = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    assert tuple(counts.quoted_stats(c, counts.Options(min_quality=0.5)).first()) == (4, 1, 1, 1)


def test_folding_equals_python_for_every_code_point(spark):
    from pyspark.sql import functions as F

    from lexforge.functions import folding

    rng = random.Random(9)
    hot = [chr(c) for c in [*range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A7, 0x11C3), *range(0x9BE, 0x9D8), 0x9C7, 0xAC00, 0xAC01, 0x301, 0x308, 0x345, 0x3B9, 0xDF, 0x1FB3, 0x130, 0x1F600]]
    texts = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000] + ["".join(rng.choices(hot, k=rng.randint(0, 8))) for _ in range(5000)]
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"t": texts}))
    got = df.select("t", folding.casefold(F.col("t")).alias("c"), folding.strip_accents(F.col("t")).alias("a")).toPandas()
    assert [c for t, c in zip(got.t, got.c, strict=True) if c != t.casefold()] == []
    bare = lambda t: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn"))
    assert [a for t, a in zip(got.t, got.a, strict=True) if a != bare(t)] == []


def test_folded_counts_need_no_python(spark, sf):
    from lexforge.plans import catalog

    for q in (catalog.word_count_casefold, catalog.word_count_strip_accents):
        assert "Python" not in q(spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_partitions_do_not_matter(spark):
    c = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = {tuple(r) for r in counts.word_counts(c).collect()}
    assert a == {tuple(r) for r in counts.word_counts(c.repartition(7)).collect()}
    merged = counts.merge(counts.word_counts(c.where("doc_id < 50")), counts.word_counts(c.where("doc_id >= 50")))
    assert a == {tuple(r) for r in merged.collect()}


def test_segments_are_stripped_in_one_scan(spark, sf):
    texts = ["say ' padded ' and \" both \" or ` `", "only \" double\t\" here", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.segments for r in quotes.with_segments(rows, "text").collect()}
    assert got == {0: ["padded", "both"], 1: ["double"], 2: []}
    from lexforge.operators import counts

    plan = counts.quoted_word_counts(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == plan.count("FileScan") <= 2 and plan.split("== Initial Plan ==")[0].count("FileScan") == 1


@pytest.mark.parametrize(("min_count", "limit", "buckets", "spread"), [(1, 5, 4, 30), (3, 0, 64, 50), (2, 17, 1, 200), (1, 3, 1 << 16, 1), (5, 1000, 8, 60), (1, 40, 16, 400)])
def test_pruned_counts_equal_full_ones(spark, min_count, limit, buckets, spread):
    """Also with ties at the last place, buckets that hold many words, and fewer words than are asked for."""
    from lexforge.operators import topk

    rnd = random.Random(limit)
    rows = [(i, " ".join(rnd.choice("ÄßxY") + chr(97 + (k % 26)) + "q" * (k // 26) for k in (min(int(rnd.expovariate(3 / spread)), spread) for _ in range(60)))) for i in range(40)]
    c = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for o in (counts.Options(), counts.Options(lowercase=True, strip_accents=True, min_length=3)):
        want = counts.ranked(counts.word_counts(c, o), min_count, limit).collect()
        assert topk.top_counts(c, o, min_count, limit, buckets).collect() == want
    assert topk.top_counts(c.limit(0), o, min_count, limit, buckets).collect() == []
