"""What folding costs: an expression that doesn't grow with each step, and no word folded that need not be."""

from pyspark.sql import functions as F

from lexforge.functions import text as T
from lexforge.operators import counts


def test_folding_names_its_text_once(spark):
    """Steps that name their text several times would double the work, and the plan, with each further step."""
    rows = spark.createDataFrame([("Ά",)], "some_text string")
    plan = rows.select(T.strip_accents(T.casefold(F.col("some_text"))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("some_text#") <= 3


def test_folding_of_ascii_and_other_words(spark):
    import unicodedata

    words = ["", "ABC z'Q", "ΌΔΟΣ", "ς", "ẞß", "İi", "é", "각", "ﬃ", "̈́", "line Z\n", None]
    bare = lambda w: unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn"))
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    for r in rows.select("i", T.casefold(F.col("w")).alias("c"), T.strip_accents(F.col("w")).alias("a"), T.strip_accents(T.casefold(F.col("w"))).alias("b")).collect():
        w = words[r.i]
        assert (r.c, r.a, r.b) == ((None,) * 3 if w is None else (w.casefold(), bare(w), bare(w.casefold())))


def test_stored_asks_only_whether_a_word_survives(spark, tmp_path):
    texts = ["", None, "a b", "ΆΒΓΔ long words here", "ab abcd", "áb́"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")
    o = counts.Options(lowercase=True, strip_accents=True, min_length=4)
    assert [r.n for r in counts._with_words(rows, o, whole=False).collect()] == [min(r.n, 1) for r in counts._with_words(rows, o).collect()]
    _, seen = counts.stored(rows, f"{tmp_path}/counts", o)
    assert seen == counts.scan_stats(rows, o).first().asDict()
