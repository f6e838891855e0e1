import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lexforge.llm import quality, queries


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    cover = {i + k for i in range(len(ws) - 2) if at[tuple(ws[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), n < 50 or 100 * len(cover) > 50 * n


def histograms(text):
    text = text or ""
    ws = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    common = [ws[w] for w in quality.COMMON]
    classes = []
    import regex

    for p in quality.CLASSES:
        rest = regex.sub(p, "", text)
        classes.append(len(text) - len(rest))
        text = rest
    return [*common, sum(ws.values()) - sum(common)], [*classes, len(text)]


def js(p, q):
    n, m = sum(p), sum(q)
    if not n or not m:
        return 0.0
    out = 0
    for a, b in zip(p, q, strict=True):
        a, b = a / n, b / m
        mid = (a + b) / 2
        out += sum(x * math.log2(x / mid) for x in (a, b) if x) / 2
    return math.sqrt(max(out, 0))


def expected(rows):
    refs = {}
    for _, text, lang in rows:
        common, classes = histograms(text)
        if sum(common) >= 50 and classes[5] <= 0.01 * sum(classes) and classes[2] <= 0.2 * sum(classes):
            old = refs.get(lang, ([0] * len(common), [0] * len(classes)))
            refs[lang] = [a + b for a, b in zip(old[0], common, strict=True)], [a + b for a, b in zip(old[1], classes, strict=True)]
    out = []
    for d, text, lang in rows:
        base = brute(text)
        common, classes = histograms(text)
        ref = refs.get(lang)
        far = False
        if ref and base[0] >= 50 and sum(ref[0]) >= quality.MIN_REFERENCE:
            one, two, n = js(classes, ref[1]), js(common, ref[0]), base[0]
            mixed = (ref[1][4] + ref[1][5]) / sum(ref[1])
            far = one > quality.MAX_CLASS + quality.NOISE / n and two > quality.MAX_COMMON
            far = far or one > quality.MAX_CLASS + quality.CLASS_ALONE / n + quality.MIXED * mixed or two > quality.MAX_COMMON + quality.COMMON_ALONE / math.sqrt(n)
        out.append((d, *base, not base[-1] and not far))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(queries.op8_quality_rules(spark, sf)) == expected(rows)


def test_odd_rows(spark):
    rows = [(1, None, None), (None, "", "en"), (2, "a b a b a b " * 40, "xx"), (2, "a b a b a b " * 40, "xx"), (3, "x " * 30_000, "en"), (4, "the\n\n \nthe\nthe", None), (5, "a b c d a b c", "en"), (6, "** ||", "")]
    rows += [(10 + k, " ".join(f"w{(i * 7 + k) % 997}" for i in range(80 * k)), "en") for k in range(12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 key", "2 kept", "3 n_words")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = expected(rows)
    assert got(quality.report(d).select(*names)) == want
    left = quality.passed(d)
    assert left.columns == d.columns and left.count() == sum(r[-1] for r in want)
    assert quality.report(d.limit(0)).count() == 0 and quality.passed(d.limit(0)).count() == 0


def test_one_scan(spark, sf):
    """References and verdicts come from the written counts: the texts are read by one job."""
    plan = quality.report(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and plan.count("FileScan parquet") <= 2


def test_labels(spark):
    sf = "/root/testdata/sf0.01"
    rows = quality.report(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    bad, good = [r.kept for r in rows if not r.quality], [r.kept for r in rows if r.quality]
    assert sum(bad) <= 0.05 * len(bad) and sum(good) >= 0.98 * len(good)


def test_partly_junk(spark):
    rnd = random.Random(2)
    found = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("doc_id", "text", "lang")
    clean = [(r.doc_id, r.text, r.lang) for r in quality.report(found).where("kept and n_words >= 400").select("doc_id").join(found, "doc_id").orderBy("doc_id").limit(30).collect()]
    greek = ["".join(rnd.choice("αβγδεζηθικλμνο") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]  # of no list
    clean += [(10**6 + i, " ".join(rnd.choice(greek) for _ in range(450)), "el") for i in range(30)]
    junk = []
    for d, text, lang in clean[::3]:
        for k, letters in enumerate(("#*$%&|<>", "#*$%0123456789")):
            ws = ["".join(rnd.choice(letters) for _ in w) if rnd.random() < 0.3 else w for w in text.split()]
            junk.append((10**7 * (k + 1) + d, " ".join(ws), lang))
    got = {r.doc_id: r.kept for r in quality.report(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string")).collect()}
    assert all(got[d] for d, _, _ in clean)
    assert not any(got[d] for d, _, _ in junk)


def test_common_words_of_each_language(spark):
    words = "the of and to in is that for with was de la le les et des en un une que der die und den das von zu mit ist nicht el los las del se por con para no y".split()
    counts = spark.createDataFrame([(words + ["other"],)], "w array<string>").select(quality.common_counts(F.col("w")).alias("c")).first().c
    assert counts == [1] * 41
