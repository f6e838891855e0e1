import datetime as dt

from pyspark.sql import functions as F

from lexforge.llm import queries, url_filter
from tests.llm.helpers import duck, same


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def brute(captures, entries):
    lists = {}
    for name, key, action, d in set(entries):
        if None not in (name, key, action, d):
            lists.setdefault((name, key), []).append((d, action))
    out = []
    for i, url, d in captures:
        keys = set()
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            for c in "?#":
                rest = rest.split(c)[0]
            host, _, path = rest.partition("/")
            host = host.split("@")[-1].split(":")[0].lower()
            labels = host.split(".")
            keys |= {".".join(labels[k:]) for k in range(len(labels) - 1)}
            parts = [x for x in path.split("/") if x]
            keys |= {host + "/" + "/".join(parts[: k + 1]) for k in range(len(parts))} if host else set()
        n = 0
        for (_, key), acts in lists.items():
            if key in keys and d is not None:
                past = [a for a in sorted(acts) if a[0] <= d]
                n += bool(past) and past[-1][1] == "add"
        out.append((i, n > 0, n))
    return sorted(out, key=str)


def test_against_brute_force(spark, monkeypatch):
    urls = ["http://a.b.example.com/x/y?q=1", "https://user@Example.com:80/x", "http://example.com", "ftp://b.example.com//x//z#f", "nonsense", "", None, "http://localhost/x", "http://x.b.example.com/x/y/z"]
    captures = [(i * 40 + d, u, day(d)) for i, u in enumerate(urls) for d in range(0, 40, 3)] + [(9, urls[0], None), (9, urls[0], day(5)), (9, urls[0], day(5)), (None, urls[0], day(20))]
    entries = [("l", "example.com", "add", day(10)), ("l", "example.com", "remove", day(20)), ("l", "example.com", "add", day(30)), ("m", "b.example.com", "add", day(5)), ("m", "b.example.com", "add", day(8)), ("m", "b.example.com", "remove", day(15)),
               ("p", "example.com/x", "add", day(3)), ("p", "a.b.example.com/x/y", "add", day(12)), ("p", "a.b.example.com/x/y", "remove", day(12)), ("l", None, "add", day(1)), ("l", "example.com", "add", None), ("l", "example.com", "add", day(10))]
    c = spark.createDataFrame(captures, "page_id long, url string, day date").selectExpr("*", "1 host", "2 uid", "'x' key", "3 row")
    e = spark.createDataFrame(entries, "list string, key string, action string, day date")
    for sent in (100, 0):
        monkeypatch.setattr(url_filter, "SENT", sent)
        got = sorted(((r.row.page_id, r.filtered, r.n_entries) for r in url_filter.judged(c, e).collect()), key=str)
        assert got == brute(captures, entries)
    left = url_filter.passed(c, e)
    assert left.columns == c.columns and left.count() == sum(not x[1] for x in got)
    assert url_filter.judged(c.limit(0), e).count() == 0 and url_filter.passed(c, e.limit(0)).count() == len(captures)


def test_against_sql(spark):
    for sf in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        n = same(queries.op2_url_filter(spark, sf), duck(sf).sql(queries.oracle_sql()["op2_url_filter"]))
        assert n
    rows = queries.op2_url_filter(spark, sf).collect()
    assert 0 < sum(r.filtered for r in rows) < len(rows)


def test_shuffled_captures(spark):
    """Captures that come from a join, dropDuplicates or a repartition get the verdicts of a plain scan."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html")
    entries = url_filter.drawn_entries(pages)
    plain = pages.withColumn("day", url_filter.fetch_day(F.col("url")))
    ids = spark.range(0, 10**6).withColumnRenamed("id", "page_id")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        rows = lambda d: sorted((r.row.page_id, r.filtered, r.n_entries) for r in url_filter.judged(d, entries).select(F.struct("row.page_id").alias("row"), "filtered", "n_entries").collect())
        lists = [(r.list, r.key, r.action, r.day) for r in entries.collect()]
        few = plain.orderBy("page_id").limit(300)
        want = brute([(r.page_id, r.url, r.day) for r in few.select("page_id", "url", "day").collect()], lists)
        assert sorted(want) == rows(few)
        found = rows(plain)
        assert 0 < sum(x[1] for x in found) < len(found)
        for other in (plain.dropDuplicates(["page_id"]), plain.dropDuplicates(), plain.join(ids, "page_id"), plain.repartition(64, "page_id"), plain.repartition(7)):
            assert rows(other) == found
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_long_url(spark):
    url = "http://a.example.com/" + "/".join(f"p{i}" for i in range(3000))
    c = spark.createDataFrame([(1, url, day(9))], "page_id long, url string, day date")
    e = spark.createDataFrame([("l", "a.example.com/p0/p1", "add", day(9))], "list string, key string, action string, day date")
    assert [(r.filtered, r.n_entries) for r in url_filter.judged(c, e).collect()] == [(True, 1)]
