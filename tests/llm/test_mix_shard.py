import duckdb
from pyspark.sql import functions as F

from lexforge.llm import mix, queries, sharding
from tests.llm.helpers import duck, same


def odd(spark):
    rows = [(i, " ".join(["w"] * (i % 17 + 1)), f"s{i % 3}") for i in range(200)]
    rows += [(5, "a b c", None)] * 3 + [(None, "x y", "s0"), (7, None, "s1"), (8, "", "empty"), (9, " \n", None), (999, "w " * 5000, "huge")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 k", "2 size", "'q' shard", "3 h")


def test_mix_against_sql(spark, sf):
    c = duck(sf)
    assert same(queries.op1_source_mix(spark, sf), c.sql(queries.oracle_sql()["op1_source_mix"]))


def test_mix_odd_rows(spark):
    d = odd(spark)
    c = duckdb.connect()
    documents = d.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    c.sql("CREATE TABLE documents AS SELECT * FROM documents")
    got = mix.report(d)
    assert same(got, c.sql(queries.oracle_sql()["op1_source_mix"])) == d.count()
    rows = got.collect()
    assert all(r.taken <= 3 * r["size"] for r in rows)
    out = mix.mixed(d)
    assert out.columns == d.columns
    assert out.count() == sum(r.taken // r["size"] for r in rows if r["size"])
    assert mix.report(d.limit(0)).count() == 0 and mix.mixed(d.limit(0)).count() == 0


def test_mix_reaches_targets(spark):
    rows = mix.report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    assert abs(sum(t for _, t in by) - sum(r["size"] for r in rows)) < 1e-3 * sum(r["size"] for r in rows)
    for (size, target), taken in by.items():  # twenty sources of fifty documents
        assert target <= 3 * size and sum(taken) <= target + 1e-6 and target - sum(taken) <= max(0.02 * target, 50)


def test_mix_passes_over_groups(spark):
    """Rows of one id and text, a third of a source's words, that fit nowhere as a whole: the fills go on behind them."""
    one = [(None, "a b c d e", "s0")] * 400 + [(i, "v w x y z", "s0") for i in range(800)]
    rest = [(10_000 + i, "w " * 5, f"t{i % 2}") for i in range(400)]
    d = spark.createDataFrame(one + rest, "doc_id long, text string, source string")
    documents = d.toPandas().astype({"doc_id": "Int64"})  # noqa: F841
    c = duckdb.connect()
    c.sql("CREATE TABLE documents AS SELECT * FROM documents")
    got = mix.report(d)
    assert same(got, c.sql(queries.oracle_sql()["op1_source_mix"])) == d.count()
    rows = [r for r in got.collect() if r.source_size == 6000]
    # the target, 2,000 words, is the group's size: it fits only if no other document comes before it
    assert sum(r.taken for r in rows if r.doc_id is None) == 0
    assert 0 <= rows[0].target - sum(r.taken for r in rows) < 5


def test_mix_differs_by_text(spark):
    """Null ids are no group: nearly the whole target is met although all rows of a source have one."""
    d = spark.createDataFrame([(None, f"a b c d t{i}", f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    by = {}
    for r in mix.report(d).collect():
        by[r.target] = by.get(r.target, 0) + r.taken
    assert len(by) == 3 and all(0 <= target - taken < 5 for target, taken in by.items())


def shards(c, limit):
    sql = f"WITH docs AS (SELECT doc_id, text FROM documents), {sharding.SQL.replace(f'<= {sharding.LIMIT}', f'<= {limit}')} SELECT doc_id, n_bytes, substr(lpad(bin(h), 60, '0'), 1, x.d) AS shard, CAST(x.d AS INTEGER) AS depth, x.s AS shard_bytes, x.s > {limit} AS over_limit FROM f"
    return c.sql(sql)


def test_shards_against_sql(spark, sf):
    c = duck(sf)
    assert same(queries.op7_sharding(spark, sf), c.sql(queries.oracle_sql()["op7_sharding"]))
    d = spark.read.parquet(f"{sf}/documents.parquet")
    most = max(len(r.text.encode()) for r in d.collect())
    for limit, bits in ((most, 12), (most, 2), (200_000, 3)):
        got = sharding.report(d, limit=limit, bits=bits)
        same(got, shards(c, limit))
        assert got.where("over_limit").count() == 0


def test_shards_odd_rows(spark):
    d = odd(spark)
    got = sharding.report(d, limit=60, bits=5)
    assert got.count() == d.count()
    by = {}
    for r in got.collect():
        by.setdefault(r.shard, []).append(r)
    for rows in by.values():
        assert {r.shard_bytes for r in rows} == {sum(r.n_bytes for r in rows)} and {r.over_limit for r in rows} == {rows[0].shard_bytes > 60}
        assert not rows[0].over_limit or len({r.doc_id for r in rows}) == 1
    out = sharding.sharded(d, limit=60)
    assert sorted(out.columns) == sorted(d.columns) and out.count() == d.count()
    assert sharding.report(d.limit(0)).count() == 0


def test_query_splits(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_sharding(spark, sf)
    assert same(got, duck(sf).sql(queries.oracle_sql()["op7_sharding"]))
    assert len({r.depth for r in got.collect()}) > 1


def test_written_shards(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d = d.where("octet_length(text) < 20000").unionByName(d.limit(1).withColumn("text", F.lit("long " * 40_000)).withColumn("doc_id", F.lit(10**9)))
    sharding.write(d, str(tmp_path / "s"), limit=100_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(map(str, back.select(*d.columns).collect())) == sorted(map(str, d.collect()))
    sizes = {}
    for r in spark.read.parquet(str(tmp_path / "s")).select("doc_id", F.input_file_name().alias("f"), F.octet_length("text").alias("n")).collect():
        sizes.setdefault(r.f, []).append(r.n)
    assert len(sizes) > 5 and all(sum(x) <= 100_000 or len(x) == 1 for x in sizes.values())
