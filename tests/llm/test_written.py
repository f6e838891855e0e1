"""Tables on the way: what their writes leave behind."""

import time

from pyspark.sql import functions as F

from lexforge.llm import common


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f and f.endswith(".data")}


def test_shuffle_files_go_with_the_write(spark):
    rows = spark.range(5000).groupBy((F.col("id") % 97).alias("k")).count()
    joined = rows.join(spark.range(97).withColumnRenamed("id", "k").repartition(3, "k").hint("merge"), "k")
    before = _shuffle_files(spark)
    table = common.written(joined, "test")
    end = time.time() + 20
    while _shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not _shuffle_files(spark) - before
    assert table.count() == 97 and table.agg(F.sum("count")).first()[0] == 5000
    # the rows can be planned again: another query has its own shuffles
    assert joined.count() == 97 and common.written(joined, "test").count() == 97


def test_the_setting_is_put_back(spark):
    for value in (None, "false", "true"):
        if value is not None:
            spark.conf.set(common._CLEANUP, value)
        common.written(spark.range(3), "test")
        assert spark.conf.get(common._CLEANUP, None) == value
        spark.conf.unset(common._CLEANUP)


def test_scopes_of_threads_are_their_own(spark):
    import os
    import threading

    found, inside, out = {}, threading.Barrier(2), threading.Barrier(2)

    def run(name, first):
        with common.scratch(spark):
            found[name] = common.written(spark.range(3), name)
            inside.wait(60)
            if not first:
                out.wait(60)  # the other scope is left meanwhile
                found["still"] = found[name].count()
        if first:
            out.wait(60)

    threads = [threading.Thread(target=run, args=(n, n == "a")) for n in ("a", "b")]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    assert found["still"] == 3
    paths = [found[n].inputFiles()[0].removeprefix("file://").rpartition("/")[0] for n in ("a", "b")]
    assert not any(os.path.exists(p) for p in paths)
