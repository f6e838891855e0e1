from lexforge.operators import counts


def test_segments_are_made_once(spark):
    """The filter that Spark infers from an explode made them a second time."""
    rows = spark.createDataFrame([(1, "say \"one\" and 'two words' or `three`"), (2, None), (3, "none")], "doc_id int, text string")
    found = counts.quoted_segments(rows)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_sort(") == 1
    assert [tuple(r) for r in found.orderBy("doc_id", "position").collect()] == [(1, 0, "one"), (1, 1, "two words"), (1, 2, "three")]
    assert found.columns == ["doc_id", "position", "segment"]
