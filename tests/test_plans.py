"""Plan helpers."""

import pytest

from assayer.plans import bounded_batches, fresh_names, join_counted


def test_fresh_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, A_ int, b int")
    assert fresh_names(df, "a", "b", "c", "c") == ["a__", "b_", "c", "c_"]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("small", [100, 0])
def test_counted_join_equals_a_plain_join(spark, how, small):
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [("cold", 1), (None, 2), ("none", 3)], "k string, i int")
    right = spark.createDataFrame([("hot", 7, 3000), ("cold", 8, 1)], "k string, v int, n long")
    got = join_counted(left, right, "k", "n", how, small=small)
    assert sorted(map(str, got.collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_batches_are_bounded_by_bytes(spark):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    bounded_batches(spark)
    df = spark.range(300, numPartitions=1).selectExpr("repeat('x', 100000) AS t")
    assert max(r["n"] for r in df.mapInArrow(sizes, "n long").collect()) < 8 << 20
