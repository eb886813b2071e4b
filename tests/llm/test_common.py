import pytest
from pyspark.sql import functions as F

from civicpulse.llm import common


def test_scratch_tables_can_be_cleared(spark):
    common.clear_scratch(spark)
    df = common.materialise(spark.range(5), "t")
    other = common.materialise(spark.range(3), "t")
    common.drop_scratch(other)
    common.drop_scratch(other)
    assert df.count() == 5
    assert common.clear_scratch(spark) == 1 and common.clear_scratch(spark) == 0


def test_prefix_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"), (F.col("id") % 13).alias("n"))
    rows = sorted((r.k, r.n, r.at) for r in common.prefix_sums(df, ["k"], "n", "at").collect())
    total = 0
    for _, n, at in rows:
        assert at == total
        total += n
    assert common.prefix_sums(df.limit(0), ["k"], "n", "at").collect() == []

@pytest.mark.parametrize("merge", [False, True])
def test_prefix_sums_of_many_ranges(spark, merge):
    """Sums run on over all ranges, also where small ones are merged into fewer files."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    try:
        df = spark.range(3000, numPartitions=3).selectExpr("(id * 7919) % 3001 AS k", "id % 5 AS n")
        found = common.prefix_sums(df, ["k"], "n", "at", merge=merge)
        rows, ranges = sorted((r.k, r.n, r.at) for r in found.collect()), len(found.inputFiles())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [r[2] for r in rows] == [sum(r[1] for r in rows[:k]) for k in range(len(rows))]
    assert ranges < 40 if merge else ranges == 40


def test_small_batches_last_as_long_as_their_block(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    most = lambda: max(r.n for r in spark.range(5000, numPartitions=1).mapInArrow(sizes, "n long").collect())
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with common.small_batches(spark, 700):
        assert most() == 700
    assert spark.conf.get(name) == before and most() > 700
