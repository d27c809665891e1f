from pyspark.sql import functions as F

from hedgewatch.checks import inputs


def test_a_scan_is_dealt_by_its_rows_not_by_its_bytes(spark, tmp_path):
    """One row group is read by one split, however many splits its file is cut into."""
    path = str(tmp_path / "rows")
    spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        dealt = inputs.spread(scan, 5_000)
        sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 100_000 and max(sizes) <= 6_000
        assert dealt.agg(F.sum("id")).first()[0] == 100_000 * 99_999 // 2
        again = inputs.spread(spark.range(0, 20_000, 1, 4), 5_000)
        assert again.rdd.getNumPartitions() == 4  # small and even splits are left alone
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_an_empty_table_is_dealt(spark):
    assert inputs.spread(spark.createDataFrame([], "id bigint"), 10).count() == 0
