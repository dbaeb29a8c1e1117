import re

from pyspark.sql import functions as F

from marlstone.sources import keyed


def test_lookups_open_few_buckets(spark, tmp_path):
    rows = spark.range(20_000).select((F.col("id") * 7).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    keyed.write_keyed(rows, "keyed_test", "k", str(tmp_path / "t"), buckets=32, distinct_keys=2_000)
    asked = [7 * i for i in range(0, 20_000, 2_500)] + [3, None, 7 * 12_345, 7 * 12_345]
    got = keyed.lookup(spark, "keyed_test", "k", asked)
    assert sorted(r.k for r in got.collect()) == sorted({k for k in asked if k is not None and k % 7 == 0})
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are pruned without being told
    plan = keyed.lookup(spark, "keyed_test", "k", asked)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    taken = re.search(r"SelectedBucketsCount: (\d+) out of (\d+)", plan)
    assert taken and int(taken[1]) <= 10 and int(taken[2]) == 32 and "PushedFilters: [In(k" in plan
    # One file a bucket, one row group a file, so at most as many row groups as keys are opened; a miss is ruled out by its filter.
    assert len(list((tmp_path / "t").glob("*.parquet"))) == 32 and got.inputFiles() and len({r.f for r in got.select(F.input_file_name().alias("f")).collect()}) <= 9
    assert keyed.lookup(spark, "keyed_test", "k", [None]).collect() == []
    many = keyed.lookup_all(spark, "keyed_test", "k", spark.range(0, 7_000, 5).select(F.col("id").alias("k")))
    assert sorted(r.k for r in many.collect()) == [k for k in range(0, 7_000, 5) if k % 7 == 0]
    spark.sql("DROP TABLE keyed_test")


def test_bloom_filters_are_written(spark, tmp_path):
    import pyarrow.parquet as pq

    keyed.write_keyed(spark.range(5_000).withColumnRenamed("id", "k"), "keyed_bloom", "k", str(tmp_path / "b"), buckets=4, distinct_keys=2_000)
    with_filter = sum(p.stat().st_size for p in (tmp_path / "b").glob("*.parquet"))
    spark.range(5_000).withColumnRenamed("id", "k").repartition(4, "k").sortWithinPartitions("k").write.parquet(str(tmp_path / "plain"))
    without = sum(p.stat().st_size for p in (tmp_path / "plain").glob("*.parquet"))
    assert with_filter > without and all(pq.read_table(p).num_rows for p in (tmp_path / "b").glob("*.parquet"))
    spark.sql("DROP TABLE keyed_bloom")
