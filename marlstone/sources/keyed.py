"""Tables for lookups by a unique key: bucketed and sorted by it, with Bloom filters.

A lookup of a batch of keys opens the buckets that can hold them, at most one a key, and in these the row groups whose range
and filter do not rule all of them out. So it costs by the number of keys and not by the size of the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys of one lookup at most; more are a join.
MOST_KEYS = 1_000


def write_keyed(rows: DataFrame, table: str, key: str, path: str, buckets: int = 64, distinct_keys: int = 1_000_000) -> None:
    """Write ``rows`` as ``table`` at ``path``, a file a bucket. ``distinct_keys`` of one file is what its filter is made for."""
    writer = rows.repartition(buckets, key).write.mode("overwrite").format("parquet").option("path", path)
    writer = writer.option(f"parquet.bloom.filter.enabled#{key}", "true").option(f"parquet.bloom.filter.expected.ndv#{key}", str(distinct_keys))
    writer.bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def lookup(spark: SparkSession, table: str, key: str, keys: list) -> DataFrame:
    """The rows of ``keys``. A null key is in no row; more than `MOST_KEYS` are for a join (`lookup_all`)."""
    keys = [k for k in dict.fromkeys(keys) if k is not None]
    if len(keys) > MOST_KEYS:
        raise ValueError(f"{len(keys)} keys in one lookup; join them instead")
    return spark.table(table).filter(F.col(key).isin(keys) if keys else F.lit(False))


def lookup_all(spark: SparkSession, table: str, key: str, keys: DataFrame) -> DataFrame:
    """The rows of the keys in a table of any size. The keyed table is not shuffled, as it lies by key already."""
    return spark.table(table).join(keys.select(key).distinct(), key, "left_semi")
