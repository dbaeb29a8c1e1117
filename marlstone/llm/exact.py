"""Exact dedup with a heavy-hitter split.

Texts are equal when they are identical after every run of white space has become
one space; what is compared is the SHA-256 of that.

Digests that many rows share are found by Misra-Gries: every task keeps at most
`COUNTERS` counters, and the summaries of tasks are merged some at a time until one
is left. A digest of more than 1 / (`COUNTERS` + 1) of all rows is in it for certain. What it
holds is then counted exactly over all rows, with partial sums in each task, and the
digests that are as frequent as that are the winners, at most `COUNTERS` of them.
They are broadcast with the row that stays, so their copies are settled where they
lie. All other digests, none of which holds a large share of the rows, are grouped
by an ordinary shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, unused

#: Counters of a summary, and so the most rows that are ever broadcast; summaries that one task merges.
COUNTERS, MERGED = 512, 16
SPACES = r"[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """SHA-256, as 32 bytes, of the text with each run of white space as one space; null is an empty text."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " "), 256))


def _trimmed(counts: Counter, most: int) -> Counter:
    """The Misra-Gries step for any number of counters: all fall by the largest that must go, and those at 0 go."""
    if len(counts) <= most:
        return counts
    n = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    least = int(np.partition(n, len(n) - most - 1)[len(n) - most - 1])
    return Counter({d: c - least for d, c in counts.items() if c > least})


def _summary(most: int):
    """Rows of (digest, n) to the summary of a task: at most ``most`` such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            sums = pa.Table.from_batches([b]).group_by("digest").aggregate([("n", "sum")])
            for d, n in zip(sums.column("digest").to_pylist(), sums.column("n_sum").to_pylist(), strict=True):
                counts[d] += n
            counts = _trimmed(counts, most)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return run


def frequent(digests: DataFrame, counters: int = COUNTERS) -> list[bytes]:
    """At most ``counters`` digests, among them each of more than 1 / (``counters`` + 1) of all rows."""
    parts = digests.rdd.getNumPartitions()
    summary = digests.select("digest", F.lit(1).cast("long").alias("n")).mapInArrow(_summary(counters), "digest binary, n long")
    while parts > 1:
        parts = -(-parts // MERGED)
        summary = summary.repartition(parts).mapInArrow(_summary(counters), "digest binary, n long")
    return [bytes(r["digest"]) for r in summary.select("digest").collect()]


def _winners(rows: DataFrame, counters: int) -> DataFrame:
    """(digest, first, group_size) of the frequent digests, with exact counts: at most ``counters`` rows."""
    spark = rows.sparkSession
    found = spark.createDataFrame([(bytearray(d),) for d in frequent(rows, counters)], "digest binary")
    total = rows.count()
    counted = rows.join(F.broadcast(found), "digest").groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("group_size"))
    counted = counted.filter(F.col("group_size") * (counters + 1) > total)
    return spark.createDataFrame(counted.collect(), counted.schema)


def exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, digest, keep_id, group_size, kept.

    Of equal texts the row with the smallest doc_id stays, of several such rows the one that is read
    first; rows without doc_id come last. A null text is an empty one, and all empty texts are equal. Exactly one row of a
    group has ``kept``. Other columns are not looked at; an empty table gives no rows.
    """
    place = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", F.monotonically_increasing_id().alias("row")).alias("place")
    rows = cut(docs.select(text_digest(F.col("text")).alias("digest"), place))
    winners = _winners(rows, counters)
    heavy, light = rows.join(F.broadcast(winners), "digest"), rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = light.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("group_size"))
    out = heavy.unionByName(light.join(groups, "digest"))
    kept = F.col("place.row") == F.col("first.row")
    return out.select(F.col("place.doc_id").alias("doc_id"), "digest", F.col("first.doc_id").alias("keep_id"), "group_size", kept.alias("kept"))


def drop_exact_duplicates(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that of the smallest doc_id, as in `exact_duplicates`.

    Copies of frequent texts are removed where they are read. Of all other rows a task passes on one a digest
    at most. Columns stay as they are.
    """
    digest, turn, place = unused(docs, "text_digest"), unused(docs, "text_turn"), unused(docs, "text_place")
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    rows = cut(docs.select(text_digest(F.col("text")).alias("digest"), order.alias("place")))
    winners = _winners(rows, counters)
    own = docs.withColumn(digest, text_digest(F.col("text"))).withColumn(place, order)
    won = F.broadcast(winners.select(F.col("digest").alias(digest), F.col("first").alias(turn)))
    heavy = own.join(won, digest).filter(F.col(place) == F.col(turn)).drop(turn)
    light = own.join(won, digest, "left_anti")
    # What is left of the frequent texts are the rows that share the winner's doc_id.
    first = F.row_number().over(Window.partitionBy(digest).orderBy(place))
    return heavy.unionByName(light).withColumn(turn, first).filter(F.col(turn) == 1).select(*docs.columns)

