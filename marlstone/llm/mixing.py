"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document copy gets a virtual finish time: the tokens its source has sent
up to and including it, in shuffled order, divided by the source's target. The
mix is the copies in order of finish time, cut at the total budget.

The shuffled order is a hash of seed and doc_id. Documents are range-sorted by source and
that order, rows of equal keys too, so no task holds a whole source or all rows of one
doc_id; each range adds the sums of its source's earlier ranges. Copies are then
range-sorted by finish time over all sources and cut in the range in which the budget ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: Virtual finish times are integers of 1 / UNIT, at most 2**48 - 1.
UNIT = 1 << 30


def cyclic_weight(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the source's rank from 0."""
    return (rank % 3 + 1).cast("double")


def _plan(docs: DataFrame, seed: int, keyed: bool = False) -> DataFrame:
    # A source's key: code point order, null last, never null.
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    return docs.select(
        "doc_id",
        "source",
        key.alias("src"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 16).alias("k"),
        *([F.xxhash64("text").alias("text_key")] if keyed else []),
    )


def targets(plan: DataFrame, share: float = 1.0, max_repeats: int = 3, weights: dict[str, float] | None = None) -> DataFrame:
    """(src, source_size, target) of each source, by filling to a common level.

    Of ``share`` of all sizes each source gets its weight's part, at most
    ``max_repeats`` times its size; what is above goes to the others by weight.
    One row a source; sources are a dimension, so the windows over all of them
    are small.
    """
    by_name = Window.orderBy("src")
    s = plan.groupBy("src").agg(F.sum("size").alias("source_size"), F.first("source").alias("source"))
    if weights is None:
        s = s.withColumn("w", cyclic_weight(F.row_number().over(by_name) - 1))
    else:
        given = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else None
        s = s.withColumn("w", F.coalesce(given[F.col("source")], F.lit(0.0)) if given is not None else F.lit(0.0))
    cap = (F.col("source_size") * max_repeats).cast("double")
    s = s.filter("w > 0").withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    by_ratio = Window.orderBy("ratio", "src")
    all_rows = Window.orderBy("ratio", "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("total", F.sum("source_size").over(all_rows) * F.lit(float(share)))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    # Sources whose level is reached are capped; the first that isn't sets the level of the others.
    s = s.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    s = s.withColumn("level", F.min(F.when(~F.col("capped"), F.struct("ratio", "src", "level"))).over(all_rows)["level"])
    return s.select("src", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("w")).alias("target"))


def _ranged(rows: DataFrame, *by: str) -> DataFrame:
    """``rows`` range-sorted, with the number of their range as ``part``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("part", F.spark_partition_id())


def _end(copies: DataFrame, budget: float) -> int | None:
    """The finish time of the first copy, in the global order of (f, size) rows, that no longer fits the budget; None: all fit."""
    stream = cut(_ranged(copies, "f"))
    # One row a range, then the rows of one range.
    parts = stream.groupBy("part").agg(F.sum("size").alias("s"))
    upto = F.sum("s").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = parts.withColumn("upto", upto).filter(F.col("upto") > F.lit(budget)).orderBy("part").first()
    if last is None:
        return None
    ends = stream.filter(F.col("part") == last["part"]).groupBy("f").agg(F.sum("size").alias("s"))
    upto = F.lit(last["upto"] - last["s"]) + F.sum("s").over(Window.orderBy("f").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ends.withColumn("upto", upto).filter(F.col("upto") > F.lit(budget)).agg(F.min("f")).first()[0]


def mix(docs: DataFrame, share: float = 1.0, max_repeats: int = 3, weights: dict[str, float] | None = None, seed: int = 17, keyed: bool = False) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, finish, taken, copies.

    ``taken`` is size times ``copies``, the number of passes in which the mix
    takes the document. Null text has size 0, null sources are one source, a
    source of weight 0 or without words has taken 0. Repeated rows count as
    documents of their own, whose keys are equal; equal shuffle keys go by size. An empty table gives
    no rows. Same input and seed, same mix. With ``keyed`` the hash of the text is a column, text_key.
    """
    plan, key = cut(_plan(docs, seed, keyed)), ["text_key"] if keyed else []
    goal = targets(plan, share, max_repeats, weights)
    order = ["k", "size", "doc_id", "row"]
    plan = cut(_ranged(plan.withColumn("row", F.monotonically_increasing_id()), "src", *order))
    sums = plan.groupBy("src", "part").agg(F.sum("size").alias("part_size"))
    earlier = Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("src", "part", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("before"))
    sums = sums.join(goal, "src", "left")
    inside = Window.partitionBy("src", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sent = F.col("before") + F.sum("size").over(inside)
    rows = cut(plan.join(sums, ["src", "part"]).withColumn("sent", sent).select("doc_id", "source", "size", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), "sent", *key))

    def finish(copy: int) -> Column:
        t = F.floor((F.lit(copy) * F.col("source_size") + F.col("sent")).cast("double") / F.col("target") * F.lit(float(UNIT)))
        return F.when((F.col("target") > 0) & (F.col("size") > 0), F.least(t, F.lit(2**48 - 1)).cast("long"))

    rows = rows.withColumns({f"f{c}": finish(c) for c in range(max_repeats)})
    copies = rows.select("size", F.explode(F.array(*[F.col(f"f{c}") for c in range(max_repeats)])).alias("f")).filter("f is not null")
    budget = rows.agg(F.sum("size")).first()[0] or 0
    limit = _end(copies, budget * share)
    taken = [F.coalesce(F.col(f"f{c}") < F.lit(limit if limit is not None else 2**62), F.lit(False)).cast("long") for c in range(max_repeats)]
    out = rows.withColumn("copies", sum(taken[1:], taken[0]))
    return out.select("doc_id", "source", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), "target", F.col("f0").alias("finish"), (F.col("size") * F.col("copies")).alias("taken"), "copies", *key)


def mixed_stream(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: one row per taken copy with its virtual finish time, globally sorted by it."""
    plan = mix(docs, **options)
    copy = F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy")
    return plan.filter("copies > 0").select("doc_id", "source", "size", "source_size", "target", "finish", copy).withColumn("finish", F.col("finish") + (F.col("copy") * F.col("source_size") / F.col("target") * F.lit(float(UNIT))).cast("long")).orderBy("finish", "doc_id", "copy")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with all their columns and size, source_size, target, taken and copies: how often each is to be read.

    Rows with one doc_id, source and text come out as one, with the copies of all. Columns of ``docs`` with those names are replaced.
    """
    told = ["size", "source_size", "target", "taken", "copies"]
    own, key = [c for c in docs.columns if c.lower() not in told], ["doc_id", "source", "text_key"]
    plan = mix(docs, keyed=True, **options).filter("copies > 0").groupBy(*key).agg(*[F.first(c).alias(c) for c in told[:3]], *[F.sum(c).alias(c) for c in told[3:]])
    plan = plan.withColumnsRenamed({c: f"mix_{c}" for c in key})
    rows = docs.select(*own).withColumn("mix_key", F.xxhash64("text"))
    rows = rows.withColumn("mix_turn", F.row_number().over(Window.partitionBy("doc_id", "source", "mix_key").orderBy("mix_key"))).filter("mix_turn = 1")
    same = F.col("doc_id").eqNullSafe(F.col("mix_doc_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("mix_key") == F.col("mix_text_key"))
    return rows.join(plan, same).select(*own, *told)
