"""Ingest of records in order: each meets what earlier ones have become.

A record of a known URL is a sighting of the listing that has it. Else it joins the first listing, by position of its
founder, that one of its sources makes the same: by content hash, or by organiser where the record's
title is close to the founder's, and never with another cycle than the founder's. It then is a source of that
listing. A record that joins none founds a listing.

Who owns a record hangs on earlier records only, so the owners are found in rounds: in each, every record takes
the listing that the owners of the last round give it. A round puts right at least the first record that was
wrong, and where nothing changes all are right. Rounds are as many as records hang on each other in
turn; a star of any size takes two.

What a record asks for is the least owner among earlier sources of some key. That is a fold with a
running minimum, which spreads keys of any size over all tasks; pairs are made of distinct titles only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import Rounds, checkpointed
from .dedupe import MERGE, REVIEW, prepared, similar_titles
from .folds import Fold, fold_log

_NONE = (1 << 63) - 1


class Least(Fold):
    """The least of what earlier rows of the key bring, and of the row's own; null for nothing. Rows that only ask bring the largest bigint."""

    label = "bigint"

    def start(self):
        return _NONE

    def run(self, state, columns):
        least = np.minimum(np.minimum.accumulate(columns[1]), state)
        return pa.array(least, mask=least == _NONE), int(least[-1]) if len(least) else state

    def summary(self, columns):
        return int(columns[1].min(initial=_NONE))

    def after(self, state, summary):
        return min(state, summary)


def _key(kind: str, *parts: Column) -> Column:
    """One string of several, from which they could be read back; null if one is null."""
    return F.concat(F.lit(kind), *[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)])


def _brought(key: Column, cycle: Column) -> Column:
    """The keys under which a source is found: by its founder's cycle, and by any."""
    return F.array(F.concat(key, F.lit("|"), F.coalesce(cycle.cast("string"), F.lit("none"))), F.concat(key, F.lit("|any")))


def _asked(key: Column, cycle: Column) -> Column:
    """The keys that a record looks at: its own cycle and none, or any if it has none itself."""
    own = F.concat(key, F.lit("|"), cycle.cast("string"))
    return F.when(cycle.isNull(), F.array(F.concat(key, F.lit("|any")))).otherwise(F.array(own, F.concat(key, F.lit("|none"))))


def _least_before(asks: DataFrame, brings: DataFrame) -> DataFrame:
    """(pos, least): of (pos, keys) and (pos, keys, owner) the least owner that earlier rows bring to one of a record's keys."""
    flat = lambda df, turn, owner: df.select("pos", F.explode("keys").alias("k"), F.lit(turn).alias("turn"), owner.alias("owner")).filter("k is not null")
    rows = flat(asks, 0, F.lit(_NONE)).unionByName(flat(brings, 1, F.col("owner"))).withColumn("at", F.timestamp_micros("pos"))
    seen = fold_log(rows, F.col("k"), Least(), "least", {"owner": F.col("owner")}, seq="turn")
    return seen.filter("turn = 0 and least is not null").groupBy("pos").agg(F.min("least").alias("least"))


def ingest_in_order(records: DataFrame, known: Column | None = None) -> tuple[DataFrame, int]:
    """(id, merge_into, status) of each record that is not ``known``, and the rounds that took.

    ``records`` (id, pos, url, hash, title, org, cycle) come in order of pos, a bigint that no two share. Those that are ``known``
    are listings already and stay so, whatever they look like. ``merge_into`` is the pos of the founder of the listing that a record
    joins. The status is `merged`, or for a founder `review` where an earlier listing of a cycle that fits has a close title,
    else `created`. Missing and empty values match nothing; rows without pos come out with null.
    """
    given = records.withColumn("is_known", F.coalesce(known, F.lit(False)) if known is not None else F.lit(False))
    all_rows = prepared(given).join(given.select("id", "pos", "is_known").withColumnsRenamed({"id": "id_", "pos": "pos_"}), F.col("id").eqNullSafe(F.col("id_")) & F.col("pos").eqNullSafe(F.col("pos_"))).drop("id_", "pos_")
    timeless = all_rows.filter("pos is null and not is_known")
    r = all_rows.filter("pos is not null").withColumn("pos", F.col("pos").cast("long"))
    first = r.filter("url is not null").groupBy("url").agg(F.min("pos").alias("first"))
    r = r.join(first, "url", "left").withColumn("first", F.when(F.col("is_known"), F.col("pos")).otherwise(F.coalesce("first", "pos")))
    r = checkpointed(r.select("id", "pos", "hash", "norm", "org", "cycle", "is_known", "first").withColumn("owner", F.col("first")))

    titles = r.select(F.col("norm").alias("title")).filter("title is not null").distinct()
    close = similar_titles(titles, REVIEW)
    same = titles.select(F.col("title").alias("x"), F.col("title").alias("y"), F.lit(1.0).alias("similarity"))
    close = checkpointed(close.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(close.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity")).unionByName(same))
    # What a record asks for never changes: its hash, and its organiser with every close title.
    asking = r.filter("not is_known and first = pos").select("pos", "hash", "org", "cycle", F.col("norm").alias("x"))
    titled = asking.join(close, "x")
    cycle = F.col("cycle")
    asks = asking.select("pos", _asked(_key("h", F.col("hash")), cycle).alias("keys")).unionByName(titled.filter(F.col("similarity") >= MERGE).select("pos", _asked(_key("t", F.col("y"), F.col("org")), cycle).alias("keys")))
    asks = checkpointed(asks)

    # Sightings of a known URL follow its first record, so rounds are about first records only. Their joins are never broadcast: what
    # passes the driver would be a table a round.
    rounds, kept = 0, Rounds(records.sparkSession)
    firsts = r.filter("first = pos")
    while True:
        founders = firsts.select(F.col("pos").alias("owner"), F.col("norm").alias("o_norm"), F.col("cycle").alias("o_cycle"))
        sources = firsts.select("pos", "hash", "org", "owner").join(founders.hint("merge"), "owner")
        by = [_brought(_key("h", F.col("hash")), F.col("o_cycle")), _brought(_key("t", F.col("o_norm"), F.col("org")), F.col("o_cycle"))]
        found = _least_before(asks, sources.select("pos", "owner", F.concat(*[F.coalesce(k, F.array()) for k in by]).alias("keys")))
        told = firsts.join(found.hint("merge"), "pos", "left").withColumn("now", F.when(F.col("is_known"), F.col("pos")).otherwise(F.coalesce("least", "pos"))).drop("least")
        told = kept.keep(told)
        rounds += 1
        settled = not told.filter("now <> owner").head(1)
        firsts = told.withColumn("owner", F.col("now")).select(*r.columns)
        if settled:
            break
    listings = firsts.filter("owner = pos").select("pos", "owner", _brought(_key("c", F.col("norm")), cycle).alias("keys"))
    r = r.drop("owner").join(firsts.select("first", "owner"), "first")
    near = _least_before(titled.select("pos", _asked(_key("c", F.col("y")), cycle).alias("keys")), listings).select("pos", F.lit(True).alias("near"))
    out = r.filter("not is_known").join(near, "pos", "left")
    status = F.when(F.col("owner") < F.col("pos"), "merged").when(F.coalesce("near", F.lit(False)), "review").otherwise("created")
    out = out.select("id", F.when(F.col("owner") < F.col("pos"), F.col("owner")).alias("merge_into"), status.alias("status"))
    return out.unionByName(timeless.select("id", F.lit(None).cast("long").alias("merge_into"), F.lit(None).cast("string").alias("status"))), rounds
