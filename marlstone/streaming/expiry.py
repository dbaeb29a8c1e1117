"""The expiry sweep as a stream: the twin of `operators.deadlines.sweep_expired`.

Changes of listings come in as they happen. A listing with a last date to come has one timer, on event time; when the
watermark passes the date, the listing expires, its audit row is written, and its state goes. A listing that can't
expire (archived, expired, rolling, without dates) is remembered only until the watermark has passed its
change, as no older one can come after that. So the state is the listings with a date ahead.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

NOTE = "Application deadline passed with no future cycle recorded."


def last_dates(deadlines: DataFrame) -> DataFrame:
    """(opp_id, last_date, is_rolling) of the dates that a listing expires by."""
    act = deadlines.filter(F.col("kind").isin("APPLICATION_DEADLINE", "REGISTRATION_DEADLINE"))
    return act.groupBy("opp_id").agg(F.max("date").alias("last_date"), F.bool_or(F.coalesce("is_rolling", F.lit(False))).alias("is_rolling"))


def can_expire(state: Column, last_date: Column, is_rolling: Column) -> Column:
    return F.coalesce(~state.isin("EXPIRED", "ARCHIVED") & last_date.isNotNull() & ~F.coalesce(is_rolling, F.lit(False)), F.lit(False))


def expiry_stream(changes: DataFrame, late: str = "1 day") -> DataFrame:
    """Audit rows (opp_id, actor, action, note, date) of a stream of changes (opp_id, at, state, last_date, is_rolling).

    The change with the latest ``at`` counts, of several at one time the one with the latest date. Changes older than the watermark, which follows
    the latest ``at`` by ``late``, are dropped. A listing expires when the watermark is past its last date.
    """

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, ends = state.get if state.exists else (None, None)
        if not state.hasTimedOut:
            for b in batches:
                for t, e in zip(b["t"].tolist(), b["ends"].tolist(), strict=True):
                    e = None if pd.isna(e) else int(e)
                    if at is None or (t, e is not None, e or 0) > (at, ends is not None, ends or 0):
                        at, ends = int(t), e
        now = state.getCurrentWatermarkMs()
        if ends is not None and ends < now * 1000:
            state.remove()
            yield pd.DataFrame({"opp_id": [group[0]], "ends": [ends]})
        elif ends is None and at < now * 1000:
            state.remove()
        else:
            state.update((at, ends))
            state.setTimeoutTimestamp(max((at if ends is None else ends) // 1000, now) + 1)

    ends = F.when(can_expire(F.col("state"), F.col("last_date"), F.col("is_rolling")), F.unix_micros("last_date"))
    rows = changes.withWatermark("at", late).select(F.col("opp_id").cast("long").alias("opp_id"), "at", F.unix_micros("at").alias("t"), ends.alias("ends"))
    out = rows.groupBy("opp_id").applyInPandasWithState(run, "opp_id long, ends long", "at long, ends long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.select("opp_id", F.lit("SYSTEM").alias("actor"), F.lit("MARKED_EXPIRED").alias("action"), F.lit(NOTE).alias("note"), F.timestamp_micros("ends").alias("date"))
