"""Rate limits and repeat suppression over a stream: the twin of `operators.temporal.accepted`.

The state of a key is the accepted times that still lie in the window, at most
``limit`` of them, and goes when the watermark has left the last of them behind. Rows of a micro-batch are taken in order
of time; a row that is older than what an earlier batch accepted is judged by what is in the state, and
one that is older than the watermark is dropped.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.folds import Accept


def accepted_stream(actions: DataFrame, key: str, limit: int, window_seconds: int, at: str = "at", seq: str = "seq", late: str = "1 day") -> DataFrame:
    """(key, seq, accepted) of a streaming DataFrame with a string key, a timestamp and a bigint sequence number; rows may be ``late``.

    Of a key's rows in a micro-batch two numbers each are held, to be put in order.
    """
    fold = Accept(limit, window_seconds * 1_000_000)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = tuple(state.get[0]) if state.exists else ()
        held = [(b["t"].to_numpy(np.int64), b["n"].to_numpy(np.int64)) for b in batches]
        t, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((n, t))
        ok, times = fold.run(times, [t[order]])
        # What an older row finds in the state may be later than itself, so it is kept in order.
        times = sorted(times)
        now = state.getCurrentWatermarkMs() * 1000
        times = times[bisect_left(times, now - fold.window) :]
        if times:
            state.update((times,))
            state.setTimeoutTimestamp(max((times[-1] + fold.window) // 1000, now // 1000) + 1)
        else:
            state.remove()
        yield pd.DataFrame({"k": group[0], "n": n[order], "accepted": ok.to_pandas()})

    rows = actions.withWatermark(at, late).select(F.col(key).cast("string").alias("k"), F.col(at).alias("at"), F.unix_micros(at).alias("t"), F.col(seq).cast("long").alias("n"))
    return rows.groupBy("k").applyInPandasWithState(run, "k string, n long, accepted boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def quota_stream(requests: DataFrame, at: str = "at", n: str = "n", late: str = "1 day") -> DataFrame:
    """Requests per calendar month of a stream, by day windows under a watermark; the quota follows from the sums."""
    r = requests.withWatermark(at, late)
    return r.groupBy(F.window(at, "1 day").alias("w")).agg(F.sum(n).alias("n")).select(F.date_format("w.start", "yyyy-MM").alias("period"), F.col("w.start").alias("day"), "n")
