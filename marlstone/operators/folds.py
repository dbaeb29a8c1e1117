"""Folds over ordered logs whose keys may be of any size.

A log is range-sorted by key, time and sequence number, so a key with a third of all rows lies
in a third of all tasks. What a task needs to go on with is the state in which the one before it ends:

1. Each task sums up its last key. Where that key begins in the task, or has a pause in it after which
   nothing earlier counts, the state at the end is known at once. Otherwise the summary is a function of the state before.
2. The summaries of a key, one a task, are chained in order. Most keys lie in one task and have no chain.
3. With the states at their beginnings, at most one a task, all tasks fold their rows.

A `Fold` says what a state is, how rows change it and what sums rows up.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layout import checkpointed


class Fold:
    """``label`` is the SQL type of what a row gets. Columns come as arrays, the time in microseconds first."""

    label = "boolean"

    def start(self):
        """The state before a key's first row."""

    def run(self, state, columns: list[np.ndarray]) -> tuple[pa.Array, object]:
        """Labels of some consecutive rows of a key, and the state after them; ``state`` itself stays as it is."""
        raise NotImplementedError

    def summary(self, columns: list[np.ndarray]):
        """What consecutive rows of a key do to any state before them."""
        raise NotImplementedError

    def after(self, state, summary):
        """The state after rows that have this summary."""
        raise NotImplementedError


class WindowFold(Fold):
    """A fold whose state holds nothing older than ``window`` microseconds.

    After a pause longer than that the state is the one at the start. Rows without such a pause are summed up by their
    columns, packed: times as differences in as few bytes as they need.
    """

    window = 0

    def counting(self, columns: list[np.ndarray]) -> np.ndarray | None:
        """Which rows can change a state, None for all."""

    def summary(self, columns):
        pauses = np.flatnonzero(np.diff(columns[0]) > self.window)
        if len(pauses):
            return "state", self.run(self.start(), [c[pauses[-1] + 1 :] for c in columns])[1]
        keep = self.counting(columns)
        t, *rest = columns if keep is None else [c[keep] for c in columns]
        step = np.diff(t, prepend=t[:1])
        return "rows", zlib.compress(pickle.dumps((t[:1], step.astype(np.min_scalar_type(step.max(initial=0))), rest)), 1)

    def after(self, state, summary):
        kind, what = summary
        if kind == "state":
            return what
        first, step, rest = pickle.loads(zlib.decompress(what))
        return self.run(state, [first + np.cumsum(step.astype(np.int64)), *rest])[1] if len(first) else state


class Accept(WindowFold):
    """A row passes while fewer than ``limit`` counting rows that passed lie in the window up to it, both ends included.

    A second column, if there is one, says which rows count when they pass. The state is the latest
    ``limit`` times; between two rows that pass all others are skipped at once.
    """

    def __init__(self, limit: int, window: int):
        self.limit, self.window = limit, window

    def start(self):
        return ()

    def counting(self, columns):
        return columns[1].astype(bool) if len(columns) > 1 else None

    def run(self, state, columns):
        t, counts, times, n = columns[0].tolist(), columns[1].tolist() if len(columns) > 1 else None, deque(state), len(columns[0])
        ok, i = np.zeros(n, dtype=bool), 0
        while i < n and self.limit > 0:
            if len(times) == self.limit and times[0] >= t[i] - self.window:
                i = bisect_right(t, times[0] + self.window, i + 1)
                continue
            ok[i] = True
            if counts is None or counts[i]:
                times.append(t[i])
                if len(times) > self.limit:
                    times.popleft()
            i += 1
        return pa.array(ok), tuple(times)


class Report(WindowFold):
    """`capped` where ``limit`` rows are filed in the ``cap`` up to a row, else `already` where one of them in the ``same`` up to
    it is of the same thing, else `reported`, which is filed. The second column names the thing. The state is what is filed within the longer window."""

    label = "string"

    def __init__(self, limit: int, cap: int, same: int):
        self.limit, self.cap, self.same, self.window = limit, cap, same, max(cap, same)

    def start(self):
        return (), {}

    def run(self, state, columns):
        filed, latest, out = deque(state[0]), dict(state[1]), []
        for t, o in zip(columns[0].tolist(), columns[1].tolist(), strict=True):
            while filed and filed[0] < t - self.cap:
                filed.popleft()
            if len(filed) >= self.limit:
                out.append("capped")
            elif latest.get(o, t - self.same - 1) >= t - self.same:
                out.append("already")
            else:
                out.append("reported")
                filed.append(t)
                latest = {x: y for x, y in latest.items() if y >= t - self.same} | {o: t}
        return pa.array(out, pa.string()), (tuple(filed), latest)


class Quota(Fold):
    """Reservations of n under a limit that may change with every row: used becomes max(used, min(used + n, limit)).

    Columns after the time: n, limit. Rows of one limit sum up to two numbers (a, b), used -> max(used, min(used + a, b)); any
    rows sum up to the greatest of several such terms, those that no other term exceeds in both numbers. While the limit stays there is
    one, and there can be only as many as limits.
    """

    label = "struct<granted: bigint, used: bigint>"

    def start(self):
        return 0

    @staticmethod
    def _stretches(columns) -> Iterator[tuple[np.ndarray, int]]:
        n, limit = np.maximum(columns[1], 0), columns[2]
        ends = np.append(np.flatnonzero(np.diff(limit)) + 1, len(limit))
        for i, e in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), strict=True):
            if e > i:
                yield n[i:e], int(limit[i])

    def run(self, state, columns):
        used, granted, total = state, [], []
        for n, limit in self._stretches(columns):
            after = np.maximum(used, np.minimum(used + np.cumsum(n), limit))
            granted.append(np.diff(after, prepend=used))
            total.append(after)
            used = int(after[-1])
        flat = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([flat(granted), flat(total)], names=["granted", "used"]), used

    def summary(self, columns):
        terms: list[tuple[int, int]] = []
        for n, limit in self._stretches(columns):
            c = int(n.sum())
            every = [*terms, (c, limit), *((a + c, min(b + c, limit)) for a, b in terms)]
            terms = []
            for a, b in sorted(every, reverse=True):  # by falling a; only a larger b makes up for a smaller a
                if not terms or b > terms[-1][1]:
                    terms.append((a, b))
        return terms

    def after(self, state, summary):
        return max([state, *(min(state + a, b) for a, b in summary)])


class Budget(Fold):
    """Runs against a limit that is looked at before a run, as the last reservation left it: a run that uses it up is the period's last.

    Columns after the time: n, limit, and whether the row asks. Before the first reservation a row's own limit is looked at, so where
    that is 0 nothing is reserved. What is used is the plain sum of n until a row at which the sum reaches
    its limit; that one gets what is left, later ones nothing. So rows sum up to their sum and to the least
    used with which one of them reaches its limit, once for a period with and once for one without a reservation before them.
    """

    label = "struct<granted: bigint, exhausted: boolean>"

    def start(self):
        return 0, False, False

    @staticmethod
    def _reserving(columns, reserved: bool) -> tuple[np.ndarray, np.ndarray]:
        """Which rows reserve, and how much they ask for."""
        _, n, limit, asks = columns
        asks = asks.astype(bool)
        if not reserved:
            asks = asks & (np.cumsum(asks & (limit > 0)) > 0)
        return asks, np.where(asks, np.maximum(n, 0), 0)

    def run(self, state, columns):
        used, full, reserved = state
        limit = columns[2]
        asks, n = self._reserving(columns, reserved)
        upto = used + np.cumsum(n)
        hits = np.flatnonzero(asks & (upto >= limit))
        last = -1 if full else hits[0] if len(hits) else len(n)
        over = np.arange(len(n)) > last
        granted = np.where(asks & ~over, np.maximum(np.minimum(n, limit - upto + n), 0), 0)
        earlier = np.concatenate([[reserved], reserved | (np.cumsum(asks) > 0)])[:-1]
        exhausted = over | np.where(asks, granted == 0, ~earlier & (limit <= 0))
        labels = pa.StructArray.from_arrays([pa.array(granted, pa.int64()), pa.array(exhausted)], names=["granted", "exhausted"])
        return labels, (int(upto[-1]) if len(n) else used, full or bool(len(hits)), reserved or bool(asks.any()))

    def summary(self, columns):
        out = []
        for reserved in (False, True):
            asks, n = self._reserving(columns, reserved)
            room = (columns[2] - np.cumsum(n))[asks]
            out.append((int(n.sum()), int(room.min()) if len(room) else None))
        return out

    def after(self, state, summary):
        used, full, reserved = state
        n, room = summary[reserved]
        return used + n, full or (room is not None and used >= room), reserved or room is not None


def _stretches(keys: pa.Array) -> list[tuple[int, int, object]]:
    """(begin, end, key) of runs of equal keys."""
    runs = pc.run_end_encode(keys)
    ends = runs.run_ends.to_pylist()
    return list(zip([0, *ends[:-1]], ends, runs.values.to_pylist(), strict=True))


def _arrays(b: pa.RecordBatch, names: list[str], i: int, e: int) -> list[np.ndarray]:
    return [b.column(c).slice(i, e - i).to_numpy(zero_copy_only=False) for c in names]


def _ends(fold: Fold, names: list[str]):
    """Rows (part, k, begins, goes_on, summary): of the first key of a task, whose state it needs, and of the last key, whose state it gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, part, first, last, alone, held = None, None, None, None, True, []
        for b in batches:
            if not b.num_rows:
                continue
            stretches = _stretches(b.column("fold_key"))
            if part is None:
                kind, part, first = b.schema.field("fold_key").type, b.column("fold_part")[0].as_py(), stretches[0][2]
            if not (first == stretches[-1][2] and len(stretches) == 1):
                alone = False
            i, e, last_key = stretches[-1]
            if not held or len(stretches) > 1 or last_key != last:
                held = []
            last = last_key
            held.append(_arrays(b, names, i, e))
        if part is None:
            return
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        what = fold.summary(columns) if alone else fold.run(fold.start(), columns)[1]
        rows = [(part, first, True, alone, what if alone else None)] + ([] if alone else [(part, last, False, False, what)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], kind), pa.array([r[2] for r in rows]), pa.array([r[3] for r in rows]), pa.array([pickle.dumps(r[4]) for r in rows], pa.binary())],
            names=["part", "k", "begins", "alone", "summary"],
        )

    return run


def _chain(fold: Fold):
    """Those rows in order to (part, state): the states that tasks begin with where their first key goes on from an earlier task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, seen = None, None, False
        for b in batches:
            parts, states = [], []
            for r in b.to_pylist():
                if not seen or r["k"] != key:
                    key, state, seen, known = r["k"], fold.start(), True, False
                what = pickle.loads(r["summary"])
                if r["begins"] and known:
                    parts.append(r["part"])
                    states.append(pickle.dumps(state))
                if r["alone"]:
                    state, known = fold.after(state, what), True
                elif not r["begins"]:
                    state, known = what, True
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(states, pa.binary())], names=["part", "state"])

    return run


def _label(fold: Fold, names: list[str], given: list[str], states: dict[int, bytes], label: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, seen = None, None, False
        for b in batches:
            if not b.num_rows:
                continue
            out = []
            for i, e, k in _stretches(b.column("fold_key")):
                if not seen:
                    begin = states.get(b.column("fold_part")[0].as_py())
                    key, state, seen = k, fold.start() if begin is None else pickle.loads(begin), True
                elif k != key:
                    key, state = k, fold.start()
                labels, state = fold.run(state, _arrays(b, names, i, e))
                out.append(labels)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in given), pa.concat_arrays(out)], names=[*given, label])

    return run


def fold_log(log: DataFrame, key: Column, fold: Fold, label: str, columns: dict[str, Column] | None = None, at: str = "at", seq: str = "seq") -> DataFrame:
    """``log`` with what ``fold`` gives each row as ``label``, of each key's rows by time and sequence number.

    ``columns`` are what the fold reads after the time; none may be null. Rows without key are one key; rows without time are no part of it, their label is null.
    A column of that name is replaced.
    """
    spark = log.sparkSession
    given = [c for c in log.columns if c.lower() != label.lower()]
    names = ["fold_at", *(f"fold_c{i}" for i in range(len(columns or {})))]
    timed = log.filter(F.col(at).isNotNull()).select(*given, key.alias("fold_key"), F.unix_micros(at).alias("fold_at"), *[c.alias(f"fold_c{i}") for i, c in enumerate((columns or {}).values())])
    order = ["fold_key", "fold_at", seq, "fold_row"]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = timed.withColumn("fold_row", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = checkpointed(rows.withColumn("fold_part", F.spark_partition_id()))
    kind = rows.schema["fold_key"].dataType.simpleString()
    ends = rows.select("fold_key", "fold_part", *names).mapInArrow(_ends(fold, names), f"part int, k {kind}, begins boolean, alone boolean, summary binary")
    chained = ends.repartition("k").sortWithinPartitions("k", "part", F.desc("begins")).mapInArrow(_chain(fold), "part int, state binary")
    states = {r["part"]: bytes(r["state"]) for r in chained.collect()}  # at most one a task
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.select(*given).schema)
    out = rows.mapInArrow(_label(fold, names, given, states, label), f"{schema}, `{label}` {fold.label}")
    return out.unionByName(log.filter(F.col(at).isNull()).select(*given, F.lit(None).cast(fold.label).alias(label)))
