"""Where each field's value comes from, and what to do when two sources disagree."""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.dates import lookup
from .folds import Fold, fold_log


def confidence(method: Column) -> Column:
    return lookup(D.METHOD_CONFIDENCE, method)


def outranks(a: Column, b: Column) -> Column:
    return lookup(D.METHOD_RANK, a) > lookup(D.METHOD_RANK, b)


def needs_human(field: Column, method: Column) -> Column:
    """A model's word on a field that is never generated, or on a part of one."""
    named = [(field == f) | F.startswith(field, F.lit(f + ".")) for f in D.NEVER_GENERATED_FIELDS]
    out = named[0]
    for n in named[1:]:
        out = out | n
    return (method == "AI_EXTRACTED") & out


def provenance_map(**fields: tuple[Column, Column]) -> Column:
    """Map of field -> provenance of the fields whose value is present; each argument is (value, provenance)."""
    entries = F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), p.alias("value"))) for k, (v, p) in fields.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def merge(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """One row per (id, field): value, method, at, conflict.

    A field known on one side is taken as it is. Equal values keep the better
    method; the current row is confirmed at the incoming time. Unequal values
    are always a conflict, and only a better method takes the field over.
    """
    e, i = existing.alias("e"), incoming.alias("i")
    j = e.join(i, (F.col("e.id") == F.col("i.id")) & (F.col("e.field") == F.col("i.field")), "full_outer")
    old, new = F.col("e.id").isNotNull(), F.col("i.id").isNotNull()
    equal = F.col("e.value").eqNullSafe(F.col("i.value"))
    better = outranks(F.col("i.method"), F.col("e.method"))
    take = new & (~old | better)
    choose = lambda c: F.when(take, F.col(f"i.{c}")).otherwise(F.col(f"e.{c}"))
    return j.select(
        F.coalesce("e.id", "i.id").alias("id"),
        F.coalesce("e.field", "i.field").alias("field"),
        choose("value").alias("value"),
        choose("method").alias("method"),
        F.when(take | (old & new & equal), F.col("i.at")).otherwise(F.col("e.at")).alias("at"),
        (old & new & ~equal).alias("conflict"),
    )


class Observed(Fold):
    """What a field is after each of its observations, and whether that one disagreed with what the field was.

    Columns after the time: rank of the method, method, value. A state is (rank, method, value, at), or None before the first. The first
    observation that outranks the state takes the field over, whatever came before, so rows sum up to the state after
    each such take-over, of which there is one a rank at most, and, for a state that none of them outranks, to the last time of every value.
    """

    label = "struct<value: string, method: string, at: bigint, conflict: boolean>"

    def start(self):
        return None

    def run(self, state, columns):
        times, ranks, methods, values = (c.tolist() for c in columns)
        out = []
        for t, r, m, v in zip(times, ranks, methods, values, strict=True):
            conflict = state is not None and state[2] != v
            if state is None or r > state[0]:
                state = (r, m, v, t)
            elif not conflict:
                state = (*state[:3], t)
            out.append((state[2], state[1], state[3], conflict))
        value, method, at, conflict = zip(*out, strict=True) if out else ((),) * 4
        arrays = [pa.array(value, pa.string()), pa.array(method, pa.string()), pa.array(at, pa.int64()), pa.array(conflict, pa.bool_())]
        return pa.StructArray.from_arrays(arrays, names=["value", "method", "at", "conflict"]), state

    def summary(self, columns):
        times, ranks, methods, values = columns
        ends, most = {}, int(ranks.max(initial=-2))
        for r in range(-2, most):
            first = int(np.argmax(ranks > r))
            ends[r] = self.run(None, [c[first:] for c in columns])[1]
        last = dict(zip(values.tolist(), times.tolist(), strict=True))
        return ends, most, zlib.compress(pickle.dumps(last), 1)

    def after(self, state, summary):
        ends, most, last = summary
        rank = -2 if state is None else state[0]
        if rank < most:
            return ends[rank]
        return state if state is None else (*state[:3], pickle.loads(zlib.decompress(last)).get(state[2], state[3]))


def merge_history(observations: DataFrame, at: str = "at", seq: str = "seq") -> DataFrame:
    """One row per (id, field) of observations (id, field, value, method, at, seq) in order: value, method, at, conflicts, n.

    As `merge` has it of two: a better method takes a field over, an equal value confirms it at its time, an unequal one is a conflict, and
    of equally good methods the first stays. Nulls are a value; a method without a rank is below all others. Observations without time don't count.
    """
    rank = F.coalesce(lookup(D.METHOD_RANK, F.col("method")), F.lit(-1)).cast("int")
    key = F.to_json(F.struct("id", "field"))
    columns = {"rank": rank, "method": F.col("method"), "value": F.col("value").cast("string")}
    rows = fold_log(observations, key, Observed(), "seen", columns, at, seq).filter("seen is not null")
    last = F.max_by("seen", F.struct(F.unix_micros(at), F.col(seq)))
    out = rows.groupBy("id", "field").agg(last.alias("last"), F.count_if("seen.conflict").alias("conflicts"), F.count(F.lit(1)).alias("n"))
    return out.select("id", "field", "last.value", "last.method", F.timestamp_micros("last.at").alias("at"), "conflicts", "n")
