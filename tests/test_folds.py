"""Folds over logs against sequential models, with keys that span many tasks."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from marlstone.operators import temporal as TM
from marlstone.operators.folds import Budget, Quota, fold_log

T0 = datetime(2026, 1, 30)


def log(spark, rows, schema):
    return spark.createDataFrame([(i, T0 + timedelta(seconds=t), *r) for i, (t, *r) in enumerate(rows)], f"seq long, at timestamp, {schema}").repartition(5)


@pytest.fixture
def wide(spark):
    """More tasks than usual, so that keys span several."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def accept_model(rows, limit, seconds):
    kept, out = {}, []
    for t, k, counts in rows:
        past = [x for x in kept.get(k, []) if x >= t - seconds]
        out.append(len(past) < limit)
        kept[k] = past + [t] if out[-1] and counts else past
    return out


@pytest.mark.parametrize(("limit", "seconds", "pause"), [(1, 30, 0), (3, 50, 40), (12, 400, 500), (0, 5, 0)])
def test_hot_keys_are_spread_and_exact(spark, wide, limit, seconds, pause):
    r, t, rows = random.Random(limit), 0, []
    for i in range(3000):
        # One key holds half of the rows, without pauses or with some; times repeat.
        t += r.choice([0, 0, 1, 1, 2]) + (pause if pause and i % 400 == 399 else 0)
        rows.append((t, r.choice(["hot"] * 6 + ["a", "b", "c", None, f"k{i % 50}", f"k{i % 300}"]), r.random() < 0.7))
    rows_df = log(spark, rows, "k string, counted boolean")
    got = {x.seq: x.accepted for x in TM.accepted(rows_df, "k", limit, seconds, counts=F.col("counted")).collect()}
    assert [got[i] for i in range(len(rows))] == accept_model(rows, limit, seconds)
    got = {x.seq: x.accepted for x in TM.accepted(rows_df, "k", limit, seconds).collect()}
    assert [got[i] for i in range(len(rows))] == accept_model([(t, k, True) for t, k, _ in rows], limit, seconds)
    # The hot key lies in about half of all tasks, and none of them has much more than its share.
    parts = fold_log(rows_df, F.col("k"), TM.Accept(1, 1), "x").withColumn("p", F.spark_partition_id()).filter("k = 'hot'").groupBy("p").count().collect()
    assert len(parts) >= 5 and max(x["count"] for x in parts) < 1.8 * 3000 / 13


def test_reports_over_a_hot_user(spark, wide):
    r, rows, t = random.Random(4), [], 0
    for _ in range(1500):
        t += r.choice([0, 1, 5])
        rows.append((t, r.choice(["hot", "hot", "x", "y"]), r.choice([None, *range(15)])))
    filed, want = {}, []
    for t, u, o in rows:
        log_of = filed.setdefault(u, [])
        if sum(x >= t - 20 for x, _ in log_of) >= 3:
            want.append("capped")
        elif any(x >= t - 90 and y == o for x, y in log_of):
            want.append("already")
        else:
            want.append("reported")
            log_of.append((t, o))
    got = {x.seq: x.outcome for x in TM.reports(log(spark, rows, "user string, o long"), "user", "o", 3, 20, 90).collect()}
    assert [got[i] for i in range(len(rows))] == want and set(want) == {"capped", "already", "reported"}


def quota_model(rows):
    used, out = {}, []
    for t, n, limit in rows:
        p = (T0 + timedelta(seconds=t)).strftime("%Y-%m")
        got = min(max(n, 0), max(0, limit - used.get(p, 0)))
        used[p] = used.get(p, 0) + got
        out.append((p, got, used[p]))
    return out


@pytest.mark.parametrize("kind", ["constant", "rising", "wild"])
def test_quota_with_a_limit_that_changes(spark, wide, kind):
    r, t, rows = random.Random(kind), 0, []
    for i in range(2000):
        t += r.randint(0, 400)
        rows.append((t, r.randint(-1, 4), {"constant": 300, "rising": 100 + i // 4, "wild": r.choice([0, 150, 900, 901, 902, 2000]) if i % 7 == 0 or not rows else rows[-1][2]}[kind]))
    got = {x.seq: (x.period, x.granted, x.used) for x in TM.varying_quota(log(spark, rows, "n long, lim long"), F.col("lim")).collect()}
    assert [got[i] for i in range(len(rows))] == quota_model(rows)
    assert len({p for p, _, _ in got.values()}) == 2


def test_summaries_compose():
    import numpy as np

    r = random.Random(9)
    for fold, extra in ((Quota(), 1), (Budget(), 2)):
        for _ in range(300):
            n = r.randint(1, 12)
            columns = [np.zeros(n, np.int64), np.array([r.randint(-1, 5) for _ in range(n)]), np.array([r.choice([0, 3, 8, 8, 15]) for _ in range(n)]), np.array([r.random() < 0.7 for _ in range(n)])][: 2 + extra]
            state = r.randint(0, 12) if extra == 1 else r.choice([(0, False, False), (r.randint(0, 12), r.random() < 0.2, True)])
            after, ran = fold.after(state, fold.summary(columns)), fold.run(state, columns)[1]
            assert after == ran
    # Terms are as many as limits at most.
    assert len(Quota().summary([np.zeros(500, np.int64), np.ones(500, np.int64), np.repeat([5, 500, 90, 7], 125)])) <= 4


def runs_model(rows, cap, hour, repeat):
    executed, used, stored, out = [], {}, {}, []
    for t, user, query, n, failed, limit in rows:
        p = (T0 + timedelta(seconds=t)).strftime("%Y-%m")
        if sum(u == user and x >= t - hour for x, u, _, _ in executed) >= cap:
            out.append(("capped", 0))
        elif used.get(p, 0) >= stored.get(p, limit):
            out.append(("exhausted", 0))
        elif any(q == query and x >= t - repeat and not f for x, _, q, f in executed):
            out.append(("recent", 0))
        else:
            stored[p] = limit
            granted = min(n, max(0, limit - used.get(p, 0)))
            if granted == 0:
                out.append(("exhausted", 0))
                continue
            used[p] = used.get(p, 0) + granted
            executed.append((t, user, query, failed))
            out.append(("executed", granted))
    return out


@pytest.mark.parametrize(("seed", "limit"), [(1, 10**6), (3, None)])
def test_three_limits_as_one_run(spark, seed, limit):
    r, t, rows = random.Random(seed), 86_400 * 2 - 1500, []
    for _ in range(400):
        t += r.choice([0, 3, 10, 20])
        rows.append((t, r.choice(["u", "u", "v", "w"]), r.choice("abcdefgh"), r.randint(0, 4), r.random() < 0.3, limit or (0 if len(rows) < 9 else r.choice([450, 500]))))
    out, rounds = TM.live_runs(log(spark, rows, "user string, query string, n long, failed boolean, lim long"), F.col("lim"), 3, 100, 130)
    got = {x.seq: (x.outcome, x.granted) for x in out.collect()}
    want = runs_model(rows, 3, 100, 130)
    assert [got[i] for i in range(len(rows))] == want
    assert {"executed", "capped", "recent"} <= {o for o, _ in want} and 1 < rounds < 40


def test_runs_that_hang_on_each_other_take_no_more_rounds_than_segments(spark):
    # A full cap keeps its phase for ever, so each run hangs on all before it.
    r, t, rows = random.Random(5), 86_400 * 2 - 3000, []
    for i in range(3000):
        t += r.choice([0, 0, 1, 3])
        rows.append((t, r.choice(["u", "v", "w", None]), r.choice("abcdefghijklmnopqrstuvwxyz"), r.randint(0, 4), r.random() < 0.3, r.choice([300, 320, None]) if i > 400 else 310))
    out, rounds = TM.live_runs(log(spark, rows, "user string, query string, n long, failed boolean, lim long"), F.col("lim"), 3, 40, 60)
    got = {x.seq: (x.outcome, x.granted) for x in out.collect()}
    want = runs_model([(*x, limit or 0) for *x, limit in rows], 3, 40, 60)
    assert [got[i] for i in range(len(rows))] == want
    assert {"executed", "capped", "recent", "exhausted"} == {o for o, _ in want} and rounds <= spark.sparkContext.defaultParallelism


def test_observations_as_a_left_fold(spark, wide):
    from marlstone.domains import METHOD_RANK
    from marlstone.operators import provenance as P

    r, rows, t = random.Random(6), [], 0
    for k in range(1200):
        t += r.choice([0, 1, 9])
        methods = [m for m in METHOD_RANK if METHOD_RANK[m] < 1 + k / 250] if k % 2 else list(METHOD_RANK)[:2]
        rows.append((t, r.choice([1, 1, 1, 2, None]), r.choice("ab"), r.choice(["x", "y", None]), r.choice(methods + ["unknown"])))
    state, conflicts, n = {}, {}, {}
    for t, i, f, v, m in rows:
        k, rank = (i, f), METHOD_RANK.get(m, -1)
        n[k], now = n.get(k, 0) + 1, state.get(k)
        conflicts[k] = conflicts.get(k, 0) + (now is not None and now[0] != v)
        if now is None or rank > METHOD_RANK.get(now[1], -1):
            state[k] = (v, m, t)
        elif now[0] == v:
            state[k] = (v, now[1], t)
    got = P.merge_history(log(spark, rows, "id long, field string, value string, method string")).collect()
    assert {(x.id, x.field): (x.value, x.method, (x.at - T0).total_seconds(), x.conflicts, x.n) for x in got} == {k: (*state[k], conflicts[k], n[k]) for k in state}


def test_edges(spark):
    schema = "seq long, at timestamp, k string, n long, accepted int"
    some = spark.createDataFrame([(1, T0, "a", 2, 7), (2, None, "a", 2, 7), (3, T0, None, None, 7), (4, T0, None, -5, 7)], schema)
    assert sorted((x.seq, x.accepted) for x in TM.accepted(some, "k", 1, 5).collect()) == [(1, True), (2, None), (3, True), (4, False)]
    assert sorted((x.seq, x.granted, x.used) for x in TM.varying_quota(some, F.lit(5)).collect()) == [(1, 2, 2), (2, None, None), (3, 0, 2), (4, 0, 2)]
    none = some.limit(0)
    assert TM.accepted(none, "k", 1, 5).collect() == [] == TM.varying_quota(none, F.lit(5)).collect()
    runs = none.withColumns({"user": F.col("k"), "query": F.col("k"), "failed": F.lit(False)})
    assert TM.live_runs(runs, F.lit(5))[0].collect() == []
