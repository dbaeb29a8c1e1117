"""Quotas, limits, retention and counting queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import temporal as TM
from ..sources import tables as T
from ..sources.tables import EVENTS_NOW, ctes
from .registry import query

Q = """WITH r AS (SELECT event_id AS seq, ts AS tm, (event_id % 4 + 1)::BIGINT AS n FROM events), t AS (SELECT *, strftime(tm, '%Y-%m') AS period, sum(n) OVER (PARTITION BY strftime(tm, '%Y-%m') ORDER BY tm, seq ROWS UNBOUNDED PRECEDING) AS total FROM r)
"""


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("ts").alias("at"), (F.col("event_id") % 4 + 1).alias("n"))


@query(Q + "SELECT seq, period, (least(1800, total) - least(1800, total - n))::BIGINT AS granted, least(1800, total)::BIGINT AS used FROM t")
def h01_quota(spark: SparkSession, d: str) -> DataFrame:
    return TM.quota(_requests(spark, d), 1800).select("seq", "period", "granted", "used")


@query(Q + "SELECT period, least(1800, sum(n))::BIGINT AS used, (1800 - least(1800, sum(n)))::BIGINT AS remaining, sum(n) >= 1800 AS exhausted FROM t GROUP BY period")
def h02_quota_status(spark: SparkSession, d: str) -> DataFrame:
    return TM.quota_status(_requests(spark, d), 1800)


_VARYING = "CASE WHEN event_id % 50 < 25 THEN 1500 ELSE 1500 + event_id // 2 END"


@query(
    f"""WITH RECURSIVE e AS (SELECT event_id, strftime(ts, '%Y-%m') AS period, event_id % 4 + 1 AS n, ({_VARYING})::BIGINT AS lim, row_number() OVER (PARTITION BY strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT event_id, period, i, least(n, greatest(lim, 0)) AS granted, least(n, greatest(lim, 0)) AS used FROM e WHERE i = 1
  UNION ALL SELECT e.event_id, e.period, e.i, least(e.n, greatest(0, e.lim - f.used)), f.used + least(e.n, greatest(0, e.lim - f.used)) FROM f JOIN e ON e.period = f.period AND e.i = f.i + 1)
SELECT event_id AS seq, period, granted::BIGINT AS granted, used::BIGINT AS used FROM f"""
)
def h01_varying_quota(spark: SparkSession, d: str) -> DataFrame:
    """A month's quota whose limit goes up and down between requests."""
    limit = F.when(F.col("seq") % 50 < 25, 1500).otherwise(1500 + F.floor(F.col("seq") / 2))
    return TM.varying_quota(_requests(spark, d), limit).select("seq", "period", "granted", "used")


def _fold_sql(key: str, limit: int, seconds: int, where: str = "true") -> str:
    """The fold as a recursive query over each key's n-th action; the state is the list of accepted times."""
    us = seconds * 1_000_000
    return f"""WITH RECURSIVE e AS (SELECT event_id, {key} AS k, epoch_us(ts) AS t, row_number() OVER (PARTITION BY {key} ORDER BY ts, event_id) AS n FROM events WHERE {where}),
f AS (SELECT event_id, k, t, n, true AS accepted, [t] AS times FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.k, e.t, e.n, len(list_filter(f.times, lambda x: x >= e.t - {us})) < {limit},
    CASE WHEN len(list_filter(f.times, lambda x: x >= e.t - {us})) < {limit} THEN list_append(list_filter(f.times, lambda x: x >= e.t - {us}), e.t) ELSE list_filter(f.times, lambda x: x >= e.t - {us}) END
  FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
SELECT event_id, accepted FROM f"""


def _fold(spark: SparkSession, d: str, key: str, limit: int, seconds: int) -> DataFrame:
    rows = T.load(spark, d, "events").select("event_id", "user_id", "event_type", "ts")
    return TM.accepted(rows, key, limit, seconds, at="ts", seq="event_id").select("event_id", "accepted")


#: The log is sparse, so its times are drawn together and its users are taken together, until limits are reached.
_START = "2024-01-01 00:00:00"


def _dense(spark: SparkSession, d: str, users: int, closer: int, kind: str | None = None) -> DataFrame:
    e = T.load(spark, d, "events")
    start = F.unix_micros(F.lit(_START).cast("timestamp"))
    rows = e if kind is None else e.filter(F.col("event_type") == kind)
    return rows.select("event_id", (F.col("user_id") % users).alias("actor"), (F.col("event_id") % 250).alias("opp_id"), F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / closer)).alias("at"))


def _dense_sql(users: int, closer: int, kind: str | None = None) -> str:
    start = f"epoch_us(TIMESTAMP '{_START}')"
    where = f" WHERE event_type = '{kind}'" if kind else ""
    return f"e0 AS (SELECT event_id, user_id % {users} AS k, event_id % 250 AS o, {start} + (epoch_us(ts) - {start}) // {closer} AS t FROM events{where}),\ne AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t, event_id) AS n FROM e0)"


def _cap_sql(users: int, closer: int, limit: int, seconds: int, kind: str | None = None) -> str:
    near = f"list_filter(f.times, lambda x: x >= e.t - {seconds * 1_000_000})"
    return f"""WITH RECURSIVE {_dense_sql(users, closer, kind)},
f AS (SELECT event_id, k, n, true AS accepted, [t] AS times FROM e WHERE n = 1
  UNION ALL SELECT e.event_id, e.k, e.n, len({near}) < {limit}, CASE WHEN len({near}) < {limit} THEN list_append({near}, e.t) ELSE {near} END FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1)
SELECT event_id, accepted FROM f"""


def _cap(spark: SparkSession, d: str, users: int, closer: int, limit: int, seconds: int, kind: str | None = None) -> DataFrame:
    return TM.accepted(_dense(spark, d, users, closer, kind), "actor", limit, seconds, seq="event_id").select("event_id", "accepted")


@query(_cap_sql(10, 16, 12, 3600))
def h03_hourly_cap(spark: SparkSession, d: str) -> DataFrame:
    """Twelve executed searches of a user in an hour."""
    return _cap(spark, d, 10, 16, 12, 3600)


@query(_fold_sql("event_type", 1, 3600 * 6))
def h04_repeat(spark: SparkSession, d: str) -> DataFrame:
    """Six-hour suppression of repeats, over all users."""
    return _fold(spark, d, "event_type", 1, 3600 * 6)


_ERRORS = _fold_sql("event_id % 40", 1, 3600 * 6).replace("ts) AS t,", "ts) AS t, event_type <> 'error' AS clean,").replace("SELECT event_id, k, t, n, true AS accepted, [t] AS times", "SELECT event_id, k, t, n, true AS accepted, CASE WHEN clean THEN [t] ELSE [] END AS times").replace("< 1 THEN list_append", "< 1 AND e.clean THEN list_append")


@query(_ERRORS)
def h04_error_free(spark: SparkSession, d: str) -> DataFrame:
    """Suppression of repeats for six hours, by runs that did not fail only."""
    rows = T.load(spark, d, "events").select("event_id", (F.col("event_id") % 40).alias("text"), "event_type", "ts")
    return TM.accepted(rows, "text", 1, 3600 * 6, at="ts", seq="event_id", counts=F.col("event_type") != "error").select("event_id", "accepted")


#: Runs of ten users over 600 query texts; the limit is raised now and then.
_RUNS = """WITH RECURSIVE e0 AS (SELECT event_id, user_id % 10 AS u, event_id % 600 AS q, event_id % 4 + 1 AS n, event_type = 'error' AS failed, (5000 + 100 * (event_id % 3))::BIGINT AS lim, {start} + (epoch_us(ts) - {start}) // 16 AS t FROM events),
e AS MATERIALIZED (SELECT *, strftime(make_timestamp(t), '%Y-%m') AS p, row_number() OVER (ORDER BY t, event_id) AS i FROM e0),
f AS (SELECT 0::BIGINT AS i, 0::BIGINT AS event_id, '' AS outcome, 0::BIGINT AS granted, []::STRUCT(t BIGINT, u BIGINT, q BIGINT, failed BOOLEAN)[] AS log, '' AS p, 0::BIGINT AS used, NULL::BIGINT AS stored
  UNION ALL SELECT i, event_id, CASE WHEN outcome = 'executed' AND granted = 0 THEN 'exhausted' ELSE outcome END, granted,
    CASE WHEN outcome = 'executed' AND granted > 0 THEN list_append(near, {{'t': t, 'u': u, 'q': q, 'failed': failed}}) ELSE near END, p, used + granted, CASE WHEN outcome = 'executed' THEN lim ELSE stored END
  FROM (SELECT *, CASE WHEN outcome = 'executed' THEN least(n, greatest(0, lim - used)) ELSE 0 END::BIGINT AS granted
  FROM (SELECT *, CASE WHEN len(list_filter(near, lambda x: x.u = u AND x.t >= t - 3600000000)) >= 12 THEN 'capped' WHEN used >= coalesce(stored, lim) THEN 'exhausted' WHEN len(list_filter(near, lambda x: x.q = q AND NOT x.failed)) > 0 THEN 'recent' ELSE 'executed' END AS outcome
  FROM (SELECT e.*, list_filter(f.log, lambda x: x.t >= e.t - 21600000000) AS near, CASE WHEN e.p = f.p THEN f.used ELSE 0 END AS used, CASE WHEN e.p = f.p THEN f.stored END AS stored FROM f JOIN e ON e.i = f.i + 1))))
SELECT event_id, outcome, granted FROM f WHERE i > 0"""


@query(_RUNS.format(start=f"epoch_us(TIMESTAMP '{_START}')"))
def h_live_runs(spark: SparkSession, d: str) -> DataFrame:
    """Hourly cap, repeat rule and monthly quota as one decision; only executed runs enter the logs."""
    e = T.load(spark, d, "events")
    start = F.unix_micros(F.lit(_START).cast("timestamp"))
    at = F.timestamp_micros(start + F.floor((F.unix_micros("ts") - start) / 16))
    runs = e.select("event_id", (F.col("user_id") % 10).alias("user"), (F.col("event_id") % 600).alias("query"), (F.col("event_id") % 4 + 1).alias("n"), (F.col("event_type") == "error").alias("failed"), at.alias("at"))
    out, _ = TM.live_runs(runs, 5000 + 100 * (F.col("event_id") % 3), seq="event_id")
    return out.select("event_id", "outcome", "granted")


_DAY, _WEEK = 86_400_000_000, 7 * 86_400_000_000
_REPORTS = f"""WITH RECURSIVE {_dense_sql(10, 4, "error")},
f AS (SELECT event_id, k, o, n, 'reported' AS outcome, [{{'t': t, 'o': o}}] AS filed FROM e WHERE n = 1
  UNION ALL SELECT event_id, k, o, n, outcome, CASE WHEN outcome = 'reported' THEN list_append(filed, {{'t': t, 'o': o}}) ELSE filed END FROM (
    SELECT e.event_id, e.k, e.o, e.n, e.t, f.filed, CASE WHEN len(list_filter(f.filed, lambda x: x.t >= e.t - {_DAY})) >= 20 THEN 'capped'
      WHEN len(list_filter(f.filed, lambda x: x.o = e.o AND x.t >= e.t - {_WEEK})) > 0 THEN 'already' ELSE 'reported' END AS outcome
    FROM f JOIN e ON e.k = f.k AND e.n = f.n + 1))
"""


def _reports(spark: SparkSession, d: str) -> DataFrame:
    return TM.reports(_dense(spark, d, 10, 4, "error"), "actor", "opp_id", seq="event_id")


@query(_REPORTS + "SELECT event_id, outcome FROM f")
def h05_reports(spark: SparkSession, d: str) -> DataFrame:
    """Twenty reports of a user in a day; one of the same listing within a week is done already."""
    return _reports(spark, d).select("event_id", "outcome")


@query(
    _REPORTS.replace("WITH RECURSIVE ", "WITH RECURSIVE " + ctes("opps")[5:] + ", ")
    + "SELECT opp_id, CASE WHEN state <> 'ARCHIVED' AND opp_id IN (SELECT o FROM f WHERE outcome = 'reported') THEN 'NEEDS_REVIEW' ELSE state END AS state FROM opps"
)
def h05_states(spark: SparkSession, d: str) -> DataFrame:
    return TM.reported_states(T.opportunities(spark, d).select("opp_id", "state"), _reports(spark, d), "opp_id")


@query(_cap_sql(3, 64, 30, 3600, "signup"))
def h06_admin_adds(spark: SparkSession, d: str) -> DataFrame:
    """Thirty additions of an admin in an hour; other events of the log do not count."""
    return _cap(spark, d, 3, 64, 30, 3600, "signup")


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)::BIGINT AS n FROM events")
def w09_trailing_count(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").withColumn("us", F.unix_micros("ts"))
    return e.select("event_id", F.count(F.lit(1)).over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-86_400_000_000, 0)).alias("n"))


_CUT = f"TIMESTAMP '{EVENTS_NOW}'"


def _log(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "events").select("event_id", F.col("ts").alias("at"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("sent_at"))


@query(f"SELECT event_id FROM events WHERE ts >= {_CUT} - INTERVAL 20 DAY")
def h08_purged_queries(spark: SparkSession, d: str) -> DataFrame:
    return TM.purge(_log(spark, d), _log(spark, d), T.events_now(), 20, 10)[0].select("event_id")


@query(f"SELECT event_id FROM events WHERE NOT (ts < {_CUT} - INTERVAL 10 DAY AND event_id % 2 = 0)")
def h08_purged_notifications(spark: SparkSession, d: str) -> DataFrame:
    return TM.purge(_log(spark, d), _log(spark, d), T.events_now(), 20, 10)[1].select("event_id")


@query(f"SELECT count(*) FILTER (WHERE ts < {_CUT} - INTERVAL 20 DAY)::BIGINT AS due, count(*)::BIGINT AS total, epoch_us(min(ts)) AS oldest FROM events")
def h09_preview(spark: SparkSession, d: str) -> DataFrame:
    return TM.retention_preview(_log(spark, d), T.events_now(), 20).withColumn("oldest", F.unix_micros("oldest"))


_NEW = ["SUBMITTED", "ACCEPTED", "REJECTED", "WAITLISTED", "PREPARING"]


@query(
    f"""WITH o AS (SELECT o_orderkey AS app_id, {T._pick(_NEW, 'o_orderkey')} AS s, CASE WHEN o_orderkey % 2 = 0 THEN epoch(o_orderdate)::BIGINT END AS sub FROM orders)
SELECT app_id, s AS status, CASE WHEN s = 'SUBMITTED' THEN epoch(TIMESTAMP '2000-01-15')::BIGINT ELSE sub END AS submitted, CASE WHEN s IN ('ACCEPTED', 'REJECTED', 'WAITLISTED') THEN epoch(TIMESTAMP '2000-01-15')::BIGINT END AS decided, CASE WHEN s IN ('ACCEPTED', 'REJECTED', 'WAITLISTED') THEN s END AS outcome FROM o"""
)
def h14_status(spark: SparkSession, d: str) -> DataFrame:
    o = T.load(spark, d, "orders")
    rows = o.select(F.col("o_orderkey").alias("app_id"), F.lit("STARTED").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("submitted_at"), F.lit(None).cast("timestamp").alias("decision_at"), F.lit(None).cast("string").alias("outcome"))
    out = TM.status_effects(rows, T.pick(_NEW, F.col("app_id")), T.now())
    return out.select("app_id", "status", F.unix_seconds("submitted_at").alias("submitted"), F.unix_seconds("decision_at").alias("decided"), "outcome")


# ------------------------------------------------------------------- counting


@query(ctes("opps") + "SELECT state, count(*)::BIGINT AS n, sum(count(*)) OVER ()::BIGINT AS total FROM opps GROUP BY state")
def a01_state_counts(spark: SparkSession, d: str) -> DataFrame:
    n = T.opportunities(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(1))))


@query("SELECT user_id, count(*)::BIGINT AS n, count(*) FILTER (WHERE value > 50)::BIGINT AS high, max(value) AS most FROM events GROUP BY user_id")
def a02_filtered_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.max("value").alias("most"))


@query(ctes("opps") + "SELECT state, min({'a': first_seen_at, 'b': opp_id}).b AS oldest FROM opps GROUP BY state")
def a17_oldest(spark: SparkSession, d: str) -> DataFrame:
    return T.opportunities(spark, d).groupBy("state").agg(F.min_by("opp_id", F.struct("first_seen_at", "opp_id")).alias("oldest"))


@query(ctes("opps") + "SELECT opp_id, state FROM opps ORDER BY state, first_seen_at DESC, opp_id LIMIT 25")
def o04_review_queue(spark: SparkSession, d: str) -> DataFrame:
    return T.opportunities(spark, d).orderBy("state", F.desc("first_seen_at"), "opp_id").limit(25).select("opp_id", "state")
