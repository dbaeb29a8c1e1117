"""Deadline, checklist, readiness and calendar queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domains import DEADLINE_LABELS, REQUIREMENT_KINDS, TASK_LEAD_DAYS
from ..functions import dates as DT
from ..operators import checklist as C
from ..operators import deadlines as L
from ..sources import ics
from ..sources import tables as T
from ..sources.tables import NOW, ctes
from .registry import query

ACT = "kind IN ('APPLICATION_DEADLINE', 'EARLY_DEADLINE', 'REGISTRATION_DEADLINE', 'DOCUMENT_DEADLINE')"
_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in DEADLINE_LABELS.items())


def _count_words(past: str, yesterday: str, today: str, tomorrow: str, ahead: str) -> str:
    return f"""CASE WHEN days < -1 THEN '{past}' || (-days) || ' days ago' WHEN days < 0 THEN '{yesterday}' WHEN days = 0 THEN '{today}' WHEN days = 1 THEN '{tomorrow}'
    WHEN days <= 27 THEN '{ahead}' || days || ' days' WHEN floor(days / 7 + 0.5) < 9 THEN '{ahead}' || floor(days / 7 + 0.5)::BIGINT || ' weeks' ELSE '{ahead}' || floor(days / 30 + 0.5)::BIGINT || ' months' END"""


TRIAGE = (
    ctes("dl")
    + f""", d0 AS (SELECT *, floor((epoch_us(date) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000)::BIGINT AS days FROM dl),
tri AS (SELECT *, CASE kind {_CASES} ELSE kind END AS label, CASE WHEN days < 0 THEN 'PASSED' WHEN days <= 3 THEN 'URGENT' WHEN days <= 7 THEN 'SOON' WHEN days <= 21 THEN 'UPCOMING' ELSE 'CALM' END AS level,
  CASE WHEN days < 0 AND NOT {ACT} THEN CASE WHEN kind = 'APPLICATION_OPENS' THEN 'Open now' ELSE 'Already happened' END WHEN days < 0 THEN 'Closed' WHEN days <= 3 THEN 'Due very soon' WHEN days <= 7 THEN 'Due this week' WHEN days <= 21 THEN 'Coming up' ELSE 'Plenty of time' END AS band,
  CASE WHEN {ACT} THEN {_count_words('Closed ', 'Closed yesterday', 'Due today', 'Due tomorrow', 'Due in ')} ELSE {_count_words('', 'Yesterday', 'Today', 'Tomorrow', 'In ')} END AS countdown, {ACT} AS actionable FROM d0)
"""
)


def _triaged(spark: SparkSession, d: str) -> DataFrame:
    return L.triage(T.deadlines(spark, d), T.now())


@query(TRIAGE + "SELECT opp_id, deadline_id, kind, label, days, level, band, countdown, actionable FROM tri")
def c01_triage(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d).select("opp_id", "deadline_id", "kind", "label", "days", "level", "band", "countdown", "actionable")


@query(TRIAGE + "SELECT deadline_id, days, level FROM tri")
def d01_elapsed_days(spark: SparkSession, d: str) -> DataFrame:
    return _triaged(spark, d).select("deadline_id", "days", "level")


@query(TRIAGE + "SELECT opp_id, deadline_id, kind, level FROM tri WHERE actionable QUALIFY row_number() OVER (PARTITION BY opp_id ORDER BY level = 'PASSED', date, deadline_id) = 1")
def c02_primary_deadline(spark: SparkSession, d: str) -> DataFrame:
    return L.primary_deadline(_triaged(spark, d)).select("opp_id", "deadline_id", "kind", "level")


@query(ctes("dl") + f"SELECT opp_id, deadline_id, kind FROM dl WHERE {ACT} AND NOT is_rolling AND date >= TIMESTAMP '{NOW}' QUALIFY row_number() OVER (PARTITION BY opp_id ORDER BY date, deadline_id) = 1")
def j10_next_deadline(spark: SparkSession, d: str) -> DataFrame:
    return L.next_actionable(T.deadlines(spark, d), T.now()).select("opp_id", "deadline_id", "kind")


@query(TRIAGE + "SELECT level, count(*)::BIGINT AS n, CASE level WHEN 'URGENT' THEN 1 WHEN 'SOON' THEN 2 WHEN 'UPCOMING' THEN 3 WHEN 'CALM' THEN 4 ELSE 5 END::INT AS place FROM tri GROUP BY level")
def a10_urgency_buckets(spark: SparkSession, d: str) -> DataFrame:
    return L.buckets(_triaged(spark, d))


@query(TRIAGE + "SELECT opp_id, count(*) FILTER (WHERE actionable AND days BETWEEN 0 AND 7)::BIGINT AS due FROM tri GROUP BY opp_id")
def a09_due_within(spark: SparkSession, d: str) -> DataFrame:
    return L.due_within(_triaged(spark, d), 7, "opp_id")


@query(
    ctes("opps", "dl")
    + f""", act AS (SELECT opp_id, bool_or(is_rolling) AS rolling, max(date) AS last FROM dl WHERE kind IN ('APPLICATION_DEADLINE', 'REGISTRATION_DEADLINE') GROUP BY opp_id)
SELECT opp_id, CASE WHEN NOT rolling AND last < TIMESTAMP '{NOW}' AND state NOT IN ('EXPIRED', 'ARCHIVED') THEN 'EXPIRED' ELSE state END AS state FROM opps LEFT JOIN act USING (opp_id)"""
)
def h07_expiry(spark: SparkSession, d: str) -> DataFrame:
    return L.sweep_expired(T.opportunities(spark, d), T.deadlines(spark, d), T.now())[0].select("opp_id", "state")


@query(
    ctes("opps", "dl")
    + f""", act AS (SELECT opp_id, bool_or(is_rolling) AS rolling, max(date) AS last FROM dl WHERE kind IN ('APPLICATION_DEADLINE', 'REGISTRATION_DEADLINE') GROUP BY opp_id)
SELECT opp_id, 'SYSTEM' AS actor, 'MARKED_EXPIRED' AS action FROM opps JOIN act USING (opp_id) WHERE NOT rolling AND last < TIMESTAMP '{NOW}' AND state NOT IN ('EXPIRED', 'ARCHIVED')"""
)
def h07_expiry_audit(spark: SparkSession, d: str) -> DataFrame:
    return L.sweep_expired(T.opportunities(spark, d), T.deadlines(spark, d), T.now())[1].select("opp_id", "actor", "action")


# ------------------------------------------------------------------ checklist

LABELS = ["Two letters of recommendation", "Upload your academic transcript", "500-word personal statement", "Pay the application fee", "Something unusual", "A photo ID", "Attend an interview", "Sign up on the site", "The questionnaire", "Certified transcript copy"]
_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_KIND = "CASE " + " ".join(f"WHEN regexp_matches(label, '{p}', 'i') THEN '{k}'" for k, p in REQUIREMENT_KINDS) + " ELSE 'CUSTOM' END"
_LEAD = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TASK_LEAD_DAYS.items()) + " END"
REQ = ctes("opps") + f", req AS (SELECT opp_id, i AS pos, ({_LIST})[(opp_id * 3 + i * 7) % {len(LABELS)} + 1] AS label FROM opps, (SELECT unnest(range(7)) AS i) WHERE i < n_requirements),\nrk AS (SELECT *, {_KIND} AS kind FROM req)\n"


def _requirements(spark: SparkSession, d: str) -> DataFrame:
    o = T.opportunities(spark, d)
    one = o.filter("n_requirements > 0").select("opp_id", F.explode(F.sequence(F.lit(0), F.col("n_requirements") - 1)).alias("pos"))
    return one.withColumn("label", F.get(F.array(*map(F.lit, LABELS)), ((F.col("opp_id") * 3 + F.col("pos") * 7) % len(LABELS)).cast("int")))


@query(REQ + "SELECT opp_id, pos::INT AS pos, kind FROM rk")
def c04_classify(spark: SparkSession, d: str) -> DataFrame:
    return _requirements(spark, d).select("opp_id", "pos", C.classify_requirement(F.col("label")).alias("kind"))


@query(
    REQ
    + f""", dr AS (SELECT opp_id, pos + 100 AS pos, label AS title, kind, kind <> 'INTERVIEW_PREP' AS blocks_submission, {_LEAD} AS lead_days FROM rk QUALIFY kind = 'CUSTOM' OR row_number() OVER (PARTITION BY opp_id, kind ORDER BY pos) = 1),
ba AS (SELECT opp_id, b.* FROM opps, (VALUES (0, 'Read the official page in full', 'CUSTOM', false, 1), (1, 'Create an account with the organiser', 'ACCOUNT', true, 2), (2, 'Complete the application form', 'FORM', true, 3), (3, 'Submit the application', 'SUBMIT', true, 1)) b(pos, title, kind, blocks_submission, lead_days)
  WHERE NOT EXISTS (SELECT 1 FROM dr WHERE dr.opp_id = opps.opp_id AND dr.kind = b.kind AND b.kind <> 'CUSTOM')),
al AS (SELECT * FROM ba UNION ALL SELECT * FROM dr)
SELECT opp_id, (row_number() OVER (PARTITION BY opp_id ORDER BY kind = 'SUBMIT', lead_days DESC, pos) - 1)::INT AS sort_order, title, kind, blocks_submission, lead_days::INT AS lead_days FROM al"""
)
def c05_checklist(spark: SparkSession, d: str) -> DataFrame:
    return C.build_checklist(_requirements(spark, d), T.opportunities(spark, d))


KINDS = list(TASK_LEAD_DAYS)
TASKS = f"""WITH tk0 AS (SELECT l_orderkey AS app_id, l_linenumber AS task_no, {T._pick(KINDS, 'l_partkey')} AS kind, l_linenumber <> 4 AS is_required, l_linestatus = 'F' AS is_complete, l_suppkey % 3 <> 0 AS blocks_submission,
  CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate + to_days((o_orderkey % 40)::INT) END AS deadline FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tk AS (SELECT *, 'Task ' || kind || ' ' || task_no AS title, {_LEAD} AS lead_days, floor((epoch_us(deadline) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000)::BIGINT AS days_left FROM tk0),
tu AS (SELECT *, CASE WHEN NOT is_complete THEN days_left - lead_days END AS slack_days FROM tk)
"""


def _tasks(spark: SparkSession, d: str) -> DataFrame:
    li, o = T.load(spark, d, "lineitem"), T.load(spark, d, "orders")
    kind = T.pick(KINDS, F.col("l_partkey"))
    rows = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    due = F.when(F.col("l_orderkey") % 9 != 0, F.col("o_orderdate") + F.make_dt_interval(days=(F.col("l_orderkey") % 40).cast("int")))
    return rows.select(
        F.col("l_orderkey").alias("app_id"),
        F.col("l_linenumber").alias("task_no"),
        kind.alias("kind"),
        F.concat(F.lit("Task "), kind, F.lit(" "), F.col("l_linenumber").cast("string")).alias("title"),
        (F.col("l_linenumber") != 4).alias("is_required"),
        (F.col("l_linestatus") == "F").alias("is_complete"),
        (F.col("l_suppkey") % 3 != 0).alias("blocks_submission"),
        DT.lookup(TASK_LEAD_DAYS, kind).alias("lead_days"),
        due.alias("deadline"),
    )


@query(
    TASKS
    + """SELECT app_id, task_no, slack_days, coalesce(slack_days < 0, false) AS is_behind, CASE WHEN slack_days < 0 THEN CASE WHEN kind = 'RECOMMENDATION'
  THEN 'This usually needs about ' || lead_days || ' days because it depends on someone else replying. The deadline is in ' || days_left || ' days — ask now.'
  ELSE 'This normally takes around ' || lead_days || ' days and the deadline is in ' || days_left || '.' END END AS message FROM tu"""
)
def c06_task_urgency(spark: SparkSession, d: str) -> DataFrame:
    return C.task_urgency(_tasks(spark, d), T.now()).select("app_id", "task_no", "slack_days", "is_behind", "message")


READY = (
    TASKS
    + """, rd AS (SELECT app_id, count(*) FILTER (WHERE is_required AND is_complete) AS completed, count(*) FILTER (WHERE is_required) AS total,
  count(*) FILTER (WHERE is_required AND NOT is_complete AND blocks_submission) AS blockers, count(*) FILTER (WHERE is_required AND slack_days < 0) AS behind,
  (min({'n': task_no, 't': title}) FILTER (WHERE is_required AND slack_days < 0)).t AS b0, (min({'l': -lead_days, 'n': task_no, 't': title}) FILTER (WHERE is_required AND NOT is_complete AND blocks_submission)).t AS b1,
  (min({'n': task_no, 't': title}) FILTER (WHERE is_required AND NOT is_complete)).t AS b2, (min({'n': task_no, 't': title}) FILTER (WHERE is_required AND NOT is_complete AND blocks_submission)).t AS b3, max(days_left) AS days FROM tu GROUP BY app_id)
"""
)


@query(READY + "SELECT app_id, CASE WHEN total = 0 THEN 0 ELSE floor(completed / total * 100.0::DOUBLE + 0.5)::BIGINT END AS score, completed::BIGINT AS completed, total::BIGINT AS total, blockers::BIGINT AS blockers, behind::BIGINT AS behind, coalesce(b0, b1, b2) AS next_action, blockers = 0 AND total > 0 AS can_submit FROM rd")
def c07_readiness(spark: SparkSession, d: str) -> DataFrame:
    return C.readiness(_tasks(spark, d), T.now()).select("app_id", "score", "completed", "total", "blockers", "behind", "next_action", "can_submit")


@query(
    READY
    + """, w AS (SELECT *, 'Order ' || app_id || ' is due ' || CASE days WHEN 0 THEN 'today' WHEN 1 THEN 'tomorrow' ELSE 'in ' || days || ' days' END AS due FROM rd)
SELECT app_id, CASE WHEN days >= 0 THEN CASE WHEN behind > 0 THEN due || ', and ' || lower(b0[1]) || b0[2:] || ' usually takes longer than the time you have left.'
  WHEN blockers = 1 THEN due || ', and ' || lower(b3[1]) || b3[2:] || ' is the only thing left before you can submit.'
  WHEN blockers > 1 THEN due || ', with ' || blockers || ' things still outstanding — starting with ' || lower(b3[1]) || b3[2:] || '.'
  ELSE due || ' and everything on your checklist is done. Submit when you''re ready.' END END AS reminder FROM w"""
)
def c08_reminder(spark: SparkSession, d: str) -> DataFrame:
    return C.readiness(_tasks(spark, d), T.now()).select("app_id", C.reminder(F.concat(F.lit("Order "), F.col("app_id").cast("string")), T.now()).alias("reminder"))


@query(READY + "SELECT count(*) FILTER (WHERE behind > 0)::BIGINT AS needs_action, count(*) FILTER (WHERE days BETWEEN 0 AND 7)::BIGINT AS due_this_week, count(*)::BIGINT AS applications FROM rd")
def c09_dashboard(spark: SparkSession, d: str) -> DataFrame:
    days = DT.days_between(F.col("deadline"), T.now())
    return C.readiness(_tasks(spark, d), T.now()).agg(F.count_if(F.col("behind") > 0).alias("needs_action"), F.count_if(days.between(0, 7)).alias("due_this_week"), F.count(F.lit(1)).alias("applications"))


# ------------------------------------------------------------------- calendar


def _calendar(spark: SparkSession, d: str) -> DataFrame:
    rows = T.deadlines(spark, d).withColumn("user_id", F.col("deadline_id") % 100)
    out = L.calendar_union(rows.filter("deadline_id % 3 = 0").withColumn("src", F.lit(0)), rows.filter("deadline_id % 3 <> 0").withColumn("src", F.lit(1)))
    slug = F.concat(F.lit("opp-"), F.col("opp_id").cast("string"))
    return out.withColumns({"slug": slug, "title": F.concat(F.lit("Opportunity, no; "), F.col("opp_id").cast("string")), "url": F.concat(F.lit("https://example.org/"), slug), "raw_text": F.when(F.col("deadline_id") % 2 == 0, "by noon; local time")})


CAL = (
    ctes("dl")
    + """, r AS (SELECT *, deadline_id % 100 AS user_id FROM dl), app AS (SELECT *, 0 AS src FROM r WHERE deadline_id % 3 = 0),
u AS (SELECT * FROM app UNION ALL SELECT *, 1 AS src FROM r WHERE deadline_id % 3 <> 0 AND opp_id NOT IN (SELECT opp_id FROM app))
"""
)


@query(CAL + "SELECT opp_id, deadline_id, src::INT AS src FROM u")
def u01_calendar_union(spark: SparkSession, d: str) -> DataFrame:
    return _calendar(spark, d).select("opp_id", "deadline_id", "src")


@query(
    CAL
    + f""", e AS (SELECT *, 'opp-' || opp_id || '-' || kind || '-' || epoch_ms(date) || '@calendar.invalid' AS uid, CASE kind {_CASES} ELSE kind END AS label FROM u WHERE NOT is_rolling),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, uid ORDER BY src, opp_id, deadline_id % 2) = 1)
SELECT user_id, uid, count(*)::BIGINT AS n FROM f GROUP BY user_id, uid"""
)
def u02_uid_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return ics.events(_calendar(spark, d), T.now()).groupBy("user_id", "uid").agg(F.count(F.lit(1)).alias("n"))


@query(
    CAL
    + f""", e AS (SELECT *, 'opp-' || opp_id || '-' || kind || '-' || epoch_ms(date) || '@calendar.invalid' AS uid, CASE kind {_CASES} ELSE kind END AS label FROM u WHERE NOT is_rolling AND deadline_id % 2 = 1)
SELECT DISTINCT user_id, array_to_string(['BEGIN:VEVENT', 'UID:' || uid, 'DTSTAMP:20000115T000000Z', 'DTSTART;VALUE=DATE:' || strftime(date, '%Y%m%d'), 'DTEND;VALUE=DATE:' || strftime(date + INTERVAL 1 DAY, '%Y%m%d'),
  'SUMMARY:' || label || ': Opportunity\\, no\\; ' || opp_id, 'DESCRIPTION:Confirm on the official page: https://example.org/opp-' || opp_id, 'URL:https://example.org/opp-' || opp_id, 'END:VEVENT'], chr(13) || chr(10)) AS event FROM e"""
)
def s10_ics_lines(spark: SparkSession, d: str) -> DataFrame:
    return ics.events(_calendar(spark, d).filter("raw_text is null"), T.now()).select("user_id", "event")


@query(ctes("dl") + f"SELECT opp_id, deadline_id, kind FROM dl WHERE date < TIMESTAMP '{NOW}' ORDER BY date DESC, deadline_id LIMIT 8")
def o06_recent_past(spark: SparkSession, d: str) -> DataFrame:
    return T.deadlines(spark, d).filter(F.col("date") < T.now()).orderBy(F.desc("date"), "deadline_id").limit(8).select("opp_id", "deadline_id", "kind")


@query("SELECT o_orderkey AS app_id, row_number() OVER (ORDER BY o_orderstatus = 'F', CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END ASC NULLS LAST, o_orderkey)::INT AS place FROM orders QUALIFY place <= 100")
def o05_missing_last(spark: SparkSession, d: str) -> DataFrame:
    """Applications page: closed ones at the end, missing deadlines last; the first hundred places."""
    o = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("app_id"), (F.col("o_orderstatus") == "F").alias("closed"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate")).alias("due"))
    order = (F.col("closed"), F.asc_nulls_last("due"), F.col("app_id"))
    return o.orderBy(*order).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order))).select("app_id", "place")
