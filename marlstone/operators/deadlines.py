"""Deadline triage, buckets, and the dates that lead a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.dates import band_label, countdown, days_between, is_actionable, lookup, urgency

#: Order of the urgency groups on a dashboard.
URGENCY_ORDER = {"URGENT": 1, "SOON": 2, "UPCOMING": 3, "CALM": 4, "PASSED": 5}


def triage(deadlines: DataFrame, now: Column) -> DataFrame:
    """``deadlines`` with label, days, level, band, countdown and actionable. Unknown kinds label themselves."""
    days, kind = F.col("days"), F.col("kind")
    out = deadlines.withColumn("days", days_between(F.col("date"), now))
    return out.withColumns({"label": F.coalesce(lookup(D.DEADLINE_LABELS, kind), kind), "level": urgency(days), "band": band_label(kind, days), "countdown": countdown(kind, days), "actionable": is_actionable(kind)})


def primary_deadline(triaged: DataFrame) -> DataFrame:
    """The one date per opportunity to lead with: the first open actionable one, else the first actionable one."""
    w = Window.partitionBy("opp_id").orderBy((F.col("level") == "PASSED").cast("int"), "date", "deadline_id")
    return triaged.filter("actionable").withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def next_actionable(deadlines: DataFrame, now: Column) -> DataFrame:
    """The earliest actionable deadline from now on that is not rolling, per opportunity."""
    open_ = deadlines.filter(is_actionable(F.col("kind")) & ~F.coalesce("is_rolling", F.lit(False)) & (F.col("date") >= now))
    return open_.groupBy("opp_id").agg(F.min(F.struct("date", "deadline_id", "kind")).alias("m")).select("opp_id", "m.deadline_id", "m.kind", "m.date")


def buckets(triaged: DataFrame) -> DataFrame:
    """Numbers per urgency level, in dashboard order; empty levels are left out."""
    return triaged.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("place", lookup(URGENCY_ORDER, F.col("level")))


def due_within(triaged: DataFrame, days: int, *by: str) -> DataFrame:
    """How many actionable dates lie from today to ``days`` ahead."""
    return triaged.groupBy(*by).agg(F.count_if(F.col("actionable") & F.col("days").between(0, days)).alias("due"))


def calendar_union(applications: DataFrame, saved: DataFrame) -> DataFrame:
    """Deadlines of applied-for and saved opportunities; an application with any date supersedes its saved twin."""
    return applications.unionByName(saved.join(applications.select("opp_id").distinct(), "opp_id", "left_anti"))


def sweep_expired(opportunities: DataFrame, deadlines: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(opportunities with new states, audit rows): all application and registration dates past and none rolling expires."""
    act = deadlines.filter(F.col("kind").isin("APPLICATION_DEADLINE", "REGISTRATION_DEADLINE"))
    over = act.groupBy("opp_id").agg((~F.bool_or(F.coalesce("is_rolling", F.lit(False))) & (F.max("date") < now)).alias("over")).filter("over")
    rows = opportunities.join(over, "opp_id", "left")
    expire = F.coalesce("over", F.lit(False)) & ~F.col("state").isin("EXPIRED", "ARCHIVED")
    after = rows.withColumn("state", F.when(expire, "EXPIRED").otherwise(F.col("state"))).drop("over")
    audit = rows.filter(expire).select("opp_id", F.lit("SYSTEM").alias("actor"), F.lit("MARKED_EXPIRED").alias("action"), F.lit("Application deadline passed with no future cycle recorded.").alias("note"))
    return after, audit
