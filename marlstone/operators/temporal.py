"""State over time: quotas, rate limits, suppression, retention, consent and status changes.

Only accepted actions count against a limit, so acceptance is a fold over each
key's actions in order (`folds`): its state is bounded, and a key of any size is
spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.dates import age_on, period_key
from .folds import Accept, Quota, Report, fold_log
from .segments import decide


def quota(requests: DataFrame, limit: int, at: str = "at", n: str = "n", seq: str = "seq") -> DataFrame:
    """Adds period, granted, used of monthly reservations in order: what a request gets is what its month has left.

    used_i = min(limit, sum of requests so far), so no fold is needed. Sums run within a day and
    start from those of the month's earlier days, so no task holds a month.
    """
    r = requests.withColumn("period", period_key(F.col(at))).withColumn("_day", F.to_date(at))
    earlier = Window.partitionBy("period").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = r.groupBy("period", "_day").agg(F.sum(n).alias("_s")).withColumn("_before", F.coalesce(F.sum("_s").over(earlier), F.lit(0)))
    days = days.select(F.col("period").alias("_p"), F.col("_day").alias("_d"), "_before")
    r = r.join(days, F.col("period").eqNullSafe(F.col("_p")) & F.col("_day").eqNullSafe(F.col("_d")))
    upto = Window.partitionBy("period", "_day").orderBy(at, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("total", F.col("_before") + F.sum(n).over(upto))
    used = F.least(F.lit(limit), F.col("total"))
    return r.withColumn("granted", used - F.least(F.lit(limit), F.col("total") - F.col(n))).withColumn("used", used).drop("total", "_day", "_p", "_d", "_before")


def varying_quota(requests: DataFrame, limit: Column, at: str = "at", n: str = "n", seq: str = "seq") -> DataFrame:
    """Adds period, granted, used like `quota`, under a limit that may change from request to request.

    A request gets what is left under the limit as it is then; what is used never falls, whatever the limit does. Null and
    negative n ask for nothing, a null limit is 0. Requests without time have no period and get null.
    """
    columns = {"n": F.coalesce(n, F.lit(0)).cast("long"), "limit": F.coalesce(limit, F.lit(0)).cast("long")}
    r = fold_log(requests.withColumn("period", period_key(F.col(at))), F.col("period"), Quota(), "quota", columns, at, seq)
    return r.withColumns({"granted": F.col("quota.granted"), "used": F.col("quota.used")}).drop("quota")


def quota_status(requests: DataFrame, limit: int, at: str = "at", n: str = "n") -> DataFrame:
    s = requests.groupBy(period_key(F.col(at)).alias("period")).agg(F.least(F.lit(limit), F.sum(n)).alias("used"))
    return s.withColumns({"remaining": F.lit(limit) - F.col("used"), "exhausted": F.col("used") >= limit})


def accepted(actions: DataFrame, key: str, limit: int, window_seconds: int, at: str = "at", seq: str = "seq", counts: Column | None = None) -> DataFrame:
    """Adds ``accepted``: an action passes while fewer than ``limit`` accepted ones of its key lie in the
    window up to it, both ends included. ``limit`` 1 is suppression of repeats.

    ``counts`` says which actions count once they are accepted, all by default: failed runs, say, do not
    suppress a repeat; null is no. Rows without key are one key. Rows without time are neither accepted nor refused (null).
    """
    columns = {} if counts is None else {"counts": F.coalesce(counts, F.lit(False))}
    return fold_log(actions, F.col(key), Accept(limit, window_seconds * 1_000_000), "accepted", columns, at, seq)


def reports(actions: DataFrame, user: str, listing: str, limit: int = 20, cap_seconds: int = 86_400, same_seconds: int = 7 * 86_400, at: str = "at", seq: str = "seq") -> DataFrame:
    """Adds ``outcome``: `capped` where the user has filed ``limit`` reports in the day up to it, else `already` where
    one of them in the week up to it is of the same listing, else `reported`. Only the last kind is filed.

    Ends of windows count. ``listing`` is a number or a string; null is a listing too.
    """
    fold = Report(limit, cap_seconds * 1_000_000, same_seconds * 1_000_000)
    return fold_log(actions, F.col(user), fold, "outcome", {"listing": F.coalesce(F.col(listing).cast("string"), F.lit(""))}, at, seq)


def live_runs(runs: DataFrame, limit: Column, cap: int = 12, cap_seconds: int = 3600, repeat_seconds: int = 6 * 3600, at: str = "at", seq: str = "seq") -> tuple[DataFrame, int]:
    """Runs (user, query, n, failed, at, seq) under all three limits together, with ``outcome`` and ``granted``; and the rounds that took.

    In order, a run is `capped` where its user has ``cap`` executed ones in the hour up to it, `exhausted` where the month's
    searches are used up or none is left for it, `recent` where an executed run of the same query in the six hours up to it
    has not failed, else `executed`; only executed runs enter the logs, and each takes as many of its n searches as its month has left.
    ``limit`` is the month's limit as set at the time of the run; a month whose limit is reached stays closed.

    A user's, a query's and the month's runs hang on each other, so runs are decided in order of time, over segments of the log (`segments`).
    Rounds are as many as segments at most.
    """
    return decide(runs, limit, period_key(F.col(at)), cap, cap_seconds * 1_000_000, repeat_seconds * 1_000_000, at, seq)


def reported_states(listings: DataFrame, outcomes: DataFrame, key: str) -> DataFrame:
    """A listing with a filed report needs review, unless it is archived."""
    hit = outcomes.filter("outcome = 'reported'").select(key).distinct().withColumn("_hit", F.lit(True))
    out = listings.join(hit, key, "left")
    return out.withColumn("state", F.when(F.col("_hit") & (F.col("state") != "ARCHIVED"), "NEEDS_REVIEW").otherwise(F.col("state"))).drop("_hit")


def purge(queries: DataFrame, notifications: DataFrame, now: Column, query_days: int = 90, notification_days: int = 60) -> tuple[DataFrame, DataFrame]:
    """What stays: queries younger than the limit, and notifications that are younger or not yet sent."""
    cut = lambda days: now - F.make_dt_interval(days=F.lit(days))
    return queries.filter(F.col("at") >= cut(query_days)), notifications.filter(~((F.col("at") < cut(notification_days)) & F.col("sent_at").isNotNull()))


def retention_preview(rows: DataFrame, now: Column, days: int) -> DataFrame:
    cut = now - F.make_dt_interval(days=F.lit(days))
    return rows.agg(F.count_if(F.col("at") < cut).alias("due"), F.count(F.lit(1)).alias("total"), F.min("at").alias("oldest"))


def assess_age(born: Column, country: Column, now: Column) -> Column:
    age = age_on(born, now)
    return (
        F.when(born.isNull(), "ALLOWED").when(age < D.MINIMUM_AGE, "TOO_YOUNG")
        .when(F.coalesce(F.upper(country).isin(D.EU_COUNTRIES), F.lit(False)) & (age < D.EU_CONSENT_AGE), "NEEDS_PARENTAL_CONSENT").otherwise("ALLOWED")
    )


def consent_expiry(requested_at: Column) -> Column:
    return requested_at + F.make_dt_interval(days=F.lit(D.CONSENT_TTL_DAYS))


def consent_status(granted_at: Column, revoked_at: Column, expires_at: Column, now: Column) -> Column:
    """NONE without a record, that is without an expiry."""
    return F.when(expires_at.isNull(), "NONE").when(revoked_at.isNotNull(), "REVOKED").when(granted_at.isNotNull(), "GRANTED").when(expires_at <= now, "EXPIRED").otherwise("PENDING")


def account_usable(age_verdict: Column, status: Column) -> Column:
    return F.when(age_verdict == "ALLOWED", True).when(age_verdict == "TOO_YOUNG", False).otherwise(status == "GRANTED")


def settle_consent(found: Column, granted_at: Column, revoked_at: Column, expires_at: Column, approve: Column, now: Column) -> Column:
    """What a parent's answer does; the address is cleared on DECLINED and GRANTED."""
    return (
        F.when(~found, "NOT_FOUND").when(granted_at.isNotNull() | revoked_at.isNotNull(), "ALREADY_SETTLED").when(expires_at <= now, "EXPIRED")
        .when(approve, "GRANTED").otherwise("DECLINED")
    )


def status_effects(applications: DataFrame, new_status: Column, now: Column) -> DataFrame:
    """Applies a new status: submission and decision times and outcome follow it, all else stays."""
    decided = new_status.isin("ACCEPTED", "REJECTED", "WAITLISTED")
    return applications.withColumns(
        {
            "submitted_at": F.when(new_status == "SUBMITTED", now).otherwise(F.col("submitted_at")),
            "decision_at": F.when(decided, now).otherwise(F.col("decision_at")),
            "outcome": F.when(decided, new_status).otherwise(F.col("outcome")),
            "status": new_status,
        }
    )
