"""Application checklists, their urgency, readiness and the reminder sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.dates import days_between, lookup, round_half_up
from ..functions.patterns import first_kind
from ..functions.text import lower_first

#: (title, kind, blocks submission, lead days) of the tasks that every application has; SUBMIT comes last.
BASE_TASKS = [("Read the official page in full", "CUSTOM", False, 1), ("Create an account with the organiser", "ACCOUNT", True, 2), ("Complete the application form", "FORM", True, 3)]
SUBMIT_TASK = ("Submit the application", "SUBMIT", True, 1)


def classify_requirement(label: Column) -> Column:
    return first_kind(label, D.REQUIREMENT_KINDS, "CUSTOM")


def build_checklist(requirements: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Tasks of each opportunity: opp_id, sort_order, title, kind, blocks_submission, lead_days.

    ``requirements`` has opp_id, pos, label and an optional kind. One task per
    kind, the first wins, CUSTOM is exempt; base tasks give way to derived ones
    of their kind. Longest lead first, SUBMIT last.
    """
    kind = F.coalesce(F.col("kind"), classify_requirement(F.col("label"))) if "kind" in requirements.columns else classify_requirement(F.col("label"))
    req = requirements.select("opp_id", "pos", F.col("label").alias("title"), kind.alias("kind"))
    first = Window.partitionBy("opp_id", "kind").orderBy("pos")
    derived = req.withColumn("rn", F.row_number().over(first)).filter("rn = 1 or kind = 'CUSTOM'").drop("rn")
    derived = derived.select("opp_id", (F.col("pos") + 100).alias("pos"), "title", "kind", (F.col("kind") != "INTERVIEW_PREP").alias("blocks_submission"), lookup(D.TASK_LEAD_DAYS, F.col("kind")).alias("lead_days"))
    fixed = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(t).alias("title"), F.lit(k).alias("kind"), F.lit(b).alias("blocks_submission"), F.lit(d).alias("lead_days")) for i, (t, k, b, d) in enumerate([*BASE_TASKS, SUBMIT_TASK])])
    base = opportunities.select("opp_id", F.inline(fixed))
    covered = derived.filter("kind <> 'CUSTOM'").select("opp_id", "kind").distinct()
    base = base.join(covered, ["opp_id", "kind"], "left_anti").unionByName(derived)
    order = Window.partitionBy("opp_id").orderBy((F.col("kind") == "SUBMIT").cast("int"), F.desc("lead_days"), "pos")
    return base.withColumn("sort_order", F.row_number().over(order) - 1).select("opp_id", "sort_order", "title", "kind", "blocks_submission", "lead_days")


def task_urgency(tasks: DataFrame, now: Column) -> DataFrame:
    """Adds days_left, slack_days (null where nothing presses), is_behind and message; needs deadline, lead_days and is_complete."""
    days = days_between(F.col("deadline"), now)
    slack = F.when(~F.col("is_complete"), days - F.col("lead_days"))
    left, lead = days.cast("string"), F.col("lead_days").cast("string")
    message = F.when(F.col("kind") == "RECOMMENDATION", F.concat(F.lit("This usually needs about "), lead, F.lit(" days because it depends on someone else replying. The deadline is in "), left, F.lit(" days — ask now."))).otherwise(
        F.concat(F.lit("This normally takes around "), lead, F.lit(" days and the deadline is in "), left, F.lit("."))
    )
    return tasks.withColumns({"days_left": days, "slack_days": slack, "is_behind": F.coalesce(slack < 0, F.lit(False)), "message": F.when(slack < 0, message)})


def readiness(tasks: DataFrame, now: Column) -> DataFrame:
    """One row per application: score over required tasks, counts, the next action, and what reminders need.

    The next action is the first task behind schedule, else the blocker of the
    longest lead, else the first open one; ties keep list order.
    """
    t = task_urgency(tasks, now)
    required, open_ = F.col("is_required"), F.col("is_required") & ~F.col("is_complete")
    blocker = open_ & F.col("blocks_submission")
    at = lambda cond, *key: F.min(F.when(cond, F.struct(*key, F.col("task_no").alias("n"), F.col("title").alias("t"))))
    out = t.groupBy("app_id").agg(
        F.count_if(required & F.col("is_complete")).alias("completed"),
        F.count_if(required).alias("total"),
        F.count_if(blocker).alias("blockers"),
        F.count_if(open_ & F.col("is_behind")).alias("behind"),
        at(open_ & F.col("is_behind")).alias("b0"),
        at(blocker, (-F.col("lead_days")).alias("l")).alias("b1"),
        at(open_).alias("b2"),
        at(blocker).alias("b3"),
        F.max("deadline").alias("deadline"),
    )
    score = F.when(F.col("total") == 0, 0).otherwise(round_half_up(F.col("completed") / F.col("total") * F.lit(100.0)))
    return out.select(
        "app_id",
        score.cast("long").alias("score"),
        "completed",
        "total",
        "blockers",
        "behind",
        F.coalesce("b0.t", "b1.t", "b2.t").alias("next_action"),
        ((F.col("blockers") == 0) & (F.col("total") > 0)).alias("can_submit"),
        F.col("b0.t").alias("first_behind"),
        F.col("b3.t").alias("first_blocker"),
        "deadline",
    )


def reminder(title: Column, now: Column) -> Column:
    """The reminder sentence of a readiness row; null without a deadline or after it."""
    days = days_between(F.col("deadline"), now)
    when = F.when(days == 0, "today").when(days == 1, "tomorrow").otherwise(F.concat(F.lit("in "), days.cast("string"), F.lit(" days")))
    due = F.concat(title, F.lit(" is due "), when)
    text = (
        F.when(F.col("behind") > 0, F.concat(due, F.lit(", and "), lower_first(F.col("first_behind")), F.lit(" usually takes longer than the time you have left.")))
        .when(F.col("blockers") == 1, F.concat(due, F.lit(", and "), lower_first(F.col("first_blocker")), F.lit(" is the only thing left before you can submit.")))
        .when(F.col("blockers") > 1, F.concat(due, F.lit(", with "), F.col("blockers").cast("string"), F.lit(" things still outstanding — starting with "), lower_first(F.col("first_blocker")), F.lit(".")))
        .otherwise(F.concat(due, F.lit(" and everything on your checklist is done. Submit when you're ready.")))
    )
    return F.when(days >= 0, text)
