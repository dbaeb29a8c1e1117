"""Changes of tables as pure functions of DataFrames: the result is a new table to write.

Several outputs of one change are not written atomically; a table format with
transactions gives that where it is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``changes`` replace rows of ``table`` with their key; by ``order`` the last of several changes wins."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
        changes = changes.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
    kept = table.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes.select(*table.columns))


def update_where(table: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def toggle_tasks(tasks: DataFrame, applications: DataFrame, changes: DataFrame) -> DataFrame:
    """Tasks after students ticked them: changes (user_id, task_id, complete, at), the last of a task counts.

    A change only reaches a task whose application is the student's own; all others do nothing.
    Unticking clears the time.
    """
    own = changes.join(tasks.select("task_id", "app_id"), "task_id").join(applications.select("app_id", "user_id"), ["app_id", "user_id"], "left_semi")
    last = top_per_key(own, "task_id", [F.desc("at"), F.desc("complete")], 1).select("task_id", "complete", "at")
    done = F.when(F.col("complete").isNotNull(), F.when(F.col("complete"), F.col("at"))).otherwise(F.col("completed_at"))
    return tasks.join(last, "task_id", "left").withColumns({"is_complete": F.coalesce("complete", "is_complete"), "completed_at": done}).select(*tasks.columns)


def nested_create(records: DataFrame, key: str, children: dict[str, str]) -> dict[str, DataFrame]:
    """One table of parents and one of each kind of children from nested records.

    ``children`` names the array columns by table; a child has the parent's key, its place from 0
    and its fields. Empty and null arrays give no rows.
    """
    out = {"parents": records.drop(*children.values())}
    for name, column in children.items():
        element = records.schema[column].dataType.elementType.typeName()
        rows = records.select(key, F.posexplode(column).alias("pos", "value"))
        out[name] = rows.select(key, "pos", "value.*") if element == "struct" else rows
    return out


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """A condition that is null deletes nothing."""
    return table.filter(~F.coalesce(condition, F.lit(False)))


def replace_children(children: DataFrame, parents: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the given parents give way to the new ones."""
    return children.join(parents.select(key).distinct(), key, "left_anti").unionByName(new.select(*children.columns))


def cascade(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def erase_users(gone: DataFrame, owned: dict[str, DataFrame], queries: DataFrame, users: DataFrame) -> dict[str, DataFrame]:
    """Account erasure: owned rows go, query logs lose their user, users are anonymised."""
    ids = gone.select("user_id").distinct().withColumn("_gone", F.lit(True))
    out = {name: cascade(df, gone, "user_id") for name, df in owned.items()}
    q = queries.join(ids, "user_id", "left")
    out["queries"] = q.withColumn("user_id", F.when(F.col("_gone").isNull(), F.col("user_id"))).select(*queries.columns)
    u = users.join(ids, "user_id", "left")
    blank = {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in users.columns if c != "user_id"}
    out["users"] = u.withColumns(blank).withColumn("deleted", F.col("_gone").isNotNull()).drop("_gone")
    return out


def decide(table: DataFrame, decisions: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(table with new states, audit rows) of reviewers' decisions: key, actor, action, new_state, note."""
    out = table.join(decisions.select(key, "new_state"), key, "left").withColumn("state", F.coalesce("new_state", "state")).drop("new_state")
    audit = decisions.join(table.select(key), key, "left_semi").select(key, "actor", "action", F.substring("note", 1, 500).alias("note"))
    return out, audit


def top_per_key(rows: DataFrame, key: str, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")
