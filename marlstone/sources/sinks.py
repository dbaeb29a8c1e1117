"""Sinks of logs and JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def append_log(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Append rows to a parquet log, in folders by a column's day where one is given."""
    if by is None:
        rows.write.mode("append").parquet(path)
    else:
        rows.withColumn("day", F.to_date(by)).write.mode("append").partitionBy("day").parquet(path)


def json_text(value: Column) -> Column:
    """An array, map or struct as JSON text; null stays null."""
    return F.to_json(value)
