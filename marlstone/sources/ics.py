"""iCalendar sink: one text row per event, in file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..domains import DEADLINE_LABELS
from ..functions.dates import ics_day, ics_time, lookup
from ..functions.text import escape_ics

HEADER = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//Opportunity dates//EN", "CALSCALE:GREGORIAN", "METHOD:PUBLISH", "X-WR-CALNAME:Deadlines"]
FOOTER = ["END:VCALENDAR"]


def events(rows: DataFrame, now: Column, site: str = "calendar.invalid") -> DataFrame:
    """(user_id, uid, event): VEVENT blocks with CRLF between lines.

    ``rows`` has user_id, src (applications before saved), slug, title, url,
    kind, date, is_rolling, raw_text. Rolling dates have no day; the first row
    of a UID within a calendar wins.
    """
    millis = F.unix_millis("date").cast("string")
    uid = F.concat("slug", F.lit("-"), "kind", F.lit("-"), millis, F.lit(f"@{site}"))
    first = Window.partitionBy("user_id", "uid").orderBy("src", "title")
    r = rows.filter(~F.coalesce("is_rolling", F.lit(False))).withColumn("uid", uid).withColumn("rn", F.row_number().over(first)).filter("rn = 1")
    label = F.coalesce(lookup(DEADLINE_LABELS, F.col("kind")), F.col("kind"))
    confirm = F.concat(F.lit("Confirm on the official page: "), "url")
    said = F.when(F.col("raw_text").isNotNull(), F.concat(F.lit('Source says: "'), "raw_text", F.lit('"\\n'), confirm)).otherwise(confirm)
    lines = F.array(
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), "uid"),
        F.concat(F.lit("DTSTAMP:"), ics_time(now)),
        F.concat(F.lit("DTSTART;VALUE=DATE:"), ics_day(F.col("date"))),
        F.concat(F.lit("DTEND;VALUE=DATE:"), ics_day(F.col("date") + F.make_dt_interval(days=F.lit(1)))),
        F.concat(F.lit("SUMMARY:"), escape_ics(F.concat(label, F.lit(": "), "title"))),
        F.concat(F.lit("DESCRIPTION:"), escape_ics(said)),
        F.concat(F.lit("URL:"), "url"),
        F.lit("END:VEVENT"),
    )
    return r.select("user_id", "uid", F.array_join(lines, "\r\n").alias("event"))


def write(calendar: DataFrame, path: str) -> None:
    """One folder of text per calendar: the events between header and footer, CRLF line ends."""
    last = 1 << 30
    frame = lambda at, lines: calendar.sparkSession.createDataFrame([(at, "\r\n".join(lines))], "at int, event string")
    rows = frame(0, HEADER).unionByName(calendar.select(F.lit(1).alias("at"), "event")).unionByName(frame(last, FOOTER))
    rows.orderBy("at", "event").select("event").write.option("lineSep", "\r\n").text(path)
