"""Date and countdown functions over UTC timestamps; ``now`` is always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import domains as D
from .patterns import java

_MONTH = "|".join(D.MONTHS)


def round_half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def days_between(date: Column, now: Column) -> Column:
    """Elapsed whole days, floored; not calendar days."""
    return F.floor((F.unix_micros(date) - F.unix_micros(now)) / F.lit(86_400_000_000))


def urgency(days: Column) -> Column:
    return F.when(days < 0, "PASSED").when(days <= 3, "URGENT").when(days <= 7, "SOON").when(days <= 21, "UPCOMING").when(days.isNotNull(), "CALM")


def _words(days: Column, past: str, yesterday: str, today: str, tomorrow: str, ahead: str) -> Column:
    text = lambda n: n.cast("string")
    weeks, months = round_half_up(days / 7), round_half_up(days / 30)
    return (
        F.when(days < -1, F.concat(F.lit(past), text(-days), F.lit(" days ago")))
        .when(days < 0, yesterday)
        .when(days == 0, today)
        .when(days == 1, tomorrow)
        .when(days <= 27, F.concat(F.lit(ahead), text(days), F.lit(" days")))
        .when(weeks < 9, F.concat(F.lit(ahead), text(weeks), F.lit(" weeks")))
        .when(days.isNotNull(), F.concat(F.lit(ahead), text(months), F.lit(" months")))
    )


def is_actionable(kind: Column) -> Column:
    return kind.isin(D.ACTIONABLE_KINDS)


def countdown(kind: Column, days: Column) -> Column:
    """Deadline wording for kinds that one must act on, neutral wording for all other dates."""
    due = _words(days, "Closed ", "Closed yesterday", "Due today", "Due tomorrow", "Due in ")
    neutral = _words(days, "", "Yesterday", "Today", "Tomorrow", "In ")
    return F.when(is_actionable(kind), due).otherwise(neutral)


#: Labels of the urgency levels.
BAND_LABELS = {"PASSED": "Closed", "URGENT": "Due very soon", "SOON": "Due this week", "UPCOMING": "Coming up", "CALM": "Plenty of time"}


def lookup(values: dict[str, object], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def band_label(kind: Column, days: Column) -> Column:
    level = urgency(days)
    past = F.when(kind == "APPLICATION_OPENS", "Open now").otherwise("Already happened")
    return F.when((level == "PASSED") & ~is_actionable(kind), past).otherwise(lookup(BAND_LABELS, level))


def age_on(born: Column, now: Column) -> Column:
    """Whole years, by calendar; a leap-day birthday passes on 1 March of other years."""
    return F.year(now) - F.year(born) - (F.date_format(now, "MMdd") < F.date_format(born, "MMdd")).cast("int")


def age_at(born: Column, now: Column) -> Column:
    age = age_on(born, now)
    return F.when(age.between(0, 129), age)


def _moment(year: Column, month: Column, day: Column) -> Column:
    y, d = year.try_cast("int"), day.try_cast("int")
    return F.when(y.between(1900, 2200), F.try_make_timestamp(y, month, d, F.lit(23), F.lit(59), F.lit(0.0)))


def parse_date(text: Column, reference_year: Column | None = None) -> Column:
    """struct(date, raw): the first date that the text states beyond doubt, at 23:59 UTC.

    ISO, day-month-year, month-day-year, then (given a reference year) day-month
    and month-day, then numeric dates in which one part is over 12. A form whose
    date does not exist gives way to the next; numeric dates that could be read
    both ways give null.
    """
    forms: list[tuple[str, int | None, int | str, int]] = [
        (r"\b(\d{4})-(\d{2})-(\d{2})\b", 1, 2, 3),
        (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?,?\s+(\d{{4}})\b", 3, "2", 1),
        (rf"\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", 3, "1", 2),
    ]
    if reference_year is not None:
        forms += [
            (rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\b(?!\s+\d{{4}})", None, "2", 1),
            (rf"\b({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\b(?!,?\s+\d{{4}})", None, "1", 2),
        ]
    def read(pattern: str, date) -> Column:
        """struct(date, raw) of the pattern's first match; the match is found once and taken apart as a short text."""
        raw = F.array(F.when(text.rlike("[0-9]"), F.nullif(F.regexp_extract(text, java(pattern), 0), F.lit(""))))
        part = lambda r, k: F.regexp_extract(r, java(pattern), k)
        found = F.transform(F.filter(raw, lambda r: r.isNotNull()), lambda r: F.struct(date(lambda k: part(r, k)).alias("date"), r.alias("raw")))
        return F.get(F.filter(found, lambda x: x["date"].isNotNull()), F.lit(0))

    def worded(y, m, d):
        def date(part) -> Column:
            month = lookup(D.MONTHS, F.lower(part(int(m)))) if isinstance(m, str) else part(m).try_cast("int")
            return _moment(part(y) if y else reference_year, month, part(d))

        return date

    def numeric(part) -> Column:
        a, b = part(1).try_cast("int"), part(2).try_cast("int")
        return F.when((a > 12) & (b <= 12), _moment(part(3), b, a)).when((b > 12) & (a <= 12), _moment(part(3), a, b))

    out = [read(pattern, worded(y, m, d)) for pattern, y, m, d in forms]
    return F.coalesce(*out, read(r"\b(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})\b", numeric))


def cycle_year(title: Column, url: Column, year: Column) -> Column:
    """The latest year from last year to three ahead that title or URL names."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\b(20\d{2})\b")) for c in (title, url)])
    return F.array_max(F.filter(F.transform(found, lambda x: x.cast("int")), lambda x: x.between(year - 1, year + 3)))


def period_key(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def relative_time(at: Column, now: Column) -> Column:
    minutes = round_half_up((F.unix_micros(now) - F.unix_micros(at)) / F.lit(60_000_000))
    hours = round_half_up(minutes / 60)
    one = lambda n, word: F.concat(n.cast("string"), F.when(n == 1, f" {word} ago").otherwise(f" {word}s ago"))
    return F.when(minutes < 60, one(minutes, "minute")).otherwise(one(hours, "hour"))


def display_date(at: Column) -> Column:
    """British short form; September is written Sept."""
    return F.replace(F.date_format(at, "d MMM yyyy"), F.lit("Sep "), F.lit("Sept "))


def ics_day(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd")


def ics_time(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd'T'HHmmss'Z'")
