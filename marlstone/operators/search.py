"""Corpus search: filters from a sentence, predicates on the corpus, candidates for every student."""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.layout import spread
from ..functions.patterns import EDGE, first_kind, first_match, matches
from ..functions.text import humanise_lower


@dataclass
class Filters:
    """What a search asks for; None or empty asks for nothing."""

    categories: list[str] = field(default_factory=list)
    subjects: list[str] = field(default_factory=list)
    country: str | None = None
    city: str | None = None
    format: str | None = None
    cost_free: bool | None = None
    within_days: int | None = None
    keywords: list[str] = field(default_factory=list)
    include_expired: bool = False
    hidden_for: int | None = None


def predicates(f: Filters) -> list[Column]:
    """Row predicates on opportunities; text search ignores case."""
    out = [F.col("state").isin(D.VISIBLE_STATES + (["EXPIRED"] if f.include_expired else []))]
    if f.format:
        out.append(F.col("format") == f.format)
    if f.country:
        out.append((F.col("location_country") == f.country) | (F.col("format") == "ONLINE") | F.col("location_country").isNull())
    if f.cost_free:
        out.append(F.col("cost_type").isin("FREE", "FREE_WITH_AID"))
    if f.city:
        out.append(F.contains(F.lower("location_city"), F.lit(f.city.lower())))
    if f.keywords:
        out.append(functools.reduce(operator.or_, [F.contains(F.lower(c), F.lit(k.lower())) for k in f.keywords for c in ("title", "summary")]))
    return out


def due_within(deadlines: DataFrame, days: int, now: Column) -> DataFrame:
    """opp_id of opportunities with an application or registration deadline from now on to ``days`` ahead, both ends included."""
    last = now + F.make_dt_interval(days=F.lit(days))
    return deadlines.filter(F.col("kind").isin("APPLICATION_DEADLINE", "REGISTRATION_DEADLINE") & F.col("date").between(now, last)).select("opp_id")


def with_method(records: DataFrame, provenance: str, method: str) -> DataFrame:
    """Records of which some field is known by the method; the provenance is JSON by field, as stored text."""
    return records.filter(F.contains(F.col(provenance), F.lit(f'"{method}"')))


def search(opportunities: DataFrame, f: Filters, now: Column, categories: DataFrame | None = None, tags: DataFrame | None = None, deadlines: DataFrame | None = None, saved: DataFrame | None = None) -> DataFrame:
    """Opportunities that pass every filter. Relations are semi and anti joins, so no row is ever doubled."""
    out = opportunities.filter(functools.reduce(operator.and_, predicates(f)))
    if f.categories and categories is not None:
        out = out.join(categories.filter(F.col("category").isin(f.categories)), "opp_id", "left_semi")
    if f.subjects and tags is not None:
        out = out.join(tags.filter(F.col("tag").isin(f.subjects)), "opp_id", "left_semi")
    if f.within_days is not None and deadlines is not None:
        out = out.join(due_within(deadlines, f.within_days, now), "opp_id", "left_semi")
    if f.hidden_for is not None and saved is not None:
        hidden = saved.filter((F.col("user_id") == f.hidden_for) & F.col("state").isin("HIDDEN", "NOT_INTERESTED")).select("opp_id")
        out = out.join(hidden, "opp_id", "left_anti")
    return out


#: Countries whose lists are broadcast: at most this many times a list's length of number pairs.
MOST_COUNTRIES = 1_000


def candidate_lists(opportunities: DataFrame, profiles: DataFrame, limit: int = 200) -> DataFrame:
    """(key, opp_id): for each country of a student, and for null if some have none, the newest ``limit`` visible opportunities open to it.

    The corpus is ranked once per country. Online and placeless opportunities are open everywhere, so of those only
    the newest ``limit`` can be on any list; students without a country get the newest of all.
    """
    seen = opportunities.filter(F.col("state").isin(D.VISIBLE_STATES)).select("opp_id", "location_country", "format", "updated_at")
    newest = lambda *by: Window.partitionBy(*by).orderBy(F.desc("updated_at"), "opp_id")
    top = lambda df, *by: df.withColumn("rn", F.row_number().over(newest(*by))).filter(F.col("rn") <= limit).drop("rn")
    first = lambda df: df.orderBy(F.desc("updated_at"), "opp_id").limit(limit)
    everywhere = (F.col("format") == "ONLINE") | F.col("location_country").isNull()
    keys = profiles.select(F.col("country_code").alias("key")).distinct()
    countries = keys.filter("key is not null")
    placed = top(seen.filter(~everywhere).withColumn("key", F.col("location_country")), "key").join(countries, "key", "left_semi")
    # One short list for all: bounded by the limit, so pairing it with the countries is a broadcast of at most that many rows.
    open_list = first(seen.filter(everywhere)).agg(F.collect_list(F.struct("opp_id", "location_country", "format", "updated_at")).alias("list"))
    shared = countries.join(open_list, F.lit(True)).select("key", F.inline("list"))
    lists = top(placed.unionByName(shared, allowMissingColumns=True).select("key", "opp_id", "updated_at"), "key").select("key", "opp_id")
    homeless = first(seen).agg(F.collect_list("opp_id").alias("list"))
    return lists.unionByName(keys.filter("key is null").join(homeless, F.lit(True)).select("key", F.explode("list").alias("opp_id")))


def candidates(opportunities: DataFrame, profiles: DataFrame, limit: int = 200) -> DataFrame:
    """(user_id, opp_id): for each student the newest ``limit`` visible opportunities open to their country.

    One search per country serves all its students, who meet its list by an equi-join. The
    number of pairs grows with the students, not with students times corpus.
    """
    lists = candidate_lists(opportunities, profiles, limit)
    # A student becomes a list's length of pairs.
    students = spread(profiles.select("user_id", "country_code"))
    # Countries are few; where codes are not, the join is left to the planner.
    few = profiles.select("country_code").distinct().limit(MOST_COUNTRIES + 1).count() <= MOST_COUNTRIES
    return students.join(F.broadcast(lists) if few else lists, F.col("country_code").eqNullSafe(F.col("key"))).select("user_id", "opp_id")


# ------------------------------------------------------------- sentences


def parse_query(q: Column) -> dict[str, Column]:
    """Columns of the filters that a student's own sentence states."""
    names = lambda terms: F.filter(F.array(*[F.when(matches(q, p), F.lit(s)) for s, p in terms]), lambda x: x.isNotNull())
    first = lambda terms: F.coalesce(*[F.when(matches(q, p), F.lit(s)) for s, p in terms])
    age = F.coalesce(*[first_match(q, p, 1) for p in D.QUERY_AGES]).cast("int")
    return {
        "categories": names(D.CATEGORY_TERMS),
        "subjects": names(D.SUBJECT_TERMS),
        "country": first(D.COUNTRY_TERMS),
        "cost_free": F.when(matches(q, D.QUERY_FREE), F.lit(True)),
        "format": first_kind(q, D.QUERY_FORMATS),
        "age": F.when(age.between(5, 30), age),
        "education_level": first_kind(q, D.QUERY_LEVELS),
        "month": F.coalesce(*[F.when(matches(q, rf"\b{m}\b"), F.lit(i + 1)) for i, m in enumerate(D.MONTH_NAMES)]),
        "within_days": F.when(matches(q, D.QUERY_SOON), 7).when(matches(q, D.QUERY_MONTH), 30),
    }


def residual_keywords(q: Column, categories: Column, subjects: Column, country: Column) -> Column:
    """Up to six words that no recognised term has used up."""
    left = q
    # All terms that were recognised count as one alternation, tried in this order at each place.
    terms = [(s, p, F.array_contains(categories, s)) for s, p in D.CATEGORY_TERMS] + [(s, p, F.array_contains(subjects, s)) for s, p in D.SUBJECT_TERMS] + [(s, p, F.coalesce(country == s, F.lit(False))) for s, p in D.COUNTRY_TERMS]
    chosen = F.array_join(F.filter(F.array(*[F.when(on, F.lit(_java_ascii(p))) for _, p, on in terms]), lambda x: x.isNotNull()), "|")
    left = F.regexp_replace(left, F.concat(F.lit("(?i)"), F.when(chosen == "", F.lit("(?!)")).otherwise(chosen)), F.lit(" "))
    words = F.split(F.regexp_replace(F.lower(left), r"[^a-z0-9\s-]", " "), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(D.FILLER_WORDS) & ~w.rlike(r"^\d+$")), 1, 6)


def _java_ascii(pattern: str) -> str:
    return re.sub(r"\\b", lambda _: EDGE, pattern)


def chips(filters: DataFrame, key: str) -> DataFrame:
    """One row per shown filter: key, pos, field, label, value."""
    one = lambda name, label, value: F.when(value.isNotNull(), F.array(F.struct(F.lit(name).alias("field"), F.lit(label).alias("label"), value.cast("string").alias("value")))).otherwise(F.array())
    many = lambda name, label, values, f: F.transform(values, lambda v: F.struct(F.lit(name).alias("field"), F.lit(label).alias("label"), f(v).alias("value")))
    month = F.get(F.array(*[F.lit(m.capitalize()) for m in D.MONTH_NAMES]), F.col("month") - 1)
    c = F.col
    rows = F.concat(
        many("categories", "Type", c("categories"), humanise_lower),
        many("subjects", "Subject", c("subjects"), humanise_lower),
        one("countryCode", "Country", c("country")),
        one("format", "Format", humanise_lower(c("format"))),
        one("costFree", "Cost", F.when(c("cost_free"), F.lit("Free only"))),
        one("age", "Age", c("age")),
        one("educationLevel", "Level", humanise_lower(c("education_level"))),
        one("month", "Month", month),
        one("withinDays", "Deadline", F.concat(F.lit("Within "), c("within_days").cast("string"), F.lit(" days"))),
        many("keywords", "Keyword", c("keywords"), lambda v: v),
    )
    return filters.select(key, F.posexplode(rows).alias("pos", "chip")).select(key, "pos", "chip.*")


def plan_queries(year: int, limit: int = 4) -> Column:
    """Array of at most ``limit`` provider queries: categories by subjects, narrowed by level, format, place and year.

    Reads the columns of `parse_query` plus keywords, and profile_age,
    profile_country, profile_level and profile_interests of the student.
    """
    c = F.col
    cats = F.when(F.size("categories") > 0, c("categories")).otherwise(F.array(*map(F.lit, ("scholarship", "competition", "summer-program"))))
    subs = F.when(F.size("subjects") > 0, c("subjects")).otherwise(F.slice("profile_interests", 1, 3))
    subs = F.when(F.size(subs) > 0, subs).otherwise(F.array(F.lit("")))
    level, age = F.coalesce(c("education_level"), c("profile_level")), F.coalesce(c("age"), c("profile_age"))
    phrase = (
        F.when(level == "UNDERGRAD", "undergraduate students").when(level == "MIDDLE", "middle school students").when(level.isin("SECONDARY", "SENIOR_SECONDARY"), "high school students")
        .when(age <= 18, "high school students").when(age.isNotNull(), "university students").otherwise("students")
    )
    place = F.coalesce(c("country"), F.when(F.coalesce(c("format") != "ONLINE", F.lit(True)), c("profile_country")), F.lit(""))
    tail = F.concat(F.array(phrase, F.when(c("format") == "ONLINE", "online").otherwise(""), place, F.lit(str(year))), c("keywords"))

    def one(cat: Column, sub: Column) -> Column:
        parts = F.concat(F.array(F.when(c("cost_free"), "free").otherwise(""), humanise_lower(sub), humanise_lower(cat)), tail)
        return F.trim(F.regexp_replace(F.array_join(F.filter(parts, lambda p: F.length(p) > 0), " "), r"\s+", " "))

    return F.slice(F.array_distinct(F.flatten(F.transform(cats, lambda x: F.transform(subs, lambda y: one(x, y))))), 1, limit)
