"""Match score of a student and an opportunity, with a sentence for each dimension.

Each dimension gives struct(value, verdict, text); a null value leaves the
score. Scores are row-wise arithmetic in declared order.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions.layout import checkpointed
from ..functions.dates import days_between, is_actionable, round_half_up
from ..functions.text import humanise, same_loosely
from ..functions.values import strings_only
from . import eligibility as E
from . import panels as P
from .eligibility import is_blocked, rules_of

#: Makes something of a dimension's value, sentence and, where it isn't the value's, verdict.
Say = Callable[..., Column]
#: How sentences call the service that shows them.
SERVICE = "we"


def _score(value: Column | float | None, text: Column | str, verdict: str | None = None) -> Column:
    v = F.lit(value).cast("double") if not isinstance(value, Column) else value.cast("double")
    by_value = F.when(v >= 0.75, "MATCH").when(v >= 0.35, "PARTIAL").when(v.isNotNull(), "MISMATCH").otherwise("UNKNOWN")
    return F.struct(v.alias("value"), (F.lit(verdict) if verdict else by_value).alias("verdict"), (F.lit(text) if isinstance(text, str) else text).alias("text"))


def _value(value: Column | float | None, text: Column | str, verdict: str | None = None) -> Column:
    return F.lit(value).cast("double") if not isinstance(value, Column) else value.cast("double")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _strength() -> Column:
    return F.map_from_entries(F.transform("interests", lambda i: F.struct(i["slug"], i["strength"])))


def subject(score: Say = _score) -> Column:
    topical, strength, total = F.col("topical"), _strength(), F.col("topical_weight")
    earned = F.aggregate(topical, F.lit(0.0), lambda s, t: s + F.coalesce(t["weight"] * (F.lit(0.6) + F.lit(0.4) * (strength[t["slug"]] / F.lit(5.0))), F.lit(0.0)))
    matched = F.transform(F.filter(topical, lambda t: strength[t["slug"]].isNotNull()), lambda t: humanise(t["slug"]))
    names = F.array_join(F.slice(matched, 1, 2), " and ")
    said = F.when(F.size(matched) == 0, "No subject of the listing is among your interests.").when(F.size(matched) <= 2, _text("In line with your interest in ", names, ".")).otherwise(_text("In line with ", F.size(matched).cast("string"), " interests of yours, among them ", names, "."))
    return F.when(F.size(topical) == 0, score(None, "The listing names no subject.")).when(F.size("interests") == 0, score(None, f"Without interests on the profile {SERVICE} cannot compare subjects.")).otherwise(score(F.least(F.lit(1.0), F.try_divide(earned, total)), said))


def career(score: Say = _score) -> Column:
    pool = F.col("career_pool")
    hits = F.filter("career_directions", lambda c: F.array_contains(pool, c))
    n = F.size(hits)
    return (
        F.when(F.size("career_directions") == 0, score(None, f"Without a career on the profile {SERVICE} cannot compare fields."))
        .when(F.size(pool) == 0, score(None, "The listing names no career field."))
        .when(n == 0, score(0.2, "Leads elsewhere than the careers you named, and may be new to you for that.", "PARTIAL"))
        .otherwise(score(F.least(F.lit(1.0), F.lit(0.7) + F.lit(0.3) * n), _text("Leads towards ", humanise(F.get(hits, F.lit(0))), ", a career you named.")))
    )


def format_location(score: Say = _score) -> Column:
    wanted = F.col("format_preference").isin("ONLINE", "ANY", "HYBRID")
    no_place = (F.coalesce("country_code", F.lit("")) == "") | (F.coalesce("location_country", F.lit("")) == "")
    same_city = F.coalesce((F.col("city") != "") & (F.col("location_city") != "") & same_loosely(F.col("city"), F.col("location_city")), F.lit(False))
    return (
        F.when(F.col("format") == "UNKNOWN", score(None, "The page does not say how it is held."))
        .when((F.col("format") == "ONLINE") & wanted, score(1.0, "Online, so you can join from anywhere."))
        .when(F.col("format") == "ONLINE", score(0.5, "Online, while you would rather be there."))
        .when(F.col("format_preference") == "ONLINE", score(0.15, "You would have to be there, while you would rather join online."))
        .when(no_place, score(None, "Either the place or your country is unknown."))
        .when(F.lower("country_code") != F.lower("location_country"), score(0.25, "Abroad for you: think of the journey, its price and a visa.", "PARTIAL"))
        .when(same_city, score(1.0, _text("Held in ", F.col("location_city"), ", the city you live in.")))
        .otherwise(score(0.8, "In the country you live in."))
    )


def cost(score: Say = _score) -> Column:
    kind, amount = F.col("cost_type"), F.col("cost_amount")
    differ = F.coalesce((F.col("cost_currency") != "") & (F.col("budget_currency") != "") & (F.col("cost_currency") != F.col("budget_currency")), F.lit(False))
    return (
        F.when(kind == "FREE", score(1.0, "Costs nothing."))
        .when((kind == "UNKNOWN") | ((kind == "PAID") & amount.isNull()), score(None, "The page gives no price."))
        .when(kind == "FREE_WITH_AID", score(0.9, "Has a price, and help with it can be asked for."))
        .when(F.col("budget_ceiling").isNull(), score(None, f"Without a budget on the profile {SERVICE} cannot compare prices."))
        .when(differ, score(None, _text("Priced in ", F.col("cost_currency"), " while your budget is in ", F.col("budget_currency"), " — compare these yourself.")))
        .when(amount <= F.col("budget_ceiling"), score(1.0, "No dearer than your budget."))
        .when(F.coalesce("aid_available", F.lit(False)), score(0.5, "Dearer than your budget, but help can be asked for.", "PARTIAL"))
        .otherwise(score(0.0, "Dearer than your budget."))
    )


def timing_facts(deadlines: DataFrame, now: Column) -> DataFrame:
    """What scoring needs of an opportunity's dates, once per opportunity: next_at, rolling, any_actionable, start_at."""
    act = is_actionable(F.col("kind"))
    rolling = F.coalesce("is_rolling", F.lit(False))
    return deadlines.groupBy("opp_id").agg(
        F.min(F.when(act & ~rolling & (F.col("date") >= now), F.col("date"))).alias("next_at"),
        F.bool_or(act & rolling).alias("rolling"),
        F.bool_or(act).alias("any_actionable"),
        F.min(F.when(F.col("kind") == "PROGRAM_START", F.col("date"))).alias("start_at"),
    )


def timing(now: Column, score: Say = _score) -> Column:
    """Needs the columns of `timing_facts`; null ones (no dates at all) count as false."""
    days = days_between(F.col("next_at"), now)
    rolling = F.coalesce("rolling", F.lit(False))
    outside = F.coalesce(F.col("start_at") < F.col("available_from"), F.lit(False)) | F.coalesce(F.col("start_at") > F.col("available_until"), F.lit(False))
    soon = F.when(days <= 0, "under a day").otherwise(_text(days.cast("string"), " days"))
    closes = lambda tail: _text("Closes in ", days.cast("string"), tail)
    return (
        F.when(F.col("next_at").isNull() & ~rolling & F.coalesce("any_actionable", F.lit(False)), score(0.0, "The last day to apply has passed.", "MISMATCH"))
        .when(F.col("next_at").isNull() & ~rolling, score(None, "The page gives no last day to apply."))
        .when(outside, score(0.25, "Takes place when you are not free.", "PARTIAL"))
        .when(F.col("next_at").isNull(), score(0.9, "Applications are taken all the time."))
        .when(days <= 2, score(0.3, _text("Closes in ", soon, ", so begin at once or not at all."), "PARTIAL"))
        .when(days <= 7, score(0.65, closes(" days, which is little time but enough.")))
        .when(days <= 30, score(1.0, closes(" days, so there is time.")))
        .otherwise(score(0.95, _text("Closes in ", round_half_up(days / 7).cast("string"), " weeks, so there is much time.")))
    )


def experience_facts(rules: DataFrame) -> DataFrame:
    """asks_experience and the wanted kinds of each opportunity, from its PRIOR_EXPERIENCE rules."""
    prior = rules.filter(F.col("dimension") == "PRIOR_EXPERIENCE")
    return prior.groupBy("opp_id").agg(F.lit(True).alias("asks_experience"), F.array_distinct(F.flatten(F.collect_list(strings_only(F.col("value"), "$.kinds")))).alias("wanted_kinds"))


def experience(score: Say = _score) -> Column:
    """Needs the columns of `experience_facts`. Looks at kinds only, not at tags."""
    held = F.filter("achievements", lambda a: F.array_contains("wanted_kinds", a["kind"]))
    national = F.exists(held, lambda a: F.coalesce(a["level"].isin("NATIONAL", "INTERNATIONAL"), F.lit(False)))
    said = F.when(F.size(held) == 1, "an activity that counts").otherwise(_text(F.size(held).cast("string"), " activities that count"))
    return (
        F.when(F.col("asks_experience").isNull(), score(None, "Nothing is said of earlier experience."))
        .when(F.size("wanted_kinds") == 0, score(0.5, "Wants earlier experience but does not say which.", "PARTIAL"))
        .when(F.size(held) == 0, score(0.25, "Wants experience of which the profile says nothing yet.", "PARTIAL"))
        .otherwise(score(F.when(national, 1.0).otherwise(0.75), _text("On your profile: ", said, ".")))
    )


def profile_gap(score: Say = _score) -> Column:
    wanted = F.filter("categories", lambda c: F.array_contains("wanted_areas", c))
    return (
        F.when(F.size("thin_areas") == 0, score(None, "The profile holds too little to see what is missing."))
        .when(F.size(wanted) == 0, score(None, "Adds to no area of which you wanted more."))
        .otherwise(score(1.0, _text("So far you have done less ", humanise(F.get(wanted, F.lit(0))), " than elsewhere, and you wanted more of it.")))
    )


def opportunity_facts(opportunities: DataFrame, deadlines: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """Opportunities with what timing and experience need, aggregated once per opportunity."""
    return opportunities.join(timing_facts(deadlines, now), "opp_id", "left").join(experience_facts(rules), "opp_id", "left")


def _prepared(facts: DataFrame) -> DataFrame:
    """What scoring looks at of an opportunity's tags, once per opportunity."""
    topical = F.filter("tags", lambda t: t["kind"].isin("SUBJECT", "INTEREST"))
    pool = F.concat(F.transform(F.filter("tags", lambda t: t["kind"] == "CAREER_FIELD"), lambda t: t["slug"]), F.col("categories"))
    return facts.withColumns({"topical": topical, "topical_weight": F.aggregate(topical, F.lit(0.0), lambda s, t: s + t["weight"]), "career_pool": pool})


def _looking(profiles: DataFrame) -> DataFrame:
    """The thin areas that a student wants more of, once per student."""
    wanted = F.filter("thin_areas", lambda c: F.exists("interests", lambda i: i["slug"] == c) | F.array_contains("career_directions", c))
    return profiles.withColumn("wanted_areas", wanted)


def _own(now: Column, score: Say) -> dict[str, Column]:
    """The dimensions in declared order, as ``score`` makes them."""
    return {"SUBJECT": subject(score), "CAREER": career(score), "FORMAT_LOCATION": format_location(score), "COST": cost(score), "TIMING": timing(now, score), "EXPERIENCE": experience(score), "PROFILE_GAP": profile_gap(score)}


def dimensions(pairs: DataFrame, facts: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """One row per pair with a struct column for each dimension."""
    rows = pairs.select("user_id", "opp_id").join(_prepared(facts), "opp_id").join(_looking(profiles), "user_id")
    return rows.select("user_id", "opp_id", *[c.alias(name) for name, c in _own(now, _score).items()])


def tally(value: Callable[[str], Column], eligible: Column) -> dict[str, Column]:
    """score and, as a number with a bit for each, which dimensions are ``unknown``: small keys to count pairs by, of which `unknown_said` makes words."""
    num = sum((F.coalesce(value(d) * F.lit(float(w)), F.lit(0.0)) for d, w in D.DIMENSION_WEIGHTS.items()), F.lit(0.0))
    den = sum((F.when(value(d).isNotNull(), float(w)).otherwise(0.0) for d, w in D.DIMENSION_WEIGHTS.items()), F.lit(0.0))
    unknown = sum((value(d).isNull().cast("int") * (1 << i) for i, d in enumerate(D.DIMENSION_WEIGHTS)), F.lit(0))
    fit = F.when(den == 0, F.lit(0)).otherwise(round_half_up(num / den * F.lit(100.0)))
    return {"score": F.when(eligible, fit).otherwise(0).cast("long"), "unknown": unknown}


def unknown_said(unknown: Column) -> dict[str, Column]:
    """confidence and unknown_dimensions."""
    known = len(D.DIMENSION_WEIGHTS) - F.bit_count(unknown)
    names = F.concat_ws(",", *[F.when(unknown.bitwiseAND(1 << i) != 0, d) for i, d in enumerate(D.DIMENSION_WEIGHTS)])
    return {"confidence": F.when(known >= 6, "HIGH").when(known >= 4, "MEDIUM").otherwise("LOW"), "unknown_dimensions": names}


def composition(value: Callable[[str], Column], eligible: Column) -> dict[str, Column]:
    """score, confidence and unknown_dimensions of the dimensions' values."""
    both = tally(value, eligible)
    return {"score": both["score"], **unknown_said(both["unknown"])}


def _composed(rows: DataFrame, value: Callable[[str], Column]) -> DataFrame:
    return rows.select("user_id", "opp_id", "eligible", *[c.alias(n) for n, c in composition(value, F.col("eligible")).items()])


def compose(dims: DataFrame, eligible: DataFrame) -> DataFrame:
    """user_id, opp_id, eligible, score, confidence, unknown_dimensions of each pair."""
    return _composed(dims.join(eligible.select("user_id", "opp_id", "eligible"), ["user_id", "opp_id"]), lambda d: F.col(d)["value"])


def scores(pairs: DataFrame, facts: DataFrame, rules: DataFrame, profiles: DataFrame, now: Column) -> DataFrame:
    """What `compose` gives, in one pass over the pairs and without any sentence.

    Pairs meet their opportunity, with its rules as an array, and their student
    once; all else is arithmetic within the row. Values stand behind a
    generator, so a filter on eligibility comes first and nothing is evaluated twice.
    """
    rows = pairs.select("user_id", "opp_id").join(_prepared(facts).join(rules_of(rules), "opp_id", "left"), "opp_id").join(_looking(profiles), "user_id")
    rows = rows.select("*", F.explode(F.array(~is_blocked())).alias("eligible"))
    values = [c.alias(d) for d, c in _own(now, _value).items()]
    return _composed(rows.select("user_id", "opp_id", "eligible", F.inline(F.array(F.struct(*values)))), F.col)


#: The columns of `looking` students that a dimension looks at besides the country.
READS = {
    "SUBJECT": ["interests"], "CAREER": ["career_directions"], "FORMAT_LOCATION": ["format_preference", "city"], "COST": ["budget_ceiling", "budget_currency"],
    "TIMING": ["available_from", "available_until"], "EXPERIENCE": ["achievements"], "PROFILE_GAP": ["thin_areas", "wanted_areas"],
}


def facts_along(lists: DataFrame, facts: DataFrame, rules: DataFrame) -> DataFrame:
    """What scoring needs of the lists' opportunities; see `panels.listing`. As many rows as the lists have, however many opportunities there are."""
    return P.listing(lists, _prepared(facts).join(rules_of(rules), "opp_id", "left"))


def looking(profiles: DataFrame, listing: DataFrame) -> DataFrame:
    """Students with what dimensions look at, no finer than dimensions tell apart."""
    p = _looking(profiles).withColumn("thin_areas", F.slice("thin_areas", 1, 1))
    return P.within_amounts(p, listing)


def score_parts(now: Column) -> list[P.Part]:
    """opp_id, whether some rule blocks, and the dimensions' values, as `panels`."""
    rules = [P.Part(list(c), {f"blocked_{i}": E.blocks(E.verdicts(names))}) for i, (c, names) in enumerate(E.by_reads().items()) if not c or set(E.HARD_READS) & set(c)]
    return [P.Part([], {"opp_id": F.col("opp_id")}), *rules, *[P.Part(READS[d], {d: c}) for d, c in _own(now, _value).items()]]


def is_open(parts: list[P.Part], value: Callable[[str], Column]) -> Column:
    return ~functools.reduce(operator.or_, [value(n) for p in parts for n in p.along if n.startswith("blocked_")])


def reasons(dims: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row per shown reason, in order: satisfied rules, matching dimensions, concerns, partial or
    mismatching dimensions, unknown dimensions, unevaluated rules. Blocking rules are reported apart."""
    weights = list(D.DIMENSION_WEIGHTS.items())
    fits = dims.select("user_id", "opp_id", F.inline(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(d).alias("dimension"), F.col(d)["verdict"].alias("verdict"), F.when(F.col(d)["value"].isNull(), 0).otherwise(w).alias("weight"), F.col(d)["text"].alias("text")) for i, (d, w) in enumerate(weights)])))
    fits = fits.withColumn("grp", F.when(F.col("verdict") == "MATCH", 2).when(F.col("verdict") == "UNKNOWN", 5).otherwise(4))
    v = F.col("verdict")
    ev = evaluations.filter(~(F.col("is_hard") & (v == "MISMATCH")))
    ev = ev.select("user_id", "opp_id", F.col("rule_no").alias("pos"), "dimension", "verdict", F.lit(0).alias("weight"), "text", F.when(v == "MATCH", 1).when(v == "UNKNOWN", 6).otherwise(3).alias("grp"))
    w = Window.partitionBy("user_id", "opp_id").orderBy("grp", "pos")
    return fits.unionByName(ev).withColumn("place", F.row_number().over(w)).select("user_id", "opp_id", "place", "dimension", "verdict", "weight", "text")


def rank(scores: DataFrame, facts: DataFrame, k: int = 40, include_ineligible: bool = False) -> DataFrame:
    """Each student's k best: score, then next deadline (none last), then newest, then opp_id. Sponsorship plays no part."""
    rows = scores if include_ineligible else scores.filter("eligible")
    rows = rows.join(facts.select("opp_id", "next_at", "first_seen_at"), "opp_id")
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc_nulls_last("next_at"), F.desc("first_seen_at"), "opp_id")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def best(parts: list[P.Part], k: int) -> Column:
    """A student's ``k`` best of a panel of `score_parts`, as `rank` orders them: the list's own order is that of equal scores."""
    zipped = F.arrays_zip(*[n for p in parts for n in p.along])

    def one(x: Column, i: Column) -> Column:
        c = composition(lambda d: x[d], F.lit(True))
        return F.when(is_open(parts, lambda n: x[n]), F.struct((-c["score"]).alias("falling"), i.alias("at"), x["opp_id"].alias("opp_id"), c["score"].alias("score"), c["confidence"].alias("confidence")))

    return F.slice(F.sort_array(F.filter(F.transform(zipped, one), lambda x: x.isNotNull())), 1, k)


def own(now: Column) -> dict[str, Column]:
    """The dimensions with their sentences, of a student of `looking` next to an opportunity of `facts_along`."""
    return _own(now, _score)


def reason_parts(now: Column) -> list[P.Part]:
    """The items of `reasons` that look at the same columns, as arrays of struct(grp, pos, dimension, verdict, weight, text)."""
    item = lambda grp, pos, dimension, verdict, weight, text: F.struct(grp.alias("grp"), pos.cast("int").alias("pos"), dimension.alias("dimension"), verdict.alias("verdict"), weight.cast("int").alias("weight"), text.alias("text"))
    v = lambda x: x["v"]["verdict"]
    out: dict[tuple[str, ...], list[Column]] = {}
    for columns, names in E.by_reads().items():
        shown = F.filter(E.judged(names), lambda x: ~(x["is_hard"] & (v(x) == "MISMATCH")))
        out[columns] = [F.transform(shown, lambda x: item(F.when(v(x) == "MATCH", 1).when(v(x) == "UNKNOWN", 6).otherwise(3), x["rule_no"], x["dimension"], v(x), F.lit(0), x["v"]["text"]))]
    for i, (d, c) in enumerate(_own(now, _score).items()):
        one = F.transform(F.array(c), lambda x: item(F.when(x["verdict"] == "MATCH", 2).when(x["verdict"] == "UNKNOWN", 5).otherwise(4), F.lit(i), F.lit(d), x["verdict"], F.when(x["value"].isNull(), 0).otherwise(D.DIMENSION_WEIGHTS[d]), x["text"]))
        out.setdefault(tuple(READS[d]), []).append(one)
    return [P.Part(list(columns), {"items": F.concat(*cs)}) for columns, cs in out.items()]


def reason_counts(students: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """opp_id, place, dimension, verdict, weight, text of `reasons`, and ``n``, of how many students.

    An opportunity's items are numbered in the order of their places, so a pair is a few small numbers that are sorted and counted.
    """
    item = ["grp", "pos", "dimension", "verdict", "weight", "text"]
    parts = reason_parts(now)
    rows = [P.rows_of(students, listing, p, "opp_id") for p in parts]
    every = functools.reduce(DataFrame.unionByName, [r.select("opp_id", F.inline("items")).distinct() for r in rows]).distinct()
    names = checkpointed(every.withColumn("item", F.row_number().over(Window.partitionBy("opp_id").orderBy(*item))))
    of = names.select(F.col("opp_id").alias("o"), F.struct(*item).alias("i"), "item")
    tables, numbered = [], []
    for k, (p, r) in enumerate(zip(parts, rows, strict=True)):
        q = P.Part(p.columns, {f"items_{k}": F.col("items")})
        flat = r.select(*[c for c in r.columns if c != "items"], F.explode_outer("items").alias("one")).join(F.broadcast(of), (F.col("opp_id") == F.col("o")) & F.col("one").eqNullSafe(F.col("i")), "left")
        along = flat.groupBy("kind", "at").agg(*[F.first(c).alias(c) for c in r.columns if c.startswith("kind_")], F.collect_list("item").alias(f"items_{k}"))
        numbered.append(q)
        tables.append(P.table_of(along, q))
    first = P.Part([], {"opp_id": F.col("opp_id")})
    pairs = P.panel(students, [first, *numbered], [P.table_of(P.rows_of(students, listing, first), first), *tables])
    arrays = [n for q in numbered for n in q.along]
    pairs = pairs.select(F.inline(F.arrays_zip("opp_id", *arrays)))
    # Without holes: places are those of a pair's own items.
    places = pairs.select("opp_id", F.posexplode(F.sort_array(F.flatten(F.array(*arrays)))).alias("pos", "item"))
    counts = places.groupBy("opp_id", "pos", "item").agg(F.count(F.lit(1)).alias("n")).withColumn("place", F.col("pos") + 1).drop("pos")
    return counts.join(names.drop("grp", "pos"), ["opp_id", "item"]).groupBy("opp_id", "place", "dimension", "verdict", "weight", "text").agg(F.sum("n").alias("n"))
