"""Eligibility rules over pairs of opportunity and student: three-valued verdicts with their sentences.

A rule that cannot be read, or whose profile field is missing, is UNKNOWN and
never blocks. Rules are data (dimension, operator, JSON value); their values are
decoded once per rule, before rules meet students.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import domains as D
from ..functions import values
from ..functions.text import in_loosely

JUDGE = "The organiser says this in words of its own; please judge by the quotation."


def decode_rules(rules: DataFrame) -> DataFrame:
    """Adds low, high, items, kinds, tag_slugs and flag, decoded from the JSON ``value``."""
    b = values.bounds(F.col("value"))
    return rules.withColumns(
        {
            "low": b["min"],
            "high": b["max"],
            "items": values.string_list(F.col("value")),
            "kinds": F.coalesce(values.string_list(F.col("value"), "$.kinds"), F.array().cast("array<string>")),
            "tag_slugs": F.coalesce(values.string_list(F.col("value"), "$.tagSlugs"), F.array().cast("array<string>")),
            "flag": values.is_true(F.col("value")),
        }
    )


def _number(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def _stated(low: Column, high: Column) -> Column:
    return F.when(low.isNotNull() & high.isNotNull(), F.concat(_number(low), F.lit("–"), _number(high))).when(low.isNotNull(), F.concat(_number(low), F.lit("+"))).otherwise(F.concat(F.lit("up to "), _number(high)))


def _lit(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _answer(verdict: Column | str, text: Column | str) -> Column:
    return F.struct(_lit(verdict).alias("verdict"), _lit(text).alias("text"))


def _verdict_only(verdict: Column | str, text: Column | str) -> Column:
    return _lit(verdict)


def _yes(ok: Column, otherwise: str = "MISMATCH") -> Column:
    return F.when(ok, "MATCH").otherwise(otherwise)


def verdict(rule: Callable[[str], Column] = F.col, answer: Callable[[Column | str, Column | str], Column] = _answer, only: list[str] | None = None) -> Column:
    """struct(verdict, text) of a decoded rule next to a student's columns, or what else ``answer`` makes of the two.

    ``rule`` gives the rule's fields by name. ``only`` names the judged dimensions that the rule can have, all by default.
    """
    _unknown = lambda text: answer("UNKNOWN", text)
    age, grade = F.col("age"), F.col("grade")
    low, high = rule("low"), rule("high")
    no_bounds = low.isNull() & high.isNull()
    items, joined = rule("items"), F.array_join(rule("items"), ", ")
    inside = lambda x: F.coalesce(x >= low, F.lit(True)) & F.coalesce(x <= high, F.lit(True))
    not_in = rule("operator") == "NOT_IN"

    age_rule = F.when(age.isNull(), _unknown("Unchecked: the profile has no age.")).when(no_bounds, _unknown("Unchecked: the page's age limits are unclear.")).otherwise(
        answer(_yes(inside(age)), F.concat(F.lit("You are "), age.cast("string"), F.lit(" years old; ages wanted: "), _stated(low, high), F.lit(".")))
    )
    in_list = in_loosely(items, grade.cast("string"))
    grade_said = F.concat(F.lit("Your school year is "), grade.cast("string"))
    unreadable_grade = _unknown("Unchecked: the page's school years are unclear.")
    grade_rule = (
        F.when(grade.isNull(), _unknown("Unchecked: the profile has no school year."))
        .when((rule("operator") == "IN") & items.isNull(), unreadable_grade)
        .when(rule("operator") == "IN", answer(_yes(in_list), F.when(in_list, F.concat(grade_said, F.lit(", one of those wanted."))).otherwise(F.concat(grade_said, F.lit("; years wanted: "), joined, F.lit(".")))))
        .when(no_bounds, unreadable_grade)
        .otherwise(answer(_yes(inside(grade)), F.concat(grade_said, F.lit("; years wanted: "), _stated(low, high), F.lit("."))))
    )
    level = F.col("education_level")
    has_level = in_loosely(items, level)
    level_rule = F.when(level.isNull(), _unknown("Unchecked: the profile has no level of education.")).when(items.isNull(), _unknown("Unchecked: the page's levels of education are unclear.")).otherwise(
        # The sentence follows membership even where the operator turns the verdict round.
        answer(_yes(has_level != not_in), F.when(has_level, "Open to students at your level of education.").otherwise("Meant for other levels of education than yours."))
    )
    country = F.col("country_code")
    noun = F.when(rule("dimension") == "COUNTRY", "location").when(rule("dimension") == "RESIDENCY", "residency").otherwise("citizenship")
    in_place = in_loosely(items, country) != not_in
    place_rule = F.when(country.isNull(), _unknown("Unchecked: the profile has no country.")).when(items.isNull(), _unknown("Unchecked: the page's list of places is unclear.")).otherwise(
        answer(_yes(in_place), F.when(in_place, F.concat(F.lit("Fine as to "), noun, F.lit(" of applicants."))).otherwise(F.concat(F.lit("Limited as to "), noun, F.lit(" of applicants, and your country is left out."))))
    )
    curriculum = F.col("curriculum")
    named = in_loosely(items, curriculum)
    curriculum_rule = F.when(curriculum.isNull() | (curriculum == "UNKNOWN"), _unknown("Unchecked: the profile has no curriculum.")).when(items.isNull(), _unknown("Unchecked: the page's curricula are unclear.")).otherwise(
        answer(_yes(named, "PARTIAL"), F.when(named, "Names the curriculum that you follow.").otherwise(F.concat(F.lit("Names "), joined, F.lit(" and not yours; ask the organiser whether others count."))))
    )
    speaks = F.exists(items, lambda x: in_loosely(F.col("languages"), x))
    language_rule = F.when(F.size("languages") == 0, _unknown("Unchecked: the profile has no languages.")).when(items.isNull(), _unknown("Unchecked: the page's languages are unclear.")).otherwise(
        answer(_yes(speaks), F.when(speaks, "Held in a language that you speak.").otherwise(F.concat(F.lit("Held in "), joined, F.lit(" only, and the profile has no such language."))))
    )
    held = F.size(F.filter(items, lambda s: F.exists("interests", lambda i: i["slug"] == s)))
    subject_rule = (
        F.when(items.isNull(), _unknown("Unchecked: the page's subjects are unclear."))
        .when(held == F.size(items), answer("MATCH", "All subjects that are wanted are among yours."))
        .when(held > 0, answer("PARTIAL", "Some of the subjects that are wanted are among yours."))
        .otherwise(answer("PARTIAL", "None of the subjects that are wanted is among yours so far."))
    )
    relevant = F.filter("achievements", lambda a: F.array_contains(rule("kinds"), a["kind"]) | F.arrays_overlap(a["tag_slugs"], rule("tag_slugs")))
    many = F.concat(F.size(relevant).cast("string"), F.lit(" activities of yours"))
    prior_rule = (
        F.when((F.size(rule("kinds")) == 0) & (F.size(rule("tag_slugs")) == 0), answer("PARTIAL", "Wants earlier experience; the quotation says of what kind."))
        .when(F.size(relevant) == 0, answer("PARTIAL", "Wants earlier experience of which the profile says nothing yet."))
        .otherwise(answer("PARTIAL", F.concat(F.lit("Wants earlier experience, such as "), F.when(F.size(relevant) == 1, F.get(relevant, F.lit(0))["title"]).otherwise(many), F.lit(" — you will have to make that case in the application."))))
    )
    enrolled = level != "GAP_YEAR"
    school_rule = (
        F.when(level.isNull(), _unknown("Unchecked: the profile has no level of education."))
        .when(~rule("flag"), answer("MATCH", "Open whether or not you are at school."))
        .otherwise(answer(_yes(enrolled), F.when(enrolled, "For students who are enrolled, as you are.").otherwise("For students who are enrolled, and you are taking a year off.")))
    )
    d = rule("dimension")
    out = F.when(rule("operator") == "FREE_TEXT", _unknown(JUDGE))
    for names, said in (
        (["AGE"], age_rule), (["GRADE"], grade_rule), (["EDUCATION_LEVEL"], level_rule), (PLACES, place_rule), (["CURRICULUM"], curriculum_rule),
        (["LANGUAGE"], language_rule), (["SUBJECT_BACKGROUND"], subject_rule), (["PRIOR_EXPERIENCE"], prior_rule), (["SCHOOL_ENROLMENT"], school_rule),
    ):
        if only is None or set(names) & set(only):
            out = out.when(d.isin(names), said)
    return out.otherwise(_unknown(JUDGE))


#: Dimensions that look at the country.
PLACES = ["COUNTRY", "RESIDENCY", "CITIZENSHIP"]
#: The student's columns that rules of a dimension look at; of other dimensions none.
READS = {
    "AGE": ["age"], "GRADE": ["grade"], "EDUCATION_LEVEL": ["education_level"], "SCHOOL_ENROLMENT": ["education_level"], "CURRICULUM": ["curriculum"],
    "LANGUAGE": ["languages"], "SUBJECT_BACKGROUND": ["interests"], "PRIOR_EXPERIENCE": ["achievements"],
}
HARD_READS = {c for d, columns in READS.items() if d in D.HARD_DIMENSIONS for c in columns}
PROFILE = ["user_id", "age", "grade", "education_level", "country_code", "curriculum", "languages", "interests", "achievements"]


def evaluate_rules(pairs: DataFrame, rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per (user_id, opp_id, rule_no) of the given pairs: dimension, verdict, text, is_hard.

    Rules are joined by opportunity and students by user, both equi-joins, so
    only pairs that a search has made candidates are evaluated.
    """
    rows = pairs.select("user_id", "opp_id").join(decode_rules(rules), "opp_id").join(profiles.select(*PROFILE), "user_id")
    rows = rows.withColumn("v", verdict())
    return rows.select("user_id", "opp_id", "rule_no", "dimension", "v.verdict", "v.text", F.col("dimension").isin(D.HARD_DIMENSIONS).alias("is_hard"))


def eligibility(pairs: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row per pair: eligible and the numbers of blocking, concerning, satisfied and unevaluated rules.

    A pair without rules is eligible.
    """
    v, hard = F.col("verdict"), F.col("is_hard")
    sums = evaluations.groupBy("user_id", "opp_id").agg(
        F.count_if(hard & (v == "MISMATCH")).alias("blocking"),
        F.count_if((v == "PARTIAL") | (~hard & (v == "MISMATCH"))).alias("concerns"),
        F.count_if(v == "MATCH").alias("satisfied"),
        F.count_if(v == "UNKNOWN").alias("unevaluated"),
    )
    out = pairs.select("user_id", "opp_id").join(sums, ["user_id", "opp_id"], "left").fillna(0, ["blocking", "concerns", "satisfied", "unevaluated"])
    return out.withColumn("eligible", F.col("blocking") == 0)


def rules_of(rules: DataFrame) -> DataFrame:
    """(opp_id, rules): the decoded rules of each opportunity, in order; there are as many as its page states."""
    r = decode_rules(rules).withColumn("is_hard", F.col("dimension").isin(D.HARD_DIMENSIONS))
    return r.groupBy("opp_id").agg(F.array_sort(F.collect_list(F.struct("rule_no", "dimension", "operator", "low", "high", "items", "kinds", "tag_slugs", "flag", "is_hard"))).alias("rules"))


def is_blocked() -> Column:
    """Whether a hard rule of ``rules`` rules the student of the row out."""
    hard = F.filter("rules", lambda r: r["is_hard"])
    return F.coalesce(F.exists(hard, lambda r: verdict(lambda f: r[f], _verdict_only) == "MISMATCH"), F.lit(False))


def eligibility_of(pairs: DataFrame, rules: DataFrame, profiles: DataFrame) -> DataFrame:
    """`eligibility` without the sentences: a pair's rules are an array in its row, so pairs are not multiplied and not grouped again."""
    rows = pairs.select("user_id", "opp_id").join(rules_of(rules), "opp_id", "left").join(profiles.select(*PROFILE), "user_id")
    verdicts = F.transform("rules", lambda r: F.struct(r["is_hard"].alias("hard"), verdict(lambda f: r[f], _verdict_only).alias("v")))
    rows = rows.select("user_id", "opp_id", F.explode(F.array(F.coalesce(verdicts, F.array().cast("array<struct<hard:boolean,v:string>>")))).alias("vs"))
    n = lambda test: F.size(F.filter("vs", test)).cast("long")
    return rows.select(
        "user_id",
        "opp_id",
        n(lambda x: x["hard"] & (x["v"] == "MISMATCH")).alias("blocking"),
        n(lambda x: (x["v"] == "PARTIAL") | (~x["hard"] & (x["v"] == "MISMATCH"))).alias("concerns"),
        n(lambda x: x["v"] == "MATCH").alias("satisfied"),
        n(lambda x: x["v"] == "UNKNOWN").alias("unevaluated"),
    ).withColumn("eligible", F.col("blocking") == 0)


def by_reads() -> dict[tuple[str, ...], list[str]]:
    """The dimensions that look at just these columns of the student besides the country; under none also those that are never judged."""
    groups: dict[tuple[str, ...], list[str]] = {(): PLACES}
    for d, columns in READS.items():
        groups.setdefault(tuple(columns), []).append(d)
    return groups


def judged(names: list[str], answer: Callable[[Column | str, Column | str], Column] = _answer) -> Column:
    """Of the row's ``rules`` those of an entry of `by_reads`: array of struct(rule_no, dimension, is_hard, v), in order."""
    mine = lambda d: ~d.isin(list(READS)) if names == PLACES else d.isin(names)
    rules = F.filter(F.coalesce("rules", F.array()), lambda r: mine(r["dimension"]))
    return F.transform(rules, lambda r: F.struct(r["rule_no"].alias("rule_no"), r["dimension"].alias("dimension"), r["is_hard"].alias("is_hard"), verdict(lambda f: r[f], answer, names).alias("v")))


def verdicts(names: list[str]) -> Column:
    """`judged` without the sentences."""
    return judged(names, _verdict_only)


def blocks(verdicts: Column) -> Column:
    """Whether one of the verdicts rules the student out."""
    return F.exists(verdicts, lambda x: x["is_hard"] & (x["v"] == "MISMATCH"))


def tallies(verdicts: Column) -> dict[str, Column]:
    """The numbers of `eligibility` over some verdicts."""
    n = lambda test: F.size(F.filter(verdicts, test)).cast("long")
    return {
        "blocking": n(lambda x: x["is_hard"] & (x["v"] == "MISMATCH")),
        "concerns": n(lambda x: (x["v"] == "PARTIAL") | (~x["is_hard"] & (x["v"] == "MISMATCH"))),
        "satisfied": n(lambda x: x["v"] == "MATCH"),
        "unevaluated": n(lambda x: x["v"] == "UNKNOWN"),
    }
