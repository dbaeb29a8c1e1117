"""Eligibility, match, ranking, search, benefits and profile queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..domains import DIMENSION_WEIGHTS
from ..functions.layout import checkpointed, spread
from ..operators import benefits as B
from ..operators import eligibility as E
from ..operators import match as M
from ..operators import panels as P
from ..operators import search as S
from ..sources import tables as T
from ..sources.tables import NOW, ctes
from .registry import query

# --------------------------------------------------------------- eligibility

EV = (
    ctes("profiles", "opps", "rules", "pairs")
    + """,
rd AS (SELECT opp_id, rule_no, dimension, operator, value,
  CASE WHEN json_type(value, '$.min') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(value, '$.min')::DOUBLE END AS low,
  CASE WHEN json_type(value, '$.max') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN json_extract_string(value, '$.max')::DOUBLE END AS high,
  CASE WHEN json_type(value) = 'ARRAY' AND len(list_filter(json_extract(value, '$[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0
       THEN list_transform(json_extract(value, '$[*]'), lambda x: x ->> '$') END AS items,
  coalesce(list_transform(json_extract(value, '$.kinds[*]'), lambda x: x ->> '$'), []) AS kinds,
  coalesce(list_transform(json_extract(value, '$.tagSlugs[*]'), lambda x: x ->> '$'), []) AS tag_slugs,
  value = 'true' AS flag FROM rules),
er AS (SELECT pairs.user_id, pairs.opp_id, rule_no, dimension, operator, low, high, items, flag, kinds, tag_slugs, p.age, p.grade, p.education_level, p.country_code, p.curriculum, p.languages,
  CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN low::BIGINT || '–' || high::BIGINT WHEN low IS NOT NULL THEN low::BIGINT || '+' ELSE 'up to ' || high::BIGINT END AS stated,
  array_to_string(items, ', ') AS joined,
  len(list_filter(items, lambda s: list_contains(list_transform(p.interests, lambda i: i.slug), s))) AS held,
  list_filter(p.achievements, lambda a: list_contains(kinds, a.kind) OR list_has_any(a.tag_slugs, tag_slugs)) AS rel,
  list_transform(items, lambda x: lower(trim(x))) AS low_items
  FROM pairs JOIN rd USING (opp_id) JOIN profiles p USING (user_id)),
ev0 AS (SELECT *, CASE
  WHEN operator = 'FREE_TEXT' THEN ['UNKNOWN', 'The organiser says this in words of its own; please judge by the quotation.']
  WHEN dimension = 'AGE' THEN CASE WHEN age IS NULL THEN ['UNKNOWN', 'Unchecked: the profile has no age.']
    WHEN low IS NULL AND high IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s age limits are unclear.']
    ELSE [CASE WHEN age < low OR age > high THEN 'MISMATCH' ELSE 'MATCH' END, 'You are ' || age || ' years old; ages wanted: ' || stated || '.'] END
  WHEN dimension = 'GRADE' THEN CASE WHEN grade IS NULL THEN ['UNKNOWN', 'Unchecked: the profile has no school year.']
    WHEN operator = 'IN' AND items IS NULL OR operator <> 'IN' AND low IS NULL AND high IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s school years are unclear.']
    WHEN operator = 'IN' THEN CASE WHEN list_contains(low_items, grade::VARCHAR) THEN ['MATCH', 'Your school year is ' || grade || ', one of those wanted.']
      ELSE ['MISMATCH', 'Your school year is ' || grade || '; years wanted: ' || joined || '.'] END
    ELSE [CASE WHEN grade < low OR grade > high THEN 'MISMATCH' ELSE 'MATCH' END, 'Your school year is ' || grade || '; years wanted: ' || stated || '.'] END
  WHEN dimension = 'EDUCATION_LEVEL' THEN CASE WHEN education_level IS NULL THEN ['UNKNOWN', 'Unchecked: the profile has no level of education.']
    WHEN items IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s levels of education are unclear.']
    ELSE [CASE WHEN list_contains(low_items, lower(education_level)) <> (operator = 'NOT_IN') THEN 'MATCH' ELSE 'MISMATCH' END,
      CASE WHEN list_contains(low_items, lower(education_level)) THEN 'Open to students at your level of education.' ELSE 'Meant for other levels of education than yours.' END] END
  WHEN dimension IN ('COUNTRY', 'RESIDENCY', 'CITIZENSHIP') THEN CASE WHEN country_code IS NULL THEN ['UNKNOWN', 'Unchecked: the profile has no country.']
    WHEN items IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s list of places is unclear.']
    WHEN list_contains(low_items, lower(country_code)) <> (operator = 'NOT_IN') THEN ['MATCH', 'Fine as to ' || CASE dimension WHEN 'COUNTRY' THEN 'location' WHEN 'RESIDENCY' THEN 'residency' ELSE 'citizenship' END || ' of applicants.']
    ELSE ['MISMATCH', 'Limited as to ' || CASE dimension WHEN 'COUNTRY' THEN 'location' WHEN 'RESIDENCY' THEN 'residency' ELSE 'citizenship' END || ' of applicants, and your country is left out.'] END
  WHEN dimension = 'CURRICULUM' THEN CASE WHEN curriculum IS NULL OR curriculum = 'UNKNOWN' THEN ['UNKNOWN', 'Unchecked: the profile has no curriculum.']
    WHEN items IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s curricula are unclear.']
    WHEN list_contains(low_items, lower(curriculum)) THEN ['MATCH', 'Names the curriculum that you follow.']
    ELSE ['PARTIAL', 'Names ' || joined || ' and not yours; ask the organiser whether others count.'] END
  WHEN dimension = 'LANGUAGE' THEN CASE WHEN len(languages) = 0 THEN ['UNKNOWN', 'Unchecked: the profile has no languages.']
    WHEN items IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s languages are unclear.']
    WHEN list_has_any(low_items, languages) THEN ['MATCH', 'Held in a language that you speak.']
    ELSE ['MISMATCH', 'Held in ' || joined || ' only, and the profile has no such language.'] END
  WHEN dimension = 'SUBJECT_BACKGROUND' THEN CASE WHEN items IS NULL THEN ['UNKNOWN', 'Unchecked: the page''s subjects are unclear.']
    WHEN held = len(items) THEN ['MATCH', 'All subjects that are wanted are among yours.']
    WHEN held > 0 THEN ['PARTIAL', 'Some of the subjects that are wanted are among yours.']
    ELSE ['PARTIAL', 'None of the subjects that are wanted is among yours so far.'] END
  WHEN dimension = 'PRIOR_EXPERIENCE' THEN CASE WHEN len(kinds) = 0 AND len(tag_slugs) = 0 THEN ['PARTIAL', 'Wants earlier experience; the quotation says of what kind.']
    WHEN len(rel) = 0 THEN ['PARTIAL', 'Wants earlier experience of which the profile says nothing yet.']
    ELSE ['PARTIAL', 'Wants earlier experience, such as ' || CASE WHEN len(rel) = 1 THEN rel[1].title ELSE len(rel) || ' activities of yours' END || ' — you will have to make that case in the application.'] END
  WHEN dimension = 'SCHOOL_ENROLMENT' THEN CASE WHEN education_level IS NULL THEN ['UNKNOWN', 'Unchecked: the profile has no level of education.']
    WHEN NOT flag THEN ['MATCH', 'Open whether or not you are at school.']
    WHEN education_level <> 'GAP_YEAR' THEN ['MATCH', 'For students who are enrolled, as you are.']
    ELSE ['MISMATCH', 'For students who are enrolled, and you are taking a year off.'] END
  ELSE ['UNKNOWN', 'The organiser says this in words of its own; please judge by the quotation.'] END AS a FROM er),
ev AS (SELECT user_id, opp_id, rule_no, dimension, a[1] AS verdict, a[2] AS text,
  dimension IN ('AGE', 'GRADE', 'EDUCATION_LEVEL', 'COUNTRY', 'RESIDENCY', 'CITIZENSHIP', 'SCHOOL_ENROLMENT') AS is_hard FROM ev0)
"""
)
ELIG = """, el AS (SELECT user_id, opp_id, coalesce(count(*) FILTER (WHERE is_hard AND verdict = 'MISMATCH'), 0)::BIGINT AS blocking,
  count(*) FILTER (WHERE verdict = 'PARTIAL' OR NOT is_hard AND verdict = 'MISMATCH')::BIGINT AS concerns,
  count(*) FILTER (WHERE verdict = 'MATCH')::BIGINT AS satisfied, count(*) FILTER (WHERE verdict = 'UNKNOWN')::BIGINT AS unevaluated
  FROM pairs LEFT JOIN ev USING (user_id, opp_id) GROUP BY user_id, opp_id)
"""


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.candidates(T.opportunities(spark, d), T.profiles(spark, d))


def _evaluations(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    return E.evaluate_rules(_pairs(spark, d) if pairs is None else pairs, T.rules(spark, d), T.profiles(spark, d))


def _listed(spark: SparkSession, d: str) -> DataFrame:
    """The candidates of each country: a list's length for each, however many opportunities and students there are."""
    return checkpointed(S.candidate_lists(T.opportunities(spark, d), T.profiles(spark, d)))


def _of_listed(df: DataFrame, lists: DataFrame) -> DataFrame:
    return df.join(F.broadcast(lists.select("opp_id").distinct()), "opp_id", "left_semi")


def _facts_along(spark: SparkSession, d: str, lists: DataFrame) -> DataFrame:
    o, dl, r = (_of_listed(f(spark, d), lists) for f in (T.opportunities, T.deadlines, T.rules))
    return checkpointed(M.facts_along(lists, M.opportunity_facts(o, dl, r, T.now()), r))


def _students(spark: SparkSession, d: str, along: DataFrame) -> DataFrame:
    """Students as dimensions see them, written once, as every part reads them."""
    customers = spread(T.load(spark, d, "customer"))
    profiles = T.profiles(spark, d, customers)
    return checkpointed(M.looking(profiles.withColumn("thin_areas", B.thin_areas(F.col("achievements"))), along))


def _panel(spark: SparkSession, d: str, parts: list[P.Part], along: DataFrame | None = None) -> DataFrame:
    along = _facts_along(spark, d, _listed(spark, d)) if along is None else along
    return P.pairs_of(_students(spark, d, along), along, parts)


def _open_counts(students: DataFrame, along: DataFrame) -> tuple[P.Part, DataFrame]:
    """How long the list is and how many of it no hard rule closes: as students see it who are alike in what hard rules look at."""
    parts = [p for p in M.score_parts(T.now()) if any(n.startswith("blocked_") for n in p.along)]
    blocked = F.arrays_zip(*[n for p in parts for n in p.along])
    return P.told(students, along, parts, {"listed": F.size(blocked).cast("long"), "open": F.size(F.filter(blocked, lambda x: M.is_open(parts, lambda n: x[n]))).cast("long")})


def _verdicts(dims: tuple[str, ...]):
    where = ", ".join(f"'{x}'" for x in dims)
    sql = EV + f"SELECT opp_id, rule_no::INT AS rule_no, verdict, text, count(*)::BIGINT AS n FROM ev WHERE dimension IN ({where}) GROUP BY ALL"
    reads = list(dict.fromkeys(c for x in dims for c in E.READS.get(x, [])))

    def run(spark: SparkSession, d: str) -> DataFrame:
        lists = _listed(spark, d)
        students = P.kinds(T.profiles(spark, d), reads)
        rows = E.evaluate_rules(P.met(students, lists), _of_listed(T.rules(spark, d).filter(F.col("dimension").isin(*dims)), lists), students)
        rows = rows.join(students.select("user_id", "alike"), "user_id")
        return rows.groupBy("opp_id", "rule_no", "verdict", "text").agg(F.sum("alike").alias("n"))

    return run, sql


for _name, _dims in {
    "e01_age": ("AGE",),
    "e02_grade": ("GRADE",),
    "e03_education_level": ("EDUCATION_LEVEL",),
    "e04_place": ("COUNTRY", "RESIDENCY", "CITIZENSHIP"),
    "e05_curriculum": ("CURRICULUM",),
    "e06_language": ("LANGUAGE",),
    "e07_subject_background": ("SUBJECT_BACKGROUND",),
    "e08_prior_experience": ("PRIOR_EXPERIENCE",),
    "e09_enrolment": ("SCHOOL_ENROLMENT",),
    "e10_never_judged": ("GENDER", "FINANCIAL_NEED", "OTHER"),
}.items():
    _run, _sql = _verdicts(_dims)
    _run.__name__ = _name
    query(_sql)(_run)


@query(EV + ELIG + "SELECT user_id, count(*) FILTER (WHERE blocking = 0)::BIGINT AS eligible, sum(blocking)::BIGINT AS blocking, sum(concerns)::BIGINT AS concerns, sum(satisfied)::BIGINT AS satisfied, sum(unevaluated)::BIGINT AS unevaluated FROM el GROUP BY user_id")
def e11_eligibility(spark: SparkSession, d: str) -> DataFrame:
    names = ("blocking", "concerns", "satisfied", "unevaluated")
    parts = [P.Part(list(c), {}, {f"{n}_{i}": x for n, x in E.tallies(F.col("vs")).items()}, {"vs": E.verdicts(names_of)}) for i, (c, names_of) in enumerate(E.by_reads().items())]
    along = _facts_along(spark, d, _listed(spark, d))
    students = _students(spark, d, along)
    hard, counts = _open_counts(students, along)
    rows = P.panel(students, [hard, *parts], [counts, *[P.table_of(P.rows_of(students, along, p), p) for p in parts]])
    return rows.select("user_id", F.col("open").alias("eligible"), *[sum(F.col(f"{n}_{i}") for i in range(len(parts))).alias(n) for n in names])


# --------------------------------------------------------------------- match

_R = "floor({} + 0.5)"
_DAYS = f"floor((epoch_us(next_at) - epoch_us(TIMESTAMP '{NOW}')) / 86400000000)::BIGINT"
DIMS = (
    """, tf AS (SELECT opp_id, min(date) FILTER (WHERE act AND NOT is_rolling AND date >= TIMESTAMP '"""
    + NOW
    + """') AS next_at, bool_or(act AND is_rolling) AS rolling, bool_or(act) AS any_act, min(date) FILTER (WHERE kind = 'PROGRAM_START') AS start_at
  FROM (SELECT *, kind IN ('APPLICATION_DEADLINE', 'EARLY_DEADLINE', 'REGISTRATION_DEADLINE', 'DOCUMENT_DEADLINE') AS act FROM dl) GROUP BY opp_id),
xf AS (SELECT opp_id, true AS asks, list_distinct(flatten(list(coalesce(list_transform(json_extract(value, '$.kinds[*]'), lambda x: x ->> '$'), [])))) AS wanted FROM rules WHERE dimension = 'PRIOR_EXPERIENCE' GROUP BY opp_id),
thin AS (SELECT user_id, CASE WHEN len(achievements) < 3 THEN [] ELSE (SELECT list(area) FROM (SELECT area, len(list_filter(kk, lambda x: x = area)) AS n,
    max(len(list_filter(kk, lambda x: x = area))) OVER () AS most FROM (SELECT unnest(['competition', 'research', 'leadership', 'volunteering', 'course', 'sports', 'arts']) AS area)) WHERE n <= most // 2) END AS thin_areas
  FROM (SELECT user_id, achievements, list_transform(achievements, lambda a: CASE a.kind WHEN 'COMPETITION' THEN 'competition' WHEN 'PUBLICATION' THEN 'research' WHEN 'PROJECT' THEN 'research' WHEN 'LEADERSHIP' THEN 'leadership'
    WHEN 'SERVICE' THEN 'volunteering' WHEN 'CERTIFICATION' THEN 'course' WHEN 'SPORT' THEN 'sports' WHEN 'ARTS' THEN 'arts' END) AS kk FROM profiles)),
j0 AS (SELECT pairs.user_id, pairs.opp_id, o.* EXCLUDE (opp_id), p.* EXCLUDE (user_id), tf.* EXCLUDE (opp_id), xf.asks, xf.wanted, thin_areas,
  list_filter(o.tags, lambda t: t.kind IN ('SUBJECT', 'INTEREST')) AS topical,
  list_concat(list_transform(list_filter(o.tags, lambda t: t.kind = 'CAREER_FIELD'), lambda t: t.slug), o.categories) AS pool,
  map_from_entries(list_transform(p.interests, lambda i: (i.slug, i.strength))) AS st
  FROM pairs JOIN opps o USING (opp_id) JOIN profiles p USING (user_id) LEFT JOIN tf USING (opp_id) LEFT JOIN xf USING (opp_id) LEFT JOIN thin USING (user_id)),
j AS (SELECT *, list_filter(topical, lambda t: st[t.slug] IS NOT NULL) AS mt, list_filter(career_directions, lambda c: list_contains(pool, c)) AS hits,
  list_filter(achievements, lambda a: list_contains(wanted, a.kind)) AS heldx,
  list_filter(categories, lambda c: list_contains(thin_areas, c) AND (list_contains(list_transform(interests, lambda i: i.slug), c) OR list_contains(career_directions, c))) AS gap,
  """
    + _DAYS
    + """ AS days FROM j0),
dims0 AS (SELECT user_id, opp_id, next_at, first_seen_at,
  CASE WHEN len(topical) = 0 THEN {'v': NULL::DOUBLE, 'o': NULL::VARCHAR, 't': 'The listing names no subject.'}
    WHEN len(interests) = 0 THEN {'v': NULL, 'o': NULL, 't': 'Without interests on the profile we cannot compare subjects.'}
    ELSE {'v': least(1.0::DOUBLE, list_sum(list_transform(topical, lambda t: coalesce(t.weight * (0.6::DOUBLE + 0.4::DOUBLE * (st[t.slug] / 5.0::DOUBLE)), 0.0::DOUBLE))) / list_sum(list_transform(topical, lambda t: t.weight))), 'o': NULL,
      't': CASE WHEN len(mt) = 0 THEN 'No subject of the listing is among your interests.' WHEN len(mt) <= 2 THEN 'In line with your interest in ' || array_to_string(list_transform(mt[1:2], lambda t: translate(t.slug, '-_', '  ')), ' and ') || '.'
        ELSE 'In line with ' || len(mt) || ' interests of yours, among them ' || array_to_string(list_transform(mt[1:2], lambda t: translate(t.slug, '-_', '  ')), ' and ') || '.' END} END AS subject,
  CASE WHEN len(career_directions) = 0 THEN {'v': NULL::DOUBLE, 'o': NULL::VARCHAR, 't': 'Without a career on the profile we cannot compare fields.'}
    WHEN len(pool) = 0 THEN {'v': NULL, 'o': NULL, 't': 'The listing names no career field.'}
    WHEN len(hits) = 0 THEN {'v': 0.2::DOUBLE, 'o': 'PARTIAL', 't': 'Leads elsewhere than the careers you named, and may be new to you for that.'}
    ELSE {'v': least(1.0::DOUBLE, 0.7::DOUBLE + 0.3::DOUBLE * len(hits)), 'o': NULL, 't': 'Leads towards ' || translate(hits[1], '-_', '  ') || ', a career you named.'} END AS career,
  CASE WHEN format = 'UNKNOWN' THEN {'v': NULL::DOUBLE, 'o': NULL::VARCHAR, 't': 'The page does not say how it is held.'}
    WHEN format = 'ONLINE' AND format_preference <> 'IN_PERSON' THEN {'v': 1.0::DOUBLE, 'o': NULL, 't': 'Online, so you can join from anywhere.'}
    WHEN format = 'ONLINE' THEN {'v': 0.5::DOUBLE, 'o': NULL, 't': 'Online, while you would rather be there.'}
    WHEN format_preference = 'ONLINE' THEN {'v': 0.15::DOUBLE, 'o': NULL, 't': 'You would have to be there, while you would rather join online.'}
    WHEN country_code IS NULL OR location_country IS NULL THEN {'v': NULL, 'o': NULL, 't': 'Either the place or your country is unknown.'}
    WHEN country_code <> location_country THEN {'v': 0.25::DOUBLE, 'o': 'PARTIAL', 't': 'Abroad for you: think of the journey, its price and a visa.'}
    WHEN city = location_city THEN {'v': 1.0::DOUBLE, 'o': NULL, 't': 'Held in ' || location_city || ', the city you live in.'}
    ELSE {'v': 0.8::DOUBLE, 'o': NULL, 't': 'In the country you live in.'} END AS format_location,
  CASE WHEN cost_type = 'FREE' THEN {'v': 1.0::DOUBLE, 'o': NULL::VARCHAR, 't': 'Costs nothing.'}
    WHEN cost_type = 'UNKNOWN' OR cost_type = 'PAID' AND cost_amount IS NULL THEN {'v': NULL, 'o': NULL, 't': 'The page gives no price.'}
    WHEN cost_type = 'FREE_WITH_AID' THEN {'v': 0.9::DOUBLE, 'o': NULL, 't': 'Has a price, and help with it can be asked for.'}
    WHEN budget_ceiling IS NULL THEN {'v': NULL, 'o': NULL, 't': 'Without a budget on the profile we cannot compare prices.'}
    WHEN cost_currency <> budget_currency THEN {'v': NULL, 'o': NULL, 't': 'Priced in ' || cost_currency || ' while your budget is in ' || budget_currency || ' — compare these yourself.'}
    WHEN cost_amount <= budget_ceiling THEN {'v': 1.0::DOUBLE, 'o': NULL, 't': 'No dearer than your budget.'}
    WHEN aid_available THEN {'v': 0.5::DOUBLE, 'o': 'PARTIAL', 't': 'Dearer than your budget, but help can be asked for.'}
    ELSE {'v': 0.0::DOUBLE, 'o': NULL, 't': 'Dearer than your budget.'} END AS cost,
  CASE WHEN next_at IS NULL AND NOT coalesce(rolling, false) AND coalesce(any_act, false) THEN {'v': 0.0::DOUBLE, 'o': 'MISMATCH', 't': 'The last day to apply has passed.'}
    WHEN next_at IS NULL AND NOT coalesce(rolling, false) THEN {'v': NULL::DOUBLE, 'o': NULL::VARCHAR, 't': 'The page gives no last day to apply.'}
    WHEN start_at < available_from OR start_at > available_until THEN {'v': 0.25::DOUBLE, 'o': 'PARTIAL', 't': 'Takes place when you are not free.'}
    WHEN next_at IS NULL THEN {'v': 0.9::DOUBLE, 'o': NULL, 't': 'Applications are taken all the time.'}
    WHEN days <= 2 THEN {'v': 0.3::DOUBLE, 'o': 'PARTIAL', 't': 'Closes in ' || CASE WHEN days <= 0 THEN 'under a day' ELSE days || ' days' END || ', so begin at once or not at all.'}
    WHEN days <= 7 THEN {'v': 0.65::DOUBLE, 'o': NULL, 't': 'Closes in ' || days || ' days, which is little time but enough.'}
    WHEN days <= 30 THEN {'v': 1.0::DOUBLE, 'o': NULL, 't': 'Closes in ' || days || ' days, so there is time.'}
    ELSE {'v': 0.95::DOUBLE, 'o': NULL, 't': 'Closes in ' || floor(days / 7 + 0.5)::BIGINT || ' weeks, so there is much time.'} END AS timing,
  CASE WHEN asks IS NULL THEN {'v': NULL::DOUBLE, 'o': NULL::VARCHAR, 't': 'Nothing is said of earlier experience.'}
    WHEN len(wanted) = 0 THEN {'v': 0.5::DOUBLE, 'o': 'PARTIAL', 't': 'Wants earlier experience but does not say which.'}
    WHEN len(heldx) = 0 THEN {'v': 0.25::DOUBLE, 'o': 'PARTIAL', 't': 'Wants experience of which the profile says nothing yet.'}
    ELSE {'v': CASE WHEN len(list_filter(heldx, lambda a: a.level IN ('NATIONAL', 'INTERNATIONAL'))) > 0 THEN 1.0 ELSE 0.75 END::DOUBLE, 'o': NULL,
      't': 'On your profile: ' || CASE WHEN len(heldx) = 1 THEN 'an activity that counts' ELSE len(heldx) || ' activities that count' END || '.'} END AS experience,
  CASE WHEN len(thin_areas) = 0 THEN {'v': NULL::DOUBLE, 'o': NULL::VARCHAR, 't': 'The profile holds too little to see what is missing.'}
    WHEN len(gap) = 0 THEN {'v': NULL, 'o': NULL, 't': 'Adds to no area of which you wanted more.'}
    ELSE {'v': 1.0::DOUBLE, 'o': NULL, 't': 'So far you have done less ' || translate(gap[1], '-_', '  ') || ' than elsewhere, and you wanted more of it.'} END AS profile_gap
  FROM j)
"""
)
_VERDICT = "coalesce({0}.o, CASE WHEN {0}.v >= 0.75 THEN 'MATCH' WHEN {0}.v >= 0.35 THEN 'PARTIAL' WHEN {0}.v IS NOT NULL THEN 'MISMATCH' ELSE 'UNKNOWN' END)"
MATCH = ctes("profiles", "opps", "rules", "dl", "pairs") + DIMS


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return M.opportunity_facts(T.opportunities(spark, d), T.deadlines(spark, d), T.rules(spark, d), T.now())


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return T.profiles(spark, d).withColumn("thin_areas", B.thin_areas(F.col("achievements")))


def _dims(spark: SparkSession, d: str, pairs: DataFrame | None = None) -> DataFrame:
    return M.dimensions(_pairs(spark, d) if pairs is None else pairs, _facts(spark, d), _profiles(spark, d), T.now())


def _dimension(name: str):
    sql = MATCH + f"SELECT opp_id, {_VERDICT.format(name)} AS verdict, {name}.t AS text, round({name}.v, 9) AS value, count(*)::BIGINT AS n FROM dims0 GROUP BY ALL"

    def run(spark: SparkSession, d: str) -> DataFrame:
        along = _facts_along(spark, d, _listed(spark, d))
        c, students = F.col(name.upper()), P.kinds(M.looking(_profiles(spark, d), along), M.READS[name.upper()])
        rows = P.met(students, along).select("opp_id", "alike", M.own(T.now())[name.upper()].alias(name.upper()))
        rows = rows.select("opp_id", "alike", c["verdict"].alias("verdict"), c["text"].alias("text"), F.round(c["value"], 9).alias("value"))
        return rows.groupBy("opp_id", "verdict", "text", "value").agg(F.sum("alike").alias("n"))

    return run, sql


for _i, _name in enumerate(DIMENSION_WEIGHTS, 1):
    _run, _sql = _dimension(_name.lower())
    _run.__name__ = f"m{_i:02d}_{_name.lower()}"
    query(_sql)(_run)

_W = {k.lower(): v for k, v in DIMENSION_WEIGHTS.items()}
SCORE = (
    EV
    + ELIG
    + ", "
    + ctes("dl")[5:]
    + DIMS
    + ", sc AS (SELECT user_id, opp_id, next_at, first_seen_at, blocking = 0 AS eligible, ("
    + " + ".join(f"coalesce({k}.v * {w}.0::DOUBLE, 0.0::DOUBLE)" for k, w in _W.items())
    + ") AS num, ("
    + " + ".join(f"CASE WHEN {k}.v IS NOT NULL THEN {w}.0::DOUBLE ELSE 0.0::DOUBLE END" for k, w in _W.items())
    + ") AS den, ("
    + " + ".join(f"({k}.v IS NOT NULL)::INT" for k in _W)
    + ") AS known, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {k}.v IS NULL THEN '{k.upper()}' END" for k in _W)
    + "], lambda x: x IS NOT NULL), ',') AS unknown_dimensions FROM dims0 JOIN el USING (user_id, opp_id)),\n"
    + "scored AS (SELECT *, CASE WHEN eligible AND den > 0 THEN floor(num / den * 100.0::DOUBLE + 0.5)::BIGINT ELSE 0 END AS score, CASE WHEN known >= 6 THEN 'HIGH' WHEN known >= 4 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sc)\n"
)


def _scored(spark: SparkSession, d: str, more: list[P.Part] = (), along: DataFrame | None = None) -> DataFrame:
    """opp_id, eligible and `tally` of every pair, and what more is asked for; for sums over pairs, made in the student's row."""
    parts = [*M.score_parts(T.now()), *more]
    rows = P.places(_panel(spark, d, parts, along), [n for p in parts for n in p.along]).withColumn("eligible", M.is_open(parts, F.col))
    return rows.select("opp_id", "eligible", *[c.alias(n) for n, c in M.tally(F.col, F.col("eligible")).items()], *[n for p in more for n in p.along])


@query(SCORE + "SELECT opp_id, eligible, score, confidence, unknown_dimensions, count(*)::BIGINT AS n FROM scored GROUP BY ALL")
def m08_score(spark: SparkSession, d: str) -> DataFrame:
    counts = _scored(spark, d).groupBy("opp_id", "eligible", "score", "unknown").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("opp_id", "eligible", "score", *[c.alias(n) for n, c in M.unknown_said(F.col("unknown")).items()], "n")


@query(SCORE + "SELECT user_id, opp_id, score, confidence, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, next_at ASC NULLS LAST, first_seen_at DESC, opp_id) AS place FROM scored WHERE eligible) WHERE place <= 3")
def r01_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: the three best opportunities of every student among the newest 200 open to them."""
    parts = M.score_parts(T.now())
    rows = _panel(spark, d, parts).select("user_id", F.posexplode(M.best(parts, 3)).alias("pos", "b"))
    return rows.select("user_id", "b.opp_id", "b.score", "b.confidence", (F.col("pos") + 1).alias("place"))


@query(
    SCORE
    + ", fr AS ("
    + " UNION ALL ".join(f"SELECT user_id, opp_id, {i} AS pos, '{k.upper()}' AS dimension, {_VERDICT.format(k)} AS verdict, CASE WHEN {k}.v IS NULL THEN 0 ELSE {w} END AS weight, {k}.t AS text FROM dims0" for i, (k, w) in enumerate(_W.items()))
    + """), ar AS (SELECT *, CASE verdict WHEN 'MATCH' THEN 2 WHEN 'UNKNOWN' THEN 5 ELSE 4 END AS grp FROM fr
  UNION ALL SELECT user_id, opp_id, rule_no, dimension, verdict, 0, text, CASE verdict WHEN 'MATCH' THEN 1 WHEN 'UNKNOWN' THEN 6 ELSE 3 END FROM ev WHERE NOT (is_hard AND verdict = 'MISMATCH')),
pl AS (SELECT *, row_number() OVER (PARTITION BY user_id, opp_id ORDER BY grp, pos) AS place FROM ar)
SELECT opp_id, place::INT AS place, dimension, verdict, weight::INT AS weight, text, count(*)::BIGINT AS n FROM pl GROUP BY ALL"""
)
def m08_reasons(spark: SparkSession, d: str) -> DataFrame:
    along = _facts_along(spark, d, _listed(spark, d))
    return M.reason_counts(_students(spark, d, along), along, T.now())


@query(
    SCORE
    + """SELECT user_id, count(*)::BIGINT AS candidates, count(*) FILTER (WHERE NOT eligible)::BIGINT AS ineligible,
  (least(count(*), 200) - least(count(*) FILTER (WHERE eligible), 40))::BIGINT AS ineligible_as_shown FROM scored GROUP BY user_id"""
)
def a16_ineligible(spark: SparkSession, d: str) -> DataFrame:
    """Hidden results per search: the true number, and the shown one, which counts results beyond the 40th as hidden too."""
    along = _facts_along(spark, d, _listed(spark, d))
    students = _students(spark, d, along)
    part, counts = _open_counts(students, along)
    rows, n, good = P.panel(students, [part], [counts]), F.col("listed"), F.col("open")
    return rows.select("user_id", n.alias("candidates"), (n - good).alias("ineligible"), (F.least(n, F.lit(200)) - F.least(good, F.lit(40))).alias("ineligible_as_shown"))


# -------------------------------------------------------------------- search

SEARCHES = {
    "f01_visible": (S.Filters(include_expired=True), "state IN ('VERIFIED','RECENTLY_VERIFIED','NEEDS_REVIEW','UNVERIFIED','EXPIRED')"),
    "f02_category": (S.Filters(categories=["research", "mun"]), "list_has_any(categories, ['research', 'mun'])"),
    "f03_tag": (S.Filters(subjects=["physics", "law"]), "list_has_any(list_transform(tags, lambda t: t.slug), ['physics', 'law'])"),
    "f04_format": (S.Filters(format="HYBRID"), "format = 'HYBRID'"),
    "f05_country": (S.Filters(country="N7"), "(location_country = 'N7' OR format = 'ONLINE' OR location_country IS NULL)"),
    "f06_free": (S.Filters(cost_free=True), "cost_type IN ('FREE', 'FREE_WITH_AID')"),
    "f07_city": (S.Filters(city="CITY3"), "contains(lower(location_city), 'city3')"),
    "f08_due_within": (S.Filters(within_days=60), f"opp_id IN (SELECT opp_id FROM dl WHERE kind IN ('APPLICATION_DEADLINE', 'REGISTRATION_DEADLINE') AND date BETWEEN TIMESTAMP '{NOW}' AND TIMESTAMP '{NOW}' + INTERVAL 60 DAY)"),
    "f09_keywords": (S.Filters(keywords=["Steel", "prize"]), "(contains(lower(title), 'steel') OR contains(lower(summary), 'steel') OR contains(lower(title), 'prize') OR contains(lower(summary), 'prize'))"),
    "f10_hidden_anti": (S.Filters(hidden_for=1), "opp_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 10 IN (1, 2))"),
}


def _search(f: S.Filters, cond: str):
    state = "" if f.include_expired else "state IN ('VERIFIED','RECENTLY_VERIFIED','NEEDS_REVIEW','UNVERIFIED') AND "
    sql = ctes("opps", "dl") + f"SELECT opp_id, state, title FROM opps WHERE {state}{cond}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        o = T.opportunities(spark, d)
        links = o.select("opp_id", F.explode("categories").alias("category"))
        tags = o.select("opp_id", F.explode("tags.slug").alias("tag"))
        saved = o.select(F.lit(1).alias("user_id"), "opp_id", F.when(F.col("opp_id") % 10 == 1, "HIDDEN").when(F.col("opp_id") % 10 == 2, "NOT_INTERESTED").otherwise("SAVED").alias("state"))
        return S.search(o, f, T.now(), links, tags, T.deadlines(spark, d), saved).select("opp_id", "state", "title")

    return run, sql


for _name, (_f, _cond) in SEARCHES.items():
    _run, _sql = _search(_f, _cond)
    _run.__name__ = _name
    query(_sql)(_run)


@query(ctes("opps", "dl") + "SELECT opp_id FROM opps WHERE opp_id NOT IN (SELECT opp_id FROM dl)")
def f12_no_deadline(spark: SparkSession, d: str) -> DataFrame:
    return T.opportunities(spark, d).join(T.deadlines(spark, d), "opp_id", "left_anti").select("opp_id")


@query(ctes("profiles", "opps", "pairs") + "SELECT user_id, opp_id FROM pairs")
def j02_candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d)


@query(ctes("opps") + "SELECT opp_id, updated_at FROM opps ORDER BY updated_at DESC, opp_id LIMIT 200")
def o01_newest_candidates(spark: SparkSession, d: str) -> DataFrame:
    return T.opportunities(spark, d).orderBy(F.desc("updated_at"), "opp_id").limit(200).select("opp_id", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


# ---------------------------------------------------------- benefits, profile

_PB = ctes("profiles", "opps", "pairs") + ", b AS (SELECT user_id, opp_id, o.* EXCLUDE (opp_id), p.* EXCLUDE (user_id) FROM pairs JOIN opps o USING (opp_id) JOIN profiles p USING (user_id))\n"


def _pair_rows(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).join(T.opportunities(spark, d), "opp_id").join(T.profiles(spark, d), "user_id")


@query(
    _PB
    + """, x AS (SELECT *, list_filter(tags, lambda t: t.kind IN ('SUBJECT', 'INTEREST') AND list_contains(list_transform(interests, lambda i: i.slug), t.slug)) AS shared,
  list_transform(achievements, lambda a: a.kind) AS ak, list_filter(categories, lambda c: list_contains(career_directions, c))[1] AS hit FROM b),
y AS (SELECT opp_id, list_concat(list_transform(stated_benefits, lambda t: {'tier': 'STATED', 'text': t}),
  list_transform(list_filter([CASE WHEN list_contains(categories, 'competition') THEN 'A contest: you will see how others solve the same task.' END,
    CASE WHEN list_contains(categories, 'research') THEN 'Research: at its end there is a question you have worked on yourself.' END,
    CASE WHEN list_contains(categories, 'mun') THEN 'Practice in putting a case to an audience.' END,
    CASE WHEN list_contains(categories, 'hackathon') THEN 'Teamwork against the clock, with a thing made at the end.' END,
    CASE WHEN list_contains(categories, 'volunteering') THEN 'Work with people outside school.' END,
    CASE WHEN format = 'IN_PERSON' THEN 'You would be there together with those who take part and those who run it.' END,
    CASE WHEN duration_days >= 21 THEN 'Runs for about ' || floor(duration_days / 7 + 0.5)::BIGINT || ' weeks, which is more than a first taste.' END], lambda t: t IS NOT NULL), lambda t: {'tier': 'STRUCTURAL', 'text': t}),
  list_transform(CASE WHEN len(shared) = 0 AND len(interests) = 0 AND NOT (list_contains(ak, 'COMPETITION') AND list_contains(categories, 'research')) AND NOT (list_contains(ak, 'LEADERSHIP') AND list_contains(categories, 'mun')) AND hit IS NULL
    THEN ['With interests on the profile we could say more about what you would gain.']
    ELSE list_filter([CASE WHEN len(shared) > 0 THEN 'You named an interest in ' || translate(shared[1].slug, '-_', '  ') || '; here is a way to do something with it.' END,
    CASE WHEN list_contains(ak, 'COMPETITION') AND list_contains(categories, 'research') THEN 'You have mostly entered contests. Research goes at another pace and has no winner.' END,
    CASE WHEN list_contains(ak, 'LEADERSHIP') AND list_contains(categories, 'mun') THEN 'You have led others before; here you would also have to win them over in debate.' END,
    CASE WHEN hit IS NOT NULL THEN 'You named ' || translate(hit, '-_', '  ') || ' as a career; this lets you try it without tying yourself down.' END], lambda t: t IS NOT NULL) END, lambda t: {'tier': 'INTERPRETED', 'text': t})) AS l FROM x),
z AS (SELECT opp_id, unnest(range(len(l)))::INT AS pos, unnest(l) AS u FROM y)
SELECT opp_id, pos, u.tier AS tier, u.text AS text, count(*)::BIGINT AS n FROM z GROUP BY ALL"""
)
def b03_benefits(spark: SparkSession, d: str) -> DataFrame:
    lists = _listed(spark, d)
    students = P.kinds(B.looking(T.profiles(spark, d)), B.READS)
    pairs = P.met(students, checkpointed(lists.join(_of_listed(T.opportunities(spark, d), lists).withColumn("own_benefits", B.own_benefits()), "opp_id")))
    rows = B.benefits(pairs, "alike")
    return rows.groupBy("opp_id", "pos", "tier", "text").agg(F.sum("alike").alias("n"))


@query(
    SCORE
    + """, q AS (SELECT s.user_id, s.opp_id, s.score, o.duration_days AS d, o.n_requirements AS n, o.cost_type, o.cost_amount, o.cost_currency, o.categories, p.interests,
  len(list_filter(o.tags, lambda t: t.kind IN ('SUBJECT', 'INTEREST') AND list_contains(list_transform(p.interests, lambda i: i.slug), t.slug))) AS ov
  FROM scored s JOIN opps o USING (opp_id) JOIN profiles p USING (user_id)),
w AS (SELECT user_id, opp_id, CASE WHEN d IS NULL THEN 'UNKNOWN' WHEN d <= 3 THEN 'LOW' WHEN d <= 21 THEN 'MEDIUM' ELSE 'HIGH' END AS time_commitment,
  CASE WHEN n <= 2 THEN 'LOW' WHEN n <= 5 THEN 'MEDIUM' ELSE 'HIGH' END AS application_effort,
  CASE WHEN cost_type = 'FREE' THEN 'Free' WHEN cost_type = 'FREE_WITH_AID' THEN 'Paid, aid available' WHEN cost_type = 'PAID' AND cost_amount IS NOT NULL THEN cost_currency || ' ' || CASE WHEN cost_amount = floor(cost_amount) THEN cost_amount::BIGINT::VARCHAR ELSE cost_amount::VARCHAR END ELSE 'Not stated' END AS cost_label,
  CASE WHEN len(interests) = 0 THEN 'UNKNOWN' WHEN ov >= 2 THEN 'HIGH' WHEN ov = 1 THEN 'MEDIUM' ELSE 'LOW' END AS skill_relevance,
  CASE WHEN score >= 75 AND n <= 5 THEN 'A strong match if you want to do more in ' || coalesce(translate(categories[1], '-_', '  '), 'this area') || ', and there is little to hand in.'
    WHEN score >= 75 THEN 'A strong match with much to hand in: take it on if ' || coalesce(translate(categories[1], '-_', '  '), 'this area') || ' is what you most want this year.'
    WHEN score >= 50 THEN 'A fair match: look at it when nothing better falls into the same weeks.'
    ELSE 'A weak match so far: see whether you may apply before you do more.' END AS assessment FROM q)
SELECT opp_id, time_commitment, application_effort, cost_label, skill_relevance, assessment, count(*)::BIGINT AS n FROM w GROUP BY ALL"""
)
def b04_worth(spark: SparkSession, d: str) -> DataFrame:
    along = _facts_along(spark, d, _listed(spark, d))
    pairs = _scored(spark, d, [P.Part(["interests"], {"overlap": B.overlap()})], along)
    counts = pairs.groupBy("opp_id", "score", "overlap").agg(F.count(F.lit(1)).alias("alike"))
    rows = counts.join(_of_listed(T.opportunities(spark, d), along), "opp_id").select("opp_id", "alike", *[c.alias(n) for n, c in B.worth_of(B.relevance_of(F.col("overlap"))).items()])
    return rows.groupBy("opp_id", "time_commitment", "application_effort", "cost_label", "skill_relevance", "assessment").agg(F.sum("alike").alias("n"))


@query(
    ctes("profiles")
    + """, a AS (SELECT user_id, unnest(achievements).kind AS kind FROM profiles),
m(area, kind) AS (VALUES ('academics', 'PUBLICATION'), ('academics', 'CERTIFICATION'), ('competitions', 'COMPETITION'), ('research', 'PROJECT'), ('research', 'PUBLICATION'), ('leadership', 'LEADERSHIP'), ('community', 'SERVICE'), ('creative', 'ARTS'), ('sport', 'SPORT')),
c AS (SELECT p.user_id, g.area, (SELECT count(*) FROM a JOIN m USING (kind) WHERE a.user_id = p.user_id AND m.area = g.area) AS n FROM profiles p, (SELECT DISTINCT area FROM m) g)
SELECT user_id, area, n::BIGINT AS n, floor(n / greatest(1, max(n) OVER (PARTITION BY user_id)) * 100.0::DOUBLE + 0.5)::BIGINT AS relative FROM c"""
)
def a11_strength(spark: SparkSession, d: str) -> DataFrame:
    p = T.profiles(spark, d)
    return B.strength(p.select("user_id", F.explode("achievements.kind").alias("kind")), p)


@query(MATCH + "SELECT user_id, array_to_string(list_sort(thin_areas), ',') AS thin_areas FROM thin")
def a12_thin_areas(spark: SparkSession, d: str) -> DataFrame:
    return _profiles(spark, d).select("user_id", F.array_join(F.array_sort("thin_areas"), ",").alias("thin_areas"))


@query(
    ctes("profiles")
    + """, f AS (SELECT user_id, [{'k': 'dateOfBirth', 'w': 22, 'f': age IS NOT NULL}, {'k': 'countryCode', 'w': 18, 'f': country_code IS NOT NULL}, {'k': 'interests', 'w': 22, 'f': len(interests) >= 2},
  {'k': 'educationLevel', 'w': 14, 'f': education_level IS NOT NULL OR grade IS NOT NULL}, {'k': 'budget', 'w': 10, 'f': budget_ceiling IS NOT NULL}, {'k': 'availability', 'w': 8, 'f': available_from IS NOT NULL}, {'k': 'careerDirections', 'w': 6, 'f': len(career_directions) > 0}] AS l FROM profiles),
u AS (SELECT user_id, unnest(l) AS x, unnest(range(7)) AS i FROM f)
SELECT user_id, floor(sum(CASE WHEN x.f THEN x.w ELSE 0 END) / 100 * 100.0::DOUBLE + 0.5)::BIGINT AS score, arg_max(x.k, x.w * 10 - i) FILTER (WHERE NOT x.f) AS next_field FROM u GROUP BY user_id"""
)
def a13_completeness(spark: SparkSession, d: str) -> DataFrame:
    return B.completeness(T.profiles(spark, d))


@query(
    ctes("opps")
    + """, v AS (SELECT opp_id // 4 AS grp, opp_id, unnest(['format', 'country', 'cost', 'duration', 'state']) AS attribute,
  unnest([coalesce(format, 'Not stated'), coalesce(location_country, 'Not stated'), coalesce(cost_type, 'Not stated'), coalesce(duration_days::VARCHAR, 'Not stated'), coalesce(state, 'Not stated')]) AS value FROM opps)
SELECT grp, attribute, string_agg(value, ' | ' ORDER BY opp_id) AS shown, count(DISTINCT value) > 1 AS differs FROM v GROUP BY grp, attribute"""
)
def p05_compare(spark: SparkSession, d: str) -> DataFrame:
    """Side-by-side comparison of four items at a time: one row per attribute, and whether it differs."""
    o = T.opportunities(spark, d)
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("Not stated"))
    wide = o.select(F.floor(F.col("opp_id") / 4).alias("grp"), "opp_id", said("format").alias("format"), said("location_country").alias("country"), said("cost_type").alias("cost"), said("duration_days").alias("duration"), said("state").alias("state"))
    rows = wide.unpivot(["grp", "opp_id"], ["format", "country", "cost", "duration", "state"], "attribute", "value")
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("opp_id", "value"))), lambda x: x["value"]), " | ")
    return rows.groupBy("grp", "attribute").agg(shown.alias("shown"), (F.count_distinct("value") > 1).alias("differs"))
