"""Match, eligibility and ranking by example: one change to a base student and opportunity each."""

import pytest
from pyspark.sql import functions as F

from marlstone.operators import benefits as B
from marlstone.operators import eligibility as E
from marlstone.operators import match as M

PROFILE = "user_id long, age int, grade int, education_level string, country_code string, city string, curriculum string, languages array<string>, format_preference string, budget_ceiling double, budget_currency string, available_from timestamp, available_until timestamp, interests array<struct<slug:string,strength:int,kind:string>>, career_directions array<string>, achievements array<struct<kind:string,level:string,tag_slugs:array<string>,title:string>>, thin_areas array<string>"
OPP = "opp_id long, title string, format string, location_country string, location_city string, cost_type string, cost_amount double, cost_currency string, aid_available boolean, duration_days int, tags array<struct<slug:string,weight:double,kind:string>>, categories array<string>, first_seen_at timestamp"
BASE_P = dict(user_id=1, age=16, grade=12, education_level="SENIOR_SECONDARY", country_code="GB", city="Leeds", curriculum="A_LEVELS", languages=["en"], format_preference="ANY", budget_ceiling=100.0, budget_currency="GBP", available_from=None, available_until=None, interests=[("molecular-biology", 5, "SUBJECT")], career_directions=["medicine"], achievements=[], thin_areas=[])
BASE_O = dict(opp_id=1, title="Summer Research Placement", format="IN_PERSON", location_country="GB", location_city="Leeds", cost_type="FREE", cost_amount=None, cost_currency=None, aid_available=None, duration_days=42, tags=[("molecular-biology", 1.0, "SUBJECT")], categories=["research"], first_seen_at=None)
DUE = [("APPLICATION_DEADLINE", "2026-09-07 00:00:00", False)]


def now():
    return F.lit("2026-08-18").cast("timestamp")


def run(spark, p=None, o=None, rules=(), due=tuple(DUE)):
    profiles = spark.createDataFrame([tuple({**BASE_P, **(p or {})}.values())], PROFILE)
    opps = spark.createDataFrame([tuple({**BASE_O, **(o or {})}.values())], OPP)
    r = spark.createDataFrame([(1, i, *x) for i, x in enumerate(rules)], "opp_id long, rule_no int, dimension string, operator string, value string")
    d = spark.createDataFrame([(1, i, k, t, roll) for i, (k, t, roll) in enumerate(due)], "opp_id long, deadline_id long, kind string, t string, is_rolling boolean").withColumn("date", F.col("t").cast("timestamp"))
    pairs = spark.createDataFrame([(1, 1)], "user_id long, opp_id long")
    ev = E.evaluate_rules(pairs, r, profiles)
    el = E.eligibility(pairs, ev)
    dims = M.dimensions(pairs, M.opportunity_facts(opps, d, r, now()), profiles, now())
    return M.compose(dims, el).first(), dims.first(), ev.orderBy("rule_no").collect(), el.first(), M.reasons(dims, ev)


def test_base_score(spark):
    s, d, _, e, _ = run(spark)
    assert (s.score, s.confidence, s.eligible) == (85, "MEDIUM", True)
    assert [d[k]["value"] for k in ("SUBJECT", "CAREER", "FORMAT_LOCATION", "COST", "TIMING", "EXPERIENCE", "PROFILE_GAP")] == [1.0, 0.2, 1.0, 1.0, 1.0, None, None]


def test_hard_age_rule(spark):
    s, _, ev, e, _ = run(spark, rules=[("AGE", "BETWEEN", '{"min":18,"max":22}')])
    assert (s.eligible, s.score, e.blocking) == (False, 0, 1) and "16" in ev[0].text and ev[0].text.endswith("18–22.")
    s, _, ev, e, _ = run(spark, {"age": None}, rules=[("AGE", "BETWEEN", '{"min":18,"max":22}')])
    assert s.eligible and ev[0].verdict == "UNKNOWN" and e.unevaluated == 1


def test_soft_rules_are_concerns(spark):
    _, _, ev, e, _ = run(spark, rules=[("CURRICULUM", "IN", '["IB"]'), ("LANGUAGE", "IN", '["fr"]'), ("PRIOR_EXPERIENCE", "REQUIRES", '{"kinds":["PROJECT"]}')], p={"achievements": [("PROJECT", "SCHOOL", ["x"], "My project")]})
    assert e.eligible and e.concerns == 3 and [x.verdict for x in ev] == ["PARTIAL", "MISMATCH", "PARTIAL"]
    assert "My project — you will have to make that case" in ev[2].text


def test_unknown_cost(spark):
    s, d, *_ = run(spark, o={"cost_type": "UNKNOWN"})
    assert "COST" in s.unknown_dimensions and s.score == 83


def test_little_is_known(spark):
    s, *_ = run(spark, p={"interests": [], "career_directions": []}, o={"format": "UNKNOWN", "cost_type": "UNKNOWN", "tags": []}, due=[])
    assert (s.confidence, s.score) == ("LOW", 0)


@pytest.mark.parametrize(
    "o,p,verdict,part",
    [
        ({"cost_type": "PAID", "cost_amount": 5000.0, "cost_currency": "INR"}, {}, "UNKNOWN", "compare these yourself"),
        ({"cost_type": "PAID", "cost_amount": 250.0, "cost_currency": "GBP"}, {}, "MISMATCH", "Dearer"),
        ({"cost_type": "PAID", "cost_amount": 250.0, "cost_currency": "GBP", "aid_available": True}, {}, "PARTIAL", "help can be asked"),
        ({"cost_type": "PAID", "cost_amount": 50.0, "cost_currency": "GBP"}, {}, "MATCH", "No dearer"),
    ],
)
def test_costs(spark, o, p, verdict, part):
    d = run(spark, p, o)[1]["COST"]
    assert d["verdict"] == verdict and part in d["text"]


@pytest.mark.parametrize(
    "due,verdict,part",
    [
        ([("PROGRAM_START", "2026-08-23", False), ("APPLICATION_DEADLINE", "2026-09-17", False)], "MATCH", "30 days"),
        ([("APPLICATION_DEADLINE", "2026-08-17", False)], "MISMATCH", "passed"),
        ([("APPLICATION_DEADLINE", "2026-08-19", False)], "PARTIAL", "1 days"),
        ([("APPLICATION_DEADLINE", "1970-01-01", True)], "MATCH", "all the time"),
        ([("RESULT_DATE", "2026-08-30", False)], "UNKNOWN", "no last day to apply"),
    ],
)
def test_timing(spark, due, verdict, part):
    d = run(spark, due=due)[1]["TIMING"]
    assert d["verdict"] == verdict and part in d["text"]


def test_profile_gap(spark):
    got = run(spark, p={"thin_areas": ["research"], "interests": [("research", 3, "INTEREST")]})[1]["PROFILE_GAP"]
    assert got["value"] == 1.0
    assert run(spark, p={"thin_areas": ["research"]})[1]["PROFILE_GAP"]["value"] is None


def test_reasons_in_order(spark):
    rows = run(spark, rules=[("AGE", "GTE", '{"min":15}'), ("GENDER", "EQUALS", '"F"'), ("CURRICULUM", "IN", '["IB"]')])[4].orderBy("place").collect()
    assert [r.dimension for r in rows] == ["AGE", "SUBJECT", "FORMAT_LOCATION", "COST", "TIMING", "CURRICULUM", "CAREER", "EXPERIENCE", "PROFILE_GAP", "GENDER"]


def test_thin_areas_and_completeness(spark):
    a = spark.createDataFrame([(["COMPETITION"] * 4 + ["PROJECT"] * 2,), (["SPORT"],)], "k array<string>")
    got = [r[0] for r in a.select(B.thin_areas(F.transform("k", lambda x: F.struct(x.alias("kind"))))).collect()]
    assert got == [["research", "leadership", "volunteering", "course", "sports", "arts"], []]
    p = spark.createDataFrame([tuple(BASE_P.values())], PROFILE)
    assert tuple(B.completeness(p).first()) == (1, 70, "interests")


def test_panels_say_what_pairs_say(spark):
    """Ranking by kinds of students gives what evaluating each pair gives."""
    from marlstone import plans
    from marlstone.plans import match_plans as MP

    d = "/root/testdata/sf0.001"
    got = {(r.user_id, r.place): (r.opp_id, r.score, r.confidence) for r in plans.queries()["r01_rank_topk"](spark, d).collect()}
    profiles, pairs = MP._profiles(spark, d), MP._pairs(spark, d)
    scores = M.scores(pairs, MP._facts(spark, d), MP.T.rules(spark, d), profiles, MP.T.now())
    want = {(r.user_id, r.place): (r.opp_id, r.score, r.confidence) for r in M.rank(scores, MP._facts(spark, d), 3).collect()}
    assert got == want


def test_kinds_count_their_students(spark):
    from marlstone.operators import panels as P

    rows = [(1, 15, "GB"), (2, 15, "GB"), (3, 16, "GB"), (4, 15, None), (5, None, None), (6, None, None)]
    got = P.kinds(spark.createDataFrame(rows, "user_id long, age int, country_code string"), ["age"]).collect()
    assert sorted((r.user_id, r.alike) for r in got) == [(1, 2), (3, 1), (4, 1), (5, 2)]


def test_sentences_are_parsed_once(spark):
    """Patterns run over distinct sentences: the parsing stands above their grouping, not above the students."""
    from marlstone.plans.text_plans import _asked

    plan = _asked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [q" in plan


def test_open_lists_are_counted_once_a_kind(spark):
    """How many of a list a student may enter is worked out for kinds of students; more of the same kinds add nothing to it."""
    from marlstone.operators import panels as P
    from marlstone.plans import match_plans as MP

    d = "/root/testdata/sf0.001"
    along = MP._facts_along(spark, d, MP._listed(spark, d))
    students = MP._students(spark, d, along)
    more = students.unionByName(students.withColumn("user_id", F.col("user_id") + 1_000_000))
    _, once = MP._open_counts(students, along)
    part, twice = MP._open_counts(more, along)
    kinds = students.select("country_code", *part.columns).distinct().count()
    got = sorted(map(repr, twice.collect()))
    assert len(got) <= kinds < more.count() and got == sorted(map(repr, once.collect()))
    want = E.eligibility_of(MP._pairs(spark, d), MP.T.rules(spark, d), MP.T.profiles(spark, d)).groupBy("user_id").agg(F.count_if("eligible").alias("open"))
    rows = P.panel(students, [part], [once]).select("user_id", "open")
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, want.collect()))


def test_pairs_are_counted_by_numbers(spark):
    """Pairs are read from where their arrays lie and counted by small numbers, words are made of the counts; they are what evaluating each pair gives."""
    from marlstone import plans
    from marlstone.plans import match_plans as MP

    d = "/root/testdata/sf0.001"
    pairs = MP._scored(spark, d)
    assert "string" not in dict(pairs.dtypes).values()
    assert "arrays_zip" not in pairs._jdf.queryExecution().optimizedPlan().toString()
    keys = ["opp_id", "eligible", "score", "confidence", "unknown_dimensions"]
    scores = M.scores(MP._pairs(spark, d), MP._facts(spark, d), MP.T.rules(spark, d), MP._profiles(spark, d), MP.T.now())
    want = scores.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, plans.queries()["m08_score"](spark, d).select(*keys, "n").collect())) == sorted(map(tuple, want.collect()))


def test_overlap_and_its_words(spark):
    tags = [(s, 1.0, k) for s, k in (("a", "SUBJECT"), ("b", "INTEREST"), ("c", "SUBJECT"), ("d", "CAREER_FIELD"))]
    rows = [(0, [], tags), (1, ["x"], tags), (2, ["a", "d"], tags), (3, ["a", "b"], tags), (4, ["a", "b", "c"], tags), (5, None, tags), (6, ["a"], None)]
    pairs = spark.createDataFrame(rows, "i int, s array<string>, tags array<struct<slug:string,weight:double,kind:string>>").withColumn("interests", F.transform("s", lambda x: F.struct(x.alias("slug"))))
    got = [tuple(r) for r in pairs.orderBy("i").select(B.overlap(), B.skill_relevance()).collect()]
    assert got == [(-1, "UNKNOWN"), (0, "LOW"), (1, "MEDIUM"), (2, "HIGH"), (2, "HIGH"), (0, "LOW"), (0, "LOW")]


def test_areas_of_activities_are_looked_up_once(spark):
    a = spark.createDataFrame([(["COMPETITION"] * 4,), ([None] * 3,), (None,)], "k array<string>")
    thin = a.select(B.thin_areas(F.transform("k", lambda x: F.struct(x.alias("kind")))).alias("thin"))
    assert thin._jdf.queryExecution().analyzed().toString().count("map(COMPETITION") == 1
    assert [len(r.thin) for r in thin.collect()] == [6, 0, 0]
