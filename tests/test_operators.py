"""Checklist, readiness, dedupe, folds, provenance, table changes, pages and calendars by example."""

import itertools
import random
from datetime import datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import checklist as C
from marlstone.operators import dedupe as K
from marlstone.operators import dml
from marlstone.operators import extract as E
from marlstone.operators import provenance as P
from marlstone.operators import search as S
from marlstone.operators import temporal as TM
from marlstone.sources import html_reader as H
from marlstone.sources import ics

T0 = datetime(2026, 8, 18)


def test_checklist(spark):
    req = spark.createDataFrame([(1, 0, "Pay the fee"), (1, 1, "A letter of recommendation"), (1, 2, "Personal statement"), (1, 3, "transcript"), (1, 4, "Report card"), (1, 5, "Odd one"), (1, 6, "Odd two")], "opp_id int, pos int, label string")
    rows = C.build_checklist(req, spark.createDataFrame([(1,)], "opp_id int")).orderBy("sort_order").collect()
    kinds = [r.kind for r in rows]
    assert kinds[0] == "RECOMMENDATION" and kinds[-1] == "SUBMIT" and kinds.count("TRANSCRIPT") == 1
    assert kinds.count("CUSTOM") == 3 and [r.sort_order for r in rows] == list(range(len(rows)))


def tasks(spark, rows, days):
    made = [(1, i, f"Task {k}", k, req, done, blocks, lead, None if days is None else T0 + timedelta(days=days)) for i, (k, req, done, blocks, lead) in enumerate(rows)]
    return spark.createDataFrame(made, "app_id int, task_no int, title string, kind string, is_required boolean, is_complete boolean, blocks_submission boolean, lead_days int, deadline timestamp")


def ready(spark, rows, days):
    now = F.lit(T0)
    r = C.readiness(tasks(spark, rows, days), now)
    return r.withColumn("text", C.reminder(F.lit("The Prize"), now)).first()


def test_readiness_and_reminder(spark):
    rows = [("ESSAY", True, False, True, 10), ("FORM", True, True, True, 3), ("FEE", True, True, True, 3), ("FORM", True, False, True, 3), ("CUSTOM", False, False, False, 3)]
    r = ready(spark, rows, 40)
    assert (r.score, r.total, r.next_action, r.can_submit) == (50, 4, "Task ESSAY", False)
    r = ready(spark, rows, 4)
    assert r.next_action == "Task ESSAY" and "usually takes longer" in r.text and "in 4 days" in r.text
    r = ready(spark, [("ESSAY", True, False, True, 0), ("FEE", True, True, True, 0)], 1)
    assert "tomorrow" in r.text and "task ESSAY is the only thing left" in r.text
    r = ready(spark, [("FEE", True, True, True, 0)], 2)
    assert "everything on your checklist is done" in r.text and r.can_submit
    assert ready(spark, rows, None).text is None and ready(spark, rows, -1).text is None
    assert ready(spark, [("FEE", False, False, True, 3)], 5).score == 0


def model_similarity(a, b, stop):
    grams = lambda s: {f"  {s} "[i : i + 3] for i in range(len(s) + 1)}
    toks = lambda s: {w for w in s.split(" ") if len(w) > 2 and w not in stop}
    ga, gb, ta, tb = grams(a), grams(b), toks(a), toks(b)
    dice = 2 * len(ga & gb) / (len(ga) + len(gb)) if ga and gb else 0
    over = len(ta & tb) / min(len(ta), len(tb)) if ta and tb else 0
    return max(dice, 0.95 * over)


def test_title_join_misses_nothing(spark):
    from marlstone.domains import TITLE_STOPWORDS

    r = random.Random(3)
    words = ["summer", "research", "programme", "advanced", "chemistry", "chess", "junior", "prize", "the", "of", "art", "camp", "young", "people", "school"]
    titles = sorted({" ".join(r.choice(words) + r.choice(["", "s", ""]) for _ in range(r.randint(1, 5))) for _ in range(160)} | {""})
    got = {(x.a, x.b): x.similarity for x in K.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    want = {(a, b): s for a, b in itertools.combinations(titles, 2) if (s := model_similarity(a, b, TITLE_STOPWORDS)) >= 0.75}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_duplicates(spark):
    schema = "id long, pos long, url string, hash string, title string, org string, cycle int"
    corpus = spark.createDataFrame([(10, 0, "u1", "h1", "Summer Programme", "a.org", 2026), (11, 1, "u2", "h2", "Chess Camp", "b.org", None)], schema)
    new = [(1, 0, "u1", "x", "Other", "z.org", 2026), (2, 1, "x", "h2", "Other", None, None), (3, 2, "q", "q", "Summer Program", "a.org", None), (4, 3, "q", "q", "Summer Programme", "c.org", None), (5, 4, "u1", "h1", "Summer Programme", "a.org", 2027), (6, 5, "", None, "Rowing", "b.org", None)]
    got = {r.id: (r.merge_into, r.status) for r in K.first_same(spark.createDataFrame(new, schema), corpus).collect()}
    # Record 3: the one token that tells titles apart is shared, so the overlap is whole.
    assert got == {1: (0, "merged"), 2: (1, "merged"), 3: (0, "merged"), 4: (None, "review"), 5: (None, "created"), 6: (None, "created")}
    best = {r.id: r.verdict for r in K.find_duplicate(spark.createDataFrame(new, schema), corpus).collect()}
    assert best[1] == "SAME" and best[4] == "REVIEW" and 5 not in best


def fold_model(actions, limit, seconds):
    out, kept = [], {}
    for k, t in actions:
        past = [x for x in kept.get(k, []) if x >= t - seconds]
        out.append(len(past) < limit)
        kept[k] = past + [t] if out[-1] else past
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 60)), min_size=1, max_size=40), st.integers(1, 3))
def test_fold_against_a_model(spark, actions, limit):
    actions = sorted(actions, key=lambda x: x[1])
    rows = spark.createDataFrame([(i, k, T0 + timedelta(seconds=t)) for i, (k, t) in enumerate(actions)], "seq long, k string, at timestamp")
    got = [r.accepted for r in TM.accepted(rows, "k", limit, 10).orderBy("seq").collect()]
    assert got == fold_model(actions, limit, 10)


def test_suppression_counts_accepted_runs_only(spark):
    rows = spark.createDataFrame([(i, "q", T0 + timedelta(hours=h)) for i, h in enumerate((0, 4, 7))], "seq long, k string, at timestamp")
    assert [r.accepted for r in TM.accepted(rows, "k", 1, 6 * 3600).orderBy("seq").collect()] == [True, False, True]


def test_quota(spark):
    rows = spark.createDataFrame([(i, T0 + timedelta(days=20 * i), n) for i, n in enumerate((4, 4, 4))], "seq long, at timestamp, n long")
    got = [(r.period, r.granted, r.used) for r in TM.quota(rows, 6).orderBy("seq").collect()]
    assert got == [("2026-08", 4, 4), ("2026-09", 4, 4), ("2026-09", 2, 6)]


def test_provenance_merge(spark):
    schema = "id int, field string, value string, method string, at int"
    old = spark.createDataFrame([(1, "deadline", "a", "SEARCH_RESULT", 1), (1, "title", "t", "AI_EXTRACTED", 1), (1, "cost", "c", "ADMIN_CORRECTED", 1), (1, "only", "o", "SEARCH_RESULT", 1)], schema)
    new = spark.createDataFrame([(1, "deadline", "b", "STRUCTURED_MARKUP", 2), (1, "title", "t", "STRUCTURED_MARKUP", 2), (1, "cost", "d", "AI_EXTRACTED", 2), (1, "fresh", "f", "AI_EXTRACTED", 2)], schema)
    got = {r.field: (r.value, r.method, r.at, r.conflict) for r in P.merge(old, new).collect()}
    assert got == {
        "deadline": ("b", "STRUCTURED_MARKUP", 2, True),
        "title": ("t", "STRUCTURED_MARKUP", 2, False),
        "cost": ("c", "ADMIN_CORRECTED", 1, True),
        "only": ("o", "SEARCH_RESULT", 1, False),
        "fresh": ("f", "AI_EXTRACTED", 2, False),
    }
    human = spark.range(1).select(P.needs_human(F.lit("eligibility.age"), F.lit("AI_EXTRACTED")), P.needs_human(F.lit("eligibilityx"), F.lit("AI_EXTRACTED")), P.needs_human(F.lit("costType"), F.lit("ADMIN_ENTERED"))).first()
    assert list(human) == [True, False, False]


def test_table_changes(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, v string, at int")
    c = spark.createDataFrame([(2, "x", 2), (2, "y", 3), (3, "z", 2)], "k int, v string, at int")
    assert sorted(map(tuple, dml.upsert(t, c, ["k"], ["at"]).collect())) == [(1, "a", 1), (2, "y", 3), (3, "z", 2)]
    nulls = spark.createDataFrame([(None,), (1,), (9,)], "v int")
    assert sorted(r.v or 0 for r in dml.delete_where(nulls, F.col("v") > 5).collect()) == [0, 1]


PAGE = """<html><head><title>Site title</title><meta property="og:title" content="Open title"><script type="application/ld+json">{"@graph":[{"@type":"BreadcrumbList","name":"no"},{"@type":"Course","name":"Graph Course","applicationDeadline":"2026-06-30","offers":{"price":"450.00","priceCurrency":"GBP"},"eventAttendanceMode":"https://schema.org/MixedEventAttendanceMode"}]}</script></head>
<body><nav>menu</nav><p>Body &amp; text</p><script>x()</script></body></html>"""


def test_html_facts_of_broken_markup():
    title, og, description, body = H._facts("""<![foo bar]><title>A &amp; B</title><meta property="og:title" content='"Q" it'><meta name=description content=d/><p>x<form action=/a/>no</form><script type="application/ld+json">{"@type":"Course","name":"A &amp; B"}""")[:4]
    assert (title, og, description, body.split()) == ("A & B", '"Q" it', "d/", ["x"])
    assert H._facts("""<script type="application/ld+json">{"@type":"Course","name":"A &amp; B"}""")[4] == "A &amp; B"
    H._facts("<a b='" * 20_000)


def test_html_facts(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, "<title> Only  title </title><p>x"), (3, None), (4, '<script type="application/ld+json">broken{</script>')], "page_id long, html string")
    got = {r.page_id: r for r in H.facts(H.read(pages)).collect()}
    a = got[1]
    assert (a.title, a.title_method, a.cost_type, a.cost_amount, a.cost_currency, a.format) == ("Graph Course", "STRUCTURED_MARKUP", "PAID", 450.0, "GBP", "HYBRID")
    assert a.text == "Body & text" and a.application_deadline == datetime(2026, 6, 30)
    assert (got[2].title, got[2].title_method) == ("Only title", "LABELLED_PAGE_TEXT")
    assert got[3].title is None and got[3].text == "" and got[4].title is None
    numbers = spark.createDataFrame([(i, x) for i, x in enumerate(["450.00", "contact us", "", "GBP 1,200", "0", None])], "i int, x string")
    assert [r.y for r in numbers.select("i", H.number(F.col("x")).alias("y")).orderBy("i").collect()] == [450.0, None, None, 1200.0, 0.0, None]


def test_model_proposals_must_stand_in_the_page(spark):
    facts = "title string, summary string, organizer string, format string"
    page = (1, "Apply by 12 September 2026. The fee is £20. " + "More text. " * 20, *[None] * 10, [])
    pages = spark.createDataFrame([page], f"id int, text string, {facts}, deadline timestamp, age_min int, age_max int, cost_type string, cost_amount double, cost_currency string, requirements array<string>")
    out = spark.createDataFrame([(1, "Invented", None, None, None, "apply by 12 september 2026", None, None, None, "the fee is £90", [], [])], f"id int, {facts}, deadline_text string, age_min int, age_max int, age_text string, cost_text string, requirements array<string>, benefits array<string>")
    r = E.fill_gaps(pages, out, "id").first()
    assert r.title is None and r.deadline == datetime(2026, 9, 12, 23, 59) and r.cost_type is None and r.rejected == ["title", "cost"]


def test_sentences_to_filters(spark):
    asked = ["Free STEM programmes for 16-year-olds in India", "MUNs in Mumbai during September", "scholarships for aeronautics enthusiasts", "help us win", ""]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string").withColumns(S.parse_query(F.col("q")))
    df = df.withColumn("keywords", S.residual_keywords(F.col("q"), F.col("categories"), F.col("subjects"), F.col("country")))
    a, b, c, d, e = df.orderBy("i").collect()
    assert (a.categories, a.cost_free, a.age, a.country) == (["stem"], True, 16, "IN")
    assert (b.categories, b.month) == (["mun"], 9) and "mumbai" in b.keywords
    assert "aeronautics" in c.keywords and c.categories == ["scholarship"]
    assert d.country == "US" and e.categories == [] and e.keywords == []
    shown = [(r.label, r.value) for r in S.chips(df.filter("i = 0"), "i").orderBy("pos").collect()]
    assert shown[:4] == [("Type", "stem"), ("Country", "IN"), ("Cost", "Free only"), ("Age", "16")]


def test_planned_queries(spark):
    df = spark.createDataFrame([("research and olympiad for physics and law in the UK",)], "q string").withColumns(S.parse_query(F.col("q"))).withColumn("keywords", F.array().cast("array<string>"))
    df = df.withColumns({"profile_age": F.lit(16), "profile_country": F.lit("FR"), "profile_level": F.lit(None).cast("string"), "profile_interests": F.array(F.lit("x"))})
    assert df.select(S.plan_queries(2026)).first()[0] == ["physics olympiad high school students GB 2026", "law olympiad high school students GB 2026", "physics research high school students GB 2026", "law research high school students GB 2026"]


def test_candidates_against_a_model(spark):
    r = random.Random(5)
    opps = [(i, r.choice(["A", "B", None]), r.choice(["ONLINE", "IN_PERSON"]), r.choice(["VERIFIED", "ARCHIVED"]), T0 + timedelta(minutes=r.randint(0, 50))) for i in range(60)]
    people = [(i, r.choice(["A", "B", "C", None])) for i in range(12)]
    o = spark.createDataFrame(opps, "opp_id long, location_country string, format string, state string, updated_at timestamp")
    p = spark.createDataFrame(people, "user_id long, country_code string")
    want = set()
    for u, c in people:
        rows = [x for x in opps if x[3] == "VERIFIED" and (c is None or x[1] in (c, None) or x[2] == "ONLINE")]
        want |= {(u, x[0]) for x in sorted(rows, key=lambda x: (-x[4].timestamp(), x[0]))[:7]}
    assert {tuple(x) for x in S.candidates(o, p, 7).collect()} == want


def test_calendar(spark, tmp_path):
    rows = [(1, 0, "s", "A, b", "https://x", "APPLICATION_DEADLINE", T0, False, None), (1, 1, "s", "A, b", "https://x", "APPLICATION_DEADLINE", T0, False, None), (1, 0, "t", "R", "https://y", "RESULT_DATE", T0, True, None)]
    df = spark.createDataFrame(rows, "user_id long, src int, slug string, title string, url string, kind string, date timestamp, is_rolling boolean, raw_text string")
    ev = ics.events(df, F.lit(T0))
    assert ev.count() == 1
    lines = ev.first().event.split("\r\n")
    assert lines[0] == "BEGIN:VEVENT" and "SUMMARY:Application deadline: A\\, b" in lines and "DTEND;VALUE=DATE:20260819" in lines
    ics.write(ev, f"{tmp_path}/cal")
    text = "".join(open(f, newline="").read() for f in sorted(map(str, (tmp_path / "cal").glob("part-*"))))
    assert text.startswith("BEGIN:VCALENDAR\r\n") and text.endswith("END:VCALENDAR\r\n")


def test_verbatim(spark):
    df = spark.createDataFrame([("Due “May  5”", 'it is due "may 5" then'), ("ab", "ab"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(X.appears_verbatim(F.col("a"), F.col("b"))).collect()] == [True, False, False]


def test_markup_without_bottom():
    assert H.nodes(["[" * 200_000, "{", '{"@type": "Course", "name": "x"}']) == [{"@type": "Course", "name": "x"}]


def test_gap_filling_makes_a_pages_form_once(spark):
    """A page's form for quotations stood once at every quotation in the plan, and was made there."""
    from marlstone.plans.extract_plans import t11_fill_gaps

    plan = t11_fill_gaps(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(lower(text") == 3  # one form names its text three times


def test_reading_pages_holds_few_of_them(spark):
    """How much Python holds hangs on a page's size, not on how many pages a partition has."""
    import os

    def workers() -> dict[int, int]:
        """Peak MB of each Python process below this one."""
        stat, peak = {}, {}
        for pid in filter(str.isdigit, os.listdir("/proc")):
            try:
                status = dict(line.split(":", 1) for line in open(f"/proc/{pid}/status") if ":" in line)
            except OSError:
                continue
            stat[int(pid)] = int(status["PPid"])
            if status["Name"].strip().startswith("python") and "VmHWM" in status:
                peak[int(pid)] = int(status["VmHWM"].split()[0]) // 1000
        below = lambda p: p in stat and (stat[p] == os.getpid() or below(stat[p]))
        return {p: mb for p, mb in peak.items() if below(p)}

    for pid in workers():
        with open(f"/proc/{pid}/clear_refs", "w") as f:
            f.write("5")  # its peak starts anew
    before = workers()
    pages = spark.range(2000, numPartitions=1).select(F.col("id").alias("page_id"), F.concat(F.lit("<title>A</title><p>"), F.repeat(F.lit("words "), 30_000)).alias("html"))
    assert H.read(pages).filter("title = 'A' and length(body) > 180000").count() == 2000
    assert max(mb - before.get(pid, 0) for pid, mb in workers().items()) < 500
