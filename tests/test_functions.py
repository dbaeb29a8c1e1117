"""Example values of text, date and extraction functions."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.functions import dates as DT
from marlstone.functions import text as X
from marlstone.functions import values as V
from marlstone.functions.patterns import first_match, matches
from marlstone.operators import checklist as C
from marlstone.operators import extract as E
from marlstone.sources import robots


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def check(spark, f, cases, kind="string"):
    assert column(spark, list(cases), f, kind) == list(cases.values())


def test_parse_date(spark):
    at = lambda y, m, d: datetime(y, m, d, 23, 59)
    cases = {
        "12 September 2026": at(2026, 9, 12),
        "September 12, 2026": at(2026, 9, 12),
        "2026-09-12": at(2026, 9, 12),
        "12th Sept 2026": at(2026, 9, 12),
        "09/12/2026": None,
        "01/02/2026": None,
        "25/09/2026": at(2026, 9, 25),
        "09/25/2026": at(2026, 9, 25),
        "31 February 2026": None,
        "2026-02-31": None,
        "12 September": None,
        "1 May 1850": None,
        "2026-02-31 or 3 March 2026": at(2026, 3, 3),
        "no date": None,
        "": None,
        None: None,
    }
    check(spark, lambda x: DT.parse_date(x)["date"], cases)
    assert column(spark, ["12 September", "May 5"], lambda x: DT.parse_date(x, F.lit(2027))["date"]) == [at(2027, 9, 12), at(2027, 5, 5)]
    assert column(spark, ["by 12th Sept 2026."], lambda x: DT.parse_date(x)["raw"]) == ["12th Sept 2026"]


def test_countdown_words(spark):
    now = F.lit("2026-03-01").cast("timestamp")
    days = lambda n: F.expr(f"timestamp'2026-03-01' + interval {n} days")
    row = spark.range(1).select(*[DT.countdown(F.lit("APPLICATION_DEADLINE"), DT.days_between(days(n), now)).alias(f"d{i}") for i, n in enumerate((0, 1, 5, 35, -2, -1, 70))]).first()
    assert list(row) == ["Due today", "Due tomorrow", "Due in 5 days", "Due in 5 weeks", "Closed 2 days ago", "Closed yesterday", "Due in 2 months"]
    row = spark.range(1).select(DT.countdown(F.lit("APPLICATION_OPENS"), DT.days_between(days(-2), now)), DT.band_label(F.lit("APPLICATION_OPENS"), F.lit(-2)), DT.band_label(F.lit("PROGRAM_END"), F.lit(-2)), DT.band_label(F.lit("APPLICATION_DEADLINE"), F.lit(-2))).first()
    assert list(row) == ["2 days ago", "Open now", "Already happened", "Closed"]


def test_age_on_a_leap_day(spark):
    born = F.lit("2008-02-29").cast("timestamp")
    row = spark.range(1).select(DT.age_on(born, F.lit("2026-02-28").cast("timestamp")), DT.age_on(born, F.lit("2026-03-01").cast("timestamp")), DT.age_at(F.lit("1800-01-01").cast("timestamp"), F.lit("2026-01-01").cast("timestamp"))).first()
    assert list(row) == [17, 18, None]


def test_date_kinds(spark):
    check(
        spark,
        E.date_kind,
        {
            "Application deadline: 1 May 2026": "APPLICATION_DEADLINE",
            "The programme starts on 1 May": "PROGRAM_START",
            "Results announced in June": "RESULT_DATE",
            "Interviews will be held in May": "INTERVIEW_WINDOW",
            "Founded in 1994 by two friends": None,
            "Early bird deadline, application deadline": "EARLY_DEADLINE",
        },
    )


def test_extracted_dates_of_a_page(spark):
    text = "Apply by 12 September 2026. The programme begins on 1 October 2026! Founded in 1994. Accepted on a rolling basis; apply by 12 September 2026."
    rows = E.split_rows(spark.createDataFrame([(1, text)], "id int, text string"), "id")
    got = [(r.kind, r.is_rolling) for r in E.dates(rows, "id").orderBy("pos").collect()]
    assert got == [("APPLICATION_DEADLINE", False), ("PROGRAM_START", False), ("APPLICATION_DEADLINE", True)]


def test_age_range(spark):
    got = column(spark, ["aged 14-18", "ages 13 to 17", "16-18 year olds", "under 18", "at least 16 years old", "4 week programme for 200 participants", "established 1994", "aged 18-14", None], E.age_range)
    assert [r and (r["min"], r["max"]) for r in got] == [(14, 18), (13, 17), (16, 18), (None, 17), (16, None), None, None, None, None]


def test_cost(spark):
    cases = ["The application fee is £20.", "Programme cost: ₹5,000 per participant", "$10,000 prize", "5,000 students", "no application fee", "free of charge", "Fee waivers and bursaries", "The fee is £250, and financial aid is available", "the fee: USD 30"]
    got = [tuple(r) for r in column(spark, cases, E.cost)]
    assert got == [("PAID", 20.0, "GBP"), ("PAID", 5000.0, "INR"), ("UNKNOWN", None, None), ("UNKNOWN", None, None), ("FREE", None, None), ("FREE", None, None), ("FREE_WITH_AID", None, None), ("FREE_WITH_AID", 250.0, "GBP"), ("PAID", 30.0, "USD")]


def test_attendance(spark):
    check(spark, E.attendance, {"held online": "ONLINE", "in person in Leeds": "IN_PERSON", "hybrid": "HYBRID", "online, then residential": "HYBRID", "in Leeds": "UNKNOWN"})


def test_requirement_kinds(spark):
    check(spark, C.classify_requirement, {"Two letters of recommendation": "RECOMMENDATION", "Upload your academic transcript": "TRANSCRIPT", "500-word personal statement": "ESSAY", "Pay the £20 application fee": "FEE", "Something unusual": "CUSTOM"})


def test_requirements_of_a_text(spark):
    rows = E.split_rows(spark.createDataFrame([(1, "Send a CV and essays. Essays again; a cv too.")], "id int, text string"), "id")
    assert sorted((r.label, r.raw_text) for r in E.requirements(rows, "id").collect()) == [("Cv", "Send a CV and essays."), ("Essays", "Send a CV and essays.")]


def test_word_edges_and_spaces(spark):
    assert column(spark, ["éfree entry", "carefree", "free of charge"], lambda x: matches(x, r"\bfree\b")) == [True, False, True]
    assert column(spark, ["free of charge", "x"], lambda x: first_match(x, r"free\s+of")) == ["free of", None]


def test_urls(spark):
    check(
        spark,
        X.canonical_url,
        {
            "https://www.a.edu/p/?utm_source=x&id=3#top": "https://a.edu/p?id=3",
            "HTTP://WWW.A.edu": "http://a.edu/",
            "https://a.edu:8080/x?b=2&a=1&b=1&ref=q": "https://a.edu:8080/x?a=1&b=2&b=1",
            "https://a.edu/?": "https://a.edu/",
            "not a url": "not a url",
            None: None,
        },
    )
    check(spark, X.host, {"https://www.Ex.org/a": "ex.org", "nothing": "", "http://u@x.org:80/": "x.org"})
    check(spark, X.source_tier, {"mit.edu": 3, "someorg.com": 2, "opportunitydesk.org": 1, "ox.ac.uk": 3, "nasa.gov": 3, "randomblog.com": 2})


def test_titles(spark):
    check(spark, X.normalise_title, {"Summer Research Programme 2026": "summer research programme", "A & B’s": "a and b s", "東京大学": ""})
    sim = lambda a, b: spark.range(1).select(X.dice(X.trigrams(X.normalise_title(F.lit(a))), X.trigrams(X.normalise_title(F.lit(b))))).first()[0]
    assert sim("Summer Programme", "Summer Program") > 0.85 and sim("Summer Programme", "Junior Chess Championship") < 0.3
    assert sim("東京大学", "北京大学") == 1.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="abc d19é", max_size=12), min_size=2, max_size=6))
def test_trigrams_against_a_model(spark, titles):
    def grams(s):
        p = f"  {s} "
        return {p[i : i + 3] for i in range(len(p) - 2)}

    got = [set(x) for x in column(spark, titles, lambda x: X.trigrams(X.normalise_title(x)))]
    normal = column(spark, titles, X.normalise_title)
    assert got == [grams(s) for s in normal]


def test_small_text_functions(spark):
    check(spark, X.title_case, {"  LETTERS of x": "Letters of x", "": ""})
    check(spark, X.lower_first, {"Essay One": "essay One", "": ""})
    check(spark, X.decode_entities, {"<strong>A</strong> &amp;lt; &quot;q&#39;": "A < \"q'"})
    check(spark, X.escape_ics, {"a,b;c\\d\ne": "a\\,b\\;c\\\\d\\ne"})
    check(spark, X.violates_claims, {"This will get you into Harvard": True, "Guarantees a place": True, "looks great on your college application": True, "This is essential for X": True, "Could help you explore": False})
    check(spark, X.sentences, {"One. Two! three;  four •five": ["One.", "Two!", "three;", "four", "•five"], "": []})
    assert column(spark, [100.0, 20.5], lambda x: X.cost_label(F.lit("PAID"), x, F.lit("GBP")), "double") == ["GBP 100", "GBP 20.5"]


def test_addresses(spark):
    check(
        spark,
        X.blocked_host,
        {
            "127.0.0.1": "LOOPBACK",
            "10.1.2.3": "PRIVATE",
            "172.31.0.1": "PRIVATE",
            "172.32.0.1": None,
            "169.254.169.254": "CLOUD_METADATA",
            "169.254.1.1": "LINK_LOCAL",
            "::1": "LOOPBACK",
            "::ffff:127.0.0.1": "LOOPBACK",
            "fd00::1": "UNIQUE_LOCAL",
            "fe80::1": "LINK_LOCAL",
            "8.8.8.8": None,
            "metadata.google.internal": "CLOUD_METADATA",
            "a.internal": "PRIVATE",
            "localhost.": "LOOPBACK",
            "example.org": None,
        },
    )


def test_robots(spark):
    body = "User-agent: *\nDisallow: /private\nAllow: /private/public\nCrawl-delay: 2\n"
    own = body + "User-agent: marlbot\nDisallow: /x\nCrawl-delay: 600\n"
    r = spark.range(1).select(robots.rules(F.lit(body), F.lit("marlbot")).alias("a"), robots.rules(F.lit(own), F.lit("marlbot")).alias("b"))
    row = r.select("a.delay_ms", F.col("b.delay_ms").alias("d2"), *[robots.allows(F.col(c), F.lit(p)) for c, p in (("a", "/private/thing"), ("a", "/private/public/page"), ("a", "/else"), ("b", "/private/thing"), ("b", "/x/y"))]).first()
    assert list(row) == [2000.0, 10000.0, False, True, True, True, False]


def test_json_values(spark):
    check(spark, V.string_list, {'["a","b"]': ["a", "b"], '["a",1]': None, "[]": [], "{}": None, "null": None, "bad{": None, None: None})
    check(spark, V.strings_only, {'["a",1,null,"b"]': ["a", "b"], "{}": [], "bad{": []})
    got = column(spark, ['{"min":14,"max":18}', '{"min":"14"}', '{"max":2.5}', "{}", "bad{"], V.bounds)
    assert [r and (r["min"], r["max"]) for r in got] == [(14.0, 18.0), None, (None, 2.5), None, None]


def test_edges_of_patterns_at_signs(spark):
    check(spark, lambda x: E.age_range(x)["min"], {"Open to those over 16+ years": None, "at least 16 years old": 16, "over 16+a": 16, "éaged 14-18": 14, "aaged 14-18": None})
    check(spark, E.date_kind, {"results announcedé": "RESULT_DATE", "results announced_": None, "xresults announced": None})
