"""Extraction queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domains as D
from ..functions import dates as DT
from ..functions import text as X
from ..functions.layout import spread
from ..operators import extract as E
from ..sources import html_reader as H
from ..sources import tables as T
from .registry import query

_KIND = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p}', 'i') THEN '{k}'" for k, p in D.DATE_KINDS) + " END"
#: Sentences made of order dates and prices; DATE, ISO, AMOUNT and ID are filled in.
SENTENCES = [
    "Applications close DATE.",
    "Registration deadline: ISO.",
    "The programme begins on DATE.",
    "Results announced ISO.",
    "Founded in DATE.",
    "Applications are accepted on a rolling basis.",
    "Documents due 31 February 2001 and no other day.",
    "Interviews take place ISO!",
    "Nothing is said here; early bird deadline DATE.",
]
MORE = ["Open to students aged 14-18.", "For 16 to 18 year olds.", "Under 21 only.", "At least 16 years old.", "Established 1994.", "aged 18-14 is not a range."]
MONEY = ["The application fee is £AMOUNT.", "Programme cost: ₹AMOUNT per participant.", "A $AMOUNT prize.", "There is no application fee.", "The tuition is USD AMOUNT with bursaries.", "Fee waivers and bursaries exist.", "AMOUNT students"]
PLACE = ["It is held online.", "Residential, in person.", "A hybrid format.", "Online and on-campus.", "Somewhere."]
NEEDS = ["Send two letters of recommendation.", "Upload an academic transcript and a CV.", "A personal statement; transcripts again.", "A passport is needed.", "No cv at all.", "Fill the application form."]


def _texts(spark: SparkSession, d: str, parts: list[str], n: int) -> DataFrame:
    o = spread(T.load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_totalprice"))
    k = F.col("o_orderkey")
    date = F.concat(F.date_format("o_orderdate", "d"), F.lit(" "), F.date_format("o_orderdate", "MMMM"), F.lit(" "), F.date_format("o_orderdate", "yyyy"))
    pieces = [T.pick(parts, k * (i + 1) + i) for i in range(n)]
    t = F.array_join(F.array(*pieces), " ")
    for a, b in (("DATE", date), ("ISO", F.date_format("o_orderdate", "yyyy-MM-dd")), ("AMOUNT", F.floor("o_totalprice").cast("string"))):
        t = F.replace(t, F.lit(a), b)
    return o.select(k.alias("id"), t.alias("text"))


def _sql(parts: list[str], n: int) -> str:
    pieces = ", ".join(T._pick(parts, f"o_orderkey * {i + 1} + {i}") for i in range(n))
    return f"""WITH tx AS (SELECT o_orderkey AS id, replace(replace(replace(array_to_string([{pieces}], ' '), 'DATE', day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate)), 'ISO', strftime(o_orderdate, '%Y-%m-%d')), 'AMOUNT', floor(o_totalprice)::BIGINT::VARCHAR) AS text FROM orders),
se AS (SELECT id, pos::INT AS pos, trim(s) AS s FROM (SELECT id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT id, list_filter(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS l FROM tx)))
"""


@query(_sql(SENTENCES, 3) + "SELECT id, pos, s AS sentence FROM se")
def x13_sentences(spark: SparkSession, d: str) -> DataFrame:
    return E.split_rows(_texts(spark, d, SENTENCES, 3), "id")


@query(_sql(SENTENCES, 3) + f"SELECT id, pos, {_KIND} AS kind FROM se")
def t01_kind(spark: SparkSession, d: str) -> DataFrame:
    return E.split_rows(_texts(spark, d, SENTENCES, 3), "id").select("id", "pos", E.date_kind(F.col("sentence")).alias("kind"))


_ROLLING = f"regexp_matches(s, '{D.ROLLING}', 'i')"
_DATE = r"""coalesce(try_strptime(regexp_extract(s, '(\d{4}-\d{2}-\d{2})', 1), '%Y-%m-%d'), try_strptime(nullif(regexp_extract(s, '(\d{1,2} [A-Z][a-z]+ \d{4})', 1), ''), '%d %B %Y')) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE"""


@query(
    _sql(SENTENCES, 3)
    + f""", k AS (SELECT id, pos, {_ROLLING} AS is_rolling, CASE WHEN {_ROLLING} THEN coalesce({_KIND}, 'APPLICATION_DEADLINE') ELSE {_KIND} END AS kind,
  CASE WHEN {_ROLLING} THEN TIMESTAMP '1970-01-01' ELSE {_DATE} END AS date FROM se)
SELECT id, pos, kind, epoch(date)::BIGINT AS at, is_rolling FROM k WHERE kind IS NOT NULL AND date IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id, kind, date, is_rolling ORDER BY pos) = 1"""
)
def t02_dates(spark: SparkSession, d: str) -> DataFrame:
    rows = E.dates(E.split_rows(_texts(spark, d, SENTENCES, 3), "id"), "id")
    return rows.select("id", "pos", "kind", F.unix_seconds("date").alias("at"), "is_rolling")


@query(
    r"""WITH s AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN 'by ' || strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN monthname(o_orderdate) || ' ' || day(o_orderdate) || 'th, ' || year(o_orderdate)
  WHEN 3 THEN day(o_orderdate) || 'th ' || monthname(o_orderdate)[1:3] || ' ' || year(o_orderdate) WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y') ELSE '31 February ' || year(o_orderdate) END AS t, o_orderdate AS o FROM orders)
SELECT id, CASE WHEN id % 6 = 5 OR id % 6 IN (1, 4) AND day(o) <= 12 THEN NULL ELSE epoch(date_trunc('day', o) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE)::BIGINT END AS at FROM s"""
)
def d07_parse_date(spark: SparkSession, d: str) -> DataFrame:
    o, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    f = lambda p: F.date_format(o, p)
    t = (
        F.when(k == 0, f("yyyy-MM-dd")).when(k == 1, F.concat(F.lit("by "), f("dd/MM/yyyy"))).when(k == 2, F.concat(f("MMMM d"), F.lit("th, "), f("yyyy")))
        .when(k == 3, F.concat(f("d"), F.lit("th "), F.substring(f("MMMM"), 1, 3), F.lit(" "), f("yyyy"))).when(k == 4, f("MM/dd/yyyy")).otherwise(F.concat(F.lit("31 February "), f("yyyy")))
    )
    return T.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(DT.parse_date(t)["date"]).alias("at"))


def _age_sql() -> str:
    return (
        _sql(MORE, 1)
        + r"""SELECT id, CASE WHEN contains(text, 'aged 14-18') THEN 14 WHEN contains(text, '16 to 18') THEN 16 WHEN contains(text, 'At least 16') THEN 16 END::INT AS age_min,
  CASE WHEN contains(text, 'aged 14-18') OR contains(text, '16 to 18') THEN 18 WHEN contains(text, 'Under 21') THEN 20 END::INT AS age_max FROM tx"""
    )


@query(_age_sql())
def t03_age_range(spark: SparkSession, d: str) -> DataFrame:
    a = E.age_range(F.col("text"))
    return _texts(spark, d, MORE, 1).select("id", a["min"].alias("age_min"), a["max"].alias("age_max"))


@query(
    _sql(MONEY, 1)
    + f""", n AS (SELECT id, text, try_cast(replace(CASE WHEN regexp_matches(text, '{D.FEE_BEFORE}', 'i') THEN regexp_extract(text, '{D.FEE_BEFORE}', 2, 'i') ELSE regexp_extract(text, '{D.FEE_AFTER}', 2, 'i') END, ',', '') AS DOUBLE) AS priced,
  coalesce(nullif(regexp_extract(text, '{D.FEE_BEFORE}', 1, 'i'), ''), nullif(regexp_extract(text, '{D.FEE_AFTER}', 1, 'i'), '')) AS sign,
  regexp_extract(text, '{D.FEE_CODE}', 1) AS code, try_cast(replace(regexp_extract(text, '{D.FEE_CODE}', 2), ',', '') AS DOUBLE) AS coded,
  regexp_matches(text, '{D.AID}', 'i') AS aid, regexp_matches(text, '{D.FREE}', 'i') AS free FROM tx),
m AS (SELECT *, coded IS NOT NULL AND list_contains({T._list(D.CURRENCY_CODES)}, code) AS by_code FROM n)
SELECT id, CASE WHEN priced IS NOT NULL OR by_code THEN CASE WHEN aid THEN 'FREE_WITH_AID' ELSE 'PAID' END WHEN free THEN 'FREE' WHEN aid THEN 'FREE_WITH_AID' ELSE 'UNKNOWN' END AS cost_type,
  CASE WHEN priced IS NOT NULL THEN priced WHEN by_code THEN coded END AS amount,
  CASE WHEN priced IS NOT NULL THEN CASE sign {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in D.CURRENCY_SYMBOLS.items())} END WHEN by_code THEN code END AS currency FROM m"""
)
def t04_cost(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, MONEY, 1).select("id", E.cost(F.col("text")).alias("c")).select("id", "c.*")


@query(
    _sql(PLACE, 1)
    + f""", p AS (SELECT id, regexp_matches(text, '{D.HYBRID}', 'i') AS h, regexp_matches(text, '{D.IN_PERSON}', 'i') AS p, regexp_matches(text, '{D.ONLINE}', 'i') AS o FROM tx)
SELECT id, CASE WHEN h OR p AND o THEN 'HYBRID' WHEN p THEN 'IN_PERSON' WHEN o THEN 'ONLINE' ELSE 'UNKNOWN' END AS format FROM p"""
)
def t05_format(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, PLACE, 1).select("id", E.attendance(F.col("text")).alias("format"))


_REQ = " UNION ALL ".join(f"SELECT id, pos, {i} AS p, s, regexp_extract(s, '{p}', 0, '{'i' if c else 'c'}') AS m FROM se" for i, (p, c) in enumerate(D.REQUIREMENTS))


@query(_sql(NEEDS, 3) + f", m AS ({_REQ}), l AS (SELECT *, upper(lower(trim(m))[1]) || lower(trim(m))[2:] AS label FROM m WHERE m <> '') SELECT id, label, s AS raw_text FROM l QUALIFY row_number() OVER (PARTITION BY id, lower(label) ORDER BY pos, p) = 1")
def t06_requirements(spark: SparkSession, d: str) -> DataFrame:
    return E.requirements(E.split_rows(_texts(spark, d, NEEDS, 3), "id"), "id")


@query(r"""SELECT page_id, nullif(trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&(amp|lt|gt|quot)$', '&\1;'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'), '\s+', ' ', 'g')), '') AS title FROM pages""")
def t07_html_title(spark: SparkSession, d: str) -> DataFrame:
    """Titles of all pages; a reference that the title's end cuts off is one without its semicolon, if a whole name is left."""
    return H.facts(H.read(T.load(spark, d, "pages"))).select("page_id", "title")


@query()
def t07_html_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every page and what is missing; the parsing is tested against pages with known facts."""
    f = H.facts(H.read(T.load(spark, d, "pages")))
    missing = E.gaps(title=F.col("title"), summary=F.col("summary"), deadline=F.col("application_deadline"), cost=F.col("cost_type"), format=F.col("format"))
    return f.select("page_id", "title", "title_method", "summary", X.sha256(F.col("text")).alias("text_sha256"), "cost_type", "cost_amount", "format", F.array_join(missing, ",").alias("gaps"))


@query("SELECT conv_id, turn, length(text) >= 3 AS verbatim, contains(text, 'zz-not-there') AS other FROM conversations")
def x16_verbatim(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    quoted = F.upper(F.regexp_replace(t, " ", "  "))
    return T.load(spark, d, "conversations").select("conv_id", "turn", X.appears_verbatim(quoted, t).alias("verbatim"), X.appears_verbatim(F.lit("zz-not-there"), t).alias("other"))


_PAGE = "The River School offers a summer course by the sea. Applications close DATE. The application fee is £AMOUNT. It is open to students aged 14-18. Send two letters of recommendation. You receive a certificate and a place to stay. Lessons are held daily."


@query(
    f"""WITH p AS (SELECT o_orderkey AS id, o_orderkey AS k, epoch(date_trunc('day', o_orderdate) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE)::BIGINT AS day, floor(o_totalprice)::BIGINT AS price,
  CASE WHEN o_orderkey % 7 = 0 THEN 'Short page.' ELSE replace(replace('{_PAGE}', 'DATE', day(o_orderdate) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate)), 'AMOUNT', (floor(o_totalprice)::BIGINT)::VARCHAR) END AS text FROM orders),
a AS (SELECT *, length(text) >= 200 AS o FROM p)
SELECT id, CASE WHEN k % 2 = 0 THEN 'Known' WHEN o THEN 'a summer course' END AS title,
  CASE WHEN o AND k % 3 = 0 THEN 'THE RIVER  school' END AS organizer, CASE WHEN o AND k % 4 <> 3 THEN 'HYBRID' END AS format,
  CASE WHEN o AND k % 4 = 0 THEN day END AS deadline, CASE WHEN o AND k % 2 = 1 THEN 14 END AS age_min,
  CASE WHEN k % 11 = 0 THEN 'FREE' WHEN o AND k % 5 <> 2 THEN 'PAID' END AS cost_type, CASE WHEN k % 11 <> 0 AND o AND k % 5 <> 2 THEN price::DOUBLE END AS cost_amount,
  CASE WHEN o THEN 'two letters' ELSE '' END AS requirements, CASE WHEN o THEN 'a certificate' ELSE '' END AS benefits,
  CASE WHEN o THEN concat_ws(',', CASE WHEN k % 3 = 1 THEN 'organizer' END, CASE WHEN k % 4 IN (1, 2) THEN 'deadline' END, CASE WHEN k % 2 = 0 THEN 'age' END, CASE WHEN k % 11 <> 0 AND k % 5 = 2 THEN 'cost' END,
    'requirement: a passport,requirement: a passport,requirement: a passport,requirement: a passport,requirement: a passport,requirement: a passport,requirement: a passport,requirement: a passport,requirement: a passport,benefit: a prize') ELSE '' END AS rejected
FROM a"""
)
def t11_fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What a model's answer may add to a page: quoted words only, read again, lists up to their lengths."""
    k = F.col("id")
    texts = _texts(spark, d, [_PAGE], 1).select("id", F.when(k % 7 == 0, "Short page.").otherwise(F.col("text")).alias("text"))
    none = lambda t: F.lit(None).cast(t)
    empty = F.array().cast("array<string>")
    pages = texts.select("id", "text", F.when(k % 2 == 0, "Known").alias("title"), none("string").alias("summary"), none("string").alias("organizer"), none("string").alias("format"), none("timestamp").alias("deadline"), none("int").alias("age_min"), none("int").alias("age_max"), F.when(k % 11 == 0, "FREE").alias("cost_type"), none("double").alias("cost_amount"), none("string").alias("cost_currency"), empty.alias("requirements"))
    close, fee = F.regexp_extract("text", r"(Applications close [^.]*)", 1), F.regexp_extract("text", r"(application fee is [^.]*)", 1)
    many = F.concat(F.array_repeat(F.lit("a passport"), 9), F.array(F.lit("two letters"), F.lit("a certificate")))
    answers = texts.select(
        "id",
        F.lit(" a summer course ").alias("title"),
        none("string").alias("summary"),
        F.when(k % 3 == 0, "THE RIVER  school").when(k % 3 == 1, "Hill School").alias("organizer"),
        F.when(k % 4 == 3, "ELSEWHERE").otherwise("HYBRID").alias("format"),
        F.when(k % 4 == 0, close).when(k % 4 == 1, "Applications close soon").when(k % 4 == 2, fee).alias("deadline_text"),
        F.lit(14).alias("age_min"),
        F.lit(18).alias("age_max"),
        F.when(k % 2 == 1, "aged 14–18").otherwise("aged 10-12").alias("age_text"),
        F.when(k % 5 == 2, "the fee is £1 only").otherwise(fee).alias("cost_text"),
        many.alias("requirements"),
        F.array(F.lit("a certificate"), F.lit("a prize")).alias("benefits"),
    )
    f = E.fill_gaps(pages, answers, "id")
    return f.select("id", "title", "organizer", "format", F.unix_seconds("deadline").alias("deadline"), "age_min", "cost_type", "cost_amount", *[F.array_join(c, ",").alias(c) for c in ("requirements", "benefits", "rejected")])
