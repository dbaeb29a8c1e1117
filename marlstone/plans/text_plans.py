"""Text, URL and label queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import domains as D
from ..functions import dates as DT
from ..functions import text as X
from ..functions import values as V
from ..operators import search as S
from ..operators import temporal as TM
from ..sources import robots
from ..sources import tables as T
from ..sources.tables import NOW
from .registry import query

NORM = r"""trim(regexp_replace(regexp_replace(regexp_replace(replace(translate(lower(@), '‘’“”', ''''''''''), '&', ' and '), '[^a-z0-9\s]', ' ', 'g'), '\b(19|20)\d{2}\b', ' ', 'g'), '\s+', ' ', 'g'))"""


def norm_sql(x: str) -> str:
    return NORM.replace("@", x)


STOP = "[" + ", ".join(f"'{w}'" for w in D.TITLE_STOPWORDS) + "]"
TOKENS = "list_sort(list_distinct(list_filter(string_split({0}, ' '), lambda w: len(w) > 2 AND NOT list_contains(" + STOP + ", w))))"
GRAMS = "list_sort(list_distinct(list_transform(range(1, len({0}) + 2), lambda i: substr('  ' || {0} || ' ', i, 3))))"
TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _titles(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "pages").select("page_id", X.normalise_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("norm"))


@query(f"SELECT page_id, {norm_sql(TITLE)} AS norm FROM pages")
def x04_normalise_title(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d)


@query(f"WITH n AS (SELECT page_id, {norm_sql(TITLE)} AS norm FROM pages) SELECT page_id, array_to_string({TOKENS.format('norm')}, ' ') AS tokens FROM n")
def x05_title_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _titles(spark, d).select("page_id", F.array_join(F.array_sort(X.title_tokens(F.col("norm"))), " ").alias("tokens"))




def _two(x: str, y: str) -> str:
    return f"WITH n AS (SELECT page_id, {norm_sql(TITLE)} AS a, {norm_sql('url')} AS b FROM pages), g AS (SELECT page_id, {x} AS x, {y} AS y FROM n)\n"



@query(_two(GRAMS.format("a"), GRAMS.format("b")) + "SELECT page_id, round(2.0::DOUBLE * len(list_intersect(x, y)) / (len(x) + len(y)), 9) AS similarity FROM g")
def x06_trigram_dice(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "pages").select("page_id", X.normalise_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("a"), X.normalise_title(F.col("url")).alias("b"))
    return p.select("page_id", F.round(X.dice(X.trigrams(F.col("a")), X.trigrams(F.col("b"))), 9).alias("similarity"))


@query(_two(TOKENS.format("a"), TOKENS.format("a || ' ' || b")) + "SELECT page_id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE round(len(list_intersect(x, y))::DOUBLE / least(len(x), len(y)), 9) END AS overlap FROM g")
def x07_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "pages").select("page_id", X.normalise_title(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("a"), X.normalise_title(F.col("url")).alias("b"))
    both = F.concat("a", F.lit(" "), "b")
    return p.select("page_id", F.round(X.overlap(X.title_tokens(F.col("a")), X.title_tokens(both)), 9).alias("overlap"))


HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\.', '')"
CANON = (
    r"""lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || """
    + HOST
    + r""" || regexp_replace(CASE WHEN regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) END, '^(.+)/$', '\1')
  || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(split_part(p, '=', 1), '^(utm_.*|fbclid|gclid|mc_[ce]id|ref|source)$', 'i'))), '&'), ''), '')"""
)


@query(f"SELECT page_id, {CANON} AS canonical FROM pages")
def x08_canonical_url(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT page_id, {HOST} AS domain FROM pages")
def x09_domain(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "pages").select("page_id", X.host(F.col("url")).alias("domain"))


DOMAINS = ["mit.edu", "ox.ac.uk", "nasa.gov", "opportunitydesk.org", "someorg.com", "x.edu.au", "who.int", "youthop.com", "gob.mx", "a.gob.mx"]
_DOM = T._pick(DOMAINS, "event_id")
TIER = f"CASE WHEN dom IN ({', '.join(repr(a) for a in D.AGGREGATORS)}) THEN 1 WHEN regexp_matches(dom, '" + "|".join(D.OFFICIAL_SUFFIXES) + "', 'i') THEN 3 ELSE 2 END::INT"


@query(f"WITH e AS (SELECT event_id, {_DOM} AS dom FROM events) SELECT event_id, dom, {TIER} AS tier FROM e")
def x10_source_tier(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").select("event_id", T.pick(DOMAINS, F.col("event_id")).alias("dom"))
    return e.select("event_id", "dom", X.source_tier(F.col("dom")).alias("tier"))


@query(f"WITH e AS (SELECT user_id, event_id AS pos, {_DOM} AS dom FROM events) SELECT user_id, pos, row_number() OVER (PARTITION BY user_id ORDER BY {TIER} DESC, pos)::INT AS place FROM e")
def w02_tier_rank(spark: SparkSession, d: str) -> DataFrame:
    """Better sources first; within a tier the provider's order stays."""
    e = T.load(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), X.source_tier(T.pick(DOMAINS, F.col("event_id"))).alias("tier"))
    return e.select("user_id", "pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("tier"), "pos")).alias("place"))


@query(f"SELECT page_id, {CANON} AS canonical FROM pages QUALIFY row_number() OVER (PARTITION BY {CANON} ORDER BY page_id) = 1")
def w03_first_per_url(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "pages").select("page_id", X.canonical_url(F.col("url")).alias("canonical"))
    return p.groupBy("canonical").agg(F.min("page_id").alias("page_id"))


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def x12_content_hash(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "documents").select("doc_id", X.sha256(F.col("text")).alias("hash"))


_IP = "((event_id * 2654435761) % 4294967296)"
_RANGES = " ".join(f"WHEN v BETWEEN {sum(int(x) << (24 - 8 * i) for i, x in enumerate(b.split('.')))} AND {sum(int(x) << (24 - 8 * i) for i, x in enumerate(b.split('.'))) + (1 << (32 - n)) - 1} THEN '{r}'" for b, n, r in D.BLOCKED_RANGES)


@query(f"WITH e AS (SELECT event_id, {_IP}::BIGINT AS v FROM events), a AS (SELECT event_id, v, (v >> 24) || '.' || ((v >> 16) & 255) || '.' || ((v >> 8) & 255) || '.' || (v & 255) AS address FROM e) SELECT event_id, address, CASE {_RANGES} END AS reason FROM a")
def x19_blocked_address(spark: SparkSession, d: str) -> DataFrame:
    v = (F.col("event_id") * F.lit(2654435761)) % F.lit(4294967296)
    octet = lambda s: F.shiftright(v, s).bitwiseAND(255).cast("string")
    address = F.concat_ws(".", *[octet(s) for s in (24, 16, 8, 0)])
    return T.load(spark, d, "events").select("event_id", address.alias("address")).withColumn("reason", X.blocked_reason(F.col("address")))


@query(r"SELECT p_partkey, substr(regexp_replace(trim(lower(p_name || ' (' || p_type || ')'), ' ()'), '[ ()]+', '-', 'g'), 1, 60) || '-' || substr(md5(p_name), 1, 6) AS slug FROM part")
def x01_slugify(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part")
    return p.select("p_partkey", X.slugify(F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")), F.md5("p_name")).alias("slug"))


EMAILS = ["", "parent@example.org", " Parent@Example.org ", "nobody", "a b@c.de", "student@example.org"]


@query(
    f"""WITH c AS (SELECT c_custkey AS user_id, {T._pick(EMAILS, 'c_custkey')} AS p FROM customer), v AS (SELECT user_id, lower(trim(p)) AS v FROM c)
SELECT user_id, CASE WHEN v = '' THEN 'Enter an email address for your parent or guardian.' WHEN NOT regexp_matches(v, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]{{2,}}$') THEN 'That does not look like an email address.'
  WHEN v = 'student@example.org' THEN 'That is your own address. Consent has to come from your parent or guardian.' END AS problem FROM v"""
)
def x20_parent_email(spark: SparkSession, d: str) -> DataFrame:
    c = T.load(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), X.parent_email_problem(T.pick(EMAILS, F.col("c_custkey")), F.lit("Student@example.org")).alias("problem"))


@query("SELECT o_orderkey, replace(day(o_orderdate) || ' ' || monthname(o_orderdate)[1:3] || ' ' || year(o_orderdate), 'Sep ', 'Sept ') AS shown FROM orders")
def x22_display_date(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "orders").select("o_orderkey", DT.display_date(F.col("o_orderdate")).alias("shown"))


@query(r"SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type || ' & ' || p_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, replace(p_name, ' ', '_') AS raw, replace(p_name, '_', ' ') AS humanised FROM part")
def x02_slug(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part")
    raw = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    return p.select("p_partkey", X.slug_ascii(F.concat("p_type", F.lit(" & "), "p_name")).alias("slug"), raw.alias("raw"), X.humanise(raw).alias("humanised"))


@query(
    r"""WITH e AS (SELECT event_id, ['{"min":14,"max":18}', '{"min":"14"}', '["a","b"]', '["a",1]', '[]', 'true', 'null', '{"max":2.5}', 'broken{'][event_id % 9 + 1] AS v FROM events),
j AS (SELECT event_id, v, CASE WHEN json_valid(v) THEN v END AS g FROM e)
SELECT event_id, CASE WHEN json_type(g, '$.min') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (g ->> '$.min')::DOUBLE END AS low, CASE WHEN json_type(g, '$.max') IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (g ->> '$.max')::DOUBLE END AS high,
  CASE WHEN v = '["a","b"]' THEN 'a,b' WHEN v = '[]' THEN '' END AS items, CASE WHEN v = '["a","b"]' THEN 'a,b' WHEN v = '["a",1]' THEN 'a' ELSE '' END AS strings, v = 'true' AS flag FROM j"""
)
def n_decode_json(spark: SparkSession, d: str) -> DataFrame:
    v = T.pick(['{"min":14,"max":18}', '{"min":"14"}', '["a","b"]', '["a",1]', "[]", "true", "null", '{"max":2.5}', "broken{"], F.col("event_id"))
    e = T.load(spark, d, "events").select("event_id", v.alias("v"))
    c = F.col("v")
    return e.select("event_id", V.number_field(c, "min").alias("low"), V.number_field(c, "max").alias("high"), F.array_join(V.string_list(c), ",").alias("items"), F.array_join(V.strings_only(c), ",").alias("strings"), V.is_true(c).alias("flag"))


BORN = "TIMESTAMP '1975-02-27' + to_days((c_custkey * 37 % 9000)::INT)"


@query(f"WITH c AS (SELECT c_custkey AS user_id, {BORN} AS b FROM customer) SELECT user_id, (2000 - year(b) - (strftime(b, '%m%d') > '0115')::INT)::INT AS age FROM c")
def d06_age(spark: SparkSession, d: str) -> DataFrame:
    return _born(spark, d).select("user_id", DT.age_on(F.col("born"), T.now()).alias("age"))


def _born(spark: SparkSession, d: str) -> DataFrame:
    born = F.lit("1975-02-27").cast("timestamp") + F.make_dt_interval(days=(F.col("c_custkey") * 37 % 9000).cast("int"))
    country = T.pick(["FR", "de", "US", None], F.col("c_custkey"))
    e = F.lit("2000-01-10").cast("timestamp") + F.make_dt_interval(days=(F.col("c_custkey") % 11).cast("int"))
    k = F.col("c_custkey")
    return T.load(spark, d, "customer").select(k.alias("user_id"), born.alias("born"), country.alias("country"), F.when(k % 3 == 0, T.now()).alias("granted_at"), F.when(k % 7 == 0, T.now()).alias("revoked_at"), F.when(k % 5 != 0, e).alias("expires_at"))


AGES = (
    f"WITH c0 AS (SELECT c_custkey AS user_id, {BORN} AS b, {T._pick(['FR', 'de', 'US', None], 'c_custkey')} AS country, c_custkey % 3 = 0 AS granted, c_custkey % 7 = 0 AS revoked, CASE WHEN c_custkey % 5 <> 0 THEN TIMESTAMP '2000-01-10' + to_days((c_custkey % 11)::INT) END AS expires FROM customer),\n"
    + "c1 AS (SELECT *, 2000 - year(b) - (strftime(b, '%m%d') > '0115')::INT AS age FROM c0),\n"
    + f"c AS (SELECT *, CASE WHEN age < 13 THEN 'TOO_YOUNG' WHEN country IN ('FR', 'de') AND age < 16 THEN 'NEEDS_PARENTAL_CONSENT' ELSE 'ALLOWED' END AS verdict, CASE WHEN expires IS NULL THEN 'NONE' WHEN revoked THEN 'REVOKED' WHEN granted THEN 'GRANTED' WHEN expires <= TIMESTAMP '{NOW}' THEN 'EXPIRED' ELSE 'PENDING' END AS status FROM c1)\n"
)


def _consent(spark: SparkSession, d: str) -> DataFrame:
    c = _born(spark, d)
    return c.withColumn("verdict", TM.assess_age(F.col("born"), F.col("country"), T.now())).withColumn("status", TM.consent_status(F.col("granted_at"), F.col("revoked_at"), F.col("expires_at"), T.now()))


@query(AGES + "SELECT user_id, verdict FROM c")
def h10_assess_age(spark: SparkSession, d: str) -> DataFrame:
    return _consent(spark, d).select("user_id", "verdict")


@query(AGES + "SELECT user_id, status FROM c")
def h11_consent_status(spark: SparkSession, d: str) -> DataFrame:
    return _consent(spark, d).select("user_id", "status")


@query(AGES + "SELECT user_id, CASE verdict WHEN 'ALLOWED' THEN true WHEN 'TOO_YOUNG' THEN false ELSE status = 'GRANTED' END AS usable FROM c")
def h12_usable(spark: SparkSession, d: str) -> DataFrame:
    return _consent(spark, d).select("user_id", TM.account_usable(F.col("verdict"), F.col("status")).alias("usable"))


@query(AGES + f"SELECT user_id, CASE WHEN expires IS NULL THEN 'NOT_FOUND' WHEN granted OR revoked THEN 'ALREADY_SETTLED' WHEN expires <= TIMESTAMP '{NOW}' THEN 'EXPIRED' WHEN user_id % 2 = 0 THEN 'GRANTED' ELSE 'DECLINED' END AS outcome FROM c")
def h13_settle(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    out = TM.settle_consent(c("expires_at").isNotNull(), c("granted_at"), c("revoked_at"), c("expires_at"), c("user_id") % 2 == 0, T.now())
    return _consent(spark, d).select("user_id", out.alias("outcome"))


@query("WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Prize ' || year(o_orderdate) ELSE 'Prize' END AS t, CASE WHEN o_orderkey % 3 = 1 THEN 'https://x.org/2001/' || year(o_orderdate) ELSE 'https://x.org/' END AS u FROM orders) SELECT o_orderkey, list_max(list_filter(list_transform(list_concat(regexp_extract_all(t, '\\b(20\\d{2})\\b', 1), regexp_extract_all(u, '\\b(20\\d{2})\\b', 1)), lambda x: x::INT), lambda y: y BETWEEN 1999 AND 2003)) AS cycle FROM o")
def d13_cycle_year(spark: SparkSession, d: str) -> DataFrame:
    y, k = F.date_format("o_orderdate", "yyyy"), F.col("o_orderkey")
    t = F.when(k % 3 == 0, F.concat(F.lit("Prize "), y)).otherwise("Prize")
    u = F.when(k % 3 == 1, F.concat(F.lit("https://x.org/2001/"), y)).otherwise("https://x.org/")
    return T.load(spark, d, "orders").select("o_orderkey", DT.cycle_year(t, u, F.lit(2000)).alias("cycle"))


@query("SELECT event_id, CASE WHEN m < 60 THEN m || CASE WHEN m = 1 THEN ' minute ago' ELSE ' minutes ago' END ELSE floor(m / 60 + 0.5)::BIGINT || CASE WHEN floor(m / 60 + 0.5) = 1 THEN ' hour ago' ELSE ' hours ago' END END AS ago FROM (SELECT event_id, floor((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts)) / 60000000 + 0.5)::BIGINT AS m FROM events)")
def d11_relative_time(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "events").select("event_id", DT.relative_time(F.col("ts"), T.events_now()).alias("ago"))


# ------------------------------------------------------------------ sentences

ASKED = [
    "Free STEM programmes for 16-year-olds in India",
    "MUNs in Mumbai during September",
    "scholarships for aeronautics enthusiasts",
    "online research internships in the UK closing soon",
    "high school maths olympiad, fully funded, this month",
    "undergraduate law debate in-person Germany aged 20",
    "essay contests",
    "zoology",
]


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """What each student's sentence asks for; a sentence is parsed once, however many students say it."""
    said = T.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), T.pick(ASKED, F.col("c_custkey")).alias("q"))
    # As many tasks as cores: a sentence is much work and its row a few bytes. A generator, so that what reads a filter doesn't parse again.
    f = S.parse_query(F.col("q"))
    rows = said.select("q").distinct().repartition(spark.sparkContext.defaultParallelism).select("q", F.inline(F.array(F.struct(*[c.alias(n) for n, c in f.items()]))))
    rows = rows.select("*", F.explode(F.array(S.residual_keywords(F.col("q"), F.col("categories"), F.col("subjects"), F.col("country")))).alias("keywords"))
    return said.join(rows.withColumnRenamed("q", "q_"), F.col("q").eqNullSafe(F.col("q_"))).drop("q_")


def _in_sql(terms: list[tuple[str, str]], text: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches({text}, '{p}', 'i') THEN '{s}' END" for s, p in terms) + "], lambda x: x IS NOT NULL)"


PARSED = f"""WITH a AS (SELECT c_custkey AS user_id, {T._pick(ASKED, 'c_custkey')} AS q FROM customer),
p AS (SELECT user_id, q, {_in_sql(D.CATEGORY_TERMS, 'q')} AS cats, {_in_sql(D.SUBJECT_TERMS, 'q')} AS subs, ({_in_sql(D.COUNTRY_TERMS, 'q')})[1] AS country,
  CASE WHEN regexp_matches(q, '\\bfree\\b|\\bno (?:entry |application )?fee\\b|\\bfully funded\\b|\\bno cost\\b', 'i') THEN true END AS cost_free,
  CASE WHEN regexp_matches(q, '\\bonline\\b|\\bvirtual\\b|\\bremote\\b', 'i') THEN 'ONLINE' WHEN regexp_matches(q, '\\bin[-\\s]person\\b|\\bon[-\\s]?campus\\b|\\bresidential\\b', 'i') THEN 'IN_PERSON' END AS format,
  CASE WHEN contains(q, '16-year') THEN 16 WHEN contains(q, 'aged 20') THEN 20 END::INT AS age,
  CASE WHEN contains(q, 'high school') THEN 'SENIOR_SECONDARY' WHEN contains(q, 'undergraduate') THEN 'UNDERGRAD' END AS level,
  CASE WHEN contains(q, 'September') THEN 9 END::INT AS month, CASE WHEN contains(q, 'closing soon') THEN 7 WHEN contains(q, 'this month') THEN 30 END::INT AS within_days FROM a)
"""


@query(PARSED + "SELECT user_id, array_to_string(cats, ',') AS categories, array_to_string(subs, ',') AS subjects, country, cost_free, format, age, level AS education_level, month, within_days FROM p")
def q01_parse_query(spark: SparkSession, d: str) -> DataFrame:
    a = _asked(spark, d)
    return a.select("user_id", F.array_join("categories", ",").alias("categories"), F.array_join("subjects", ",").alias("subjects"), "country", "cost_free", "format", "age", "education_level", "month", "within_days")


@query()
def q02_keywords(spark: SparkSession, d: str) -> DataFrame:
    """Words that no term used up; tested against expected words of each sentence."""
    return _asked(spark, d).select("user_id", F.array_join("keywords", " ").alias("keywords"))


@query()
def q03_chips(spark: SparkSession, d: str) -> DataFrame:
    return S.chips(_asked(spark, d), "user_id")


@query()
def q04_plan(spark: SparkSession, d: str) -> DataFrame:
    """At most four provider queries a student; tested against expected queries of each sentence."""
    p = T.profiles(spark, d).select("user_id", F.col("age").alias("profile_age"), F.col("country_code").alias("profile_country"), F.col("education_level").alias("profile_level"), F.transform("interests", lambda i: i["slug"]).alias("profile_interests"))
    return _asked(spark, d).join(p, "user_id").select("user_id", F.posexplode(S.plan_queries(2000)).alias("pos", "query"))


ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/public\nCrawl-delay: 600\n\nUser-agent: marlbot\nDisallow: /en/*\nCrawl-delay: 2 # slow\n"


@query(f"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages) SELECT page_id, NOT starts_with(path, '/en/') AS own, NOT starts_with(path, '/private') OR starts_with(path, '/private/public') AS others FROM p")
def s09_robots(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    p = T.load(spark, d, "pages").select("page_id", path.alias("path"), robots.rules(F.lit(ROBOTS), F.lit("marlbot")).alias("own"), robots.rules(F.lit(ROBOTS), F.lit("otherbot")).alias("others"))
    return p.select("page_id", robots.allows(F.col("own"), F.col("path")).alias("own"), robots.allows(F.col("others"), F.col("path")).alias("others"))
