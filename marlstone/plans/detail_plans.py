"""Queries of the smaller functions: references, hosts, numbers, gaps, provenance maps, logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates as DT
from ..functions import text as X
from ..functions.layout import shared_folder
from ..operators import extract as E
from ..operators import provenance as P
from ..operators import temporal as TM
from ..sources import html_reader as H
from ..sources import keyed
from ..sources import sinks
from ..sources import tables as T
from ..sources.tables import ctes
from .registry import query


@query(
    """SELECT conv_id, turn, replace(replace(replace(replace(replace(replace(replace(replace(replace(t, '<strong>', ''), '</STRONG>', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&nbsp;', ' ') AS decoded
FROM (SELECT *, CASE turn % 3 WHEN 0 THEN '<strong>' || text || '</STRONG> &amp;lt;b&gt;' WHEN 1 THEN text || ' &quot;a&#x27;b&#39;&nbsp;c&quot;' ELSE text END AS t FROM conversations)"""
)
def x11_decode_entities(spark: SparkSession, d: str) -> DataFrame:
    """Search-hit markup; a reference that another one spells is decoded too, in the fixed order."""
    c, t = T.load(spark, d, "conversations"), F.col("text")
    marked = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<strong>"), t, F.lit("</STRONG> &amp;lt;b&gt;"))).when(F.col("turn") % 3 == 1, F.concat(t, F.lit(" &quot;a&#x27;b&#39;&nbsp;c&quot;"))).otherwise(t)
    return c.select("conv_id", "turn", X.decode_entities(marked).alias("decoded"))


@query("SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'site' || (o_orderkey % 50) || '.example' WHEN 1 THEN 'a.b' || (o_orderkey % 7) || '.org' ELSE 'Unknown organiser' END AS host FROM orders")
def x23_host_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    url = (
        F.when(k % 4 == 0, F.concat(F.lit("https://www.SITE"), k % 50, F.lit(".example:8080/path?q=1#x")))
        .when(k % 4 == 1, F.concat(F.lit("http://user:pw@A.b"), k % 7, F.lit(".org")))
        .when(k % 4 == 2, F.concat(F.lit("no url "), k))
    )
    return T.load(spark, d, "orders").select(k.alias("id"), X.host_label(F.coalesce(url, F.lit(""))).alias("host"))


@query("SELECT o_orderkey AS id, epoch(o_orderdate::TIMESTAMP + INTERVAL 14 DAY)::BIGINT AS expires FROM orders")
def d10_consent_expiry(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.unix_seconds(TM.consent_expiry(F.col("o_orderdate").cast("timestamp"))).alias("expires"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 0.5 WHEN o_orderkey % 7 = 1 THEN 1000000 + o_orderkey % 1000 WHEN o_orderkey % 7 = 2 THEN -(o_orderkey % 100) WHEN o_orderkey % 7 = 3 THEN 0 END::DOUBLE AS number FROM orders")
def n04_number(spark: SparkSession, d: str) -> DataFrame:
    """Numbers between words, with separators, signs and fractions; two numbers, words and nothing are no number."""
    k = F.col("o_orderkey")
    text = (
        F.when(k % 7 == 0, F.concat(F.lit("GBP "), k, F.lit(".50 a term"))).when(k % 7 == 1, F.concat(F.lit("$1,000,"), F.lpad((k % 1000).cast("string"), 3, "0")))
        .when(k % 7 == 2, F.concat(F.lit(" -"), k % 100)).when(k % 7 == 3, "0").when(k % 7 == 4, "contact us").when(k % 7 == 5, "").otherwise(F.concat(F.lit("from 10 to "), k))
    )
    return T.load(spark, d, "orders").select(k.alias("id"), H.number(text).alias("number"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name FROM customer")
def n05_non_blank(spark: SparkSession, d: str) -> DataFrame:
    k, name = F.col("c_custkey"), F.col("c_name")
    return T.load(spark, d, "customer").select(k.alias("id"), X.non_blank(F.when(k % 3 == 0, " \t\n").when(k % 3 == 1, F.concat(F.lit(" \n"), name, F.lit("\t")))
                                                                               .otherwise(name)).alias("name"))


_MODES = ["https://schema.org/OnlineEventAttendanceMode", "MixedEventAttendanceMode", "OfflineEventAttendanceMode", "blended learning", "On campus", "in-person", "onsite", "Hybrid: online and in person", "ONLINE"]
_READ = ["ONLINE", "HYBRID", "IN_PERSON", "HYBRID", None, "IN_PERSON", "IN_PERSON", "HYBRID", "ONLINE"]


@query("SELECT p_partkey AS id, CASE p_partkey % 9 " + " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(_READ) if r) + " END AS format FROM part")
def t09_attendance_mode(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "part").select(F.col("p_partkey").alias("id"), H.attendance_mode(T.pick(_MODES, F.col("p_partkey"))).alias("format"))


_FACTS = {"title": 2, "summary": 3, "organizer": 5, "deadline": 7, "age": 11, "cost": 13, "format": 17, "requirements": 19}


@query("SELECT o_orderkey AS id, concat_ws(',', " + ", ".join(f"CASE WHEN o_orderkey % {m} = 0 THEN '{n}' END" for n, m in _FACTS.items()) + ") AS gaps FROM orders")
def t10_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What a page does not say, of eight facts, in their order."""
    k = F.col("o_orderkey")
    return T.load(spark, d, "orders").select(k.alias("id"), F.array_join(E.gaps(**{n: F.when(k % m != 0, F.lit("said")) for n, m in _FACTS.items()}), ",").alias("gaps"))


_KINDS = ["APPLICATION_DEADLINE", "RESULT_DATE", "PROGRAM_START", "PROGRAM_END"]


@query(
    f"""WITH m AS (SELECT o_custkey AS page, {T._pick(_KINDS, 'o_orderkey')} AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0),
t AS (SELECT o_custkey AS page, {T._pick(_KINDS, 'o_orderkey // 5')} AS kind, o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0)
SELECT *, 'markup' AS method FROM m UNION ALL SELECT *, 'text' FROM t WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.page = t.page AND m.kind = t.kind)"""
)
def u04_markup_first(spark: SparkSession, d: str) -> DataFrame:
    """Dates of the markup, and of the text those whose kind the page's markup has none of."""
    k, o = F.col("o_orderkey"), T.load(spark, d, "orders")
    kind = lambda i: T.pick(_KINDS, i).alias("kind")
    markup = o.filter(k % 3 == 0).select(F.col("o_custkey").alias("page"), kind(k), k.alias("id"))
    text = o.filter(k % 3 != 0).select(F.col("o_custkey").alias("page"), kind(F.floor(k / 5)), k.alias("id"))
    return E.markup_first(markup.withColumn("method", F.lit("markup")), text.withColumn("method", F.lit("text")), "page")


@query("SELECT p_partkey AS id, to_json([p_name, NULL, p_type || '\"' || chr(10) || '\\'])::VARCHAR AS list, to_json({'size': p_size, 'name': p_brand})::VARCHAR AS record FROM part")
def s11_json_text(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part")
    texts = F.array("p_name", F.lit(None), F.concat("p_type", F.lit('"\n\\')))
    return p.select(F.col("p_partkey").alias("id"), sinks.json_text(texts).alias("list"), sinks.json_text(F.struct(F.col("p_size").alias("size"), F.col("p_brand").alias("name"))).alias("record"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n, count(DISTINCT event_id)::BIGINT AS events FROM (SELECT * FROM events UNION ALL SELECT * FROM events WHERE event_type = 'error') GROUP BY 1")
def s12_append_log(spark: SparkSession, d: str) -> DataFrame:
    """A log that is appended to twice, in folders by day, and read again."""
    e, path = T.load(spark, d, "events").select("event_id", "ts", "event_type"), f"{shared_folder(spark)}/log-{uuid.uuid4().hex}"
    sinks.append_log(e, path, "ts")
    sinks.append_log(e.filter("event_type = 'error'"), path, "ts")
    return spark.read.parquet(path).groupBy(F.date_format("day", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


@query(
    """SELECT o_orderkey AS id, 'title' AS field, 'LABELLED_PAGE_TEXT' AS method FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
SELECT o_orderkey, 'applicationDeadline', 'STRUCTURED_MARKUP' FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, 'eligibility', 'AI_EXTRACTED' FROM orders WHERE o_orderkey % 5 = 1"""
)
def p03_provenance_map(spark: SparkSession, d: str) -> DataFrame:
    """Where each field comes from, of the fields that have a value."""
    k = F.col("o_orderkey")
    by = lambda m: F.struct(F.lit(m).alias("method"))
    fields = P.provenance_map(title=(F.when(k % 2 == 0, "t"), by("LABELLED_PAGE_TEXT")), applicationDeadline=(F.when(k % 3 != 0, F.col("o_orderdate").cast("string")), by("STRUCTURED_MARKUP")), eligibility=(F.when(k % 5 == 1, k), by("AI_EXTRACTED")))
    return T.load(spark, d, "orders").select(k.alias("id"), F.explode(fields).alias("field", "p")).select("id", "field", "p.method")


@query(ctes("opps") + "SELECT opp_id, state FROM opps WHERE state <> 'EXPIRED' AND state <> 'ARCHIVED'")
def f11_open_states(spark: SparkSession, d: str) -> DataFrame:
    return T.opportunities(spark, d).filter(~F.col("state").isin("EXPIRED", "ARCHIVED")).select("opp_id", "state")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 OR strftime(o_orderdate, '%m-%d') = '02-29' THEN NULL ELSE epoch(make_timestamp(2026, month(o_orderdate), day(o_orderdate), 23, 59, 0))::BIGINT END AS at FROM orders")
def d07_reference_year(spark: SparkSession, d: str) -> DataFrame:
    """Dates without a year, read in a given one; what does not exist in it is none."""
    k, o = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 3 == 0, F.concat(F.lit("until "), F.date_format(o, "d MMMM"), F.lit(" at noon"))).when(k % 3 == 1, F.concat(F.date_format(o, "MMMM d"), F.lit("th"))).otherwise("31 April")
    return T.load(spark, d, "orders").select(k.alias("id"), F.unix_seconds(DT.parse_date(text, F.lit(2026))["date"]).alias("at"))


_NORMAL = "trim(regexp_replace(translate(lower({}), '‘’“”\"–—', '''''''''''--'), '\\s+', ' ', 'g'))"


@query(
    f"""WITH q AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN translate(text[3:22], 'abcdefghij', 'ABCDEFGHIJ') WHEN 1 THEN replace(text[3:22], ' ', '   ') WHEN 2 THEN reverse(text[3:22]) ELSE text[1:2] END AS needle FROM conversations)
SELECT conv_id, turn, length({_NORMAL.format('needle')}) >= 3 AND contains({_NORMAL.format('text')}, {_NORMAL.format('needle')}) AS verbatim FROM q"""
)
def x16_quotations(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a text in other case, spacing, backwards, and too short."""
    t, k = F.col("text"), F.col("turn") % 4
    part = F.substring(t, 3, 20)
    needle = F.when(k == 0, F.translate(part, "abcdefghij", "ABCDEFGHIJ")).when(k == 1, F.replace(part, F.lit(" "), F.lit("   "))).when(k == 2, F.reverse(part)).otherwise(F.substring(t, 1, 2))
    return T.load(spark, d, "conversations").select("conv_id", "turn", X.appears_verbatim(needle, t).alias("verbatim"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey IN (1, 7, 64, 999, 1500, 3001, 0)")
def s05_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A few orders by key, from a table that is laid out for it."""
    name = f"orders_{uuid.uuid4().hex}"
    keyed.write_keyed(T.load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), name, "o_orderkey", f"{shared_folder(spark)}/{name}", buckets=16)
    return keyed.lookup(spark, name, "o_orderkey", [1, 7, 64, 999, 1500, 3001, 0, None, 7])


_AGES = "SELECT o_orderkey AS id, o_orderkey % 5 AS form, 3 + o_orderkey % 20 AS a, 5 + o_orderkey // 7 % 25 AS b FROM orders"


@query(
    f"""WITH o AS ({_AGES}), f AS (SELECT *, a >= 5 AND a <= b AS ranged FROM o)
SELECT id, CASE WHEN form IN (0, 1) AND ranged THEN a WHEN form = 3 AND a >= 5 THEN a WHEN form = 4 AND ranged THEN a END::INT AS age_min,
  CASE WHEN form IN (0, 1) AND ranged THEN b WHEN form = 2 AND a >= 5 THEN a - 1 WHEN form = 4 AND ranged THEN b WHEN form = 4 THEN 17 END::INT AS age_max FROM f"""
)
def t03_ages(spark: SparkSession, d: str) -> DataFrame:
    """Ages of many forms and values; a range that can't be one gives way to the next form."""
    k = F.col("o_orderkey")
    a, b = (3 + k % 20).cast("string"), (5 + F.floor(k / 7) % 25).cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Open to students aged "), a, F.lit("-"), b, F.lit(".")))
        .when(k % 5 == 1, F.concat(F.lit("It is for "), a, F.lit(" to "), b, F.lit(" year olds.")))
        .when(k % 5 == 2, F.concat(F.lit("Under "), a, F.lit(" only.")))
        .when(k % 5 == 3, F.concat(F.lit("At least "), a, F.lit(" years old.")))
        .otherwise(F.concat(F.lit("Once for students aged "), a, F.lit("-"), b, F.lit(", now for all under 18.")))
    )
    ages = E.age_range(text)
    return T.load(spark, d, "orders").select(k.alias("id"), ages["min"].alias("age_min"), ages["max"].alias("age_max"))
