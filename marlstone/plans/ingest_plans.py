"""Duplicate detection, provenance and table-change queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..domains import METHOD_CONFIDENCE, METHOD_RANK, NEVER_GENERATED_FIELDS
from ..functions import text as X
from ..operators import dedupe as K
from ..operators import dml
from ..operators import extract as E
from ..operators import provenance as P
from ..operators import search as S
from ..operators.ingest import ingest_in_order
from ..sources import tables as T
from ..sources.tables import ctes
from .registry import query
from .text_plans import GRAMS, TOKENS, norm_sql

_SUFFIX = ["Programme", "Prize 2026", "School for Young People", "Summer Camp", "Summer"]
_TITLE = f"p_name || ' ' || {T._pick(_SUFFIX, 'p_partkey')}"
REC = (
    f"WITH rec AS (SELECT p_partkey AS id, p_partkey AS pos, 'https://org' || (p_partkey % 50) || '.example/' || (p_partkey % 333) AS url, md5(p_type || (p_partkey % 90)) AS hash, {norm_sql(_TITLE)} AS norm, 'org' || (p_partkey % 50) AS org,\n"
    + "  CASE WHEN p_partkey % 4 <> 0 THEN (1999 + p_partkey % 3)::INT END AS cycle FROM part),\n"
    + f"tt AS (SELECT DISTINCT norm AS t FROM rec), tg AS MATERIALIZED (SELECT t, {GRAMS.format('t')} AS g, {TOKENS.format('t')} AS k FROM tt),\n"
    + "sim AS MATERIALIZED (SELECT a.t AS x, b.t AS y, greatest(2.0::DOUBLE * len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g)), CASE WHEN len(a.k) = 0 OR len(b.k) = 0 THEN 0 ELSE 0.95::DOUBLE * (len(list_intersect(a.k, b.k))::DOUBLE / least(len(a.k), len(b.k))) END) AS s FROM tg a, tg b),\n"
    + """cmp AS (SELECT i.id, c.pos AS corpus_pos, CASE WHEN i.url = c.url OR i.hash = c.hash THEN 1.0::DOUBLE ELSE s END AS similarity, CASE WHEN i.url = c.url OR i.hash = c.hash OR i.org = c.org AND s >= 0.9 THEN 'SAME' ELSE 'REVIEW' END AS verdict
  FROM rec i JOIN rec c ON i.id % 2 = 0 AND c.id % 2 = 1 AND (i.cycle = c.cycle OR i.cycle IS NULL OR c.cycle IS NULL) JOIN sim ON x = i.norm AND y = c.norm WHERE i.url = c.url OR i.hash = c.hash OR s >= 0.75)
"""
)


def _records(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("id"),
        k.alias("pos"),
        F.concat(F.lit("https://org"), (k % 50).cast("string"), F.lit(".example/"), (k % 333).cast("string")).alias("url"),
        F.md5(F.concat("p_type", (k % 90).cast("string"))).alias("hash"),
        F.concat("p_name", F.lit(" "), T.pick(_SUFFIX, k)).alias("title"),
        F.concat(F.lit("org"), (k % 50).cast("string")).alias("org"),
        F.when(k % 4 != 0, (1999 + k % 3).cast("int")).alias("cycle"),
    )


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = _records(spark, d)
    return r.filter("id % 2 = 0"), r.filter("id % 2 = 1")


@query(REC + "SELECT x AS a, y AS b, round(s, 9) AS similarity FROM sim WHERE x < y AND s >= 0.75")
def k01_similar_titles(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of distinct titles that reach the review threshold."""
    titles = _records(spark, d).select(X.normalise_title(F.col("title")).alias("title"))
    return K.similar_titles(titles).select("a", "b", F.round("similarity", 9).alias("similarity"))


@query(REC + "SELECT id, corpus_pos, round(similarity, 9) AS similarity, verdict FROM cmp QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, corpus_pos, verdict DESC) = 1")
def k02_best_match(spark: SparkSession, d: str) -> DataFrame:
    return K.find_duplicate(*_halves(spark, d)).select("id", "corpus_pos", F.round("similarity", 9).alias("similarity"), "verdict")


@query(
    REC
    + """, b AS (SELECT id, min(corpus_pos) FILTER (WHERE verdict = 'SAME') AS merge_into, bool_or(verdict = 'REVIEW') AS near FROM cmp GROUP BY id)
SELECT id, merge_into, CASE WHEN merge_into IS NOT NULL THEN 'merged' WHEN near THEN 'review' ELSE 'created' END AS status FROM rec LEFT JOIN b USING (id) WHERE id % 2 = 0"""
)
def k03_ingest(spark: SparkSession, d: str) -> DataFrame:
    return K.first_same(*_halves(spark, d))


@query(
    REC
    + """, b AS (SELECT id, min(corpus_pos) FILTER (WHERE verdict = 'SAME') AS merge_into, bool_or(verdict = 'REVIEW') AS near FROM cmp GROUP BY id)
SELECT CASE WHEN merge_into IS NOT NULL THEN 'merged' WHEN near THEN 'review' ELSE 'created' END AS status, count(*)::BIGINT AS n FROM rec LEFT JOIN b USING (id) WHERE id % 2 = 0 GROUP BY 1"""
)
def a15_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return K.first_same(*_halves(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query(
    REC
    + """, m AS (SELECT i.id, min(c.pos) AS merge_into FROM rec i JOIN rec c ON c.pos < i.pos AND (i.cycle = c.cycle OR i.cycle IS NULL OR c.cycle IS NULL) JOIN sim ON x = i.norm AND y = c.norm
  WHERE i.url = c.url OR i.hash = c.hash OR i.org = c.org AND s >= 0.9 GROUP BY i.id)
SELECT id, merge_into FROM rec LEFT JOIN m USING (id)"""
)
def k05_batch(spark: SparkSession, d: str) -> DataFrame:
    return K.batch_representatives(_records(spark, d))


@query()
def k05_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The whole batch in order, each record against what earlier ones have become; every fifth is a listing already."""
    return ingest_in_order(_records(spark, d), F.col("id") % 5 == 0)[0]


@query("SELECT sha256(text) AS hash, min(doc_id) AS first_id, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def k_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "documents").groupBy(X.sha256(F.col("text")).alias("hash")).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))


METHODS = list(METHOD_RANK)
FIELDS = ["title", "applicationDeadline", "costAmount", "eligibility.age", "summary"]


def _map_sql(values: dict, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


_NH = "(m = 'AI_EXTRACTED' AND (" + " OR ".join(f"f = '{x}' OR starts_with(f, '{x}.')" for x in NEVER_GENERATED_FIELDS) + "))"


@query(f"WITH e AS (SELECT event_id, {T._pick(METHODS, 'event_id')} AS m, {T._pick(FIELDS, 'event_id // 7')} AS f FROM events) SELECT event_id, m AS method, f AS field, {_map_sql(METHOD_CONFIDENCE, 'm')} AS confidence, {_NH} AS needs_human FROM e")
def v01_confidence(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").select("event_id", T.pick(METHODS, F.col("event_id")).alias("method"), T.pick(FIELDS, F.floor(F.col("event_id") / 7)).alias("field"))
    return e.withColumns({"confidence": P.confidence(F.col("method")), "needs_human": P.needs_human(F.col("field"), F.col("method"))})


V04 = f"""WITH e AS (SELECT event_id // 20 AS id, {T._pick(FIELDS, 'event_id')} AS field, 'v' || (event_id % 3) AS value, {T._pick(METHODS, 'event_id * 3')} AS method, floor(epoch(ts))::BIGINT AS tm, event_id % 20 AS n FROM events),
o AS (SELECT * FROM e WHERE n < 4), i AS (SELECT id, field, 'v' || (tm % 2) AS value, method, tm FROM e WHERE n BETWEEN 5 AND 9 AND field <> 'summary'),
j AS (SELECT coalesce(o.id, i.id) AS id, coalesce(o.field, i.field) AS field, o.id IS NOT NULL AS old, i.id IS NOT NULL AS new, o.value AS ov, i.value AS iv, o.method AS om, i.method AS im, o.tm AS oa, i.tm AS ia,
  {_map_sql(METHOD_RANK, 'i.method')} > {_map_sql(METHOD_RANK, 'o.method')} AS better FROM o FULL JOIN i ON o.id = i.id AND o.field = i.field)
"""


def _provenance(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    e = T.load(spark, d, "events").select(F.floor(k / 20).alias("id"), T.pick(FIELDS, k).alias("field"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("value"), T.pick(METHODS, k * 3).alias("method"), F.unix_seconds("ts").alias("at"), (k % 20).alias("n"))
    new = e.filter("n between 5 and 9 and field <> 'summary'").withColumn("value", F.concat(F.lit("v"), (F.col("at") % 2).cast("string"))).drop("n")
    return P.merge(e.filter("n < 4").drop("n"), new)


@query(V04 + "SELECT id, field, CASE WHEN new AND (NOT old OR better) THEN iv ELSE ov END AS value, CASE WHEN new AND (NOT old OR better) THEN im ELSE om END AS method, CASE WHEN new AND (NOT old OR better) OR old AND new AND ov = iv THEN ia ELSE oa END AS \"at\", old AND new AND ov <> iv AS conflict FROM j")
def v04_merge(spark: SparkSession, d: str) -> DataFrame:
    return _provenance(spark, d)


@query(V04 + "SELECT id, count(*) FILTER (WHERE old AND new AND ov <> iv)::BIGINT AS conflicts FROM j GROUP BY id")
def v_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return _provenance(spark, d).groupBy("id").agg(F.count_if("conflict").alias("conflicts"))


_OBSERVED = f"""WITH o AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 7 ELSE event_id % 40 END AS id, {T._pick(FIELDS, 'event_id // 40')} AS field, 'v' || (event_id // 7 % 3) AS v, {T._pick(METHODS, 'event_id * 5 // 3')} AS m, ts FROM events),
r AS (SELECT *, {_map_sql(METHOD_RANK, 'm')} AS rank FROM o),
b AS (SELECT *, rank > coalesce(max(rank) OVER (PARTITION BY id, field ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS takes FROM r),
c AS (SELECT *, count(*) FILTER (WHERE takes) OVER (PARTITION BY id, field ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS turn FROM b),
d AS (SELECT *, first_value(v) OVER w AS cv, first_value(m) OVER w AS cm FROM c WINDOW w AS (PARTITION BY id, field, turn ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
e AS (SELECT *, lag(cv) OVER (PARTITION BY id, field ORDER BY ts, event_id) AS was, lag(event_id) OVER (PARTITION BY id, field ORDER BY ts, event_id) IS NOT NULL AS known, max(turn) OVER (PARTITION BY id, field) AS last FROM d)
SELECT id, field, any_value(cv) FILTER (WHERE turn = last) AS value, any_value(cm) FILTER (WHERE turn = last) AS method, epoch_us(max(ts) FILTER (WHERE turn = last AND v = cv)) AS "at",
  count(*) FILTER (WHERE known AND was <> v)::BIGINT AS conflicts, count(*)::BIGINT AS n FROM e GROUP BY id, field"""


@query(_OBSERVED)
def v04_history(spark: SparkSession, d: str) -> DataFrame:
    """Fields after any number of observations; a third of them are of one record."""
    k = F.col("event_id")
    e = T.load(spark, d, "events").select(F.when(k % 3 == 0, 7).otherwise(k % 40).cast("long").alias("id"), T.pick(FIELDS, F.floor(k / 40)).alias("field"), F.concat(F.lit("v"), (F.floor(k / 7) % 3).cast("string")).alias("value"), T.pick(METHODS, F.floor(k * 5 / 3)).alias("method"), F.col("ts").alias("at"), k.alias("seq"))
    return P.merge_history(e).withColumn("at", F.unix_micros("at"))


@query(
    f"""WITH e AS (SELECT event_id, event_id % 2 = 0 AS t, event_id % 3 <> 0 AS dl, {T._pick(METHODS, 'event_id')} AS tm, {T._pick(METHODS, 'event_id + event_id % 2')} AS dm, event_id % 5 < 2 AS off FROM events)
SELECT event_id, CASE WHEN dm = 'AI_EXTRACTED' THEN 'NEEDS_REVIEW' WHEN off AND tm = 'STRUCTURED_MARKUP' AND dm = 'STRUCTURED_MARKUP' THEN 'RECENTLY_VERIFIED' WHEN NOT dl OR NOT t THEN 'UNVERIFIED' WHEN off THEN 'RECENTLY_VERIFIED' ELSE 'NEEDS_REVIEW' END AS state FROM e"""
)
def k04_state(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    tm, dm = T.pick(METHODS, k), T.pick(METHODS, k + k % 2)
    human = P.needs_human(F.lit("applicationDeadline"), dm)
    return T.load(spark, d, "events").select("event_id", K.verification_state(k % 2 == 0, k % 3 != 0, tm, dm, k % 5 < 2, human).alias("state"))


# -------------------------------------------------------------- table changes


@query(
    """WITH c AS (SELECT user_id, event_type, event_id, value FROM events WHERE event_id % 2 = 1), t AS (SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
l AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1)
SELECT * FROM l UNION ALL SELECT t.* FROM t WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.user_id = t.user_id AND l.event_type = t.event_type)"""
)
def u10_upsert(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    table = e.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    return dml.upsert(table, e.filter("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query("SELECT event_id, CASE WHEN event_type = 'view' THEN 0.0 ELSE value END AS value FROM events")
def u11_update_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.update_where(T.load(spark, d, "events"), F.col("event_type") == "view", {"value": F.lit(0.0)}).select("event_id", "value")


@query("SELECT event_id FROM events WHERE NOT coalesce(value > 50, false)")
def u12_delete_where(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete_where(T.load(spark, d, "events"), F.col("value") > 50).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 1::INT, 0.0::DOUBLE FROM orders WHERE o_orderstatus = 'P'")
def u13_replace_children(spark: SparkSession, d: str) -> DataFrame:
    li = T.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    parents = T.load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return dml.replace_children(li, parents, parents.select("l_orderkey", F.lit(1).alias("l_linenumber"), F.lit(0.0).alias("l_quantity")), "l_orderkey")


_GONE = "c_custkey % 10 = 3"


def _erased(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    users = T.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"))
    orders = T.load(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), "o_orderkey")
    queries = T.load(spark, d, "events").select("user_id", "event_id")
    return dml.erase_users(users.filter("user_id % 10 = 3"), {"orders": orders}, queries, users)


@query(f"SELECT c_custkey AS user_id, CASE WHEN NOT {_GONE} THEN c_name END AS name, {_GONE} AS deleted FROM customer")
def u16_erase_users(spark: SparkSession, d: str) -> DataFrame:
    return _erased(spark, d)["users"]


@query(f"SELECT CASE WHEN user_id NOT IN (SELECT c_custkey FROM customer WHERE {_GONE}) THEN user_id END AS user_id, event_id FROM events")
def u16_erase_queries(spark: SparkSession, d: str) -> DataFrame:
    return _erased(spark, d)["queries"]


@query(f"SELECT o_custkey AS user_id, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE {_GONE})")
def u18_cascade(spark: SparkSession, d: str) -> DataFrame:
    return _erased(spark, d)["orders"]


# --------------------------------------------------------- nested loads, joins


@query("SELECT c_custkey AS user_id, count(o_orderkey)::BIGINT AS n, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderdate, o_orderkey), '') AS children, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, n_name")
def s02_nested_load(spark: SparkSession, d: str) -> DataFrame:
    """Parents with their ordered children: children are gathered per parent before the join."""
    c, n, o = (T.load(spark, d, t) for t in ("customer", "nation", "orders"))
    kids = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: x["o_orderkey"].cast("string")), ",").alias("children"))
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(kids, "c_custkey", "left")
    return out.select(F.col("c_custkey").alias("user_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("children", F.lit("")).alias("children"), F.col("n_name").alias("parent"))


@query("SELECT o_orderkey AS app_id, p_name AS title, l_linenumber AS task_no FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_orderstatus = 'O'")
def j08_applications(spark: SparkSession, d: str) -> DataFrame:
    o, li, p = (T.load(spark, d, t) for t in ("orders", "lineitem", "part"))
    rows = o.filter("o_orderstatus = 'O'").join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(p, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.col("o_orderkey").alias("app_id"), F.col("p_name").alias("title"), F.col("l_linenumber").alias("task_no"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def j06_semi(spark: SparkSession, d: str) -> DataFrame:
    o = T.load(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return T.load(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j07_anti(spark: SparkSession, d: str) -> DataFrame:
    o = T.load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return T.load(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT a.p_partkey AS opp_id, b.p_partkey AS superseded_by FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 100 AND b.p_brand = a.p_brand")
def j12_supersedes(spark: SparkSession, d: str) -> DataFrame:
    p = T.load(spark, d, "part").select("p_partkey", "p_brand")
    next_ = p.select((F.col("p_partkey") - 100).alias("k"), "p_brand", F.col("p_partkey").alias("superseded_by"))
    return p.withColumnRenamed("p_partkey", "k").join(next_, ["k", "p_brand"]).select(F.col("k").alias("opp_id"), "superseded_by")


@query("SELECT user_id, event_id, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3")
def w08_latest_k(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return T.load(spark, d, "events").withColumn("place", F.row_number().over(w)).filter("place <= 3").select("user_id", "event_id", "place")


@query(ctes("dl") + "SELECT opp_id, deadline_id, kind FROM dl QUALIFY row_number() OVER (PARTITION BY opp_id, kind, date::DATE ORDER BY deadline_id) = 1")
def t08_one_per_day(spark: SparkSession, d: str) -> DataFrame:
    return E.one_per_day(T.deadlines(spark, d), "opp_id", "deadline_id").select("opp_id", "deadline_id", "kind")


@query(ctes("opps") + ", n AS (SELECT opp_id FROM opps ORDER BY updated_at DESC, opp_id LIMIT 500) SELECT o_custkey AS opp_id, o_orderkey AS source_id FROM orders WHERE o_custkey IN (SELECT opp_id FROM n) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def o03_corpus_window(spark: SparkSession, d: str) -> DataFrame:
    """At most five sources of each of the 500 newest listings."""
    newest = T.opportunities(spark, d).orderBy(F.desc("updated_at"), "opp_id").limit(500).select("opp_id")
    sources = T.load(spark, d, "orders").select(F.col("o_custkey").alias("opp_id"), F.col("o_orderkey").alias("source_id"))
    return dml.top_per_key(sources.join(newest, "opp_id", "left_semi"), "opp_id", [F.col("source_id")], 5)


def _decided(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = T.opportunities(spark, d).select("opp_id", "state")
    yes = F.col("opp_id") % 2 == 0
    made = o.filter("state = 'NEEDS_REVIEW'").select("opp_id", F.lit("ADMIN").alias("actor"), F.when(yes, "APPROVED").otherwise("REJECTED").alias("action"), F.when(yes, "VERIFIED").otherwise("ARCHIVED").alias("new_state"), F.concat(F.lit("Looked at "), F.col("opp_id").cast("string")).alias("note"))
    return dml.decide(o, made, "opp_id")


@query(ctes("opps") + "SELECT opp_id, CASE WHEN state <> 'NEEDS_REVIEW' THEN state WHEN opp_id % 2 = 0 THEN 'VERIFIED' ELSE 'ARCHIVED' END AS state FROM opps")
def h15_decisions(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[0]


@query(ctes("opps") + "SELECT opp_id, 'ADMIN' AS actor, CASE WHEN opp_id % 2 = 0 THEN 'APPROVED' ELSE 'REJECTED' END AS action, 'Looked at ' || opp_id AS note FROM opps WHERE state = 'NEEDS_REVIEW'")
def h15_audit(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d)[1]


@query("SELECT event_id, p_partkey AS opp_id, p_name AS title FROM events JOIN part ON p_partkey = event_id % 250 WHERE event_type = 'error'")
def j09_reports(spark: SparkSession, d: str) -> DataFrame:
    e = T.load(spark, d, "events").filter("event_type = 'error'").select("event_id", (F.col("event_id") % 250).alias("opp_id"))
    return e.join(T.load(spark, d, "part").select(F.col("p_partkey").alias("opp_id"), F.col("p_name").alias("title")), "opp_id")


@query("SELECT e.event_id, c.c_custkey AS user_id FROM events e JOIN customer c ON sha256('t' || (e.event_id % 400)) = sha256('t' || c.c_custkey)")
def j11_token_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Presented tokens meet stored hashes; the tokens themselves are never stored."""
    stored = T.load(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), X.sha256(F.concat(F.lit("t"), F.col("c_custkey").cast("string"))).alias("hash"))
    shown = T.load(spark, d, "events").select("event_id", X.sha256(F.concat(F.lit("t"), (F.col("event_id") % 400).cast("string"))).alias("hash"))
    return shown.join(stored, "hash").select("event_id", "user_id")


@query("SELECT doc_id, substr(text, 1, 300) AS title, substr(text, 1, 1200) AS summary FROM documents")
def p04_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Lengths at which stored titles and summaries end."""
    return T.load(spark, d, "documents").select("doc_id", F.substring("text", 1, 300).alias("title"), F.substring("text", 1, 1200).alias("summary"))


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def a14_distinct_kinds(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


# ------------------------------------------------- scoped and nested changes


def _tasks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tasks, applications, changes): every fourth change is of a task that isn't the student's."""
    li = T.load(spark, d, "lineitem").filter("l_linenumber <= 3")
    key = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id")
    even = F.col("l_linenumber") == 2
    tasks = li.select(key, F.col("l_orderkey").alias("app_id"), even.alias("is_complete"), F.when(even, F.lit("1999-01-01").cast("timestamp")).alias("completed_at")).dropDuplicates(["task_id"])
    apps = T.load(spark, d, "orders").select(F.col("o_orderkey").alias("app_id"), F.col("o_custkey").alias("user_id"))
    asked = tasks.filter("task_id % 3 = 0").join(apps, "app_id")
    user = F.when(F.col("task_id") % 4 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    changes = asked.select(user.alias("user_id"), "task_id", (F.col("task_id") % 2 == 0).alias("complete"), T.now().alias("at"))
    return tasks, apps, changes


@query(f"""WITH t AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS task_id, l_orderkey AS app_id, l_linenumber = 2 AS done FROM lineitem WHERE l_linenumber <= 3)
SELECT task_id, CASE WHEN task_id % 3 = 0 AND task_id % 4 <> 0 AND o_orderkey IS NOT NULL THEN task_id % 2 = 0 ELSE done END AS is_complete,
  CASE WHEN task_id % 3 = 0 AND task_id % 4 <> 0 AND o_orderkey IS NOT NULL THEN CASE WHEN task_id % 2 = 0 THEN epoch(TIMESTAMP '{T.NOW}')::BIGINT END WHEN done THEN epoch(TIMESTAMP '1999-01-01')::BIGINT END AS completed_at
FROM t LEFT JOIN orders ON o_orderkey = app_id""")
def f16_own_tasks(spark: SparkSession, d: str) -> DataFrame:
    """Ticks reach a task only through an application of the same student."""
    return dml.toggle_tasks(*_tasks(spark, d)).select("task_id", "is_complete", F.unix_seconds("completed_at").alias("completed_at"))


@query(ctes("opps") + """SELECT 'parent' AS part, opp_id, NULL::INT AS pos, title AS value FROM opps
UNION ALL SELECT 'tag', opp_id, unnest(range(len(tags)))::INT, unnest(list_transform(tags, lambda t: t.slug)) FROM opps
UNION ALL SELECT 'category', opp_id, unnest(range(len(categories)))::INT, unnest(categories) FROM opps""")
def u14_nested_create(spark: SparkSession, d: str) -> DataFrame:
    """The tables that nested records are written to, here one below the other."""
    o = T.opportunities(spark, d).select("opp_id", "title", "tags", "categories")
    made = dml.nested_create(o, "opp_id", {"tags": "tags", "categories": "categories"})
    row = lambda part, df, pos, value: df.select(F.lit(part).alias("part"), "opp_id", pos.alias("pos"), F.col(value).alias("value"))
    return row("parent", made["parents"], F.lit(None).cast("int"), "title").unionByName(row("tag", made["tags"], F.col("pos"), "slug")).unionByName(row("category", made["categories"], F.col("pos"), "value"))


@query("SELECT event_id FROM events WHERE event_id % 5 IN (1, 3)")
def f13_by_method(spark: SparkSession, d: str) -> DataFrame:
    method = F.when(F.col("event_id") % 5 == 1, "AI_EXTRACTED").otherwise("AI_EXTRACTED_BY_HAND")
    stored = F.when(F.col("event_id") % 5 == 3, F.lit('{"title":{"method":"ADMIN_ENTERED"},"cost":{"method":"AI_EXTRACTED"}}')).otherwise(F.concat(F.lit('{"title":{"method":"'), method, F.lit('"}}')))
    rows = T.load(spark, d, "events").select("event_id", stored.alias("provenance"))
    return S.with_method(rows, "provenance", "AI_EXTRACTED").select("event_id")


@query("SELECT page_id, url FROM pages ORDER BY page_id LIMIT 8")
def o08_first_pages(spark: SparkSession, d: str) -> DataFrame:
    """The pages of one run."""
    return T.load(spark, d, "pages").select("page_id", "url").orderBy("page_id").limit(8)


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&quot;'), chr(39), '&#39;') AS shown FROM pages")
def x17_escape_html(spark: SparkSession, d: str) -> DataFrame:
    return T.load(spark, d, "pages").select("page_id", X.escape_html(F.col("html")).alias("shown"))
