"""Domain-shaped tables read from the star schema by deterministic expressions.

Each function has its twin in `CTES` as DuckDB SQL, so a query and its oracle
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The injected clock of order-based and of event-based data.
NOW, EVENTS_NOW = "2000-01-15 00:00:00", "2024-01-31 00:00:00"

TOPICS = ["molecular-biology", "physics", "history", "computer-science", "law", "economics", "medicine", "arts"]
CATEGORIES = ["research", "competition", "mun", "volunteering", "hackathon", "course"]
ACHIEVEMENTS = ["COMPETITION", "PUBLICATION", "PROJECT", "LEADERSHIP", "SERVICE", "CERTIFICATION", "SPORT", "ARTS"]
LEVELS = ["SCHOOL", "REGIONAL", "NATIONAL", "INTERNATIONAL"]


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def events_now() -> Column:
    return F.lit(EVENTS_NOW).cast("timestamp")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, with zone-free timestamps taken as UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})


def pick(values: list[str | None], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values)).cast("int"))


def profiles(spark: SparkSession, sf_dir: str, customers: DataFrame | None = None) -> DataFrame:
    c = load(spark, sf_dir, "customer") if customers is None else customers
    k = F.col("c_custkey")
    interest = lambda x: F.struct(pick(TOPICS, x).alias("slug"), (x % 5 + 1).cast("int").alias("strength"), F.lit("SUBJECT").alias("kind"))
    deed = lambda i: F.struct(pick(ACHIEVEMENTS, k + i * (k % 3)).alias("kind"), pick(LEVELS, k + i).alias("level"), F.array(pick(TOPICS, k + i)).alias("tag_slugs"), F.concat(F.lit("Activity "), i.cast("string")).alias("title"))
    n = (k % 6).cast("int")
    return c.select(
        k.alias("user_id"),
        F.when(k % 17 != 0, (13 + k % 10).cast("int")).alias("age"),
        F.when(k % 13 != 0, (6 + k % 8).cast("int")).alias("grade"),
        pick(["MIDDLE", "SECONDARY", "SENIOR_SECONDARY", "UNDERGRAD", "GAP_YEAR", None], k).alias("education_level"),
        F.when(k % 19 != 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("country_code"),
        F.concat(F.lit("City"), (k % 5).cast("string")).alias("city"),
        pick(["CBSE", "IB", "A_LEVELS", "UNKNOWN", None], k).alias("curriculum"),
        F.slice(F.array(F.lit("en"), F.lit("fr")), 1, (k % 3).cast("int")).alias("languages"),
        pick(["ONLINE", "IN_PERSON", "HYBRID", "ANY"], k).alias("format_preference"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("budget_ceiling"),
        pick(["GBP", "USD", None], k).alias("budget_currency"),
        F.when(k % 4 == 0, F.lit("2000-02-01").cast("timestamp")).alias("available_from"),
        F.when(k % 4 == 0, F.lit("2000-12-31").cast("timestamp")).alias("available_until"),
        F.when(k % 7 == 0, F.slice(F.array(interest(k)), 1, 0)).otherwise(F.array(interest(k), interest(k + 3))).alias("interests"),
        F.when(k % 5 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(CATEGORIES, k))).alias("career_directions"),
        F.transform(F.slice(F.sequence(F.lit(0), F.lit(5)), 1, n), deed).alias("achievements"),
    )


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part")
    k = F.col("p_partkey")
    tag = lambda x, w, kind: F.struct(pick(TOPICS, x).alias("slug"), F.lit(w).alias("weight"), F.lit(kind).alias("kind"))
    return p.select(
        k.alias("opp_id"),
        F.concat("p_name", F.lit(" "), pick(["Programme", "Prize", "School"], k)).alias("title"),
        F.col("p_type").alias("summary"),
        pick(["ONLINE", "IN_PERSON", "HYBRID", "UNKNOWN"], k).alias("format"),
        F.when(k % 11 != 0, F.concat(F.lit("N"), (k % 25).cast("string"))).alias("location_country"),
        F.concat(F.lit("City"), (k % 5).cast("string")).alias("location_city"),
        pick(["FREE", "PAID", "FREE_WITH_AID", "UNKNOWN", "PAID"], k).alias("cost_type"),
        F.when(k % 9 != 0, F.col("p_retailprice")).alias("cost_amount"),
        pick(["GBP", "USD"], k).alias("cost_currency"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("aid_available"),
        F.when(k % 10 != 0, F.col("p_size")).alias("duration_days"),
        F.when(k % 8 == 0, F.slice(F.array(tag(k, 1.0, "SUBJECT")), 1, 0)).otherwise(F.array(tag(k, 1.0, "SUBJECT"), tag(k + 1, 0.5, "INTEREST"), tag(k + 2, 0.5, "CAREER_FIELD"))).alias("tags"),
        F.when(k % 12 == 0, F.array().cast("array<string>")).otherwise(F.array(pick(CATEGORIES, k), pick(CATEGORIES, k + 2))).alias("categories"),
        pick(["VERIFIED", "RECENTLY_VERIFIED", "NEEDS_REVIEW", "UNVERIFIED", "EXPIRED", "ARCHIVED", "VERIFIED", "VERIFIED"], k).alias("state"),
        (F.lit("2000-01-01").cast("timestamp") - F.make_dt_interval(mins=(k * 7919 % 100000).cast("int"))).alias("updated_at"),
        (F.lit("1999-01-01").cast("timestamp") + F.make_dt_interval(mins=(k * 104729 % 200000).cast("int"))).alias("first_seen_at"),
        (k % 8).cast("int").alias("n_requirements"),
        F.when(k % 6 == 0, F.array(F.lit("Certificate of participation"))).otherwise(F.array().cast("array<string>")).alias("stated_benefits"),
    )


RULE_VALUES = [
    ("AGE", "BETWEEN", '{"min":14,"max":18}'),
    ("GRADE", "IN", '["9","10","11"]'),
    ("EDUCATION_LEVEL", "NOT_IN", '["GAP_YEAR","MIDDLE"]'),
    ("COUNTRY", "IN", '["N1","n2 ","N3","N4","N5","N6","N7","N8"]'),
    ("RESIDENCY", "NOT_IN", '["N9"]'),
    ("CURRICULUM", "IN", '["IB","CBSE"]'),
    ("LANGUAGE", "IN", '["fr"]'),
    ("SUBJECT_BACKGROUND", "IN", '["physics","law"]'),
    ("PRIOR_EXPERIENCE", "REQUIRES", '{"kinds":["PROJECT","COMPETITION"],"tagSlugs":["law"]}'),
    ("SCHOOL_ENROLMENT", "REQUIRES", "true"),
    ("GENDER", "EQUALS", '"F"'),
    ("AGE", "GTE", '{"min":15}'),
    ("AGE", "FREE_TEXT", '{"min":99}'),
    ("GRADE", "BETWEEN", '{"max":12}'),
    ("CITIZENSHIP", "IN", '["N1",2]'),
    ("AGE", "BETWEEN", '{"min":"14"}'),
    ("PRIOR_EXPERIENCE", "REQUIRES", "{}"),
]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three rules an opportunity, from `RULE_VALUES`."""
    p = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("opp_id"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("rule_no"))
    shape = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(o).alias("operator"), F.lit(v).alias("value")) for d, o, v in RULE_VALUES])
    at = ((F.col("opp_id") * (F.col("rule_no") + 2) + F.col("rule_no") * 5) % len(RULE_VALUES)).cast("int")
    return p.withColumn("r", F.get(shape, at)).select("opp_id", "rule_no", "r.*")


def deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..domains import DEADLINE_KINDS

    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("opp_id"), F.col("o_orderkey").alias("deadline_id"), pick(DEADLINE_KINDS, F.col("o_orderkey")).alias("kind"), F.col("o_orderdate").alias("date"), (F.col("o_orderpriority") == "5-LOW").alias("is_rolling"))


def _list(values: list[str | None]) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


def _pick(values: list[str | None], index: str) -> str:
    return f"({_list(values)})[({index}) % {len(values)} + 1]"


#: The same tables as common table expressions.
CTES = {
    "profiles": f"""profiles AS (
  SELECT c_custkey AS user_id,
    CASE WHEN c_custkey % 17 <> 0 THEN (13 + c_custkey % 10)::INT END AS age,
    CASE WHEN c_custkey % 13 <> 0 THEN (6 + c_custkey % 8)::INT END AS grade,
    {_pick(["MIDDLE", "SECONDARY", "SENIOR_SECONDARY", "UNDERGRAD", "GAP_YEAR", None], "c_custkey")} AS education_level,
    CASE WHEN c_custkey % 19 <> 0 THEN 'N' || c_nationkey END AS country_code,
    'City' || (c_custkey % 5) AS city,
    {_pick(["CBSE", "IB", "A_LEVELS", "UNKNOWN", None], "c_custkey")} AS curriculum,
    (['en', 'fr'])[1:c_custkey % 3] AS languages,
    {_pick(["ONLINE", "IN_PERSON", "HYBRID", "ANY"], "c_custkey")} AS format_preference,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS budget_ceiling,
    {_pick(["GBP", "USD", None], "c_custkey")} AS budget_currency,
    CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2000-02-01' END AS available_from,
    CASE WHEN c_custkey % 4 = 0 THEN TIMESTAMP '2000-12-31' END AS available_until,
    CASE WHEN c_custkey % 7 = 0 THEN [] ELSE [
      {{'slug': {_pick(TOPICS, "c_custkey")}, 'strength': (c_custkey % 5 + 1)::INT, 'kind': 'SUBJECT'}},
      {{'slug': {_pick(TOPICS, "c_custkey + 3")}, 'strength': ((c_custkey + 3) % 5 + 1)::INT, 'kind': 'SUBJECT'}}] END AS interests,
    CASE WHEN c_custkey % 5 = 0 THEN [] ELSE [{_pick(CATEGORIES, "c_custkey")}] END AS career_directions,
    list_transform(range(c_custkey % 6), lambda i: {{'kind': {_pick(ACHIEVEMENTS, "c_custkey + i * (c_custkey % 3)")},
      'level': {_pick(LEVELS, "c_custkey + i")}, 'tag_slugs': [{_pick(TOPICS, "c_custkey + i")}], 'title': 'Activity ' || i}}) AS achievements
  FROM customer)""",
    "opps": f"""opps AS (
  SELECT p_partkey AS opp_id, p_name || ' ' || {_pick(["Programme", "Prize", "School"], "p_partkey")} AS title, p_type AS summary,
    {_pick(["ONLINE", "IN_PERSON", "HYBRID", "UNKNOWN"], "p_partkey")} AS format,
    CASE WHEN p_partkey % 11 <> 0 THEN 'N' || (p_partkey % 25) END AS location_country,
    'City' || (p_partkey % 5) AS location_city,
    {_pick(["FREE", "PAID", "FREE_WITH_AID", "UNKNOWN", "PAID"], "p_partkey")} AS cost_type,
    CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS cost_amount,
    {_pick(["GBP", "USD"], "p_partkey")} AS cost_currency,
    CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS aid_available,
    CASE WHEN p_partkey % 10 <> 0 THEN p_size END AS duration_days,
    CASE WHEN p_partkey % 8 = 0 THEN [] ELSE [
      {{'slug': {_pick(TOPICS, "p_partkey")}, 'weight': 1.0::DOUBLE, 'kind': 'SUBJECT'}},
      {{'slug': {_pick(TOPICS, "p_partkey + 1")}, 'weight': 0.5::DOUBLE, 'kind': 'INTEREST'}},
      {{'slug': {_pick(TOPICS, "p_partkey + 2")}, 'weight': 0.5::DOUBLE, 'kind': 'CAREER_FIELD'}}] END AS tags,
    CASE WHEN p_partkey % 12 = 0 THEN [] ELSE [{_pick(CATEGORIES, "p_partkey")}, {_pick(CATEGORIES, "p_partkey + 2")}] END AS categories,
    {_pick(["VERIFIED", "RECENTLY_VERIFIED", "NEEDS_REVIEW", "UNVERIFIED", "EXPIRED", "ARCHIVED", "VERIFIED", "VERIFIED"], "p_partkey")} AS state,
    TIMESTAMP '2000-01-01' - to_minutes(p_partkey * 7919 % 100000) AS updated_at,
    TIMESTAMP '1999-01-01' + to_minutes(p_partkey * 104729 % 200000) AS first_seen_at,
    (p_partkey % 8)::INT AS n_requirements,
    CASE WHEN p_partkey % 6 = 0 THEN ['Certificate of participation'] ELSE [] END AS stated_benefits
  FROM part)""",
    "rules": "rules AS (\n  SELECT p_partkey AS opp_id, n AS rule_no, s.d AS dimension, s.o AS operator, s.v AS value FROM part, (VALUES (0), (1), (2)) t(n),\n    (VALUES " + ", ".join(f"({i}, '{d}', '{o}', '{v}')" for i, (d, o, v) in enumerate(RULE_VALUES)) + f") s(i, d, o, v)\n  WHERE s.i = (p_partkey * (n + 2) + n * 5) % {len(RULE_VALUES)})",
    "dl": "dl AS (\n  SELECT o_custkey AS opp_id, o_orderkey AS deadline_id, " + _pick("APPLICATION_DEADLINE EARLY_DEADLINE REGISTRATION_DEADLINE DOCUMENT_DEADLINE INTERVIEW_WINDOW APPLICATION_OPENS PROGRAM_START PROGRAM_END RESULT_DATE NOTIFICATION_DATE".split(), "o_orderkey") + " AS kind,\n    o_orderdate AS date, o_orderpriority = '5-LOW' AS is_rolling FROM orders)",
    # For each student the newest 200 visible opportunities open to their country.
    "pairs": """vis AS (SELECT opp_id, location_country, format, updated_at FROM opps WHERE state NOT IN ('EXPIRED', 'ARCHIVED')),
keys AS (SELECT DISTINCT country_code AS key FROM profiles),
lists AS (SELECT key, opp_id FROM keys JOIN vis ON key IS NULL OR location_country = key OR format = 'ONLINE' OR location_country IS NULL
  QUALIFY row_number() OVER (PARTITION BY key ORDER BY updated_at DESC, opp_id) <= 200),
pairs AS (SELECT user_id, opp_id FROM profiles p JOIN lists l ON p.country_code IS NOT DISTINCT FROM l.key)""",
}


def ctes(*names: str) -> str:
    return "WITH " + ",\n".join(CTES[n] for n in names)
