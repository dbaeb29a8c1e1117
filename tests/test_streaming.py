from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.functions import text as X
from marlstone.operators import temporal as TM
from marlstone.sources import sinks
from marlstone.operators import deadlines as DL
from marlstone.streaming import expiry, limits

T0 = datetime(2026, 8, 18)


def test_stream_agrees_with_batch(spark, tmp_path):
    schema = "seq long, k string, at timestamp"
    rows = [(i, "ab"[i % 2], T0 + timedelta(hours=i * 7 % 50)) for i in range(30)]
    rows.sort(key=lambda r: r[2])
    for part in range(3):  # one file a micro-batch, in order of time
        spark.createDataFrame(rows[part * 10 : part * 10 + 10], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = limits.accepted_stream(stream, "k", 2, 12 * 3600).writeStream.format("memory").queryName("limits_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.n: r.accepted for r in spark.table("limits_out").collect()}
    want = {r.seq: r.accepted for r in TM.accepted(spark.createDataFrame(rows, schema), "k", 2, 12 * 3600).collect()}
    assert got == want and True in got.values() and False in got.values()


def test_state_of_a_limit_goes(spark, tmp_path):
    schema = "seq long, k string, at timestamp"
    # Many keys on the first day, one key on later days, and a row that is too late.
    days = [[(i, f"k{i}", T0 + timedelta(minutes=i)) for i in range(20)], [(100, "z", T0 + timedelta(days=5))], [(101, "z", T0 + timedelta(days=9)), (102, "k3", T0)], [(103, "k3", T0 + timedelta(days=10))]]
    for rows in days:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = limits.accepted_stream(stream, "k", 1, 3600).writeStream.format("memory").queryName("limits_state").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.n for r in spark.table("limits_state").filter("accepted").collect()} == {*range(20), 100, 101, 103}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 20 and held[-1] <= 2


def test_expiry_agrees_with_the_sweep(spark, tmp_path):
    day = lambda d: T0 + timedelta(days=d)
    schema = "opp_id long, at timestamp, state string, last_date timestamp, is_rolling boolean"
    batches = [
        [(i, day(0), ["VERIFIED", "ARCHIVED", "UNVERIFIED"][i % 3], None if i % 7 == 0 else day(1 + i % 12), i % 5 == 0) for i in range(60)],
        [(1, day(3), "VERIFIED", day(40), False), (2, day(3), "ARCHIVED", day(2), False), (5, day(3), "VERIFIED", day(9), False)],
        [(8, day(6), "VERIFIED", day(4), False), (6, day(5.5), "VERIFIED", day(7), True)],
        [(11, day(1), "VERIFIED", day(2), False), (900, day(20), "ARCHIVED", None, None)],  # the first of them is too late
        [(901, day(20), "ARCHIVED", None, None)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = expiry.expiry_stream(stream).writeStream.format("memory").queryName("expiry_out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = [r.opp_id for r in spark.table("expiry_out").collect()]
    latest = {}
    for k, rows in enumerate(batches):
        for r in rows:
            if r[0] != 11 or k == 0:
                latest[r[0]] = r
    listings = spark.createDataFrame([(r[0], r[2]) for r in latest.values()], "opp_id long, state string")
    dates = spark.createDataFrame([(r[0], "APPLICATION_DEADLINE", r[3], r[4]) for r in latest.values() if r[3]], "opp_id long, kind string, date timestamp, is_rolling boolean")
    _, audit = DL.sweep_expired(listings, dates, F.lit(day(19)))
    # What a later change put off had expired before it only where its date had passed by then.
    assert sorted(got) == sorted(r.opp_id for r in audit.collect()) and len(got) == len(set(got)) > 15
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(held) >= 40 and held[-1] <= 4
    assert {tuple(r) for r in expiry.last_dates(dates).collect()} == {(r[0], r[3], bool(r[4])) for r in latest.values() if r[3]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, T0)], "i int, at timestamp")
    sinks.append_log(df, f"{tmp_path}/log", "at")
    sinks.append_log(df, f"{tmp_path}/log", "at")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 2
    assert spark.range(1).select(sinks.json_text(F.array(F.lit("a")))).first()[0] == '["a"]'


def test_slugify(spark):
    cases = {"Été à Paris: 2026!": "ete-a-paris-2026-abcdef", "東京 大学": "東京-大学-abcdef", "!!!": "opportunity-abcdef", " a -- b ": "a-b-abcdef", "ﬁ x": "fi-x-abcdef"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(X.slugify(F.col("t"), F.lit("abcdefgh"))).collect()] == list(cases.values())
