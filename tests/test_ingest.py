"""Ingest in order against a model that takes one record after the other."""

import hashlib
import random

import pytest

from marlstone.functions import text as X
from marlstone.operators import dedupe as K
from marlstone.operators.ingest import ingest_in_order
from pyspark.sql import functions as F

SCHEMA = "id long, pos long, url string, hash string, title string, org string, cycle int, old boolean"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA).repartition(4)


def model(rows, norm, sim):
    """rows in order of pos -> (id, merge_into, status)."""
    close = lambda a, b: 1.0 if a == b else sim.get((min(a, b), max(a, b)), 0.0)
    urls, listings, out = {}, [], []
    for i, pos, url, h, title, org, cycle, old in sorted(rows, key=lambda r: r[1]):
        if old:
            listings.append({"pos": pos, "t": norm[title], "c": cycle, "s": [(h, org)]})
            urls.setdefault(url, listings[-1])
            continue
        owner, near = urls.get(url) if url else None, False
        if owner is None:
            for one in listings:
                if cycle is not None and one["c"] is not None and cycle != one["c"]:
                    continue
                s = close(norm[title], one["t"]) if title is not None and one["t"] is not None else 0.0
                if any((h and h == sh) or (org and org == so and s >= 0.9) for sh, so in one["s"]):
                    owner = one
                    break
                near = near or s >= 0.75
            if owner is not None:
                owner["s"].append((h, org))
            else:
                listings.append({"pos": pos, "t": norm[title], "c": cycle, "s": [(h, org)]})
                out.append((i, None, "review" if near else "created"))
            if url:
                urls[url] = owner or listings[-1]
            if owner is None:
                continue
        out.append((i, owner["pos"], "merged"))
    return sorted(out)


def check(spark, rows):
    titles = spark.createDataFrame([(t,) for t in {r[4] for r in rows}], "title string").withColumn("norm", X.normalise_title(F.col("title"))).collect()
    norm = {r.title: r.norm for r in titles}
    pairs = K.similar_titles(spark.createDataFrame([(n,) for n in {*norm.values()} - {None}], "title string")).collect()
    got, rounds = ingest_in_order(frame(spark, rows), F.col("old"))
    want = model(rows, norm, {(p.a, p.b): p.similarity for p in pairs})
    assert sorted(tuple(r) for r in got.collect()) == want
    return want, rounds


@pytest.mark.parametrize("seed", [1, 2])
def test_random_batches(spark, seed):
    r = random.Random(seed)
    words = ["summer", "school", "physics", "prize", "young", "people", "camp", "autumn"]
    rows = []
    for i in range(160):
        title = " ".join(r.choices(words, k=4)) + r.choice(["", " programme"])
        rows.append((i, 3 * i + r.randint(0, 2), r.choice([None, "", f"u{r.randint(0, 90)}"]), r.choice([None, f"h{r.randint(0, 60)}"]), r.choice([title, title, None]), r.choice(["o1", "o2", "o3", None]), r.choice([2025, 2026, None]), r.random() < 0.2))
    want, rounds = check(spark, rows)
    assert {s for _, _, s in want} == {"merged", "review", "created"} and 2 <= rounds < 25


def test_a_chain_in_which_each_decides_the_next(spark):
    # Each title is close to the one before it only: the second joins the first, so the third founds a listing, and so on.
    word = lambda k: f"w{k:03d}x{k * 7919 % 1000:03d}"
    rows = [(i, i, None, None, " ".join(word(i * 2 + j) for j in range(21)), "o", None, False) for i in range(14)]
    want, rounds = check(spark, rows)
    assert [m for _, m, _ in want][:6] == [None, 0, None, 2, None, 4] and rounds <= 16


def test_a_star(spark):
    rows = [(i, i, f"u{i}", "same", hashlib.sha256(str(i).encode()).hexdigest()[:8], None, None, False) for i in range(10_000)]
    got, rounds = ingest_in_order(frame(spark, rows))
    got = got.groupBy("merge_into", "status").count().collect()
    assert {(r.merge_into, r.status, r["count"]) for r in got} == {(None, "created", 1), (0, "merged", 9_999)} and rounds == 2


def test_a_source_of_another_title_brings_its_organiser(spark):
    rows = [(1, 1, "a", "h", "Young Physics School", "o1", 2026, False), (2, 2, "b", "h", "Another Name", "o2", None, False), (3, 3, "c", None, "Young Physics School", "o2", 2026, False), (4, 4, "b", None, "Whatever Else", "o9", 2025, False), (5, 5, None, "h", "Young Physics School", "o1", 2025, False), (None, None, None, None, None, None, None, False)]
    got, _ = ingest_in_order(frame(spark, rows))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, None, "created"), (2, 1, "merged"), (3, 1, "merged"), (4, 1, "merged"), (5, None, "created"), (None, None, None)], key=repr)
    assert ingest_in_order(frame(spark, []))[0].collect() == []


def test_records_alike_are_compared_once(spark):
    r = random.Random(3)
    titles = ["Steel Prize", "Steel Prize 2026", "Steel Prizes", "Open Lab Week", "Open Lab Weeks", "Debate Days", None]
    one = lambda k: (k, k, r.choice([None, "", *(f"u{n}" for n in range(40))]), r.choice([None, "", *(f"h{n}" for n in range(60))]), r.choice(titles), r.choice(["o1", "o2", "o3", None, ""]), r.choice([2025, 2026, None]), False)
    rows = [one(k) for k in range(300)]
    new, old = rows[::2], rows[1::2]
    norm = {x.title: x.norm for x in spark.createDataFrame([(t,) for t in titles], "title string").withColumn("norm", X.normalise_title(F.col("title"))).collect()}
    sim = {(p.a, p.b): p.similarity for p in K.similar_titles(spark.createDataFrame([(n,) for n in {*norm.values()} - {None}], "title string")).collect()}
    close = lambda a, b: 0.0 if a is None or b is None else 1.0 if a == b else sim.get((min(a, b), max(a, b)), 0.0)

    def compared(x, others):
        for y in others:
            if x[6] is None or y[6] is None or x[6] == y[6]:
                s = close(norm[x[4]], norm[y[4]])
                sure = any(x[k] and x[k] == y[k] for k in (2, 3))
                if sure or s >= K.REVIEW:
                    yield 1.0 if sure else s, y[1], "SAME" if sure or (x[5] and x[5] == y[5] and s >= K.MERGE) else "REVIEW"

    best, first, batch = {}, {}, {}
    for x in new:
        found = list(compared(x, old))
        if found:
            s, pos, v = min(found, key=lambda c: (-c[0], c[1], c[2] != "SAME"))
            best[x[0]] = (pos, round(s, 9), v)
        same = [pos for _, pos, v in found if v == "SAME"]
        first[x[0]] = (min(same, default=None), "merged" if same else "review" if found else "created")
    for x in rows:
        batch[x[0]] = min((pos for _, pos, v in compared(x, rows) if v == "SAME" and pos < x[1]), default=None)
    new, old = frame(spark, new), frame(spark, old)
    assert {x.id: (x.corpus_pos, round(x.similarity, 9), x.verdict) for x in K.find_duplicate(new, old).collect()} == best
    assert {x.id: (x.merge_into, x.status) for x in K.first_same(new, old).collect()} == first
    assert {x.id: x.merge_into for x in K.batch_representatives(frame(spark, rows)).collect()} == batch
    # Copies under other ids and later positions are more records, not more comparisons.
    ways = lambda a, b: [t.count() for _, t in K._ways(K.prepared(a), K.prepared(b))]
    again = lambda df: df.unionByName(df.withColumns({"id": F.col("id") + 1000, "pos": F.col("pos") + 1000}))
    assert ways(new, old) == ways(again(new), again(old))


def test_rounds_are_about_first_records_only(spark, monkeypatch):
    from marlstone.operators import ingest

    sizes, keep = [], ingest.Rounds.keep

    def counted(self, df):
        out = keep(self, df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(ingest.Rounds, "keep", counted)
    rows = [(k, k, f"u{k % 3}", f"h{k % 2}", "Steel Prize", "o", None, False) for k in range(60)]
    check(spark, rows)
    assert set(sizes) == {3}
