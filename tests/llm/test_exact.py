import hashlib
import random
import re

from marlstone.llm import exact

SCHEMA = "doc_id long, text string, digest int, place string, row int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(5)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    late = lambda i: (i is None, i or 0)
    return {t: (min(ids, key=late), len(ids)) for t, ids in groups.items()}


def test_matches_brute_force(spark):
    r = random.Random(3)
    words = ["one", "two", "three ", "Été", "x" * 5000]
    texts = [r.choice([" ", "\n\t", "  "]).join(r.choices(words, k=r.randint(0, 3))) for _ in range(300)]
    rows = [(r.choice([i, i, r.randint(0, 50), None]), r.choice([t, t, None])) for i, t in enumerate(texts)]
    # One text holds a third of all rows, with white space of its own in each.
    rows += [(1000 + i, "the same" + r.choice([" ", "\n", " \r\n"]) + "text") for i in range(150)]
    want = brute(rows)
    for counters in (1, 3, exact.COUNTERS):
        got = exact.exact_duplicates(frame(spark, rows), counters).collect()
        assert len(got) == len(rows)
        by_digest = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
        assert all((x.keep_id, x.group_size) == by_digest[bytes(x.digest)] for x in got)
        assert sorted(bytes(x.digest) for x in got if x.kept) == sorted(by_digest)
        assert all(x.doc_id == x.keep_id for x in got if x.kept)
        left = exact.drop_exact_duplicates(frame(spark, rows), counters)
        assert left.columns == ["doc_id", "text", "digest", "place", "row"]
        kept = {normal(x.text): x.doc_id for x in left.collect()}
        assert left.count() == len(want) and kept == {t: i for t, (i, _) in want.items()}


def test_frequent_digests_are_found_and_bounded(spark):
    r = random.Random(5)
    rows = [(i, f"hot {i % 3}") for i in range(600)] + [(i, f"rare {r.random()}") for i in range(600, 1800)]
    r.shuffle(rows)
    digests = frame(spark, rows).select(exact.text_digest(exact.F.col("text")).alias("digest"))
    for counters in (8, 20):
        found = exact.frequent(digests, counters)
        assert len(found) <= counters
        # Each holds a ninth of the rows, so eight counters are enough for certain.
        assert {hashlib.sha256(f"hot {k}".encode()).digest() for k in range(3)} <= set(found)


def test_trimming_is_the_misra_gries_step():
    r = random.Random(8)
    for _ in range(200):
        counts = exact.Counter({k: r.randint(1, 9) for k in range(r.randint(0, 12))})
        got = exact._trimmed(exact.Counter(counts), 4)
        falls = {counts[k] - got.get(k, 0) for k in counts if k in got}
        assert len(got) <= 4 and len(falls) <= 1
        fall = falls.pop() if falls else max(counts.values(), default=0)
        # As many counters fall by as much at least, so no count is short by more than its share.
        assert fall * 5 <= sum(counts.values())
        assert all(c <= fall for k, c in counts.items() if k not in got)


def test_edges(spark):
    assert exact.exact_duplicates(frame(spark, [])).collect() == [] and exact.drop_exact_duplicates(frame(spark, [])).collect() == []
    got = exact.exact_duplicates(frame(spark, [(None, "a"), (None, "a"), (4, None), (5, ""), (7, "b"), (7, "b"), (6, " ")])).collect()
    assert sorted([(x.doc_id or -1, x.keep_id or -1, x.group_size, x.kept) for x in got]) == [(-1, -1, 2, False), (-1, -1, 2, True), (4, 4, 2, True), (5, 4, 2, False), (6, 6, 1, True), (7, 7, 2, False), (7, 7, 2, True)]
    # doc_id may be a string.
    named = spark.createDataFrame([("b", "t"), ("a", "t")], "doc_id string, text string")
    assert [x.doc_id for x in exact.drop_exact_duplicates(named).collect()] == ["a"]
