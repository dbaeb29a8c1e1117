import random
import re
from collections import Counter

import numpy as np

from marlstone.llm import decontam

DOCS = "doc_id long, text string, item_id int"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    """Every window of every document against every item."""
    out = {}
    for d, t in docs:
        w = words(t)
        for i, x in items:
            x = words(x)
            n = min(len(x), len(w))
            if not n:
                continue
            k = min(5, len(x))
            for s in range(len(w) - n + 1):
                sim = decontam.similarity(bag(x, k), bag(w[s : s + n], k)) if n >= k else 0
                if sim >= 0.8 and sim > out.get((d, i), (0, 0))[0]:
                    out[d, i] = (sim, s)
    return out


def found(spark, docs, items):
    a = spark.createDataFrame([(d, t, 1) for d, t in docs], DOCS)
    b = spark.createDataFrame(items, "item_id long, text string")
    return a, b, {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.contamination(a, b).collect()}


def test_matches_brute_force(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdé") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(r.choice([2, 4, 15, 40, 90])))) for i in range(20)]
    docs = []
    for d in range(120):
        w = [word() for _ in range(r.choice([0, 10, 80, 200]))]
        if d % 2:
            leak = items[d % 20][1].split()
            for _ in range(r.choice([0, 0, 1, 2])):
                leak[r.randrange(len(leak))] = word()
            at = r.randint(0, len(w))
            w[at:at] = leak
        docs.append((d, "  ".join(w).upper().replace("É", "é") if d % 3 else "\n".join(w)))
    a, b, got = found(spark, docs, items)
    want = brute(docs, items)
    assert set(got) == set(want) and len(want) >= 15
    for k in want:
        assert abs(got[k][0] - want[k][0]) < 1e-12
    clean = {r.doc_id for r in decontam.drop_contaminated(a, b).collect()}
    assert clean == {d for d, _ in docs} - {d for d, _ in want}


def test_edges(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(1, None), (2, ""), (3, item), (3, item), (None, item), (4, "w0 w1"), (5, "x " * 40_000 + item)]
    a, b, got = found(spark, docs, [(1, item), (2, None), (3, ""), (4, item)])
    assert set(got) == {(3, 1), (3, 4), (None, 1), (None, 4), (5, 1), (5, 4)}
    assert got[5, 1] == (1.0, 40_000)
    assert found(spark, [], [(1, item)])[2] == {} and found(spark, docs, [])[2] == {}
    assert sorted(str(r.doc_id) for r in decontam.drop_contaminated(a, b).collect()) == ["1", "2", "4"]
    a, b, _ = found(spark, [(None, item), (None, "clean"), (None, None), (5, "clean")], [(1, item)])
    assert sorted((str(r.doc_id), r.text) for r in decontam.drop_contaminated(a, b).collect() if r.text) == [("5", "clean"), ("None", "clean")]


def test_extra_columns_and_a_doc_id_of_many_rows(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(7, f"text {i} {item if i == 3 else 'clean'}", "a", 1.0, 0, 0) for i in range(60)] + [(8, "clean", "b", 1.0, 0, 0)], "doc_id long, text string, item_id string, similarity double, item long, start int")
    bench = spark.createDataFrame([(1, item, "x")], "item_id long, text string, doc_id string")
    got = decontam.contamination(docs, bench).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(7, 1)]
    left = decontam.drop_contaminated(docs, bench)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {8}


def test_index_finds_all_within_radius():
    g = np.random.default_rng(3)
    items = decontam.Items([(i, " ".join(f"{x}" for x in g.integers(0, 99, 12))) for i in range(50)])
    flips = g.integers(0, 25, 4000)
    pick = g.integers(0, 50, 4000)
    fp = items.fp[pick].copy()
    for j in range(4000):
        for b in g.choice(64, flips[j], replace=False):
            fp[j] ^= np.uint64(1) << np.uint64(b)
    got = {(item, int(w)) for item, ws in items.within(fp, 12) for w in ws}
    want = {(i, int(w)) for i in range(50) for w in np.flatnonzero(np.bitwise_count(fp ^ items.fp[i]) <= decontam.RADIUS)}
    assert got == want
