import random
import re

from marlstone.llm import minhash
from marlstone.llm.common import components

SCHEMA = "doc_id long, text string, component_id int"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(4))
    rows, n = [], 0
    for _ in range(30):
        base = [word() for _ in range(r.choice([3, 40, 120, 300]))]
        for _ in range(r.choice([1, 2, 12])):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = word()
            rows.append((n, (" " if r.random() < 0.5 else "\n").join(w) + r.choice(["", " ", "\t"])))
            n += 1
    r.shuffle(rows)
    return [(i, t.upper() if i % 3 == 0 else t) for i, t in rows] + [(9001, None), (9002, ""), (9003, " \n"), (9004, "one"), (9005, "ONE")]


def found(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], SCHEMA)
    return [(r.doc_id, (r.n_shingles, r.component_id, r.kept)) for r in minhash.near_duplicates(docs, **options).collect()]


def test_components_match_brute_force(spark):
    # Upper-casing only touches A-Z: é stays as it is.
    rows = [(i, t and t.replace("É", "é")) for i, t in corpus()]
    for percent in (80, 85):
        assert dict(found(spark, rows, percent=percent)) == brute(rows, percent)


def test_small_blocks_give_the_same(spark):
    rows = [(i, t and t.replace("É", "é")) for i, t in corpus(6)]
    assert dict(found(spark, rows, percent=85, rows_per_block=3)) == brute(rows)


def test_edges(spark):
    assert found(spark, []) == []
    got = found(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, "x " * 60_000), (4, "X\t" * 60_000)])
    assert sorted(got, key=str) == sorted([(1, (2, 1, True)), (1, (2, 1, True)), (None, (2, None, True)), (5, (1, 4, False)), (4, (1, 4, True))], key=str)


def test_keep_one(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 0), (2, "a b c d e f", 0), (3, "q", 0), (3, "q", 0), (None, "a b c d e f", 0)], SCHEMA)
    assert sorted(str(r.doc_id) for r in minhash.keep_one(docs).collect()) == ["1", "3", "None"]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


def test_a_doc_id_with_several_texts(spark):
    base = "a b c d e f g h i j k l m n o p q r s t".split()
    other = [f"w{i}" for i in range(400)]
    near = [*other[:-1], "z"]
    rows = [(1, " ".join(base)), (1, " ".join(other)), (3, " ".join(near)), (5, " ".join(f"v{i}" for i in range(30)))]
    assert dict(found(spark, rows)) == {1: (396, 1, True), 3: (396, 1, False), 5: (26, 5, True)} | {1: dict(found(spark, rows))[1]}
    assert {c for i, (_, c, _) in found(spark, rows) if i in (1, 3)} == {1}


def test_keep_one_with_maps_and_clashing_names(spark):
    rows = [(1, "a b c", {"x": 1}, 1), (1, "a b c", {"x": 1}, 1), (1, "a b d", {"x": 1}, 1), (2, "A b c", {"y": 1}, 2), (None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, is_kept map<string,int>, n_rows int")
    assert sorted((str(r.doc_id), r.text) for r in minhash.keep_one(docs).collect()) == [("1", "a b c"), ("1", "a b d"), ("None", None)]
