import hashlib
import random

import pytest
from pyspark.sql import functions as F

from marlstone.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, code string, proof int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(6)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes, fanout):
    """(root, siblings of each node level by level)"""
    beside, below = [[] for _ in nodes], [[k] for k in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
        for run in runs:
            for k in run:
                for m in below[k]:
                    beside[m].append("".join(nodes[j] for j in run if j != k))
        below = [[m for k in run for m in below[k]] for run in runs]
        nodes = [h(*[nodes[k] for k in run]) for run in runs]
    return nodes[0], beside


def brute(rows, fanout):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs, parts = [], []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        sub, beside = tree([leaf(r) for r in own], fanout)
        subs.append(sub)
        parts.append((own, beside))
    root, above = tree(subs, fanout)
    return sorted((str(r[0]), leaf(r), sub, root, "".join(b + above[k])) for k, (own, beside) in enumerate(parts) for sub in [subs[k]] for r, b in zip(own, beside, strict=True))


def rows_of(r, n, langs, hot):
    out = [(r.choice([i, i, i % 7, None]), r.choice(["web", None]), hot if r.random() < 0.5 else r.choice(langs), r.choice([i, None]), r.choice([f"Ein Text {i}", "", None, "é" * i])) for i in range(n)]
    return out + out[:3]


@pytest.mark.parametrize(("fanout", "levels", "n", "langs"), [(8, 3, 60, ["de", "en", None]), (2, 1, 45, ["de", "en", None, "ß", "z"]), (3, 1, 130, [f"l{k}" for k in range(11)]), (2, 2, 37, [None]), (8, 1, 200, ["a", "b"])])
def test_matches_brute_force(spark, fanout, levels, n, langs):
    rows = rows_of(random.Random(n), n, langs, langs[0])
    got = merkle.merkle_manifest(frame(spark, rows), fanout=fanout, block_levels=levels).collect()
    assert sorted((str(x.doc_id), x.leaf, x.subroot, x.root, "".join(s.siblings for s in x.proof)) for x in got) == brute(rows, fanout)


def test_proofs_lead_to_the_root_and_show_changes(spark):
    rows = [(i, "web", "en" if i % 3 else None, i, f"Text {i}") for i in range(50)]
    changed = merkle.row_leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.lower("text")])
    m = merkle.merkle_manifest(frame(spark, rows), carry={"seen": changed}, fanout=2, block_levels=1)
    assert all(x.verified and x.folded_root == x.root for x in merkle.verified(m, F.col("leaf")).collect())
    assert not any(x.verified or x.folded_root == x.root for x in merkle.verified(m, F.col("seen")).collect())
    # Where only some are changed, only they fail.
    some = F.when(F.col("doc_id") % 5 == 0, F.col("seen")).otherwise(F.col("leaf"))
    assert {x.doc_id for x in merkle.verified(m, some).filter("not verified").collect()} == set(range(0, 50, 5))


def test_edges(spark):
    assert merkle.merkle_manifest(frame(spark, [])).collect() == []
    (x,) = merkle.merkle_manifest(frame(spark, [(None, None, None, None, None)])).collect()
    assert x.leaf == x.subroot == x.root == h("-----") and x.proof == []
    # One row repeated: leaves of their own; nine of them leave a run of one.
    one = (1, "s", "en", 3, "abc")
    got = merkle.merkle_manifest(frame(spark, [one] * 9)).collect()
    assert sorted(("1", x.leaf, x.subroot, x.root, "".join(s.siblings for s in x.proof)) for x in got) == brute([one] * 9, 8)
    assert sorted(len(s.siblings) // 64 for x in got for s in x.proof) == [0] + [1] * 9 + [7] * 8
    # A very long text is one leaf like any other.
    long = (2, "s", "en", 3, "wörter " * 300_000)
    assert {x.leaf for x in merkle.merkle_manifest(frame(spark, [one, long])).collect()} == {leaf(one), leaf(long)}
