import pytest

from marlstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, extra int"


def plan(spark, rows, **options):
    return mixing.mix(spark.createDataFrame(rows, SCHEMA), **options).collect()


def filled(sizes, total):
    """Brute-force targets: share by weight, cap, reshare until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: i % 3 + 1 for i, s in enumerate(names)}
    out, open_ = {}, set(names)
    while open_:
        left = total - sum(out.values())
        part = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = {s for s in open_ if part[s] >= 3 * sizes[s]}
        if not above:
            return out | part
        out |= {s: 3 * sizes[s] for s in above}
        open_ -= above
    return out


def test_targets_and_takings_match_brute_force(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), ["b", "a", None, "é", "tiny"][i % 5 if i % 50 else 4], 0) for i in range(600) if i % 5 != 4 or i % 100 == 4]
    got = plan(spark, rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = filled(sizes, sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken == r["size"] * r.copies and 0 <= r.copies <= 3
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * 13
    assert sum(taken.values()) <= sum(sizes.values())
    assert sorted(map(tuple, got)) == sorted(map(tuple, plan(spark, rows)))


def test_edges(spark):
    assert plan(spark, []) == []
    got = {r.doc_id: r for r in plan(spark, [(1, None, "a", 1), (2, "", "a", 1), (3, "x y", None, 1), (3, "x y", None, 1)])}
    assert got[1]["size"] == 0 and got[1].taken == 0 and got[2].taken == 0
    # All words are of one source; the other has none, so its target is 0.
    assert got[3].target == 4.0 and got[1].target == 0.0
    assert [r.taken for r in plan(spark, [(1, " \t", "a", 1)])] == [0]


def test_given_weights_and_stream(spark):
    rows = [(i, "w", "ab"[i % 2], 0) for i in range(100)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, weights={"a": 1.0})
    assert got.filter("source = 'b' and taken > 0").count() == 0
    stream = mixing.mixed_stream(docs).collect()
    assert len(stream) == 100 and [r.finish for r in stream] == sorted(r.finish for r in stream)
