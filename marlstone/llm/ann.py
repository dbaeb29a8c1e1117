"""Approximate nearest neighbours by a forest of random-projection trees.

A tree splits at medians, level by level; a level has one random direction, so a
tree is its directions and a median a node. Trees grow on a bounded sample, as
deep as that gives sound medians, and go on over all rows where leaves of `LEAF`
rows need it. Every vector is put into one leaf of each tree.

A query takes leaves of all trees through one shared priority queue. A leaf's
priority is how far the query is on the leaf's side of every split, summed: the
part of the inner product that the splits know of. Leaf candidates are reranked
exactly, in double precision, where the leaf's vectors and its queries meet.

How many leaves a query takes is measured when the index is fitted: as many as
bring `RECALL` of the true neighbours of sample rows within the sample. Tables larger than the
sample take a smaller share, by half of the power at which it falls within the sample.

Vectors that are equal in every component are one candidate with the smallest
ids that any answer can need (k + 1), so a third of all rows may be one vector.
Subtrees are dealt in blocks of bounded size, and so are their queries.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Trees, rows they grow on, rows that a median in the sample needs, rows of a leaf, levels at most.
TREES, SAMPLE, SOUND, LEAF, LEVELS = 16, 20_000, 16, 64, 17
#: Share of true neighbours that a search must find within the sample, and rows it is measured with.
RECALL, PROBES = 0.94, 256
#: Rows of a subtree that its queries meet together, and components of vectors, and of queries, in one block.
GROUP, BLOCK, ASKED = 32_768, 3_200_000, 1_000_000


class Forest:
    """Trees as arrays: directions (trees, levels, components), and for each level the medians (trees, nodes)."""

    def __init__(self, sample: np.ndarray, trees: int, levels: int, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        n, size = sample.shape
        ends = rng.integers(0, n, (2, trees, LEVELS))
        # From one sample row to another: directions in which the data spread.
        d = sample[ends[0]] - sample[ends[1]] + 1e-9 * rng.standard_normal((trees, LEVELS, size))
        self.directions = d / np.linalg.norm(d, axis=2, keepdims=True)
        self.medians: list[np.ndarray] = []
        self.middles: list[np.ndarray] = []
        node = np.zeros((n, trees), dtype=np.int64)
        for level in range(levels):
            p = self.along(sample, level)
            m = np.zeros((trees, 1 << level))
            for t in range(trees):
                order = np.argsort(node[:, t], kind="stable")
                for i, rows in enumerate(np.split(order, np.searchsorted(node[order, t], np.arange(1, 1 << level)))):
                    m[t, i] = np.median(p[rows, t]) if len(rows) else 0.0
            self.split(m)
            node = self.below(node, p, level)

    @property
    def levels(self) -> int:
        return len(self.medians)

    def along(self, v: np.ndarray, level: int) -> np.ndarray:
        """Rows x trees: the projections that a level splits."""
        return v @ self.directions[:, level].T

    def below(self, node: np.ndarray, p: np.ndarray, level: int) -> np.ndarray:
        return 2 * node + (p > self.medians[level][np.arange(node.shape[1]), node])

    def nodes(self, v: np.ndarray) -> np.ndarray:
        """Rows x trees: each row's node on the last level, that is its leaf."""
        node = np.zeros((len(v), len(self.directions)), dtype=np.int64)
        for level in range(self.levels):
            node = self.below(node, self.along(v, level), level)
        return node

    def split(self, medians: np.ndarray) -> None:
        """Add a level."""
        self.medians.append(medians)
        self.middles.append(np.median(medians, axis=1))

    def taken(self, q: np.ndarray, count: int) -> list[tuple[int, int]]:
        """(tree, leaf) of the first ``count`` leaves that the shared queue gives.

        A branch waits with the sides it has taken, and for the levels below
        with the better side of their middle split.
        """
        p = np.einsum("tld,d->tl", self.directions[:, : self.levels], q)
        rest = np.zeros((len(p), self.levels + 1))
        for level in reversed(range(self.levels)):
            rest[:, level] = rest[:, level + 1] + np.abs(p[:, level] - self.middles[level])
        p, rest = p.tolist(), rest.tolist()
        queue = [(-rest[t][0], 0.0, t, 0, 0) for t in range(len(p))]
        heapq.heapify(queue)
        out: list[tuple[int, int]] = []
        while queue and len(out) < count:
            _, got, t, level, node = heapq.heappop(queue)
            if level == self.levels:
                out.append((t, node))
                continue
            m = p[t][level] - float(self.medians[level][t, node])
            for child, gain in ((2 * node + 1, got + m), (2 * node, got - m)):
                heapq.heappush(queue, (-gain - rest[t][level + 1], gain, t, level + 1, child))
        return out


def levels_for(rows: int, per_leaf: int) -> int:
    """Levels after which leaves hold about ``per_leaf`` rows."""
    return min(LEVELS, max(0, math.ceil(math.log2(rows / per_leaf)))) if rows > per_leaf else 0


def needed(sample: np.ndarray, trees: int, k: int, leaf: int = LEAF, recall: float = RECALL) -> float:
    """The leaves, as a share of a tree's leaves and counted over all trees, that hold ``recall`` of the sample's true neighbours."""
    forest = Forest(sample, trees, levels_for(len(sample), leaf))
    leaves = 1 << forest.levels
    if leaves == 1 or len(sample) <= k:
        return 1.0
    nodes = forest.nodes(sample)
    asked = np.random.Generator(np.random.PCG64(7)).permutation(len(sample))[:PROBES]
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    most = leaves
    while True:
        found = []
        for i, near in zip(asked, best, strict=True):
            turn = np.full((trees, leaves), trees * leaves)
            for place, (t, leaf) in enumerate(forest.taken(sample[i], most)):
                turn[t, leaf] = place
            found.append(turn[np.arange(trees), nodes[near]].min(axis=1))
        place = int(np.quantile(np.concatenate(found), recall, method="higher"))
        if place < most or most >= trees * leaves:
            return (min(place, trees * leaves - 1) + 1) / leaves
        most *= 2


def share_for(sample: np.ndarray, rows: int, trees: int, k: int, leaf: int = LEAF) -> float:
    """`needed` of the sample, and for larger tables less by half of the power at which it falls within the sample."""
    share = needed(sample, trees, k, leaf)
    if rows <= len(sample):
        return share
    fall = max(0.0, math.log(needed(sample[::4], trees, k, leaf) / share, 4))
    return share * (rows / len(sample)) ** (-fall / 2)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _index(forest: Forest, below: int):
    """Rows of (tree, part, leaf, id, v); the part is the leaf's node, ``below`` levels above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            nodes = forest.nodes(_matrix(b.column("v"))).astype(np.int32)
            for t in range(nodes.shape[1]):
                leaf = nodes[:, t]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, dtype=np.int32)), pa.array(leaf >> below), pa.array(leaf), b.column("id"), b.column("v")], names=["tree", "part", "leaf", "id", "v"])

    return run


def _route(forest: Forest, below: int, count: int):
    """Rows of (tree, part, leaves, id, v): a query goes once to each part that it takes leaves of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts, leaves = [], [], []
            for i, q in enumerate(_matrix(b.column("v")) if b.num_rows else ()):
                own: dict[tuple[int, int], list[int]] = {}
                for t, leaf in forest.taken(q, count):
                    own.setdefault((t, leaf >> below), []).append(leaf)
                rows += [i] * len(own)
                parts += own
                leaves += own.values()
            where = np.array(parts, dtype=np.int32).reshape(-1, 2)
            picked = pa.RecordBatch.from_arrays([b.column("id"), b.column("v")], names=["id", "v"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(where[:, 0].copy()), pa.array(where[:, 1].copy()), pa.array(leaves, pa.list_(pa.int32())), picked.column("id"), picked.column("v")], names=["tree", "part", "leaves", "id", "v"])

    return run


def _split(forest: Forest, level: int):
    """Rows of (tree, node, p) on the level that is to be split next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _matrix(b.column("v"))
                nodes, p = forest.nodes(v), forest.along(v, level)
                for t in range(nodes.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, dtype=np.int32)), pa.array(nodes[:, t]), pa.array(p[:, t].copy())], names=["tree", "node", "p"])

    return run


def _deepen(forest: Forest, index: DataFrame, levels: int) -> None:
    """Split the forest further by medians over all rows, one aggregation a level, up to 2**LEVELS numbers a tree."""
    for level in range(forest.levels, levels):
        found = index.select("v").mapInArrow(_split(forest, level), "tree int, node long, p double").groupBy("tree", "node").agg(F.percentile_approx("p", 0.5, 1000).alias("m")).collect()
        m = np.zeros((len(forest.directions), 1 << level))
        for r in found:
            m[r["tree"], r["node"]] = r["m"]
        forest.split(m)


def _rerank(k: int):
    def run(key, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query", "cand", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(names, (pa.int64(), pa.int64(), pa.float64()), strict=True)})
        leaf, ids, v = vectors.column("leaf").to_numpy(), vectors.column("id").to_numpy(), _matrix(vectors.column("v"))
        order = np.lexsort((ids, leaf))
        leaf, ids, v = leaf[order], ids[order], v[order]
        asked = queries.column("leaves").combine_chunks()
        bounds, flat = asked.offsets.to_numpy(), asked.values.to_numpy()
        lo, hi = np.searchsorted(leaf, flat, side="left"), np.searchsorted(leaf, flat, side="right")
        qid, q = queries.column("id").to_numpy(), _matrix(queries.column("v"))
        out: tuple[list, list, list] = ([np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], [np.zeros(0)])
        for i in range(len(q)):
            spans = range(bounds[i], bounds[i + 1])
            c = np.concatenate([np.arange(lo[j], hi[j]) for j in spans])
            if not len(c):
                continue
            # Row by row, so that a pair has one score wherever it is met.
            s = np.einsum("nd,d->n", v[c], q[i])
            n = min(k + 1, len(c))
            # Everything that reaches the n-th score, then by score and id.
            near = np.flatnonzero(s >= -np.partition(-s, n - 1)[n - 1])
            near = near[np.lexsort((ids[c[near]], -s[near]))][:n]
            out[0].append(np.full(len(near), qid[i]))
            out[1].append(ids[c[near]])
            out[2].append(s[near])
        return pa.table({n: np.concatenate(x) for n, x in zip(names, out, strict=True)})

    return run


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(id, v, ids): each different vector once, with its k + 1 smallest ids; id is the smallest.

    Batches keep only the smallest ids of each vector before the shuffle, so
    the commonest vector sends k + 1 rows a batch.
    """

    def fewer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pd.DataFrame({"h": [(x + 0.0).tobytes() for x in _matrix(b.column("v"))], "id": b.column("vec_id").to_numpy()})
                yield b.take(pa.array(np.flatnonzero((d.groupby("h")["id"].rank(method="first") <= k + 1).to_numpy())))

    small = rows.select("vec_id", "v").mapInArrow(fewer, rows.schema).withColumn("h", F.xxhash64("v"))
    w = Window.partitionBy("h", "v").orderBy("vec_id")
    small = small.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k + 1)
    return small.groupBy("h", "v").agg(F.min("vec_id").alias("id"), F.sort_array(F.collect_list("vec_id")).alias("ids")).select("id", "v", "ids")


def usable(emb: DataFrame) -> DataFrame:
    """(vec_id, v): vectors in double precision, without null, zero or non-finite ones.

    Vectors of another length than the commonest have no inner product with them and take no part; neither do rows without vec_id.
    """
    kept = emb.schema["embedding"].dataType.simpleString() in ("array<float>", "array<double>")
    v = F.col("embedding") if kept else F.transform("embedding", lambda x: x.cast("double"))
    rows = emb.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("v") == F.lit(size["n"] if size else 0))


def fitted(index: DataFrame, rows: int, k: int, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> tuple[Forest, float]:
    """The forest of (id, v) rows and the share of a tree's leaves that a query takes over all trees."""
    picked = index.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
    known = _matrix(picked.column("v"))
    levels = levels_for(rows, leaf)
    forest = Forest(known, trees, levels if len(known) >= rows else min(levels, levels_for(len(known), SOUND)))
    _deepen(forest, index, levels)
    return forest, share_for(known, rows, trees, k, leaf)


def search(emb: DataFrame, is_query, k: int = 20, trees: int = TREES, sample: int = SAMPLE, leaf: int = LEAF) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of largest inner product found for each query row.

    Candidates are all usable rows but the query's own vec_id; equal scores go
    to the smaller vec_id. With fewer candidates than k all that are found are returned; with
    at most ``leaf`` different vectors that is all. Repeated query rows are answered
    once, repeated candidate rows count once. vec_id must be a number; other
    columns are ignored. An empty table gives no rows.
    """
    spark = emb.sparkSession
    rows = usable(emb)
    index = cut(distinct_vectors(rows, k))
    total = index.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], schema)
    forest, share = fitted(index, total, k, trees, sample, leaf)
    count = math.ceil(share * (1 << forest.levels))
    below = max(0, forest.levels - levels_for(total, GROUP))
    # Queries by their vector's id; one search for each different vector.
    asked = rows.filter(is_query).select("vec_id", "v").distinct().join(index.select("id", "v"), "v").select("vec_id", "id")
    asked = cut(asked.withColumnRenamed("vec_id", "query_id").distinct())
    probes = index.join(asked.select("id").distinct(), "id").select("id", "v")
    vector = index.schema["v"].dataType.simpleString()
    leafed = index.select("id", "v").mapInArrow(_index(forest, below), f"tree int, part int, leaf int, id long, v {vector}")
    # Routing is work for each query, so queries are spread before it.
    routed = cut(probes.repartition("id").mapInArrow(_route(forest, below, count), f"tree int, part int, leaves array<int>, id long, v {vector}"))
    size = forest.directions.shape[2]
    blocks = lambda df, most, name: df.groupBy("tree", "part").agg(F.ceil(F.count(F.lit(1)) / max(1, most // size)).cast("int").alias(name))
    # At most trees * 2**LEVELS rows of four numbers.
    sizes = F.broadcast(blocks(leafed, BLOCK, "nb").join(blocks(routed, ASKED, "nq"), ["tree", "part"]))
    # Every block of a part's vectors meets every block of its queries.
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    leafed = leafed.join(sizes, ["tree", "part"]).withColumn("block", own("nb")).withColumn("turn", each("nq")).drop("nb", "nq")
    routed = routed.join(sizes, ["tree", "part"]).withColumn("turn", own("nq")).withColumn("block", each("nb")).drop("nb", "nq")
    keys = ["tree", "part", "block", "turn"]
    near = routed.groupBy(*keys).cogroup(leafed.groupBy(*keys)).applyInArrow(_rerank(k), "query long, cand long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "cand")
    near = near.groupBy("query", "cand").agg(F.max("score").alias("score")).withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
    # Back to rows: each candidate vector stands for its smallest ids, each query vector for all its query rows.
    near = near.join(index.select(F.col("id").alias("cand"), "ids"), "cand").select("query", "score", F.explode("ids").alias("vec_id"))
    few = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    near = near.distinct().withColumn("rn", F.row_number().over(few)).filter(F.col("rn") <= k + 1)
    out = asked.join(near.withColumnRenamed("query", "id"), "id").filter("vec_id <> query_id")
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
