"""Near-duplicate documents: MinHash, banding, signature check, exact confirmation, components.

1. A text's words become 64-bit hashes and its 5-word shingles a set of hashes.
   Texts with the same set collapse to one row, a node, by a digest of the set.
2. `BANDS * ROWS` universal hash minima a set; sets that agree on a band meet in
   its bucket. Buckets are compared in blocks of bounded size by their whole
   signatures; of each bucket only a spanning forest of likely pairs is passed on.
3. Those links give candidate clusters (large-star / small-star). Every true
   link lies inside a cluster but for the banding's miss rate, about
   (1 - 0.8**ROWS)**BANDS = 2e-6 at a similarity of 0.8.
4. Inside a cluster the full shingle sets decide, again in blocks; pairs that
   are connected already need no check. Verified links give the components.

Nothing gathers a group in one place: big buckets and clusters are dealt as
pairs of blocks, each block a bounded number of rows and shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, mix64, shingles_of, steps, unused, words_of

BANDS, ROWS, SHINGLE = 25, 4, 5
#: Rows of a bucket or cluster in one block, and shingles of a cluster in one block.
BLOCK_ROWS, BLOCK_SHINGLES = 2_000, 2_000_000
#: How far under the threshold signatures may agree before a pair is out of the question:
#: five standard errors of 100 minima at 0.8, a chance of about 2e-6 like the banding's.
SLACK = 0.2

_g = np.random.Generator(np.random.PCG64(77))
_A = _g.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _g.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)


def minima(s: np.ndarray) -> np.ndarray:
    """The signature of a set of shingle hashes: 16 bits of each universal hash's minimum."""
    least = np.full(len(_A), np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(s), 4096):
        np.minimum(least, (np.multiply.outer(_A, s[i : i + 4096]) + _B[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint16)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a string column."""
    for _, _, data, offsets in steps(column):
        _, _, h, first = words_of(data, offsets)
        for i in range(len(offsets) - 1):
            yield np.unique(shingles_of(h[first[i] : first[i + 1]], SHINGLE))


def _digest(s: np.ndarray) -> int:
    return int(np.sum(mix64(s), dtype=np.uint64).astype(np.int64))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, d1, d2, sig = [], [], [], []
        for s in shingle_sets(batch.column("text")):
            n.append(len(s))
            d1.append(_digest(s))
            d2.append(int(np.sum(mix64(s ^ np.uint64(0x5BF03635F0A31E9D)), dtype=np.uint64).astype(np.int64)))
            sig.append(minima(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "sig"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        m = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, BANDS, ROWS)
        keys = np.zeros(m.shape[:2], dtype=np.uint64)
        for r in range(ROWS):
            keys = mix64(keys ^ (m[:, :, r].astype(np.uint64) + np.uint64(0x9E37)))
        keys ^= np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
        ids = np.repeat(batch.column("node").to_numpy(), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.reshape(-1).astype(np.int64))], names=["node", "key"])


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in rows that come sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows - 1, dtype=bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            change |= v[1:] != v[:-1]
        bounds = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(k)[held[-1].num_rows - 1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


class Forest:
    """Union-find over 0..n-1 that keeps each node's root at hand."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.members = {i: [i] for i in range(n)}

    def join(self, a: int, b: int) -> bool:
        x, y = int(self.root[a]), int(self.root[b])
        if x == y:
            return False
        if len(self.members[x]) < len(self.members[y]):
            x, y = y, x
        moved = self.members.pop(y)
        self.root[moved] = x
        self.members[x] += moved
        return True

    def apart(self, i: int) -> np.ndarray:
        """The nodes after i that are not joined with it yet: of a group of copies none are left after its first node."""
        return i + 1 + np.flatnonzero(self.root[i + 1 :] != self.root[i])


def _agree(sig: np.ndarray, i: int, rows: np.ndarray, least: float) -> np.ndarray:
    """Which of ``rows`` have signatures that agree with row i's on ``least`` of the minima."""
    return (sig[rows] == sig[i]).sum(axis=1) >= least * sig.shape[1]


def _likely(sig: np.ndarray, i: int, first: int, least: float) -> np.ndarray:
    """Rows from ``first`` on whose signatures agree with row i's on ``least`` of the minima."""
    return first + np.flatnonzero((sig[first:] == sig[i]).sum(axis=1) >= least * sig.shape[1])


def _block_links(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in by_group(batches, ["key", "x", "y"]):
            if t.num_rows < 2:
                continue
            ids = t.column("node").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint16).reshape(len(ids), -1)
            forest = Forest(len(ids))
            for i in range(len(ids) - 1):
                rest = forest.apart(i)
                for j in rest[_agree(sig, i, rest, threshold - SLACK)]:
                    if forest.join(i, int(j)):
                        a.append(ids[i])
                        b.append(ids[j])
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
                a, b = [], []
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cluster_links(percent: int, threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for t in by_group(batches, ["key", "x", "y"]):
            if t.num_rows < 2:
                continue
            # A doc_id can have several texts: the node's own has its digest.
            found: dict[int, np.ndarray] = {}
            for node, d1, s in zip(t.column("node").to_pylist(), t.column("d1").to_pylist(), shingle_sets(t.column("text").combine_chunks()), strict=True):
                if node not in found and _digest(s) == d1:
                    found[node] = s
            ids, sets = list(found), list(found.values())
            n = np.array([len(s) for s in sets])
            forest = Forest(len(ids))
            sig = np.stack([minima(s) for s in sets]) if len(ids) > 8 else None
            for i in range(len(ids) - 1):
                near = forest.apart(i)
                if sig is not None:
                    near = near[_agree(sig, i, near, threshold - SLACK)]
                # The smaller set bounds the intersection, the larger one the union.
                near = near[100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])]
                for j in near:
                    if forest.root[i] == forest.root[j]:
                        continue
                    both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if 100 * both >= percent * (n[i] + n[j] - both):
                        forest.join(i, int(j))
                        a.append(ids[i])
                        b.append(ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _in_blocks(rows: DataFrame, blocks: F.Column) -> DataFrame:
    """Deal each key's rows to pairs (x, y) of its blocks: every two rows meet in at least one."""
    rows = rows.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), (F.col("nb") - 1).cast("int")), lambda o: F.struct(F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")))
    rows = rows.withColumn("p", F.explode(pairs)).withColumn("x", F.col("p.x")).withColumn("y", F.col("p.y")).drop("p", "nb", "own")
    return rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")


def near_duplicates(docs: DataFrame, percent: int = 80, rows_per_block: int = BLOCK_ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Linked are texts with 100 * |intersection| >= percent * |union| of their
    shingle sets; component_id is the smallest doc_id reachable. Texts without
    words (or null) have an empty set and no links; texts of fewer than five
    words have one shingle. Repeated rows each come out, with one component; rows
    of one doc_id are one document, whose different texts are linked; rows
    without doc_id come out unlinked with a null component and are kept.
    doc_id must be a number. Other columns are ignored. An empty table gives no rows.
    """
    threshold = percent / 100
    link = "a long, b long"
    digest = ["n_shingles", "d1", "d2"]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    per_doc = cut(texts.mapInArrow(_signatures, "doc_id long, n_shingles long, d1 long, d2 long, sig binary"))
    # One node for each different set; numbers are given once, as the checkpoint keeps them.
    known = per_doc.filter("n_shingles > 0 and doc_id is not null")
    sets = known.groupBy(*digest).agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"))
    sets = cut(sets.withColumn("node", F.monotonically_increasing_id()))

    # Buckets of at least two sets, with signatures, in blocks.
    bands = sets.select("node", "sig").mapInArrow(_band_rows, "node long, key long")
    met = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = bands.join(met, "key").join(sets.select("node", "sig"), "node")
    loose = _in_blocks(buckets, F.ceil(F.col("n") / rows_per_block)).mapInArrow(_block_links(threshold), link).distinct()
    clusters = cut(components(loose, "a", "b"))

    # Whole texts of each cluster, in blocks.
    placed = clusters.join(sets.select("node", "doc_id", "n_shingles", "d1"), "node")
    sizes = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    members = placed.join(sizes, "component").select("node", "doc_id", "d1", F.col("component").alias("key"), F.greatest(F.ceil(F.col("n") / rows_per_block), F.ceil(F.col("s") / BLOCK_SHINGLES)).alias("nb0"))
    one = Window.partitionBy("doc_id", "h").orderBy("node")
    again = texts.filter("text is not null").withColumn("h", F.xxhash64("text")).join(members.select("doc_id", "node").groupBy("doc_id").agg(F.min("node").alias("node")), "doc_id")
    again = again.withColumn("rn", F.row_number().over(one)).filter("rn = 1").select("doc_id", "text")
    exact = _in_blocks(members.join(again, "doc_id"), F.col("nb0")).select("key", "x", "y", "node", "d1", "text").mapInArrow(_cluster_links(percent, threshold), link)
    # Texts of one doc_id are one document.
    nodes = known.select("doc_id", *digest).distinct().join(sets.select(*digest, "node"), digest).select("doc_id", "node")
    several = nodes.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("last")).filter("b < last")
    same = nodes.join(several, "doc_id").filter("node > b").select(F.col("node").alias("a"), "b")
    comp = components(exact.unionByName(same), "a", "b")

    linked = comp.join(sets.select("node", "doc_id"), "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("c"))
    by_set = sets.select(*digest, "node", "doc_id").join(comp.join(least, "component").select("node", "c"), "node", "left").select(*digest, F.coalesce("c", "doc_id").alias("c"))
    out = per_doc.drop("sig").join(by_set, digest, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the smallest doc_id.

    All columns stay. Of rows with one doc_id that repeat each other wholly one
    stays; rows without doc_id stay, and so do null and empty texts. An empty
    table gives no rows. doc_id must be a number.
    """
    kept, n = unused(docs, "is_kept"), unused(docs, "n_rows")
    told = near_duplicates(docs, percent).filter("doc_id is not null").groupBy("doc_id").agg(F.bool_and("kept").alias(kept), F.count(F.lit(1)).alias(n))
    told = cut(told.filter(~F.col(kept) | (F.col(n) > 1)))
    alone = docs.join(told.select("doc_id"), "doc_id", "left_anti")
    if told.filter(kept).isEmpty():
        return alone
    # Rows of repeated doc_ids by their whole content; maps have no order and no equality, so as text.
    again = docs.join(told.filter(kept).select("doc_id"), "doc_id", "left_semi").withColumn(n, F.to_json(F.struct(*docs.columns)))
    return alone.unionByName(again.dropDuplicates([n]).drop(n))
