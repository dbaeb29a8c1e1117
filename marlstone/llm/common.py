"""Shared pieces of the training-data operators.

* ``cut`` - reliable checkpoint in the cluster's shared folder.
* ``words_of`` / ``shingles_of`` - vectorised word and shingle hashing of the
  UTF-8 buffer of an Arrow string column (no per-word Python objects).
* ``weighted_cut`` - exact distributed selection by a radix histogram.
* ``components`` - connected components by alternating large-star and
  small-star, expressed with grouped minima and joins only.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words, as in ``[^\x20\x09-\x0D]+``.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one vectorised step handles; keeps its arrays in cache.
STEP_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local one is made only where none is configured and all is on one machine, as in tests."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return named or sc.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` where every executor can read it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


# ---------------------------------------------------------------- word hashing

_rng = np.random.Generator(np.random.PCG64(20240117))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, so invertible modulo 2**64
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SAME = np.arange(256, dtype=np.uint8)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_MULT = _rng.integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        p = np.full(max(n, STEP_BYTES + 1), base, dtype=np.uint64)
        p[0] = 1
        _powers[name] = np.multiply.accumulate(p)
    return _powers[name]


def steps(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of a string column.

    A step ends after ``STEP_BYTES``; a longer text is a step of its own. Null
    is an empty text.
    """
    column = column.cast(pa.large_string())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64, count=n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + STEP_BYTES, side="right")) - 1
        end = min(n, max(row + 1, end))
        own = offsets[row : end + 1]
        yield row, end, data[own[0] : own[-1]], own - own[0]
        row = end


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = True):
    """Starts, ends and 64-bit hashes of the words of some texts, and where each text's words begin.

    ``data`` holds the UTF-8 bytes of the texts, text i at offsets[i]:offsets[i+1].
    The fourth result has the word index at which each text begins, plus the total.
    """
    n = len(data)
    if not n:
        e = np.zeros(0, dtype=np.int64)
        return e, e, np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    b = _LOWER[data] if lower else data
    w = _IS_WORD[b]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = False, w[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    before[inner] = False
    starts = np.flatnonzero(w & ~before)
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = False, w[1:]
    after[inner[inner > 0] - 1] = False
    ends = np.flatnonzero(w & ~after) + 1
    sums = np.cumsum(_BYTE[b] * _power(_P, "p", n)[:n], dtype=np.uint64)
    h = sums[ends - 1].copy()
    inside = starts > 0
    h[inside] -= sums[starts[inside] - 1]
    h = mix64(h * _power(_PINV, "q", n)[starts])
    return starts, ends, h, np.searchsorted(starts, offsets)


def runs_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k consecutive word hashes from each position on."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    s = np.zeros(m, dtype=np.uint64)
    for j in range(k):
        s += h[j : j + m] * _MULT[j]
    return mix64(s)


def shingles_of(h: np.ndarray, k: int = 5) -> np.ndarray:
    """A text's k-word shingles in order; a shorter text is one shingle of all its words."""
    if len(h) >= k:
        return runs_of(h, k)
    if not len(h):
        return h
    return mix64(np.array([np.uint64(len(h))], dtype=np.uint64) + np.sum(h * _MULT[: len(h)], dtype=np.uint64))


# ------------------------------------------------------------------- selection


def weighted_cut(df: DataFrame, key: str, weight: str | None, budget: float) -> int | None:
    """The smallest key at which the running weight, by ascending key, exceeds ``budget``.

    Rows with a smaller key fit the budget together; None: all rows fit. ``key``
    is a bigint from 0 to 2**48-1. Three histograms of at most 65,536 bins are
    collected, whatever the number of rows, so nothing is sorted.
    """
    prefix, left = 0, budget
    for shift in (32, 16, 0):
        part = df if shift == 32 else df.filter(F.shiftright(key, shift + 16) == prefix)
        rows = part.groupBy(F.shiftright(key, shift).alias("bin")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("w")).orderBy("bin").collect()
        for r in rows:
            if left - (r["w"] or 0) < 0:
                prefix = r["bin"]
                break
            left -= r["w"] or 0
        else:
            return None
    return prefix


# ------------------------------------------------------------------ components


def _hop(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on (u, v) rows with u > v.

    Large-star: of each node u, link every larger neighbour to the smallest of
    u and its neighbours. Small-star: link u's smaller neighbours and u itself
    to the smallest. Minima are combined before the shuffle, and neighbourhoods
    are never gathered, so a hub costs no more than its edges.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node with a link; component is the smallest node reachable.

    Alternates large-star and small-star until the edges stay the same (row
    count and an order-free digest agree between rounds). ``edges`` may hold
    repeats, self links and either order.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    seen = None
    for _ in range(max_rounds):
        e = cut(_hop(_hop(e, True), False))
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
