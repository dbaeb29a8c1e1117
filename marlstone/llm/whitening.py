"""Embedding whitening with MLlib's BlockMatrix.

Vectors become rows of integers, are centred on their exact mean, numbered, and laid into
the blocks of a distributed matrix A. The scatter matrix is A' x A, of as many rows
as a vector has components; it is decomposed on the driver. A times the scaled
eigenvectors, one more block multiplication, projects all rows.

The middle dimension of A' x A, the rows, is split, so that blocks are multiplied where they
meet, each pair in one place, and only small products are summed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows of a block, components given at most, and the most that an entry may be away from 0 as an integer.
BLOCK_ROWS, COMPONENTS, LARGEST = 1024, 8, 1 << 50
SCALE, SHIFT = 1024.0, 100_000


@dataclass
class Whitening:
    """What is fitted: exact counts and sums, eigenvalues that are above rounding, falling, and their unit vectors as columns."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    vectors: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        v = b.column("v")
        if not b.num_rows:
            continue
        entries = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        size = v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        x = np.floor(SCALE * np.where(np.isfinite(entries), entries, np.inf)) + SHIFT
        ends = np.cumsum(size)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(x) <= LARGEST))])
        fine = (bad[ends] == bad[ends - size]) & (size > 0)
        kept = x[np.repeat(fine, size)].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(size[fine])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(fine)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(kept))], names=["id", "x"])


def _matrix(x: pa.Array) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for b in batches:
        for i in range(0, b.num_rows, 4096):  # so many entries sum to less than 2**63
            x = _matrix(b.column("x").slice(i, 4096))
            s = x.sum(axis=0).astype(object)
            n, total = n + len(x), s if total is None else total + s
    if n:
        yield pa.RecordBatch.from_pylist([{"k": k, "n": n, "s": str(s)} for k, s in enumerate(total.tolist())])


def _rows(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, x, index) of the usable vectors, numbered without gaps."""
    given = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("v"))
    kind = given.schema["id"].dataType.simpleString()
    rows = given.mapInArrow(_integers, f"id {kind}, x array<long>")
    rows = cut(rows.withColumn("at", F.monotonically_increasing_id()))
    common = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows.withColumn("index", F.col("at"))
    # Vectors of another length than the commonest leave gaps, which are closed by the counts of each part.
    rows = rows.filter(F.size("x") == common["d"])
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"), F.max("at").alias("end"))
    rows = rows.withColumn("part", part)
    if counts.filter("end - start + 1 <> n").head(1):
        rows = cut(rows.drop("at", "part").withColumn("at", F.monotonically_increasing_id())).withColumn("part", part)
        counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = counts.select("part", (before - F.col("start")).alias("shift"))  # one row a part
    return rows.join(shift, "part").select("id", "x", (F.col("at") + F.col("shift")).alias("index"))


def _blocks(rows: DataFrame, n: int, d: int, block_rows: int) -> BlockMatrix:
    """Rows of (index, centred) as a matrix of blocks."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("centred").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(block_rows, d)


def _times(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """left x right, the middle dimension split, which the Python signature of `BlockMatrix.multiply` leaves out."""
    product = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, left.rowsPerBlock, right.colsPerBlock)


def _scatter(a: BlockMatrix, splits: int) -> np.ndarray:
    return _times(a.transpose(), a, splits).toLocalMatrix().toArray()


def _splits(rows: DataFrame, n: int, block_rows: int) -> int:
    return max(1, min(-(-n // block_rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def whiten(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, Whitening]:
    """(id, deviation, whitened) of every usable vector, and what was fitted on all of them.

    An entry c counts as the integer floor(1024 c) + 100000. Vectors that are null, empty, or hold an entry that is null,
    not finite or beyond +-2**50 as an integer take no part, nor do vectors of another length than the commonest (the longer of two equally
    common ones). ``deviation`` is the exact sum of (n x - S)**2, null where it is no long. ``whitened`` has a value for each of the
    first ``components`` eigenvectors whose eigenvalue is above rounding; fewer than two unlike vectors have none. An eigenvector's largest component
    by size is positive. Repeated rows count as often as they come. Rows without id take part as any other.
    """
    rows = _rows(vectors, id_column, vector_column)
    sums = rows.select("x").mapInArrow(_sums, "k long, n long, s string").groupBy("k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("k").collect()
    if not sums:
        return rows.select(F.col("id").alias(id_column), F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), Whitening()
    n, s = sums[0]["n"], [int(r["s"]) for r in sums]
    d, splits = len(s), _splits(rows, sums[0]["n"], block_rows)
    mean = np.array([x // n for x in s], dtype=np.float64) + np.array([x % n / n for x in s])

    @F.arrow_udf("array<double>")
    def centred(x: pa.Array) -> pa.Array:
        m = _matrix(x) - mean
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * d, pa.int32()), pa.array(m.ravel()))

    @F.arrow_udf("long")
    def deviation(x: pa.Array) -> pa.Array:
        m = _matrix(x)
        most = max((max(abs(int(lo) * n - t), abs(int(hi) * n - t)) for lo, hi, t in zip(m.min(axis=0), m.max(axis=0), s, strict=True)), default=0) if len(m) else 0
        if most * most * d < 2**63 and all(abs(t) < 2**62 for t in s) and n * int(np.abs(m).max(initial=0)) < 2**62:
            y = m * n - np.array(s, dtype=np.int64)
            return pa.array((y * y).sum(axis=1))
        exact = [sum((n * int(c) - t) ** 2 for c, t in zip(r, s, strict=True)) for r in m]
        return pa.array([e if e < 2**63 else None for e in exact], pa.int64())

    a = _blocks(rows.select("index", centred("x").alias("centred")), n, d, block_rows)
    v = _scatter(a, splits) / n
    values, e = np.linalg.eigh((v + v.T) / 2)
    values, e = values[::-1], e[:, ::-1]
    k = min(components, int(np.sum(values > max(values[0], 0.0) * d * np.finfo(float).eps)))
    e = e[:, :k] * np.sign(e[np.abs(e[:, :k]).argmax(axis=0), np.arange(k)])
    fitted = Whitening(n, s, values[:k], e, float(np.trace(v)))
    named = rows.select("index", F.col("id").alias(id_column), deviation("x").alias("deviation"))
    if not k:
        return named.select(id_column, "deviation", F.array().cast("array<double>").alias("whitened")), fitted
    w = e / np.sqrt(values[:k])
    sc = rows.sparkSession.sparkContext
    right = BlockMatrix(sc.parallelize([((0, 0), Matrices.dense(d, k, w.ravel(order="F").tolist()))], 1), d, k)
    y = _times(a, right, 1).toIndexedRowMatrix()
    projected = callMLlibFunc("getIndexedRows", y._java_matrix_wrapper._java_model).select("index", vector_to_array("vector").alias("whitened"))
    return named.join(projected, "index").select("index", id_column, "deviation", "whitened"), fitted


def covariance(rows: DataFrame, n: int, block_rows: int = BLOCK_ROWS) -> np.ndarray:
    """The covariance of (index, whitened), divisor n, centred before it is multiplied."""
    mean = [r["m"] for r in rows.select(F.posexplode("whitened").alias("k", "c")).groupBy("k").agg(F.avg("c").alias("m")).orderBy("k").collect()]
    less = F.transform("whitened", lambda c, i: c - F.element_at(F.array(*[F.lit(m) for m in mean]), i + 1))
    a = _blocks(rows.select("index", less.alias("centred")), n, len(mean), block_rows)
    return _scatter(a, _splits(rows, n, block_rows)) / n


def whitened_components(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row for each usable vector and component: id, component from 1, n, deviation, whitened, explained, identity_error; see `whiten`."""
    rows, fitted = whiten(vectors, id_column, vector_column, components, block_rows)
    error = 0.0
    if len(fitted.values):
        rows = cut(rows)
        error = float(np.abs(covariance(rows, fitted.n, block_rows) - np.eye(len(fitted.values))).max())
    share = F.array(*[F.lit(float(x / fitted.trace)) for x in fitted.values]).cast("array<double>")
    each = rows.select(id_column, "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return each.select(
        id_column,
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(share, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
