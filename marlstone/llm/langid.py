"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (1 to 3 characters of
the lower-cased text, by UTF-8 code point). Weights are trained with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), and a
softmax temperature is fitted on held-back rows. Document frequencies are
counted over all training documents; the regression uses at most `MAX_ROWS`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _LOWER, cut, mix64, steps, unused

BUCKETS, ORDERS = 1 << 13, (1, 2, 3)
#: Rows the regression is fitted on, in turn of each language by hash order; a fifth of them sets the temperature.
MAX_ROWS = 4_000
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.02, 3


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x BUCKETS counts of n-grams; runs of white space, digits and marks other than letters count as one blank."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, BUCKETS), dtype=np.float32)
    b = _LOWER[data]
    letter = ((b >= 97) & (b <= 122)) | (b >= 128)
    b = np.where(letter, b, 32).astype(np.uint64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    # Code points as integers: bytes folded from each lead byte on.
    size = np.diff(np.append(lead, len(data)))
    code = b[lead].copy()
    for k in (1, 2, 3):
        more = size > k
        code[more] = code[more] * np.uint64(256) + b[lead[more] + k]
    own = np.searchsorted(offsets, lead, side="right") - 1
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (own[1:] != own[:-1])
    code, own = code[keep], own[keep]
    out = np.zeros(n * BUCKETS, dtype=np.float32)
    h = np.zeros(len(code), dtype=np.uint64)
    for k in range(max(ORDERS)):
        m = len(code) - k
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + code[k:]
        inside = own[:m] == own[k:]
        x = (mix64(h + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int64) + own[:m] * BUCKETS
        out += np.bincount(x[inside], minlength=n * BUCKETS).astype(np.float32)
    return out.reshape(n, BUCKETS)


def _small(data: np.ndarray, offsets: np.ndarray, rows: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(first text, counts) of at most ``rows`` texts at a time."""
    for i in range(0, len(offsets) - 1, rows):
        own = offsets[i : i + rows + 1]
        yield i, _counts(data[own[0] : own[-1]], own - own[0])


def _doc_freq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for _, _, data, offsets in steps(batch.column("text")):
            for _, c in _small(data, offsets):
                df += (c > 0).sum(axis=0)
                n += len(c)
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bucket", "n"])


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def _sparse(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, val = [], []
            for _, _, data, offsets in steps(batch.column("text")):
                for _, c in _small(data, offsets):
                    for x in _vectors(c, idf):
                        nz = np.flatnonzero(x)
                        at.append(nz.astype(np.int32))
                        val.append(x[nz].astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(at, pa.list_(pa.int32())), pa.array(val, pa.list_(pa.float32()))], names=["lang", "at", "val"])

    return run


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias of k classes by follow-the-regularised-leader with elastic net."""
    z, n = np.zeros((BUCKETS + 1, k)), np.zeros((BUCKETS + 1, k))

    def solve(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            y, at, val = rows[i]
            at, val = np.append(at, BUCKETS), np.append(val, 0.5)  # the last coordinate is the bias
            w = solve(at)
            p = _softmax(val @ w)
            p[y] -= 1
            g = val[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = solve(np.arange(BUCKETS + 1))
    return w[:BUCKETS].astype(np.float32), 0.5 * w[BUCKETS]


def fit(docs: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Train on ``docs`` (text, lang); rows without either are skipped.

    Collects document frequencies (a row a bucket) and at most ``max_rows``
    sparse vectors. With one language everything is of that language; with none
    everything is undetermined.
    """
    known = docs.filter("text is not null and lang is not null").select("doc_id", "text", "lang")
    df = np.zeros(BUCKETS)
    total = 0
    for r in known.select("text").mapInArrow(_doc_freq, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            total = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    # Different rows only: a doc_id that a third of all rows share is learned from once for each of its texts.
    marked = known.withColumn("h", F.xxhash64("doc_id", "lang", "text"))
    # Languages take turns, so that a rare one is learned from too; of each only ``max_rows`` rows can be wanted.
    turn = Window.partitionBy("lang").orderBy("k", "h")
    rows = marked.select("h", "lang", F.xxhash64(F.lit("sample"), "h").alias("k")).distinct().withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= max_rows)
    chosen = cut(rows.orderBy("turn", "k", "h").limit(max_rows).select("h"))
    sample = marked.join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("lang").alias("lang"))
    sample = sample.select("text", "lang").mapInArrow(_sparse(idf), "lang string, at array<int>, val array<float>")
    got = sample.collect()
    langs = sorted({r["lang"] for r in got})
    if len(langs) < 2:
        return Model(langs, idf, np.zeros((BUCKETS, max(1, len(langs))), dtype=np.float32), np.zeros(max(1, len(langs))), 1.0)
    rows = sorted(((langs.index(r["lang"]), np.array(r["at"], dtype=np.int64), np.array(r["val"])) for r in got), key=lambda r: (r[0], len(r[1]), float(r[2].sum())))
    held = rows[::5]
    w, bias = _ftrl([r for i, r in enumerate(rows) if i % 5], len(langs))
    logits = np.array([v @ w[at] + bias for _, at, v in held])
    truth = np.array([y for y, _, _ in held])
    grid = np.geomspace(0.05, 10, 60)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in grid]
    return Model(langs, idf, w, bias, float(grid[int(np.argmin(loss))]))


def predict(model: Model):
    """Column function text -> struct(lang, score)."""

    @F.arrow_udf("struct<lang string, score double>")
    def run(text: pa.Array) -> pa.Array:
        lang, score = [], []
        for _, _, data, offsets in steps(text):
            for _, c in _small(data, offsets):
                p = _softmax((_vectors(c, model.idf) @ model.weights + model.bias).astype(np.float64) / model.temperature)
                best = p.argmax(axis=1)
                lang += [model.langs[i] for i in best]
                score += p[np.arange(len(best)), best].tolist()
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["lang", "score"])

    return run


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score; `und` and 0 for null texts and texts without a letter."""
    seen = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    if not model.langs:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0))
    found = unused(docs, "found")
    out = docs.withColumn(found, F.when(seen, predict(model)("text")))
    return out.withColumn("lang_pred", F.coalesce(F.col(found)["lang"], F.lit("und"))).withColumn("score", F.coalesce(F.col(found)["score"], F.lit(0.0))).drop(found)


def held_out_languages(docs: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; rows whose crc32 fold is 1 are not learned from.

    Rows without doc_id are in no fold and neither learned from nor held out.
    Repeated rows come out as often; other columns are ignored.
    """
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    held = F.coalesce(fold == 1, F.lit(False))
    model = fit(docs.filter("doc_id is not null").filter(~held), max_rows)
    return identify(docs.select("doc_id", "text").withColumn("held_out", held), model).select("doc_id", "held_out", "lang_pred", "score")
