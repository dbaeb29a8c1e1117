"""Quality classifier by importance resampling.

Two generative models over hashed word unigrams and bigrams - one of labelled
good text (the target), one of all text (raw) - give each document the log ratio
of its probabilities. The log importance weight is that ratio, tempered by
`LENGTH` / (features + `SHRINK`): as if every text had `LENGTH` features, so that long
texts do not outweigh all others. A document is selected by Gumbel top-k: weight
plus standard Gumbel noise of its doc_id, the k largest of all documents, which
samples k documents without replacement in proportion to their weights. k is the
number of documents whose weight reaches the level that all but `LOSS` of the
held-back labelled good documents reach. Where weights lie far apart, as those of prose
and of junk do, noise of this scale turns the choice of few documents only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, runs_of, steps, unused, weighted_cut, words_of

#: Hash buckets of a model, additive smoothing, shrinkage in features, features of the scale.
BUCKETS, SMOOTHING, SHRINK, LENGTH = 1 << 16, 1.0, 50, 500
#: Share of held-back good documents that may score under the level.
LOSS = 0.0025
#: Labelled rows that are used, by hash order; a quarter of them is held back.
MAX_LABELS = 20_000
#: Keys of the cut: (OFFSET - score) * SCALE stays under 2**48.
OFFSET, SCALE = 100_000.0, float(1 << 30)


@dataclass
class Model:
    log_ratio: np.ndarray
    level: float


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and word pairs of some texts, and the text of each."""
    _, _, h, first = words_of(data, offsets)
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs = runs_of(h, 2)
    same = own[1:] == own[:-1]
    return (np.concatenate([h, pairs[same]]) & np.uint64(BUCKETS - 1)).astype(np.int64), np.concatenate([own, own[1:][same]])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, good = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
    for batch in batches:
        is_good = batch.column("good").fill_null(False).to_numpy(zero_copy_only=False)
        for a, b, data, offsets in steps(batch.column("text")):
            f, own = _features(data, offsets)
            raw += np.bincount(f, minlength=BUCKETS)
            if is_good[a:b].any():
                good += np.bincount(f[is_good[a:b][own]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(good[at])], names=["bucket", "raw", "good"])


def log_weight(log_ratio: np.ndarray):
    """Column function text -> log importance weight; null and empty texts have 0."""

    @F.arrow_udf("double")
    def weigh(text: pa.Array) -> pa.Array:
        out = np.zeros(len(text))
        for a, b, data, offsets in steps(text):
            f, own = _features(data, offsets)
            out[a:b] = LENGTH * np.bincount(own, weights=log_ratio[f], minlength=b - a) / (np.bincount(own, minlength=b - a) + SHRINK)
        return pa.array(out)

    return weigh


def _labelled(labels: DataFrame, max_labels: int) -> DataFrame:
    """(doc_id, quality, held) of at most ``max_labels`` labelled documents; the worst of repeated labels counts."""
    one = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels).withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(4)) == 0)


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> tuple[Model, DataFrame]:
    """The model, and (doc_id, log_weight) of every document.

    The raw model counts all words of all documents. The join broadcasts at
    most ``max_labels`` rows of two numbers. Without labelled good documents
    the level is minus infinity and every document passes.
    """
    known = cut(_labelled(labels, max_labels))
    marked = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
    counts = marked.select("text", (F.col("quality") == 1).__and__(~F.col("held")).alias("good")).mapInArrow(_count, "bucket long, raw long, good long")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good")).collect()
    raw, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in rows:
        raw[r["bucket"]], good[r["bucket"]] = r["raw"], r["good"]
    share = lambda c: np.log((c + SMOOTHING) / (c.sum() + SMOOTHING * BUCKETS))
    log_ratio = share(good) - share(raw)
    scored = cut(docs.select("doc_id", log_weight(log_ratio)("text").alias("log_weight")))
    # One weight a label, the least of its rows, so at most ``max_labels`` however often a doc_id comes.
    own = scored.join(F.broadcast(known.filter("held and quality = 1")), "doc_id").groupBy("doc_id").agg(F.min("log_weight").alias("w"))
    held = sorted(r["w"] for r in own.select("w").collect())
    level = held[math.floor(LOSS * len(held))] if held and good.sum() else -math.inf
    return Model(log_ratio, level), scored


def gumbel_key(seed: int = 29, weight: str = "log_weight"):
    """The cut key of (doc_id, log_weight): the larger weight plus noise, the smaller the key."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    score = F.col(weight) - F.log(-F.log(u))
    return F.greatest(F.lit(0.0), (F.lit(OFFSET) - score) * F.lit(SCALE)).cast("long")


def resample(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """One row per input row: doc_id, log_weight, kept.

    Null and empty texts weigh 0. Documents that tie with the last one of the
    top k (repeated rows have equal keys) are kept with it. An empty table gives
    no rows; extra columns are ignored.
    """
    model, scored = fit(docs, labels, max_labels)
    return scored.withColumn("k", gumbel_key()).withColumn("kept", F.col("k") <= F.lit(_limit(model, scored))).drop("k")


def _limit(model: Model, scored: DataFrame) -> int:
    k = scored.filter(F.col("log_weight") >= F.lit(model.level)).count()
    limit = weighted_cut(scored.select(gumbel_key().alias("k")), "k", None, k - 1) if k else -1
    return 1 << 62 if limit is None else limit


def keep_selected(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """The selected rows of ``docs`` with all their columns; texts are weighed again instead of shuffled.

    Null and empty texts weigh 0. Rows of one doc_id and text are kept or dropped together,
    and so are ties at the cut. An empty table gives no rows; without labels of good documents all stay.
    """
    model, scored = fit(docs, labels, max_labels)
    limit = _limit(model, scored)
    name = unused(docs, "log_weight")
    marked = docs.withColumn(name, log_weight(model.log_ratio)("text"))
    return marked.filter(gumbel_key(weight=name) <= F.lit(limit)).drop(name)
