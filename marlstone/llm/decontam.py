"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact check.

A window is as many consecutive words of a document as an item has. Windows and
items have 64-bit SimHash fingerprints of their words. Items are indexed by the
four 16-bit blocks of their fingerprint, each with every pattern of up to four
wrong bits: whatever is within 19 bits of an item agrees with it in a block but
for so many, so a lookup finds all items within the radius. Candidates are confirmed by the
weighted Jaccard similarity of 5-word shingles, weights being counts.

A window whose last ninth is other text has a similarity of 0.8 with the item
and a cosine of about 0.9 of words, so 9.2 +- 2.8 wrong bits are expected: a
chance of about 4e-4 that none of an item's windows at the threshold is within the radius.

Windows that hold no shingle of the benchmark have similarity 0 with every
item; they are skipped before fingerprints are made, which loses nothing.

Items are broadcast in chunks of bounded number and bytes; a larger benchmark
takes more passes over the documents instead of more memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, mix64, runs_of, steps, unused, words_of

SHINGLE, THRESHOLD, RADIUS = 5, 0.8, 19
CHUNK_ITEMS, CHUNK_BYTES = 1_000, 8_000_000
_BITS = 16
_PATTERNS = np.array([sum(1 << b for b in c) for e in range(RADIUS // 4 + 1) for c in combinations(range(_BITS), e)], dtype=np.uint16)
_cached: dict[int, Items] = {}


def fingerprints(h: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of the n word hashes from each start on."""
    bits = np.unpackbits(mix64(h).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    sums = np.zeros((len(h) + 1, 64), dtype=np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    votes = sums[np.minimum(starts + n, len(h))] - sums[starts]
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


def _grams(h: np.ndarray) -> np.ndarray:
    return runs_of(h, min(SHINGLE, len(h))) if len(h) else h


class Items:
    """One chunk of the benchmark, indexed."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for item_id, text in rows:
            b = np.frombuffer(text.encode(), dtype=np.uint8)
            h = words_of(b, np.array([0, len(b)]))[2]
            if len(h):
                self.ids.append(item_id)
                self.words.append(h)
        self.n = np.array([len(h) for h in self.words], dtype=np.int64)
        self.grams = [Counter(_grams(h).tolist()) for h in self.words]
        fp = np.array([fingerprints(h, np.array([0]), len(h))[0] for h in self.words], dtype=np.uint64)
        self.fp = fp
        # For each block: items by block value, as offsets and members.
        self.blocks = []
        for k in range(4):
            own = ((fp >> np.uint64(_BITS * k)) & np.uint64(0xFFFF)).astype(np.uint16)
            keys = (own[:, None] ^ _PATTERNS[None, :]).ravel()
            order = np.argsort(keys, kind="stable")
            self.blocks.append((np.searchsorted(keys[order], np.arange(1 << _BITS, dtype=np.int64), side="left"), np.searchsorted(keys[order], np.arange(1 << _BITS, dtype=np.int64), side="right"), (order // len(_PATTERNS)).astype(np.int32)))
        # Shingles by their length in words (short items are one short shingle), with the item lengths they stand for.
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, dict[int, list[int]]]] = {}
        for k in sorted({min(SHINGLE, int(n)) for n in self.n}):
            lengths: dict[int, set[int]] = {}
            for g, n in zip(self.grams, self.n.tolist(), strict=True):
                if min(SHINGLE, n) == k:
                    for x in g:
                        lengths.setdefault(x, set()).add(n)
            keys = np.array(sorted(lengths), dtype=np.uint64)
            seen = np.zeros(1 << 20, dtype=bool)
            seen[keys & np.uint64((1 << 20) - 1)] = True
            self.by_length[k] = (keys, seen, {x: sorted(v) for x, v in lengths.items()})

    def within(self, fp: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
        """(item, windows) for items of n words: the windows whose fingerprint is within the radius."""
        pairs = []
        for i in range(0, len(fp), 1024):
            own = fp[i : i + 1024]
            for k, (lo, hi, members) in enumerate(self.blocks):
                v = ((own >> np.uint64(_BITS * k)) & np.uint64(0xFFFF)).astype(np.int64)
                size = hi[v] - lo[v]
                w = np.repeat(np.arange(len(own)), size)
                item = members[np.arange(len(w)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[v], size)]
                near = (self.n[item] == n) & (np.bitwise_count(own[w] ^ self.fp[item]) <= RADIUS)
                pairs.append(item[near].astype(np.int64) * len(fp) + w[near] + i)
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        item = found // max(1, len(fp))
        for x in np.unique(item):
            yield int(x), found[item == x] % len(fp)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard of two bags."""
    both = sum(min(c, b[x]) for x, c in a.items() if x in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def _leaks(h: np.ndarray, hits: dict[int, list[int]], items: Items, threshold: float) -> Iterator[tuple[int, float, int, int]]:
    """(item, similarity, first word, words) of the best window of each item that reaches the threshold.

    ``hits`` has, by item length, the words at which a shingle of such an item begins.
    """
    for n, at in hits.items():
        size = min(n, len(h))
        k = min(SHINGLE, n)
        mark = np.zeros(len(h) + 1, dtype=np.int32)
        for p in at:
            mark[max(0, p - size + k)] += 1
            mark[min(p, len(h) - size) + 1] -= 1
        starts = np.flatnonzero(np.cumsum(mark[: len(h) - size + 1]) > 0)
        if not len(starts):
            continue
        lo, hi = starts[0], starts[-1] + size
        own = h[lo:hi]
        fp = fingerprints(own, starts - lo, size)
        g = runs_of(own, k)
        for item, windows in items.within(fp, n):
            best = (-1.0, 0)
            for w in windows.tolist():
                s = int(starts[w] - lo)
                sim = similarity(items.grams[item], Counter(g[s : s + size - k + 1].tolist()))
                if sim > best[0]:
                    best = (sim, int(starts[w]))
            if best[0] >= threshold:
                yield item, best[0], best[1], size


def _scan(rows: list[tuple[int, str]], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(rows))
        if key not in _cached:
            _cached.clear()
            _cached[key] = Items(rows)
        items = _cached[key]
        for batch in batches:
            ids = batch.column("doc_id")
            out: list[tuple] = []
            for a, _, data, offsets in steps(batch.column("text")):
                _, _, h, first = words_of(data, offsets)
                own = np.repeat(np.arange(len(first) - 1), np.diff(first))
                hits: dict[int, dict[int, list[int]]] = {}
                for k, (keys, seen, lengths) in items.by_length.items():
                    g = runs_of(h, k)
                    at = np.flatnonzero(seen[g & np.uint64((1 << 20) - 1)])
                    if not len(at) or not len(keys):
                        continue
                    at = at[own[at] == own[at + k - 1]]
                    at = at[keys[np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)] == g[at]]
                    for p in at.tolist():
                        d = int(own[p])
                        for n in lengths[int(g[p])]:
                            hits.setdefault(d, {}).setdefault(n, []).append(p - int(first[d]))
                for d, by_n in hits.items():
                    for item, sim, start, size in _leaks(h[first[d] : first[d + 1]], by_n, items, threshold):
                        out.append((ids[a + d].as_py(), items.ids[item], sim, start, size))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run


def _chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, in chunks of bounded number and bytes; one chunk at a time is on the driver."""
    chunk, size = [], 0
    for r in benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().toLocalIterator():
        if chunk and (len(chunk) >= CHUNK_ITEMS or size + len(r["text"]) > CHUNK_BYTES):
            yield chunk
            chunk, size = [], 0
        chunk.append((r["item_id"], r["text"]))
        size += len(r["text"])
    if chunk:
        yield chunk


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): the best window of each leaked item of each document.

    Words and shingles are as in near-duplicate detection: A-Z lower-cased,
    five words, a shorter item is one shingle of all its words. Null or empty
    items and texts match nothing; a document shorter than an item is one
    window. Repeated rows count once; rows without doc_id report a null id.
    """
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    parts, chunks = [], _chunks(benchmark)
    chunk = next(chunks, None)
    while chunk:
        found, chunk = texts.mapInArrow(_scan(chunk, threshold), schema), next(chunks, None)
        # A finished chunk leaves the driver.
        parts.append(cut(found) if parts or chunk else found)
    if not parts:
        return texts.sparkSession.createDataFrame([], schema)
    best = Window.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "first_word", "n_words")
    return reduce(DataFrame.unionByName, parts).withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The ids of documents with a leaked item."""
    return contamination(docs, benchmark, threshold).filter("doc_id is not null").select("doc_id").distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without documents that hold a benchmark item; all columns stay.

    Rows without doc_id are looked at by their text. Null and empty texts stay, repeated rows
    go or stay together, an empty table or benchmark drops nothing. doc_id must be a number.
    """
    left = docs.join(contaminated(docs, benchmark, threshold), "doc_id", "left_anti")
    nameless = docs.filter("doc_id is null")
    if nameless.isEmpty():
        return left
    key = unused(docs, "text_key")
    keyed = nameless.withColumn(key, F.xxhash64("text"))
    bad = contaminated(keyed.select(F.col(key).alias("doc_id"), "text"), benchmark, threshold).withColumnRenamed("doc_id", key)
    return left.filter("doc_id is not null").unionByName(keyed.join(bad, key, "left_anti").drop(key))
