"""Substring dedup by sliding sentence spans.

A text is a row of sentences. Of a sentence of more than `PLAIN` words, parts that its own words
bound are taken as sentences: a part begins at each word pair whose hash is the least of some `WINDOW` in a row, so
the same words are cut in the same places wherever they stand. Shorter sentences are never cut.

A span is a run of at least `SENTENCES` consecutive sentences with at least `WORDS` words: from each
sentence on the shortest such run, and up to each sentence the shortest such run. Every longer run that repeats is made of
such runs, so all runs count. Spans are hashed and met globally; every occurrence but the first, by doc_id and
position, covers its sentences, and covered sentences are removed. What texts share in less than a span, a line
or a name, is left alone.

A passage may begin and end inside sentences: any 51 words that repeat another 51, to the letter, hold a span, as at
most `PLAIN` words at its beginning and `WINDOW` + 1 at its end have bounds that depend on what stands around them, and the shortest
span from a bound has at most `WORDS` - 1 + `PLAIN` words.

Within an Arrow batch only the first occurrence of a hash goes to the shuffle,
later ones are known to be repeats at once. A passage that a third of all
documents share thus sends one row a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _MULT, mix64, steps, unused, words_of

#: Sentences and words of a span at least, words of a sentence that is never cut at most, words in a row one of which begins a part of a longer one.
SENTENCES, WORDS, PLAIN, WINDOW = 2, 15, 12, 12
_Q = np.uint64(0xD1342543DE82EF95)
_QINV = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
#: What ends a sentence, and what may close after it.
STOPS, CLOSERS = ".!?…。！？؟۔।", ")]\"'“”’»"


def _at_end(data: np.ndarray, ends: np.ndarray, marks: str) -> np.ndarray:
    """Bytes of the mark that ends before each position, 0 where none does."""
    size = np.zeros(len(ends), dtype=np.int64)
    for mark in marks:
        b = mark.encode()
        same = ends >= len(b)
        for k, x in enumerate(b):
            same &= data[np.maximum(ends - len(b) + k, 0)] == x
        size[same] = len(b)
    return size


def sentences(data: np.ndarray, offsets: np.ndarray):
    """Words, the word index at which each sentence begins (plus the total), and each text's first sentence.

    A sentence ends after a word that ends in a stop, up to two closing marks
    behind it not counted, and before a line feed.
    """
    starts, ends, h, first = words_of(data, offsets)
    m = len(starts)
    if not m:
        return starts, ends, h, np.zeros(1, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    begins = np.zeros(m, dtype=bool)
    begins[first[:-1][first[:-1] < m]] = True
    # Only words that do not end in a letter or digit of ASCII can end in a mark.
    last = data[ends - 1] | 32
    odd = np.flatnonzero(~(((last >= 97) & (last <= 122)) | ((last >= 48) & (last <= 57))))
    at = ends[odd]
    for _ in range(2):
        at = at - _at_end(data, at, CLOSERS)
    stop = odd[(at > starts[odd]) & (_at_end(data, at, STOPS) > 0)]
    begins[stop[stop < m - 1] + 1] = True
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    begins[1:] |= feeds[starts[1:]] > feeds[ends[:-1]]
    sent = np.flatnonzero(begins)
    return starts, ends, h, np.append(sent, m), np.searchsorted(sent, first)


def parted(h: np.ndarray, sent: np.ndarray, first_sentence: np.ndarray, plain: int = PLAIN, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Sentences as `sentences` gives them, those of more than ``plain`` words in parts."""
    n = len(h)
    if len(sent) < 2 or not (np.diff(sent) > plain).any():
        return sent, first_sentence
    of = np.repeat(np.arange(len(sent) - 1), np.diff(sent))
    after = np.append(h[1:], np.uint64(0))
    after[sent[1:] - 1] = 0  # pairs stay within their sentence
    pair = mix64(h + after * _MULT[1])
    # Where a window would go over the end of its sentence, no choice is made.
    least = np.full(max(n - window + 1, 0), np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(window):
        np.minimum(least, pair[k : k + len(least)], out=least)
    inside = np.zeros(n, dtype=bool)
    if len(least):
        inside[: len(least)] = of[: len(least)] == of[window - 1 :]
    begins = np.zeros(n, dtype=bool)
    for k in range(window):
        m = len(least)
        begins[k : k + m] |= inside[:m] & (pair[k : k + m] == least)
    begins &= (np.diff(sent) > plain)[of]
    begins[sent[:-1]] = True
    parts = np.flatnonzero(begins)
    return np.append(parts, n), np.searchsorted(parts, sent[first_sentence])


def _spans(h: np.ndarray, sent: np.ndarray, first_sentence: np.ndarray, words: int = WORDS):
    """(text, first sentence, sentence after the last, hash) of all spans; sentences count from 0 in their text."""
    n = len(sent) - 1
    if n <= 0:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, np.zeros(0, dtype=np.uint64)
    text = np.repeat(np.arange(len(first_sentence) - 1), np.diff(first_sentence))
    begin, stop = sent[:-1], sent[1:]
    i = np.arange(n)
    upto = np.maximum(i + SENTENCES, np.searchsorted(sent, begin + words))
    good = upto <= first_sentence[text + 1]
    back = np.minimum(i + 1 - SENTENCES, np.searchsorted(sent, stop - words, side="right") - 1)
    fine = (back >= first_sentence[text]) & (stop >= words)
    a = np.concatenate([i[good], back[fine]])
    b = np.concatenate([upto[good], i[fine] + 1])
    # Each span once.
    both = np.unique(a * (n + 1) + b)
    a, b = both // (n + 1), both % (n + 1)
    x = _hashes(h, sent[a], sent[b])
    t = text[a] if len(a) else a
    return t, a - first_sentence[t], b - first_sentence[t], x


def _hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of the words from a to b - 1, from running sums."""
    p = np.full(len(h) + 1, _Q, dtype=np.uint64)
    p[0] = 1
    np.multiply.accumulate(p, out=p)
    q = np.full(len(h) + 1, _QINV, dtype=np.uint64)
    q[0] = 1
    np.multiply.accumulate(q, out=q)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * p[:-1], dtype=np.uint64)])
    return mix64((sums[b] - sums[a]) * q[a] + (b - a).astype(np.uint64) * _MULT[0])


def _span_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id").to_numpy(), batch.column("text_key").to_numpy()
            parts = []
            for r, _, data, offsets in steps(batch.column("text")):
                _, _, h, sent, firsts = sentences(data, offsets)
                t, a, b, x = _spans(h, *parted(h, sent, firsts), words)
                parts.append((ids[r + t], texts[r + t], a, b, x))
            if not parts:
                continue
            d, own, a, b, x = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((a, own, d, x))
            new = np.ones(len(x), dtype=bool)
            new[1:] = x[order[1:]] != x[order[:-1]]
            head = np.zeros(len(x), dtype=np.int64)
            head[order] = order[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(x) else 0
            repeat = (d != d[head]) | (own != own[head]) | (a != a[head])
            # A known repeat needs no meeting: it gets a key of its own.
            key = np.where(repeat, mix64(x ^ mix64(d.astype(np.uint64) * _Q + a.astype(np.uint64) + own.astype(np.uint64))), x).astype(np.int64)
            # Most of what is shuffled are these rows: the place is one number, as a span has at most max(WORDS, SENTENCES)
            # sentences, and a text's rows stay together, where they compress well.
            place = (a << 17) | ((b - a) << 1) | repeat
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(d), pa.array(own), pa.array(place)], names=["h", "doc_id", "text_key", "place"])

    return run


def repeated_spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, text_key, span): of the text of that key, the hash of doc_id's text, span & 65535 sentences from span >> 16 on repeat an earlier span."""
    texts = docs.filter("text is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    spans = texts.mapInArrow(_span_rows(words), "h long, doc_id long, text_key long, place long")
    a = F.shiftright("place", 17)
    turn = F.dense_rank().over(Window.partitionBy("h").orderBy("doc_id", "text_key", a))
    again = spans.withColumn("turn", turn).filter("place & 1 = 1 or turn > 1")
    return again.select("doc_id", "text_key", F.shiftright("place", 1).alias("span"))


def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    kept, total, gone = [], [], []
    size = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, ends = spans.flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
    for r, e, data, offsets in steps(text):
        starts, _, h, sent, firsts = sentences(data, offsets)
        part, first_parts = parted(h, sent, firsts)
        for i in range(e - r):
            lo, hi = int(first_parts[i]), int(first_parts[i + 1])
            total.append(int(firsts[i + 1] - firsts[i]))
            own = flat[ends[r + i] - size[r + i] : ends[r + i]]
            edge = np.zeros(hi - lo + 1, dtype=np.int64)
            np.add.at(edge, own >> 16, 1)
            np.add.at(edge, (own >> 16) + (own & 65535), -1)
            drop = np.cumsum(edge)[:-1] > 0
            if not drop.any():
                gone.append(0)
                kept.append(data[offsets[i] : offsets[i + 1]].tobytes().decode())
                continue
            at = part[lo:hi][drop]  # first words of what goes, and so the sentences that lose it
            gone.append(len(np.unique(np.searchsorted(sent, at, side="right"))))
            edges = np.append(starts[part[lo:hi]], offsets[i + 1])
            edges[0] = offsets[i]
            turns = np.flatnonzero(np.diff(np.concatenate([[True], drop, [True]]).astype(np.int8))).reshape(-1, 2)
            kept.append(b"".join(data[edges[j] : edges[k]].tobytes() for j, k in turns).decode())
    return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["text", "n_sentences", "n_removed"])


def dedup_substrings(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per input row: ``docs`` with repeated passages cut from ``text``, plus n_sentences and n_removed, the sentences that go, wholly or in part.

    The first occurrence, by doc_id (a number) and position, stays; spans have ``words`` words at least. A text whose every
    sentence repeats becomes empty. Null texts stay null, texts without words
    and rows without doc_id stay as they are. Rows of one doc_id and text are one
    document; other texts of that doc_id are documents of their own, in no order that matters. Input columns named n_sentences or n_removed are replaced.
    """
    rest = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    spans, key, result = unused(docs, "spans_to_cut"), unused(docs, "text_key"), unused(docs, "cut_result")
    cuts = repeated_spans(docs, words).groupBy("doc_id", F.col("text_key").alias(key)).agg(F.collect_set("span").alias(spans))
    cuts = cuts.withColumnRenamed("doc_id", own := unused(docs, "doc_of_spans"))
    without = F.arrow_udf(_without, "struct<text string, n_sentences long, n_removed long>")
    keyed = docs.select(*rest).withColumn(key, F.xxhash64("text"))
    out = keyed.join(cuts.withColumnRenamed(key, f"{key}_"), (F.col("doc_id") == F.col(own)) & (F.col(key) == F.col(f"{key}_")), "left").withColumn(result, without("text", spans))
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col(result)["text"]))
    return out.select(*rest, F.col(result)["n_sentences"].alias("n_sentences"), F.col(result)["n_removed"].alias("n_removed"))
