"""Duplicate listings: layered comparison and an exact, blocked similarity join of titles.

A title pair can only reach the review threshold by Dice of trigrams or by
overlap of tokens, so pairs are found by prefix filtering: of each title only
the rarest trigrams (and, as the smaller side of an overlap, the rarest tokens)
are joined, as many as make sure that a qualifying pair shares one. Records
with the same normalised title are one title here, whatever their number.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.layout import checkpointed
from ..functions.text import dice, normalise_title, overlap, title_tokens, trigrams

MERGE, REVIEW, TOKEN_WEIGHT = 0.9, 0.75, 0.95


def _ranked(titles: DataFrame, items: str) -> DataFrame:
    """(title, n, item, rank): each title's items, the rarest of the corpus first."""
    rows = titles.select("title", F.size(items).alias("n"), F.explode(items).alias("item"))
    rarity = rows.groupBy("item").agg(F.count(F.lit(1)).alias("df"))
    w = Window.partitionBy("title").orderBy("df", "item")
    return rows.join(rarity, "item").select("title", "n", "item", F.row_number().over(w).alias("rank"))


def similar_titles(titles: DataFrame, threshold: float = REVIEW) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of distinct normalised titles that reach the threshold.

    ``titles`` has the column title, already normalised. Nothing is missed.
    """
    # Written once: else filters on what is exploded are moved below the distinct, and every record's grams are made for each use.
    t = checkpointed(titles.select("title").distinct().withColumns({"grams": trigrams(F.col("title")), "tokens": title_tokens(F.col("title"))}))
    grams, tokens = _ranked(t, "grams"), _ranked(t, "tokens")
    # Dice >= t needs an overlap of t/(2-t) of either side, so it shows among the first n - ceil(...) + 1 grams of both.
    head = grams.filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(threshold / (2 - threshold)) * F.col("n")) + 1)
    x = head.select(F.col("title").alias("a"), "item", F.col("n").alias("na")).join(head.select(F.col("title").alias("b"), "item", F.col("n").alias("nb")), "item")
    near = x.filter((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.lit(threshold / (2 - threshold)) * F.greatest("na", "nb"))).select("a", "b")
    # Overlap needs a part of the smaller side, which shows among its rarest tokens; the larger side keeps all of its.
    part = threshold / TOKEN_WEIGHT
    small = tokens.filter(F.col("rank") <= F.col("n") - F.ceil(F.lit(part) * F.col("n")) + 1).select(F.col("title").alias("s"), "item", F.col("n").alias("ns"))
    y = small.join(tokens.select(F.col("title").alias("l"), "item", F.col("n").alias("nl")), "item").filter((F.col("ns") <= F.col("nl")) & (F.col("s") != F.col("l")))
    pairs = near.unionByName(y.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b"))).distinct()
    side = lambda n: t.select(F.col("title").alias(n), F.col("grams").alias(f"g{n}"), F.col("tokens").alias(f"t{n}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    sim = F.greatest(dice(F.col("ga"), F.col("gb")), overlap(F.col("ta"), F.col("tb")) * TOKEN_WEIGHT)
    return full.select("a", "b", sim.alias("similarity")).filter(F.col("similarity") >= threshold)


def verdict(same_cycle: Column, same_url: Column, same_hash: Column, same_org: Column, similarity: Column) -> Column:
    """SAME, REVIEW or DIFFERENT; different cycles are different records before anything else."""
    return (
        F.when(~same_cycle, "DIFFERENT")
        .when(same_url | same_hash, "SAME")
        .when(same_org & (similarity >= MERGE), "SAME")
        .when(similarity >= REVIEW, "REVIEW")
        .otherwise("DIFFERENT")
    )


def prepared(records: DataFrame) -> DataFrame:
    """Records (id, pos, url, hash, title, org, cycle) with the normalised title; empty strings count as missing."""
    gone = lambda c: F.nullif(F.col(c), F.lit(""))
    return records.select("id", "pos", gone("url").alias("url"), gone("hash").alias("hash"), normalise_title(F.col("title")).alias("norm"), gone("org").alias("org"), "cycle")


def _all_titles(a: DataFrame, b: DataFrame) -> DataFrame:
    """(x, y, similarity) in both directions, and each title with itself."""
    titles = a.select(F.col("norm").alias("title")).unionByName(b.select(F.col("norm").alias("title"))).distinct()
    sim = similar_titles(titles)
    return sim.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionByName(sim.select(F.col("b").alias("x"), F.col("a").alias("y"), "similarity")).unionByName(titles.select(F.col("title").alias("x"), F.col("title").alias("y"), F.lit(1.0).alias("similarity")))


def _same_cycle(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(True))


def _ways(incoming: DataFrame, corpus: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """The ways in which prepared records can be duplicates: what a way looks at besides the cycle, and (that, cycle, corpus_pos, similarity, verdict).

    Records alike in these columns are one row here, and so are those of the corpus, so a title that thousands of records share
    costs one row a cycle, and one an organiser and cycle where organisers count. REVIEW rows look at all organisers: where their
    lowest position is one that is SAME, the SAME row is there too, and comes first.
    """
    asked = lambda *by: incoming.select(*by, "cycle").distinct()
    group = lambda *by: corpus.groupBy(*by, F.col("cycle").alias("c_cycle")).agg(F.min("pos").alias("corpus_pos"))
    fits = _same_cycle("cycle", "c_cycle")

    def way(by: list[str], rows: DataFrame, similarity: Column, verdict: str) -> tuple[list[str], DataFrame]:
        return by, rows.filter(fits).select(*by, "cycle", "corpus_pos", similarity.alias("similarity"), F.lit(verdict).alias("verdict"))

    titles = checkpointed(_all_titles(incoming, corpus)).withColumnRenamed("x", "norm")
    other = lambda *by: group(*by).withColumnRenamed("norm", "y")
    return [
        *[way([by], asked(by).join(group(by), by), F.lit(1.0), "SAME") for by in ("url", "hash")],
        way(["norm", "org"], asked("norm", "org").join(titles.filter(F.col("similarity") >= MERGE), "norm").join(other("norm", "org"), ["y", "org"]), F.col("similarity"), "SAME"),
        way(["norm"], asked("norm").join(titles, "norm").join(other("norm"), "y"), F.col("similarity"), "REVIEW"),
    ]


def _told(incoming: DataFrame, by: list[str], table: DataFrame, how: str = "inner") -> DataFrame:
    """Records next to their rows of ``table``, which has what the way looks at and the cycle."""
    keys = [*by, "cycle"]
    same = [F.col(c).eqNullSafe(F.col(f"way_{c}")) if c == "cycle" else F.col(c) == F.col(f"way_{c}") for c in keys]
    return incoming.join(table.withColumnsRenamed({c: f"way_{c}" for c in keys}), same, how).drop(*[f"way_{c}" for c in keys])


def candidates(incoming: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, corpus_pos, similarity, verdict): for each incoming record the lowest corpus positions of every way in which it can be a duplicate."""
    i = prepared(incoming)
    rows = [_told(i, by, table).select("id", "corpus_pos", "similarity", "verdict") for by, table in _ways(i, prepared(corpus))]
    return functools.reduce(DataFrame.unionByName, rows)


def find_duplicate(incoming: DataFrame, corpus: DataFrame) -> DataFrame:
    """Best match per incoming record: largest similarity, then lowest corpus position; SAME before REVIEW of one candidate."""
    i, bests = prepared(incoming), []
    out = i.select("id", "url", "hash", "norm", "org", "cycle")
    for k, (by, table) in enumerate(_ways(i, prepared(corpus))):
        one = F.struct((-F.col("similarity")).alias("falling"), "corpus_pos", (F.col("verdict") != "SAME").alias("review"))
        out = _told(out, by, table.groupBy(*by, "cycle").agg(F.min(one).alias(f"best_{k}")), "left")
        bests.append(f"best_{k}")
    best = F.array_min(F.filter(F.array(*bests), lambda x: x.isNotNull()))
    # One row an id, whatever ids records have.
    rows = out.select("id", best.alias("b")).filter("b is not null").groupBy("id").agg(F.min("b").alias("b"))
    return rows.select("id", "b.corpus_pos", (-F.col("b.falling")).alias("similarity"), F.when(F.col("b.review"), "REVIEW").otherwise("SAME").alias("verdict"))


def _first(i: DataFrame, corpus: DataFrame) -> DataFrame:
    """Prepared records with the position of the first SAME, and whether some candidate is near."""
    names = []
    for k, (by, table) in enumerate(_ways(i, corpus)):
        i = _told(i, by, table.groupBy(*by, "cycle").agg(F.min("corpus_pos").alias(f"first_{k}")), "left")
        names.append(f"first_{k}")
    *same, review = names
    return i.withColumns({"merge_into": F.least(*same), "near": F.col(review).isNotNull()}).drop(*names)


def first_same(incoming: DataFrame, corpus: DataFrame) -> DataFrame:
    """Ingest rule: the first SAME by corpus position is merged into; without one, any REVIEW sends the record to review."""
    out = _first(prepared(incoming), prepared(corpus))
    status = F.when(F.col("merge_into").isNotNull(), "merged").when(F.col("near"), "review").otherwise("created")
    return out.select("id", "merge_into", status.alias("status"))


def batch_representatives(batch: DataFrame) -> DataFrame:
    """Within one batch: each record's lowest-position SAME partner before it, or none. One hop, as a batch has no order of its own.

    A record is its own candidate too, so the lowest position of all is looked at.
    """
    b = prepared(batch)
    return _first(b, b).select("id", F.when(F.col("merge_into") < F.col("pos"), F.col("merge_into")).alias("merge_into"))


def verification_state(has_title: Column, has_deadline: Column, title_method: Column, deadline_method: Column, official: Column, needs_human: Column) -> Column:
    markup = F.coalesce((title_method == "STRUCTURED_MARKUP") & (deadline_method == "STRUCTURED_MARKUP"), F.lit(False))
    return (
        F.when(needs_human, "NEEDS_REVIEW")
        .when(official & markup, "RECENTLY_VERIFIED")
        .when(~has_deadline | ~has_title, "UNVERIFIED")
        .when(official, "RECENTLY_VERIFIED")
        .otherwise("NEEDS_REVIEW")
    )
