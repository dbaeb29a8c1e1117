"""Merkle dataset manifest by butterfly exchange.

A leaf is the hash of a row's columns. The leaves of a group (a language) are in order of
a key, every `FANOUT` consecutive nodes have a parent, up to the group's
root; the groups' roots form a tree of the same kind. A node is hashed from the hexadecimal
digests below it.

Leaves get their place by a range sort and the counts of earlier ranges, so a group of any
size is spread over all tasks. Aligned blocks of `FANOUT` ** `BLOCK_LEVELS` leaves are then the partitions
of the exchange: a block hashes its subtree by itself. In every round the blocks below
the children of one node swap these children's digests: block j of each child meets
block j of the others, at most `FANOUT` digests in one place, and each hashes the parent
for itself. So a block knows the digests beside its own path from the start, and nothing is sent
down. Children of unlike size (the last of a level, groups) meet in the same way: a smaller one's blocks
answer in turn for the places that it lacks.

At the end each block has the upper part of all its leaves' proofs, and adds the lower part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

FANOUT, BLOCK_LEVELS = 8, 3
_PROOF = "array<struct<place int, siblings string>>"


def row_leaf(columns: list[Column]) -> Column:
    """The leaf of a row: SHA-256 of its columns in order, each `-` if null, else UTF-8 byte count, `:`, value."""
    fields = []
    for c in columns:
        s = c.cast("string")
        fields.append(F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)))
    return F.sha2(F.concat(*fields), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's hexadecimal digest and a proof lead to."""

    def up(node: Column, step: Column) -> Column:
        at = step["place"] * 64
        return F.sha2(F.concat(step["siblings"].substr(F.lit(1), at), node, step["siblings"].substr(at + 1, F.length(step["siblings"]))), 256)

    return F.aggregate(proof, leaf, up)


def _parent(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _tree(leaves: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """All levels of nodes over some leaves, as many as given, or up to a single node."""
    out = [leaves]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        last = out[-1]
        out.append([_parent(last[i : i + fanout]) for i in range(0, len(last), fanout)])
    return out


def _blocks(batches: Iterator[pa.RecordBatch], first) -> Iterator[pa.Table]:
    """The sorted rows block by block; ``first`` tells from positions which rows begin one."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        at = 0
        for i in np.flatnonzero(first(b.column("pos").to_numpy())).tolist():
            if i > at:
                held.append(b.slice(at, i - at))
            if held:
                yield pa.Table.from_batches(held)
            held, at = [], i
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _hex(column: pa.ChunkedArray) -> list[str]:
    return [x.hex() for x in column.to_pylist()]


def _placed(leaves: DataFrame, block: int) -> DataFrame:
    """``leaves`` (code, key, leaf, kept) with pos, their place in their group, and size, the group's leaves, dealt by aligned blocks."""
    n = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["code", "key", "leaf", "row"]
    leaves = cut(leaves.withColumn("row", F.monotonically_increasing_id()))  # a range sort reads its rows twice
    ranged = cut(leaves.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("row").withColumn("at", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("part", F.shiftright("at", 33))
    # One row for each range and group.
    counts = ranged.groupBy("code", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("start"))
    group = Window.partitionBy("code")
    earlier = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("code", "part", (F.coalesce(earlier, F.lit(0)) - F.col("start")).alias("shift"), F.sum("n").over(group).alias("size"))
    placed = ranged.join(counts, ["code", "part"]).withColumn("pos", F.col("at") + F.col("shift")).withColumn("block", F.floor(F.col("pos") / block))
    return cut(placed.select("code", "size", "block", "pos", "key", "leaf", "kept").repartition(n, "code", "block").sortWithinPartitions("code", "block", "pos"))


def _swap(state: DataFrame, run: list[Column], place: Column, ordinal: Column, width: Column, most: Column, active: Column) -> DataFrame:
    """One round: the blocks below the children of one node swap digests, and each hashes that node.

    ``run`` names the node, ``place`` the child that a block lies below, ``ordinal`` the block among the
    child's ``width`` blocks; ``most`` is the width of the widest child. Blocks that are not ``active`` stay as they are.
    """
    own = F.when(active, F.array(*[c.cast("string") for c in run])).otherwise(F.array(F.lit("alone"), F.col("code"), F.col("block").cast("string")))
    s = state.withColumns({"run": own, "active": active, "place": F.when(active, place).otherwise(0).cast("int"), "ordinal": F.when(active, ordinal).otherwise(0), "width": F.when(active, width).otherwise(1), "most": F.when(active, most).otherwise(1)})
    s = s.withColumn("meet", F.explode(F.sequence("ordinal", F.col("most") - 1, "width")))
    carried = [c for c in state.columns if c != "node"]
    home = F.when(F.col("meet") == F.col("ordinal"), F.struct(*carried))
    s = s.groupBy("run", "meet").agg(F.sort_array(F.collect_list(F.struct("place", "node", "active", home.alias("home")))).alias("met"))  # at most FANOUT
    parent = F.sha2(F.array_join(F.col("met.node"), ""), 256)
    s = s.select("met", parent.alias("parent"), F.explode("met").alias("me")).filter("me.home is not null")
    others = F.array_join(F.transform(F.filter("met", lambda x: x["place"] != F.col("me.place")), lambda x: x["node"]), "")
    step = F.array(F.struct(F.col("me.place").alias("place"), others.alias("siblings")))
    new = {"node": F.when(F.col("me.active"), F.col("parent")).otherwise(F.col("me.node")), "proof": F.when(F.col("me.active"), F.concat("me.home.proof", step)).otherwise(F.col("me.home.proof"))}
    return s.select(*[new.get(c, F.col(f"me.home.{c}")).alias(c) if c in new else F.col(f"me.home.{c}").alias(c) for c in state.columns])


def _exchange(state: DataFrame, groups: DataFrame, fanout: int) -> DataFrame:
    """(code, block, subroot, root, proof) of every block, from its own (code, blocks, block, node): rounds within groups, then over groups."""
    most, n = groups.agg(F.coalesce(F.max("blocks"), F.lit(0)), F.count(F.lit(1))).first()
    state = state.withColumn("proof", F.array().cast(_PROOF))
    size, block, blocks = 1, F.col("block"), F.col("blocks")
    while size < most:
        child, active = F.floor(block / size), blocks > size
        run = F.floor(child / fanout)
        width = F.least(F.lit(size), blocks - child * size)
        widest = F.least(F.lit(size), blocks - run * fanout * size)  # a run's first child is full, or its only one
        state = _swap(state, [F.lit("in"), F.col("code"), run], child - run * fanout, block - child * size, width, widest, active)
        size *= fanout
    state = state.withColumn("subroot", F.col("node"))
    size = 1
    # Groups are a dimension: one row each.
    groups = groups.withColumns({"turn": F.row_number().over(Window.orderBy("code")) - 1, "before": F.sum("blocks").over(Window.orderBy("code")) - F.col("blocks")})
    while size < n:
        child = F.floor(F.col("turn") / size)
        g = groups.withColumns({"child": child, "run": F.floor(child / fanout)})
        g = g.withColumns({"width": F.sum("blocks").over(Window.partitionBy("child")), "start": F.min("before").over(Window.partitionBy("child"))})
        g = g.withColumn("most", F.max("width").over(Window.partitionBy("run")))
        g = g.select(F.col("code").alias("g"), "child", F.col("run").alias("up"), F.col("width").alias("w"), "most", (F.col("before") - F.col("start")).alias("from"))
        joined = state.join(g, F.col("code") == F.col("g")).drop("g")
        place = F.col("child") - F.col("up") * fanout
        state = _swap(joined, [F.lit("over"), F.col("up")], place, F.col("from") + block, F.col("w"), F.col("most"), F.lit(True)).select(*state.columns)
        size *= fanout
    return state.select("code", "block", "subroot", F.col("node").alias("root"), "proof")


def merkle_manifest(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof, and the columns ``carry``, which may be small only.

    Digests are lowercase hexadecimal. ``proof`` has a step for each level, from the leaf on: the digests beside
    the path, joined in order, and how many of them come before it; see `folded`. Rows of a group go by ``order``, null first,
    then by leaf; rows that repeat each other wholly are leaves of their own. Rows without group are one group, which comes first;
    the others go by UTF-8 bytes. A null text or other column is `-` in the leaf. Other columns of ``docs`` are not looked at. An empty table gives no rows.
    """
    carry, size = carry or {}, fanout**block_levels
    names = [f"kept{i}" for i in range(len(carry))]
    kept = F.struct(F.lit(0).alias("kept"), *[c.alias(n) for n, c in zip(names, carry.values(), strict=True)])
    code = F.when(F.col(group).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group).cast("string")))
    leaves = docs.select(code.alias("code"), F.col(order).alias("key"), F.unhex(row_leaf([F.col(c) for c in columns])).alias("leaf"), kept.alias("kept"))
    placed = _placed(leaves, size)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, lambda pos: pos % size == 0):
            total = t.column("size")[0].as_py()
            top = _tree(_hex(t.column("leaf")), fanout, None if total <= size else block_levels)[-1][0]
            yield pa.RecordBatch.from_pylist([{"code": t.column("code")[0].as_py(), "blocks": -(-total // size), "block": t.column("block")[0].as_py(), "node": top}])

    state = cut(placed.select("code", "size", "block", "pos", "leaf").mapInArrow(roots, "code string, blocks long, block long, node string"))
    groups = state.groupBy("code").agg(F.first("blocks").alias("blocks"))
    upper = _exchange(state, groups, fanout)

    # A block's own row goes before its leaves, so what it knows is held once for all of them.
    heads = upper.select("code", "block", F.lit(-1).cast("long").alias("pos"), "subroot", "root", "proof")
    both = placed.unionByName(heads, allowMissingColumns=True).select("code", "size", "block", "pos", "key", "leaf", "kept", "subroot", "root", "proof")
    both = both.repartition("code", "block").sortWithinPartitions("code", "block", "pos")

    def proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _blocks(batches, lambda pos: pos < 0):
            subroot, root, above = (t.column(c)[0].as_py() for c in ("subroot", "root", "proof"))
            t = t.slice(1).combine_chunks()
            hexes, n = _hex(t.column("leaf")), t.num_rows
            levels = _tree(hexes, fanout, None if t.column("size")[0].as_py() <= size else block_levels)
            steps = []
            for nodes in levels[:-1]:
                runs = [nodes[i - i % fanout : i - i % fanout + fanout] for i in range(len(nodes))]
                steps.append([(i % fanout, "".join(r[: i % fanout] + r[i % fanout + 1 :])) for i, r in enumerate(runs)])
            flat = []
            for i in range(n):
                flat += [s[i // fanout**k] for k, s in enumerate(steps)]
                flat += [(s["place"], s["siblings"]) for s in above]
            step = pa.StructArray.from_arrays([pa.array([p for p, _ in flat], pa.int32()), pa.array([s for _, s in flat], pa.string())], names=["place", "siblings"])
            proof = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (len(steps) + len(above)), pa.int32()), step)
            same = lambda x: pa.array([x] * n, pa.string())
            yield pa.RecordBatch.from_arrays([t.column("key").combine_chunks(), pa.array(hexes), same(subroot), same(root), proof, t.column("kept").combine_chunks()], names=["key", "leaf", "subroot", "root", "proof", "kept"])

    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    out = both.mapInArrow(proofs, f"key {types['key']}, leaf string, subroot string, root string, proof {_PROOF}, kept {types['kept']}")
    return out.select(F.col("key").alias(order), "leaf", "subroot", "root", "proof", *[F.col(f"kept.{n}").alias(c) for n, c in zip(names, carry, strict=True)])


def verified(rows: DataFrame, leaf: Column) -> DataFrame:
    """Rows of a manifest with folded_root, which ``leaf`` and the row's proof lead to, and whether that is the root."""
    rows = rows.withColumn("folded_root", folded(leaf, F.col("proof")))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
