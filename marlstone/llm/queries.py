"""Queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, exact, html, langid, merkle, minhash, mixing, quality, secrets, substring, whitening
from .common import table

BENCH_CHAT = "<|im_end|><|im_start|>assistant ok"


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix of all documents: words taken of each. Null text has size 0, null sources are one source, repeated rows are documents of their own, an empty table gives no rows."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without passages that repeat earlier ones. Null texts stay null, rows without doc_id stay whole, rows of one doc_id are one document, an empty table gives no rows."""
    return substring.dedup_substrings(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_sentences", "n_removed")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text. Null and empty texts have none, every row stands alone, an empty table gives no rows."""
    return secrets.find_secrets(table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates at 85 %. Texts without words and rows without doc_id are linked with nothing, repeated rows share a component, an empty table gives no rows."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages, learned from two folds of three. Null texts and texts without a letter are `und`, rows without doc_id are in no fold, an empty table gives no rows."""
    return langid.held_out_languages(table(spark, sf_dir, "documents"))


def op6_quality_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that importance resampling selects. Null and empty texts weigh 0, ties at the cut are kept, without good labels all stay, an empty table gives no rows."""
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page. Null and empty html give an empty text, broken markup is read as far as it goes, repeated rows come out as often, an empty table gives no rows."""
    return html.extract(table(spark, sf_dir, "pages"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as formatted and read back. Null texts and roles are empty, repeated rows are turns of their own, rows without conv_id are one conversation; the added conversation comes out alone from an empty table."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", BENCH_CHAT), (-1, 1, "assistant", BENCH_CHAT)], given.schema)
    read = chat.read_back(chat.format_chats(given.unionByName(extra)))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th vector. Unusable vectors take no part, ties go to the smaller vec_id, repeated rows count once, an empty table gives no rows."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in documents, with their best window. Null and empty texts and items match nothing, repeated rows count once, empty tables give no rows."""
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts. A null text is an empty one, of rows with one doc_id one stays, rows without doc_id come last, an empty table gives no rows."""
    groups = exact.exact_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened embeddings. Unusable vectors take no part, repeated rows count as often as they come, vectors without spread have no components, an empty table gives no rows."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row, checked with some texts changed. Nulls are `-`, rows without lang come first, repeated rows are leaves of their own, an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents")
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = merkle.row_leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.translate("text", letters, letters.lower())])
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.unhex(changed))
    rows = merkle.merkle_manifest(docs, carry={"tampered": tampered})
    rows = merkle.verified(rows, F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")))
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: s["siblings"]), ""), 256)
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_substring_dedup, op3_secret_scan, op4_minhash_near_dedup, op5_language_id, op6_quality_resample, op7_html_text, op8_chat_format, op9_nearest_neighbours, op10_decontaminate, op11_exact_dedup, op12_embedding_whitening, op13_merkle_manifest)}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": OP1_SQL, "op8_chat_format": OP8_SQL, "op11_exact_dedup": OP11_SQL, "op13_merkle_manifest": _op13_sql()}


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS src,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(sha256('17:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS k
  FROM documents),
s0 AS (SELECT src, sum(size)::BIGINT AS source_size FROM d GROUP BY src),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY src) - 1) % 3 + 1)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap,
              (SELECT sum(size) FROM d)::DOUBLE AS total FROM s0),
s2 AS (SELECT *, cap / w AS ratio FROM s1),
s3 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY ratio, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
              sum(w) OVER (ORDER BY ratio, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s2),
s4 AS (SELECT *, (total - full_before) / rest AS own_level FROM s3),
s5 AS (SELECT src, source_size, CASE WHEN ratio <= own_level THEN cap
              ELSE (SELECT own_level FROM s4 WHERE ratio > own_level ORDER BY ratio, src LIMIT 1) * w END AS target FROM s4),
c AS (SELECT d.*, s5.source_size, s5.target,
             sum(size) OVER (PARTITION BY src ORDER BY k, size, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS sent
      FROM d JOIN s5 USING (src)),
f AS (SELECT doc_id, k, size, source_size, target, e,
             least(floor((e * source_size + sent)::DOUBLE / target * 1073741824.0::DOUBLE), 281474976710655)::BIGINT AS f
      FROM c, (VALUES (0), (1), (2)) AS copies(e) WHERE target > 0 AND size > 0),
g AS (SELECT f, sum(sum(size)) OVER (ORDER BY f)::BIGINT AS upto FROM f GROUP BY f),
lim AS (SELECT coalesce(min(f), 4611686018427387904) AS f FROM g WHERE upto > (SELECT sum(size) FROM d)),
t AS (SELECT doc_id, k, size, count(*) FILTER (WHERE f < (SELECT f FROM lim)) * size AS taken,
             e IS NULL AS x FROM f GROUP BY doc_id, k, size, e IS NULL)
SELECT c.doc_id, c.size, c.source_size, coalesce(c.target, 0) AS target, coalesce(t.taken, 0)::BIGINT AS taken
FROM c LEFT JOIN (SELECT doc_id, k, size, taken FROM t) t
  ON c.doc_id IS NOT DISTINCT FROM t.doc_id AND c.k = t.k AND c.size = t.size
"""

OP8_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
a AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length('<|im_start|>' || replace(replace(replace(role, '<|', '<||'), '\', '\\'), chr(10), '\n') || chr(10)
             || replace(text, '<|', '<||') || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars,
       sha256(loss) AS loss_sha256, formatted_chars FROM a
"""

OP11_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h)::BIGINT AS group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id NULLS LAST) = 1 AS kept, h AS text_sha256 FROM d
"""


def _op13_sql(depth: int = 8) -> str:
    """Levels of both trees one below the other, up to 8**``depth`` leaves a language and as many languages."""
    field = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    # CRC-32 bit by bit: 256 and a byte brings the byte in, 0 shifts.
    steps = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [256 + ascii(c), 0, 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(4294967295, list_reduce({steps}, lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) ELSE xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END) END, 4294967295::BIGINT))"
    parts = [f"d AS (SELECT doc_id, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS seen, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS g FROM documents)"]
    parts.append("p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d)")

    def levels(name: str, first: str) -> None:
        parts.append(f"{name}0 AS ({first})")
        for k in range(depth):
            w = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            # What is beside each node, and its parent, while a group has several nodes; then the node stays alone.
            parts.append(f"{name}s{k} AS (SELECT g, i, h, count(*) OVER (PARTITION BY g) > 1 AS more, coalesce(string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, coalesce(string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
            parts.append(f"{name}{k + 1} AS (SELECT g, i // 8 AS i, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}s{k} GROUP BY g, i // 8)")

    levels("a", "SELECT g, i, leaf AS h FROM p")
    levels("b", f"SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM a{depth}")
    parts.append(f"u AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS j FROM a{depth})")
    tables = [f"{name}s{k}" for name in "ab" for k in range(depth)]
    joins = "".join(f" JOIN {t} ON {t}.g = " + (f"p.g AND {t}.i = p.i // {8 ** int(t[2:])}" if t[0] == "a" else f"'' AND {t}.i = u.j // {8 ** int(t[2:])}") for t in tables)
    beside = " || ".join(f"{t}.l || {t}.r" for t in tables)
    columns = ", ".join(f"{t}.more AS m{k}, {t}.l AS l{k}, {t}.r AS r{k}" for k, t in enumerate(tables))
    parts.append(f"f0 AS (SELECT p.doc_id, p.leaf, u.h AS subroot, sha256({beside}) AS proof_sha256, p.seen AS x, {columns} FROM p JOIN u ON u.g = p.g{joins})")
    for k in range(len(tables)):
        parts.append(f"f{k + 1} AS (SELECT * EXCLUDE (x), CASE WHEN m{k} THEN sha256(l{k} || x || r{k}) ELSE x END AS x FROM f{k})")
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, b{depth}.h AS root, proof_sha256, x AS folded_root, x = b{depth}.h AS verified FROM f{2 * depth}, b{depth}"
