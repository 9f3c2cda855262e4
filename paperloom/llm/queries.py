"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them.

Each is thin: it reads its whole table, applies the operator with production parameters and derives
the digest columns from the operator's result.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import alignment, bpe, exact_dedup, html_text, importance, merkle, mixing, packing, quality_rules, repeats, simhash, token_counts, token_store
from paperloom.llm.common import cut
from paperloom.sources.exam import spread

BYTE_BPE, PIECE_BPE, WORD_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_store.store_folder(spark)
    token_store.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), out, end_id=0)
    return token_store.read_tokens(spark, out).withColumnRenamed("key", "doc_id")


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_importance_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0).drop("mark")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removal_digests(table(spark, sf_dir, "documents"))


def op8_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=1, capacity=4096)
    # encoded once; the ids themselves aren't shuffled
    rows = cut(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return packing.pack(rows, ["doc_id", "piece", "ids_crc32"], capacity=4096)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, n_chars = F.col("doc_id").cast("string"), F.col("n_chars").cast("decimal(20,0)")
    # tampering; beyond the range of a long the sum stays a number
    changed = F.when(F.crc32(doc_id.cast("binary")) % 7 == 0, n_chars + 1).otherwise(n_chars)
    claim = merkle.leaf_digest([F.col("doc_id"), F.col("source"), F.col("lang"), changed, F.col("text")])
    rows = merkle.manifest(docs, claims={"claim": claim}).withColumn("folded_root", merkle.folded(F.col("claim"), F.col("proof")))
    return rows.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, a, b = table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECE_BPE)
    return alignment.align(docs, a, b, digest=True).withColumnRenamed("groups", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_html_main_text": op2_html_main_text,
    "op3_importance_quality": op3_importance_quality,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_mix_sources": op5_mix_sources,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_repeated_passages": op7_repeated_passages,
    "op8_bpe_encode_decode": op8_bpe_encode_decode,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
    "op11_best_fit_packing": op11_best_fit_packing,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

#: A-Z and a-z for translate(): lower() would change other letters as well.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

def _leaf(n_chars: str) -> str:
    """SQL for the digest of a row of documents."""
    values = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", n_chars, "text")]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


SQL: dict[str, str] = {
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (
            SELECT *, list_reduce(
                list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, _: xor(v >> 1, (v & 1) * 3988292384))
            ) AS crc FROM documents
        ),
        digests AS (
            SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf("CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END")} AS claim FROM d
        ),
        leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM digests
        ),
        tree AS (
            SELECT lang, 0 AS level, place, n, leaf AS digest FROM leaves
            UNION ALL
            SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM tree WHERE n > 1 GROUP BY lang, level, place // 2, n
        ),
        subs AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM tree WHERE n = 1),
        crown AS (
            SELECT 0 AS level, place, n, subroot AS digest FROM subs
            UNION ALL
            SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(digest, '' ORDER BY place)) FROM crown WHERE n > 1 GROUP BY level, place // 2, n
        ),
        below AS (
            SELECT t.lang, t.level, t.place, CASE WHEN s.digest IS NULL THEN '=' WHEN t.place % 2 = 1 THEN '<' || s.digest ELSE '>' || s.digest END AS step
            FROM tree t LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM t.lang AND s.level = t.level AND s.place = xor(t.place, 1) WHERE t.n > 1
        ),
        above AS (
            SELECT t.level, t.place, CASE WHEN s.digest IS NULL THEN '=' WHEN t.place % 2 = 1 THEN '<' || s.digest ELSE '>' || s.digest END AS step
            FROM crown t LEFT JOIN crown s ON s.level = t.level AND s.place = xor(t.place, 1) WHERE t.n > 1
        ),
        uppers AS (
            SELECT s.lang, s.subroot, coalesce(list(a.step ORDER BY a.level) FILTER (a.step IS NOT NULL), []) AS upper
            FROM subs s LEFT JOIN above a ON a.place = s.place >> a.level GROUP BY s.lang, s.subroot
        ),
        lowers AS (
            SELECT l.doc_id, l.lang, l.leaf, l.claim, l.place, coalesce(list(b.step ORDER BY b.level) FILTER (b.step IS NOT NULL), []) AS lower
            FROM leaves l LEFT JOIN below b ON b.lang IS NOT DISTINCT FROM l.lang AND b.place = l.place >> b.level GROUP BY ALL
        ),
        whole AS (
            SELECT doc_id, leaf, claim, subroot, (SELECT digest FROM crown WHERE n = 1) AS root, lower || upper AS proof
            FROM lowers l JOIN uppers u ON l.lang IS NOT DISTINCT FROM u.lang
        ),
        done AS (
            SELECT *, list_reduce(list_prepend(claim, proof), lambda have, x: sha256(CASE WHEN x[1] = '<' THEN x[2:] || have ELSE have || x[2:] END)) AS folded_root FROM whole
        )
        SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(proof, lambda x: x[2:]), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM done
    """,
}
