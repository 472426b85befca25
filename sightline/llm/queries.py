"""Queries of this subpackage: one per operator, over the whole of its
driver table, with production parameters; and the SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (byte_bpe, chat, exact_dedup, frames, html_text, kneser_ney, multi_index, negatives, packing,
               resampling, rlz, sharding, simhash)
from .common import table

#: Vocabulary files of public tokenizers.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


def op3_zstd_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = frames.write_token_files(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=1)
    return (frames.read_token_files(files)
            .select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op1_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return multi_index.search(rows, rows.filter("vec_id % 100 = 0"))


def op2_rlz_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = rlz.dedup_substrings(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op5_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser_ney.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_documents(table(spark, sf_dir, "conversations"))


def op8_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    path = vocabulary(BYTE_BPE)
    rows = byte_bpe.encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return byte_bpe.decode_documents(rows, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (sharding.assign(table(spark, sf_dir, "documents"), shards=8)
            .withColumn("grown_shard", F.lit(None).cast("int")))


def op13_rtree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", label.alias("label"))
    return negatives.hard_negatives(rows, rows.filter("vec_id % 50 = 0"))


QUERIES = {f.__name__: f for f in (
    op1_inverted_multi_index, op2_rlz_substring_dedup, op3_zstd_frames, op4_exact_dedup, op5_kneser_ney_quality,
    op6_html_main_text, op7_chat_snapshots, op8_online_packing, op9_segment_tree_bpe, op10_simhash_trie,
    op11_importance_resampling, op12_minimax_shards, op13_rtree_negatives)}

#: The table of CRC-32 as SQL: each byte shifted eight times.
_CRC_TABLE = """SELECT list(list_reduce(list_prepend(range, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z:
                      CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY range) AS crc FROM range(256)"""
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE = {
    "op11_importance_resampling": rf"""
        WITH tab AS ({_CRC_TABLE}),
             d AS (SELECT row_number() OVER () AS r, doc_id,
                          regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM documents),
             b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                   FROM benchmark),
             dw AS (SELECT r, unnest(w) AS w FROM d),
             bw AS (SELECT unnest(w) AS w FROM b),
             hexed AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
             bucket AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len(h), 2),
                          lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT))), lambda c, x: xor(c >> 8, crc[xor(c & 255, x) + 1])),
                          4294967295) % 10000 AS k FROM hexed, tab),
             s AS (SELECT k, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY k),
             t AS (SELECT k, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY k),
             sums AS (SELECT (SELECT count(*) FROM dw)::DOUBLE AS ds, (SELECT count(*) FROM bw)::DOUBLE AS bs),
             gain AS (SELECT s.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * (ds + 10000) / ((s.n + 1) * (bs + 10000)))) AS BIGINT) AS g
                      FROM s LEFT JOIN t USING (k), sums),
             weights AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
             scored AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 *
                          ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                          / 4294967296))) AS BIGINT) AS score
                        FROM d LEFT JOIN weights USING (r)),
             ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS a,
                               count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND a <= 10 * n // 100 THEN a END AS rank
        FROM ranked""",
    "op13_rtree_negatives": """
        WITH e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
                     AND list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
             s AS (SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
                          CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda x: x[1] * x[2])) AS BIGINT) AS score
                   FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
             p AS (SELECT * FROM s WHERE label = own
                   QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id,
               CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
               s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.label <> p.own
                     AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
        QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) <= 3""",
    "op4_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS x FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY x) AS keep_id, count(*) OVER (PARTITION BY x) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY x) AS kept, sha256(x) AS text_sha256
        FROM t""",
    "op7_chat_snapshots": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
                   FROM conversations WHERE conv_id IS NOT NULL),
             p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM t),
             c AS (SELECT conv_id, list((role, text) ORDER BY pos) AS l, count(*) AS n FROM p GROUP BY conv_id),
             k AS (SELECT min(conv_id) AS conv_id, n, l, count(*) AS copies FROM c GROUP BY n, l),
             m AS (SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM k b WHERE b.n > k.n AND b.l[1:k.n] = k.l))
        SELECT p.conv_id, p.pos // 256 AS segment, m.n AS n_turns, m.copies,
               string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS text
        FROM p JOIN m ON m.conv_id = p.conv_id
        GROUP BY ALL""",
}
