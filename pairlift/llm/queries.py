"""Registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from pairlift.llm import (
    bit_sliced,
    byte_bpe,
    exact_dedup,
    hard_negatives,
    lexical_search,
    license_scan,
    lm_scoring,
    minhash,
    packing,
    quality_classifier,
    quality_rules,
    token_counts,
    training_order,
)
from pairlift.workspace import scratch_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token pieces of all documents in sequences of at most 4096 tokens."""
    packed = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that are equal but for white space."""
    return exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of documents: 3-word shingles, similarity 0.85."""
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return license_scan.license_summary(docs, license_scan.fit(docs))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as byte-level BPE ids and back."""
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(_table(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents."""
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of all documents."""
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules on all documents."""
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = _table(spark, sf_dir, "documents")
    return quality_classifier.quality_scores(docs, quality_classifier.fit(docs, _table(spark, sf_dir, "labels")))


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as shards of sequences in training order, as read back from the shards."""
    path = scratch_path(spark, "shards")
    shards, index = training_order.materialise(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, key=2026)
    read = shards.read(spark).select("slot", F.col("n_ids").alias("n_read"), F.crc32("ids").alias("read_crc32"))
    size = shards.shard_records
    return index.join(read, "slot", "full").select(
        "slot",
        F.expr(f"slot div {size}").alias("shard"),
        (F.col("slot") % size * shards.stride).alias("at_byte"),
        "n_ids",
        "doc_ids",
        "ids_crc32",
        "n_read",
        "read_crc32",
    )


def op11_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every fiftieth."""
    return bit_sliced.top_k(_table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; a seventh of the labels is moved on by one."""
    moved = F.expr("CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS LONG) + 1) % 10 ELSE CAST(label AS LONG) END")
    return hard_negatives.hard_negatives(_table(spark, sf_dir, "embeddings"), label=moved)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus pipeline from documents to packed sequences."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


# SQL counterparts; the others are tested against brute force.
ORACLES: dict[str, str] = {
    "op4_exact_dedup": r"""
        WITH bare AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS b FROM documents
        ), named AS (
            SELECT doc_id, first_value(doc_id) OVER (PARTITION BY b ORDER BY length(t) DESC, doc_id) AS keep_id,
                count(*) OVER (PARTITION BY b) AS group_size, sha256(b) AS text_sha256
            FROM bare
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM named
    """,
    "op11_bit_sliced_top_k": r"""
        WITH v AS (
            SELECT row_number() OVER () AS u, vec_id, label, embedding, len(embedding) AS d,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.u, a.vec_id AS query_id, b.u AS o, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v AS a JOIN v AS b ON a.u <> b.u AND a.d = b.d WHERE a.vec_id % 50 = 0
        )
        SELECT query_id, row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST, o)::INTEGER AS rank, vec_id, score
        FROM scored QUALIFY rank <= 5
    """,
    "op12_lexical_search": r"""
        WITH terms AS (
            SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)
        ), counted AS (
            SELECT d, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
        ), sizes AS (
            SELECT d, sum(tf)::BIGINT AS n FROM counted GROUP BY d
        ), totals AS (
            SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS nt FROM sizes
        ), weights AS (
            SELECT term, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, totals GROUP BY term, nd
        ), wanted AS (
            SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)
        ), scored AS (
            SELECT i, item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nd) // nt))))::BIGINT AS score
            FROM wanted JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (d), totals GROUP BY ALL
        )
        SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
        QUALIFY rank <= 10
    """,
    "op13_hard_negatives": r"""
        WITH v AS (
            SELECT * REPLACE (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label) FROM (
            SELECT row_number() OVER () AS u, vec_id, label, embedding, len(embedding) AS d,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND label IS NOT NULL
            )
        ), scored AS (
            SELECT a.u, a.vec_id AS anchor_id, b.u AS o, b.vec_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
            FROM v AS a JOIN v AS b ON a.u <> b.u AND a.d = b.d WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT u, anchor_id, o AS p, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY u ORDER BY score DESC, vec_id NULLS LAST, o) <= 5
        ), mined AS (
            SELECT u, p, anchor_id, positive_id, positive_score, o, vec_id AS negative_id, score AS negative_score
            FROM positives JOIN scored USING (u, anchor_id)
            WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
        )
        SELECT anchor_id, positive_id, positive_score, negative_id, negative_score,
            row_number() OVER (PARTITION BY u, p ORDER BY negative_score DESC, negative_id NULLS LAST, o)::INTEGER AS rank
        FROM mined QUALIFY rank <= 10
    """,
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan,
        op2_best_fit_packing,
        op3_byte_bpe,
        op4_exact_dedup,
        op5_token_counts,
        op6_minhash_near_dedup,
        op7_lm_scoring,
        op8_quality_rules,
        op9_quality_classifier,
        op10_training_order,
        op11_bit_sliced_top_k,
        op12_lexical_search,
        op13_hard_negatives,
        pipeline,
    )
}
