"""The registered queries of this package, one for each operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import additive_ann, exact_topk, grammar_files, language_id, packing, passages, pieces, simhash, toxicity, url_filter
from .common import crc_fold, table

#: Host rules of the URL query (fixed values).
URL_RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
WORD_BPE, PIECE_BPE = "word_bpe_49k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies on this machine (and every executor)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_additive_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return additive_ann.search(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")


def op2_url_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op3_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))


def op4_chained_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op5_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes and decodes whole texts: ids per document, crc32 of the ids (as
    little-endian unsigned 32-bit integers) and of the text they decode to."""
    path = vocabulary(PIECE_BPE)
    out = pieces.decode_documents(pieces.encode_documents(table(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", "n_ids", "ids_crc32", F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op6_grammar_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = grammar_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary(WORD_BPE))
    return grammar_files.read_token_files(shards)


def op7_pattern_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    keep = [F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id")) == 2).alias("held_out")]
    return toxicity.predict(docs, grammar, keep)


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.search(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    names, models = language_id.fit(docs.where(crc_fold(F.col("doc_id")) != 2))
    keep = [F.col("doc_id").cast("long").alias("doc_id"), (crc_fold(F.col("doc_id")) == 2).alias("held_out")]
    return language_id.predict(docs, names, models, keep).select("doc_id", "held_out", "lang_pred", "score", "rejected")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_additive_ann,
        op2_url_ratio,
        op3_configuration_packing,
        op4_chained_passages,
        op5_piece_lattice,
        op6_grammar_files,
        op7_pattern_toxicity,
        op8_exact_topk,
        op9_simhash,
        op10_language,
    )
}

_VECTORS = """
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""

ORACLE_SQL: dict[str, str] = {
    "op8_exact_topk": f"""
WITH e AS (SELECT vec_id, list_transform(v, lambda x: floor(1024 * x)::BIGINT) AS w FROM ({_VECTORS})),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10""",
}
