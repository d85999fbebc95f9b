"""A training corpus from raw documents: five stages, each on what the last kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import language_id, packing, passages, simhash, toxicity
from tidemill.llm.common import crc_fold, recorded, remove, stored, table
from tidemill.llm.queries import WORD_BPE, vocabulary


def whole(docs: DataFrame) -> Column:
    """All columns as one, so that none clashes with what a stage adds."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar scores below 0.3 stay."""
    grammar = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.predict(docs, grammar, [whole(docs)]).where("predicted = 0").select("doc.*")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language stay; those without a letter and those
    far less likely than any learned language's own text go."""
    names, models = language_id.fit(docs.where(crc_fold(F.col("doc_id")) != 2))
    return language_id.predict(docs, names, models, [whole(docs)]).where("NOT rejected").select("doc.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash candidates whose five-word shingles
    have a similarity of 0.8 or more) the first document stays."""
    return simhash.one_of_each(docs, words=5, similarity=0.8)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay only where they come first."""
    with recorded() as written:
        found = stored(passages.repeated_passages(docs), "passages")
    remove(written[:-1])  # only the passages are read again
    return passages.cut_passages(docs, found)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids in sequences of at most 2048."""
    return packing.pack_documents(docs, vocabulary(WORD_BPE))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("best_fit_packing", pack),
]

#: No stage but the last could be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
