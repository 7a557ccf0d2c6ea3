"""A training-corpus pipeline: toxicity, near-duplicates, personal data, packing.

Each stage takes what the one before kept.  All but the last return the columns
of ``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanmill.llm import minhash, packing, pii, toxicity
from spanmill.llm.common import materialize, table
from spanmill.llm.queries import tokenizer_file

THRESHOLD = 0.5
WIDTH, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain doesn't call toxic."""
    chain = toxicity.fit_chain(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, chain).where(F.col("p_toxic") < THRESHOLD).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group of near copies."""
    groups = minhash.near_duplicates(docs, width=WIDTH, percent=PERCENT)
    gone = groups.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def hide_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by pseudonyms; n_chars follows the text."""
    hidden = pii.pseudonymize(docs, pii.session_key(spark))
    kind = dict(docs.dtypes)["n_chars"]
    return hidden.withColumn("n_chars", F.length("text").cast(kind)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", hide_private), ("packing", pack)]

#: The chain, the signatures and the tokenizer have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
