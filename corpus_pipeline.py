"""A corpus pipeline of five stages; each reads what its predecessor kept.

toxicity -> near-duplicates -> benchmark passages -> mixing -> token ids. Every stage but the last returns the columns of
documents; the last returns doc_id, start, n_tokens, ids_crc32 as read back from the token files.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfx.llm import decontaminate, mixing, simhash, token_store, toxicity
from panelfx.llm.common import read, saved


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject. Columns named as the classifier's keep their values."""
    own = {c: f"__own_{c}" for c in ("score", "predicted") if c in docs.columns}
    judged = toxicity.classify(spark, docs.withColumnsRenamed(own), read(spark, sf_dir, "labels"))
    return judged.where(F.col("predicted") == 0).select(*[F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints: the one with the smallest doc_id."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.remove(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, as often as it takes them."""
    return mixing.mix(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and their digest."""
    return token_store.store_tokens(spark, docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_ids", store_tokens),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
    return docs
