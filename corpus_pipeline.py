"""Corpus pipeline: five stages over ``documents``, each written as Parquet and reread.

Quality rules and toxicity drop the documents they reject, near-dedup keeps one
document of each group, mixing repeats or leaves out documents so that sources
come near their target weights, and the last stage encodes the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.llm import bpe, minhash, mixing, quality, toxicity
from readloom.session import Tables, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.quality_rules(docs, carry=COLUMNS).where("kept").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5 by a model trained on the labelled documents that are left."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=COLUMNS).where("predicted = 0").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each group of near copies."""
    gone = minhash.near_duplicates(docs).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.emit(mixing.mix(docs, seed=5, carry=COLUMNS), COLUMNS)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with digests of the ids and of what they decode to."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    out = bpe.decode(bpe.encode(docs, path, P.PATTERN, carry=["doc_id", "source"]), path, P.PATTERN)
    return out.select(
        "doc_id",
        "source",
        "ids",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("minhash near-dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("byte-level bpe", encoding_stage),
]

#: The first three stages can't be expressed in SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to ``documents``."""
    tables = Tables(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        done = tables.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        tables.drop(docs)
        docs = done
    return docs
