"""k-mer counts over a stream of reads: the batch plan, kept up to date in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.operators.kmers import count_kmers


def start(reads: DataFrame, folder: str, checkpoint: str, k: int = 25):
    """Count the k-mers of each micro-batch of a stream ``(seq)`` and add them to ``folder``.

    A batch is a folder of its own, overwritten if the batch is repeated, so every
    read counts once. Nothing goes to the driver.
    """

    def add(batch: DataFrame, number: int) -> None:
        count_kmers(batch, k).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return reads.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()


def counts(spark: SparkSession, folder: str, hard: int = 1) -> DataFrame:
    """``(kmer, cnt)`` of at least ``hard`` over all batches so far."""
    c = spark.read.parquet(folder).groupBy("kmer").agg(F.sum("cnt").alias("cnt"))
    return c.where(F.col("cnt") >= hard)


def compact(spark: SparkSession, folder: str, to: str) -> None:
    """Write the sums as one batch of a new folder."""
    counts(spark, folder).write.parquet(f"{to}/batch=0")
