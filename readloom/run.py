"""Whole runs from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from readloom.operators import assembly as A, contigs as C
from readloom.plans import assembly as P
from readloom.sources import formats as IO


def _numbered(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    """Rows with a number that depends on them alone; rows that are equal get the same one."""
    return df.withColumn(name, F.shiftrightunsigned(F.xxhash64(*by), 4))


def assemble_files(
    spark: SparkSession,
    out: str,
    single: str | None = None,
    left: str | None = None,
    right: str | None = None,
    kind: str | None = None,
    k: int = 24,
    size: int = 500,
    min_weight: float = 3.0,
    length: float = 100.0,
    min_length: int = 200,
    forward: bool = False,
) -> DataFrame:
    """Transcripts of FASTA or FASTQ files, written to ``out/transcripts`` as FASTA with a log in ``out/log``.

    ``single``: reads; ``left`` and ``right``: mates by name, facing each other, or
    both ``forward``. ``kind`` tells the format where the file name does not.
    """
    log: list[tuple[str, int]] = []
    reads = pairs = None
    if single:
        r = IO.read_sequences(spark, single, kind)
        reads = _numbered(r, "read_id", ["name", "seq"]).select("read_id", "seq")
        log.append(("reads", reads.count()))
    if left or right:
        if not (left and right):
            raise ValueError("both files of mates are needed")
        both = IO.read_pairs(spark, IO.read_sequences(spark, left, kind), IO.read_sequences(spark, right, kind))
        if forward:
            both = both.withColumn("seq2", P.S.reverse_complement(F.col("seq2")))
        pairs = _numbered(both.withColumnRenamed("pair_id", "stem"), "pair_id", ["stem", "seq1", "seq2"]).select("pair_id", "seq1", "seq2")
        log.append(("pairs", pairs.count()))
    t = P.assemble(reads, size, min_weight, k=k, length=length, min_length=min_length, pairs=pairs, log=log)
    named = t.select(F.concat_ws(" ", "name", F.round("weight", 6).cast("string"), F.array_join(F.col("node_path").cast("array<string>"), "->")).alias("name"), "seq")
    IO.write_fasta(named, f"{out}/transcripts")
    IO.write_log(spark, log, f"{out}/log")
    return t


def assemble_partition(spark: SparkSession, kmers: str, reads: str, out: str, k: int = 24, length: float = 100.0) -> list[tuple[str, float, list[int]]]:
    """Transcripts of one partition from its tables of (k+1)-mers and its reads, written as FASTA.

    A partition has to fit in memory, as it does in a task of ``plans.assembly.assemble``.
    """
    k1 = {r.kmer: r.cnt for r in IO.read_kmers(spark, kmers).collect()}
    found = IO.read_sequences(spark, reads).groupBy("seq").agg(F.count(F.lit(1)).cast("double").alias("w")).collect()
    made = A.transcripts(k1, {r.seq: r.w for r in found}, k=k, length=length)
    rows = [(f"{i} {w:.6f} " + "->".join(map(str, p)), s) for i, (s, w, p) in enumerate(made)]
    IO.write_fasta(spark.createDataFrame(rows, "name string, seq string"), out)
    return made


def compare_files(spark: SparkSession, found: str, truth: str, out: str) -> DataFrame:
    """Best hit of each reference among found sequences, written as a table, by shared r-mers."""
    q = _numbered(IO.read_fasta(spark, found), "contig_id", ["name", "seq"]).select("contig_id", "seq")
    t = _numbered(IO.read_fasta(spark, truth), "t_id", ["name", "seq"]).select("t_id", "name", "seq")
    best = C.best_hit(C.psl(q, t.select("t_id", "seq")))
    rows = best.join(t.select(F.col("t_id").alias("t_name"), "name"), "t_name").select("name", "t_size", "match", "fraction", "recovered")
    rows.write.option("header", "true").csv(out)
    return rows
