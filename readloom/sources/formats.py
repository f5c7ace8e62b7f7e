"""Readers and writers of the sequencing file formats; all go through Spark's own file access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

PSL_COLUMNS = {"match": 0, "q_name": 9, "q_size": 10, "t_name": 13, "t_size": 14}
#: Places of name, length and value in the three expression formats (fixed values).
EXPRESSION = {"EXP": (1, 2, 6), "SIM": (0, 1, 7), "KAL": (0, 1, 3)}


def _records(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """One row a record, split at lines that start with ``mark``."""
    rows = spark.read.option("lineSep", "\n" + mark).text(path)
    return rows.select(F.regexp_replace(F.col("value"), "\r", "").alias("value"), F.col("_metadata.file_path").alias("file"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(name, seq)``: records of one or more sequence lines, in upper case."""
    r = _records(spark, path, ">").where(F.trim("value") != "")
    body = F.regexp_replace("value", "^>", "")
    name = F.substring_index(body, "\n", 1)
    seq = F.upper(F.regexp_replace(F.expr("substring(regexp_replace(value, '^>', ''), length(substring_index(regexp_replace(value, '^>', ''), '\n', 1)) + 2)"), r"\s", ""))
    return r.select(F.trim(name).alias("name"), seq.alias("seq"))


def read_weighted_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``(weight, seq)``: the weight is the last token of the header if it is a number, else 1."""
    last = F.element_at(F.split("name", r"\s+"), -1)
    return read_fasta(spark, path).select(F.coalesce(last.try_cast("double"), F.lit(1.0)).alias("weight"), "seq")


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """``(name, seq, qual)``: records of four lines.

    The file is cut where a line starts with ``@``, so that Spark can split it. A
    quality line may start so too: then the piece before lacks its last line,
    which is the whole piece behind, as records have no other inner ``@``.
    """
    raw = spark.read.option("lineSep", "\n@").text(path)
    piece = F.regexp_replace(F.regexp_replace("value", "\r", ""), "\n$", "")
    m = raw.select(piece.alias("p"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("i"))
    whole = F.col("p").rlike(r"^@?[^\n]*\n[^\n]*\n\+[^\n]*\n[^\n]*$")
    cut = F.col("p").rlike(r"^@?[^\n]*\n[^\n]*\n\+[^\n]*$")
    # only pieces at such a place are looked at with their neighbours, across the end of a split if need be
    from pyspark.sql import Window as W

    odd = m.where(~whole)
    lead = odd.withColumn("next", F.lead("p").over(W.partitionBy("file", "block").orderBy("i"))).where(cut)
    first = odd.groupBy("file", "block").agg(F.min_by("p", "i").alias("p"))  # a row for each split
    after = F.lead("p").over(W.partitionBy("file").orderBy("block"))
    first = first.select(F.col("file").alias("f2"), F.col("block").alias("b2"), after.alias("over"))
    odd = lead.join(first, (F.col("file") == F.col("f2")) & (F.col("block") == F.col("b2")))
    odd = odd.withColumn("p", F.concat("p", F.lit("\n@"), F.coalesce("next", "over", F.lit(""))))
    f = m.where(whole).select("p").union(odd.select("p")).select(F.split(F.regexp_replace("p", "^@", ""), "\n").alias("f"))
    return f.select(F.col("f")[0].alias("name"), F.upper(F.col("f")[1]).alias("seq"), F.col("f")[3].alias("qual"))


def name_mates(fastq: DataFrame, mate: int) -> DataFrame:
    """Names that end in the mate's number, as correction needs them."""
    return fastq.withColumn("name", F.concat(F.substring_index("name", " ", 1), F.lit(f"_{mate}")))


def read_sequences(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """FASTA or FASTQ by the last letter of the path, or as told."""
    kind = kind or ("fastq" if path.rstrip("/")[-1:] in "qQ" else "fasta")
    return read_fastq(spark, path).select("name", "seq") if kind == "fastq" else read_fasta(spark, path)


def read_pairs(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(pair_id, seq1, seq2)`` of mates whose names agree up to the mate's number."""
    stem = F.regexp_replace("name", r"[_/][12]$", "")
    a = left.select(stem.alias("pair_id"), F.col("seq").alias("seq1"))
    return a.join(right.select(stem.alias("pair_id"), F.col("seq").alias("seq2")), "pair_id")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("f"))


def read_kmers(spark: SparkSession, path: str) -> DataFrame:
    """``(kmer, cnt)`` of a k-mer table; repeated k-mers add up."""
    f = _fields(spark, path).where(F.size("f") >= 2)
    return f.groupBy(F.upper(F.col("f")[0]).alias("kmer")).agg(F.sum(F.col("f")[1].cast("double")).alias("cnt"))


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Alignment rows; lines whose first field is no number are heads."""
    f = _fields(spark, path).where((F.size("f") > 14) & F.col("f")[0].try_cast("long").isNotNull())
    kind = {"match": "int", "q_size": "int", "t_size": "int"}
    return f.select(*(F.col("f")[i].cast(kind.get(c, "string")).alias(c) for c, i in PSL_COLUMNS.items()))


def read_depth(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("pos", T.IntegerType()), T.StructField("depth", T.IntegerType())])
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def read_abundance(spark: SparkSession, path: str) -> DataFrame:
    """Abundance table with a head line."""
    names = ("name", "length", "eff_length", "est_counts", "tpm")
    schema = T.StructType([T.StructField(n, T.StringType() if n == "name" else T.DoubleType()) for n in names])
    return spark.read.schema(schema).option("sep", "\t").option("header", "true").csv(path)


def read_expression(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``(name, length, value)`` of an expression file of a known format; head lines have no number there."""
    at = EXPRESSION[kind]
    f = _fields(spark, path).where((F.size("f") > max(at)) & F.col("f")[at[2]].try_cast("double").isNotNull())
    return f.select(F.col("f")[at[0]].alias("name"), F.col("f")[at[1]].cast("double").alias("length"), F.col("f")[at[2]].cast("double").alias("value"))


def read_isoforms(spark: SparkSession, path: str) -> DataFrame:
    f = _fields(spark, path).where(F.size("f") > 6)
    return f.select(F.col("f")[0].alias("name"), F.col("f")[5].alias("isoform_group"), F.col("f")[6].cast("int").alias("n_isoforms"))


def read_kmer_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Nodes ``(seq, prevalence)`` and edges ``(src, dst, overlap, copy_count)`` of tables of k-mers and (k+1)-mers.

    Numbers are rounded; a repeated node adds up, of a repeated edge the largest count stands.
    """
    n, e = (_fields(spark, p).where(F.size("f") >= 2).select(F.upper(F.col("f")[0]).alias("s"), F.round(F.col("f")[1].cast("double")).cast("long").alias("w")) for p in (nodes, edges))
    n = n.groupBy(F.col("s").alias("seq")).agg(F.sum("w").alias("prevalence"))
    size = F.length("s")
    ends = e.select(F.expr("left(s, length(s) - 1)").alias("src"), F.expr("right(s, length(s) - 1)").alias("dst"), (size - 2).alias("overlap"), "w")
    return n, ends.groupBy("src", "dst", "overlap").agg(F.max("w").alias("copy_count"))


def read_condensed(spark: SparkSession, nodes: str, edges: str, k: int = 24) -> tuple[DataFrame, DataFrame]:
    """Condensed nodes ``(node, seq, prevalence)`` and edges ``(src, dst, overlap)``; edges overlap by ``k - 1``."""
    n = _fields(spark, nodes).where(F.size("f") >= 3)
    n = n.select(F.col("f")[0].alias("node"), F.upper(F.col("f")[1]).alias("seq"), F.round(F.col("f")[2].cast("double")).cast("long").alias("prevalence"))
    e = _fields(spark, edges).where(F.size("f") >= 2)
    return n, e.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"), F.lit(k - 1).alias("overlap"))


#: Head lines of the files of a component (fixed values).
NODE_HEAD, EDGE_HEAD, PATH_HEAD = "ID\tBases\tCopycount\tNormalization", "InID\tOutID\tWeight\tCopycount\tNormalization", "ID1\tID2\tEtc."


def read_component_nodes(spark: SparkSession, path: str) -> DataFrame:
    """``(node, seq, weight, size)``; a weight that is no number is 0, and the size is the sequence's length."""
    f = _fields(spark, path).where((F.size("f") >= 3) & (F.col("f")[0] != "ID"))
    return f.select(F.col("f")[0].alias("node"), F.col("f")[1].alias("seq"), F.coalesce(F.col("f")[2].try_cast("double"), F.lit(0.0)).alias("weight"), F.length(F.col("f")[1]).alias("size"))


def read_component_edges(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst, overlap, copy_count, size)``."""
    f = _fields(spark, path).where((F.size("f") >= 5) & (F.col("f")[0] != "InID"))
    return f.select(F.col("f")[0].alias("src"), F.col("f")[1].alias("dst"), F.col("f")[2].cast("int").alias("overlap"), F.col("f")[3].cast("double").alias("copy_count"), F.col("f")[4].cast("double").alias("size"))


def read_component_paths(spark: SparkSession, path: str) -> DataFrame:
    """``(path)``: known paths as lists of nodes."""
    return _fields(spark, path).where((F.col("f")[0] != "ID1") & (F.col("f")[0] != "")).select(F.col("f").alias("path"))


def write_component_tables(nodes: DataFrame, edges: DataFrame, paths: DataFrame, folder: str) -> None:
    """Nodes, edges with a copy count above 0 and known paths of all components, each a table by ``comp`` and ``sub``."""
    kept = edges.where("copy_count > 0")
    for name, df in (("nodes", nodes), ("edges", kept), ("paths", paths)):
        df.repartition("comp").sortWithinPartitions("comp", "sub").write.parquet(f"{folder}/{name}")


def partition_graph_lines(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(comp, line_no, line)``: each component as a graph file for a partitioner.

    Line 0 has the numbers of nodes and edges and the mark of edge weights; line i
    the neighbours of the i-th node, by number, each with its weight. Nodes are
    numbered from 1 in order of their ids.
    """
    from readloom.operators.numbering import row_numbers_within

    n = row_numbers_within(components.select("comp", "contig_id"), "comp", "contig_id", "i")
    both = edges.select("src", "dst", "w").union(edges.select("dst", "src", "w"))
    other = n.select(F.col("contig_id").alias("dst"), F.col("i").alias("j"))
    near = both.join(other, "dst").groupBy(F.col("src").alias("contig_id")).agg(F.sort_array(F.collect_list(F.struct("j", "w"))).alias("near"), F.count(F.lit(1)).alias("deg"))
    rows = n.join(near, "contig_id", "left")
    text = F.array_join(F.transform("near", lambda x: F.concat_ws("\t", x["j"].cast("string"), x["w"].cast("string"))), "\t")
    lines = rows.select("comp", F.col("i").alias("line_no"), F.coalesce(text, F.lit("")).alias("line"))
    head = rows.groupBy("comp").agg(F.concat_ws("\t", F.count(F.lit(1)).cast("string"), (F.coalesce(F.sum("deg"), F.lit(0)) / 2).cast("long").cast("string"), F.lit("001")).alias("line"))
    return head.select("comp", F.lit(0).cast("long").alias("line_no"), "line").union(lines)


def write_log(spark: SparkSession, rows: list[tuple[str, int]], path: str) -> None:
    """A run's log: steps and numbers in order."""
    data = [(i, s, n) for i, (s, n) in enumerate(rows)]
    spark.createDataFrame(data, "i long, step string, n long").coalesce(1).write.option("header", "true").csv(path)


def write_fasta(df: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), name, F.lit("\n"), seq).alias("value")).write.text(path)


def write_kmers(df: DataFrame, path: str) -> None:
    df.select("kmer", F.col("cnt").cast("long")).write.option("sep", "\t").csv(path)


def write_partitions(df: DataFrame, path: str, by: str = "comp") -> None:
    """A folder for each partition, read back by partition pruning."""
    df.repartition(by).write.partitionBy(by).parquet(path)
