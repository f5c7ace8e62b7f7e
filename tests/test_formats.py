"""Readers and writers on small files, and the stream of counts."""

from pyspark.sql import functions as F

from readloom.sources import formats as X
from readloom.streaming import kmer_counts


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta_wrapped_and_weighted(spark, tmp_path):
    p = put(tmp_path / "a.fasta", ">r1 2.5\nacgt\nACGT\n>r2\nNNNN\n>r3 x 7\nA\n")
    assert sorted(map(tuple, X.read_fasta(spark, p).collect())) == [("r1 2.5", "ACGTACGT"), ("r2", "NNNN"), ("r3 x 7", "A")]
    assert sorted(map(tuple, X.read_weighted_fasta(spark, p).collect())) == [(1.0, "NNNN"), (2.5, "ACGTACGT"), (7.0, "A")]
    X.write_fasta(X.read_fasta(spark, p), str(tmp_path / "out"))
    assert sorted(map(tuple, X.read_fasta(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, X.read_fasta(spark, p).collect()))


def test_fastq_and_mates(spark, tmp_path):
    p = put(tmp_path / "a.fq", "@a 1\nACGT\n+\n@@@@\n@b 1\nGGCC\n+\nIIII\n")
    q = X.read_fastq(spark, p)
    assert sorted(map(tuple, q.collect())) == [("a 1", "ACGT", "@@@@"), ("b 1", "GGCC", "IIII")]
    assert sorted(r.name for r in X.name_mates(q, 2).collect()) == ["a_2", "b_2"]
    both = X.read_pairs(spark, X.name_mates(q, 1), X.name_mates(q, 2).where("name = 'a_2'"))
    assert [tuple(r) for r in both.collect()] == [("a", "ACGT", "ACGT")]
    assert X.read_sequences(spark, p).count() == 2


def test_tables(spark, tmp_path):
    k = put(tmp_path / "k.tsv", "acg\t2\nACG\t3\nTTT\t1\n")
    assert sorted(map(tuple, X.read_kmers(spark, k).collect())) == [("ACG", 5.0), ("TTT", 1.0)]
    psl = put(tmp_path / "x.psl", "match mis\n" + " ".join(["90"] + ["0"] * 8 + ["q", "100", "0", "90", "t", "95"]) + "\n")
    assert [tuple(r) for r in X.read_psl(spark, psl).collect()] == [(90, "q", 100, "t", 95)]
    d = put(tmp_path / "d", "t\t1\t4\n")
    assert [tuple(r) for r in X.read_depth(spark, d).collect()] == [("t", 1, 4)]
    a = put(tmp_path / "a", "target_id\tlength\teff_length\test_counts\ttpm\nt1\t100\t50\t10\t3\n")
    assert X.read_abundance(spark, a).first().eff_length == 50.0
    e = put(tmp_path / "e", "id length a est\nt1 100 50 10\n")
    assert [tuple(r) for r in X.read_expression(spark, e, "KAL").collect()] == [("t1", 100.0, 10.0)]
    X.write_kmers(X.read_kmers(spark, k), str(tmp_path / "kout"))
    assert X.read_kmers(spark, str(tmp_path / "kout")).count() == 2
    X.write_partitions(X.read_kmers(spark, k).withColumn("comp", F.lit("c1_0")), str(tmp_path / "parts"))
    assert spark.read.parquet(str(tmp_path / "parts")).where("comp = 'c1_0'").count() == 2


def test_stream_of_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    put(tmp_path / "in" / "1.txt", "ACGTACGT\nACGTNACG\n")
    reads = spark.readStream.text(str(tmp_path / "in")).withColumnRenamed("value", "seq")
    q = kmer_counts.start(reads, str(tmp_path / "counts"), str(tmp_path / "ck"), 4)
    q.processAllAvailable()
    put(tmp_path / "in" / "2.txt", "ACGT\n")
    q.processAllAvailable()
    q.stop()
    want = {"ACGT": 4, "CGTA": 1, "GTAC": 1, "TACG": 1}
    assert dict(map(tuple, kmer_counts.counts(spark, str(tmp_path / "counts")).collect())) == want
    kmer_counts.compact(spark, str(tmp_path / "counts"), str(tmp_path / "less"))
    assert dict(map(tuple, kmer_counts.counts(spark, str(tmp_path / "less"), hard=2).select("kmer", "cnt").collect())) == {"ACGT": 4}


def test_fastq_in_splits(spark, tmp_path):
    lines = [f"@r{i}\nACGTACGT\n+\n{'@' if i % 3 else 'I'}IIIIII{'@' if i % 2 else 'I'}\n" for i in range(400)]
    p = put(tmp_path / "b.fq", "".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1111")
    try:
        got = X.read_fastq(spark, p).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.name, r.seq, r.qual) for r in got) == sorted((x.split("\n")[0][1:], "ACGTACGT", x.split("\n")[3]) for x in lines)


def test_graph_files(spark, tmp_path):
    n, e = X.read_kmer_graph(spark, put(tmp_path / "n", "ACG\t2.4\nACG\t3\nCGT\t1\n"), put(tmp_path / "e", "ACGT\t2.6\n"))
    assert sorted(map(tuple, n.collect())) == [("ACG", 5), ("CGT", 1)] and [tuple(r) for r in e.collect()] == [("ACG", "CGT", 2, 3)]
    n, e = X.read_condensed(spark, put(tmp_path / "cn", "0 ACGTT 7.6\n1 GTTA 2\n"), put(tmp_path / "ce", "0 1\n"), k=4)
    assert sorted(map(tuple, n.collect())) == [("0", "ACGTT", 8), ("1", "GTTA", 2)] and [tuple(r) for r in e.collect()] == [("0", "1", 3)]
    n = X.read_component_nodes(spark, put(tmp_path / "nodes0", X.NODE_HEAD + "\n0\tACGT\t2.5\t9\n1\tAC\tnone\t1\n"))
    assert sorted(map(tuple, n.collect())) == [("0", "ACGT", 2.5, 4), ("1", "AC", 0.0, 2)]
    e = X.read_component_edges(spark, put(tmp_path / "edges0", X.EDGE_HEAD + "\n0\t1\t23\t1.5\t76\n"))
    assert [tuple(r) for r in e.collect()] == [("0", "1", 23, 1.5, 76.0)]
    p = X.read_component_paths(spark, put(tmp_path / "paths0", X.PATH_HEAD + "\n0\t1\t4\n"))
    assert [r.path for r in p.collect()] == [["0", "1", "4"]]


def test_component_tables_and_partition_graph(spark, tmp_path):
    at = lambda rows, cols: spark.createDataFrame([("c", 0, *r) for r in rows], "comp string, sub int, " + cols)
    X.write_component_tables(at([(0, "ACGT")], "node int, seq string"), at([(0, 1, 0.0), (1, 2, 1.5)], "src int, dst int, copy_count double"), at([([0, 1],)], "path array<int>"), str(tmp_path / "t"))
    assert [r.src for r in spark.read.parquet(str(tmp_path / "t" / "edges")).collect()] == [1]
    edges = spark.createDataFrame([(5, 9, 3), (9, 12, 4)], "src long, dst long, w long")
    comps = spark.createDataFrame([(5, 5), (9, 5), (12, 5)], "contig_id long, comp long")
    got = [(r.line_no, r.line) for r in X.partition_graph_lines(edges, comps).orderBy("line_no").collect()]
    assert got == [(0, "3\t2\t001"), (1, "2\t3"), (2, "1\t3\t3\t4"), (3, "2\t4")]
