"""Queries on reads and k-mers."""

from __future__ import annotations

from pyspark.sql import functions as F

from readloom.catalog import register
from readloom.functions import sequence as S
from readloom.operators import kmers as K
from readloom.operators import nodebins as N
from readloom.sources import dna
from readloom.sources.dna import sql

_TOP = "greatest(" + ", ".join(f"length({{0}}) - length(replace({{0}}, '{b}', ''))" for b in "ACGT") + ")"
RC = "translate(reverse({0}), 'ACGT', 'TGCA')"


def solid(spark, d):
    """25-mers that occur three times or more."""
    return K.count_kmers(dna.reads(spark, d), hard=3)


def nodes(spark, d):
    """Nodes of the graph of solid 25-mers with their degrees and weights."""
    return N.nodes(dna.reads(spark, d), K.K, 3)


@register(
    "kmer_count_hard_soft",
    sql("seqs", "reads", body=f"SELECT kmer, count(*) AS cnt, count(*) >= 3 AS is_seed FROM (SELECT substr(seq, i, 25) AS kmer FROM reads, unnest(range(1, 77)) t(i)) WHERE {_TOP.format('kmer')} < 23 GROUP BY kmer HAVING count(*) >= 2"),
)
def kmer_count_hard_soft(spark, d):
    out = K.count_kmers(dna.reads(spark, d), hard=2).where(~S.low_complexity(F.col("kmer")))
    return out.withColumn("is_seed", F.col("cnt") >= 3)


@register("reverse_complement", sql("seqs", "reads", body=f"SELECT read_id, {RC.format('seq')} AS rc, translate(seq, 'ACGT', 'TGCA') AS comp FROM reads"))
def reverse_complement(spark, d):
    return dna.reads(spark, d).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"), S.complement(F.col("seq")).alias("comp"))


@register("read_stats", sql("seqs", body="SELECT count(*) AS n, avg(length(seq)) AS mean_len, CAST(sum(length(seq)) AS BIGINT) AS n_bases FROM seqs"))
def read_stats(spark, d):
    n = F.length("seq")
    return dna.sequences(spark, d).agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_len"), F.sum(n).cast("long").alias("n_bases"))


@register("read_filter_acgt", sql("seqs_n", "reads", body="SELECT read_id, seq FROM reads WHERE NOT regexp_matches(seq, '[^ACGT]')"))
def read_filter_acgt(spark, d):
    return dna.reads(spark, d, S.BASES_N).where(~S.has_unread(F.col("seq"))).select("read_id", "seq")


@register("pair_filter_acgt", sql("seqs_n", "reads", "pairs", body="SELECT * FROM pairs WHERE NOT regexp_matches(seq1, '[^ACGT]') AND NOT regexp_matches(seq2, '[^ACGT]')"))
def pair_filter_acgt(spark, d):
    return dna.pairs(spark, d, S.BASES_N).where(~S.has_unread(F.col("seq1")) & ~S.has_unread(F.col("seq2")))


@register("reads_augmented", sql("seqs", "reads", body=f"SELECT read_id, 0 AS strand, seq FROM reads UNION ALL SELECT read_id, 1, {RC.format('seq')} FROM reads"))
def reads_augmented(spark, d):
    r = dna.reads(spark, d)
    return r.select("read_id", F.lit(0).alias("strand"), "seq").unionByName(r.select("read_id", F.lit(1).alias("strand"), S.reverse_complement(F.col("seq")).alias("seq")))


@register("pairs_augmented", sql("seqs", "reads", "pairs", body=f"SELECT pair_id, 0 AS strand, seq1, {RC.format('seq2')} AS seq2 FROM pairs UNION ALL SELECT pair_id, 1, seq2, {RC.format('seq1')} FROM pairs"))
def pairs_augmented(spark, d):
    p = dna.pairs(spark, d)
    rc = lambda c: S.reverse_complement(F.col(c))
    return p.select("pair_id", F.lit(0).alias("strand"), "seq1", rc("seq2").alias("seq2")).union(p.select("pair_id", F.lit(1), "seq2", rc("seq1")))


@register("low_complexity", sql("seqs", "reads", "k1", body=f"SELECT kmer, {_TOP.format('kmer')} AS top, {_TOP.format('kmer')} >= 23 AS low FROM k1"))
def low_complexity(spark, d):
    k = F.col("kmer")
    return solid(spark, d).select(k, S.top_base_count(k).alias("top"), S.low_complexity(k).alias("low"))


@register("read_multiplicity", sql("seqs", "reads", body="SELECT seq, count(*) AS copies, min(read_id) AS first_read FROM reads GROUP BY seq"))
def read_multiplicity(spark, d):
    return dna.reads(spark, d).groupBy("seq").agg(F.count(F.lit(1)).alias("copies"), F.min("read_id").alias("first_read"))


_TAIL = "length(regexp_replace(regexp_extract({0}, '^{1}*[^{1}]?{1}*'), '[^{1}]+$', ''))"


@register("polya_trim", sql("seqs", "contigs", "cut AS (SELECT contig_id, seq, " + _TAIL.format("seq", "T") + " AS a, " + _TAIL.format("reverse(seq)", "A") + " AS b FROM contigs)", body="SELECT contig_id, substr(seq, CAST(a + 1 AS INT), CAST(greatest(length(seq) - a - b, 0) AS INT)) AS trimmed FROM cut"))
def polya_trim(spark, d):
    return dna.contigs(spark, d).select("contig_id", S.trim_tails(F.col("seq")).alias("trimmed"))


@register("homopolymer_trim", sql("seqs", "contigs", body="SELECT contig_id, regexp_replace(regexp_replace(seq, '^(?:A{5,}|T{5,})', ''), '(?:A{5,}|T{5,})$', '') AS trimmed FROM contigs"))
def homopolymer_trim(spark, d):
    """The stricter rule: runs without another base, from a least length on."""
    return dna.contigs(spark, d).select("contig_id", S.trim_homopolymer_ends(F.col("seq"), 5).alias("trimmed"))


@register("kmer_count_canonical", sql("seqs", "reads", body=f"SELECT kmer, count(*) AS cnt FROM (SELECT least(k, {RC.format('k')}) AS kmer FROM (SELECT substr(seq, i, 25) AS k FROM reads, unnest(range(1, 77)) t(i))) GROUP BY kmer HAVING count(*) >= 2"))
def kmer_count_canonical(spark, d):
    return K.count_kmers(dna.reads(spark, d), hard=2, is_canonical=True)


@register("double_strandify", sql("seqs", "reads", "k1", body=f"SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT kmer, cnt FROM k1 UNION ALL SELECT {RC.format('kmer')}, cnt FROM k1) GROUP BY kmer"))
def double_strandify(spark, d):
    return N.both_strands(dna.reads(spark, d), K.K + 1, 3)


@register("kp1_to_k", sql("seqs", "reads", "k1", body="SELECT kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT substr(kmer, 1, 24) AS kmer, cnt FROM k1 UNION ALL SELECT substr(kmer, 2, 24), cnt FROM k1) GROUP BY kmer"))
def kp1_to_k(spark, d):
    return nodes(spark, d).select(F.col("node").alias("kmer"), (F.col("w_in") + F.col("w_out")).alias("cnt"))


@register("palindromes", sql("seqs", "reads", body=f"SELECT kmer, count(*) AS cnt FROM (SELECT substr(seq, i, 6) AS kmer FROM reads, unnest(range(1, 96)) t(i)) WHERE kmer = {RC.format('kmer')} GROUP BY kmer"))
def palindromes(spark, d):
    k = K.count_kmers(dna.reads(spark, d), k=6)
    return k.where(F.col("kmer") == S.reverse_complement(F.col("kmer")))


@register(
    "read_tiles",
    sql("seqs", "contigs", body="SELECT contig_id, substr(seq, i + 1, 24) AS tile FROM (SELECT contig_id, seq, i FROM contigs, unnest(range(0, greatest(length(seq) - 24, 0), 24)) t(i) UNION SELECT contig_id, seq, length(seq) - 24 FROM contigs WHERE length(seq) >= 24)"),
)
def read_tiles(spark, d):
    return dna.contigs(spark, d).select("contig_id", F.explode(S.tiles(F.col("seq"), 24)).alias("tile"))


@register("dbg_edges", sql("seqs", "reads", "k1", "edges", body="SELECT * FROM edges"))
def dbg_edges(spark, d):
    return K.dbg_edges(solid(spark, d))


@register("node_degrees", sql("seqs", "reads", "k1", "edges", body="SELECT node, CAST(sum(i) AS BIGINT) AS indeg, CAST(sum(o) AS BIGINT) AS outdeg FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node"))
def node_degrees(spark, d):
    return nodes(spark, d).select("node", "indeg", "outdeg")


_DEG = "deg AS (SELECT node, sum(i) AS indeg, sum(o) AS outdeg FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY node)"


@register("xnodes", sql("seqs", "reads", "k1", "edges", _DEG, body="SELECT node FROM deg WHERE indeg >= 2 AND outdeg >= 2"))
def xnodes(spark, d):
    return nodes(spark, d).where("indeg >= 2 and outdeg >= 2").select("node")


@register("branch_nodes", sql("seqs", "reads", "k1", "edges", _DEG, body="SELECT node, CAST(indeg AS BIGINT) AS indeg, CAST(outdeg AS BIGINT) AS outdeg FROM deg WHERE indeg > 1 OR outdeg > 1"))
def branch_nodes(spark, d):
    return nodes(spark, d).where("indeg > 1 or outdeg > 1").select("node", "indeg", "outdeg")


@register(
    "unitigs",
    "WITH RECURSIVE "
    + ", ".join(dna.SQL[n] for n in ("seqs", "reads", "k1", "edges", "nodes"))
    + f", {_DEG}, link AS (SELECT e.src, e.dst FROM edges e JOIN deg a ON a.node = e.src AND a.outdeg = 1 JOIN deg b ON b.node = e.dst AND b.indeg = 1 WHERE e.src <> e.dst), "
    "chain AS (SELECT node AS first_kmer, node AS last_node, 1 AS n, node AS seq FROM nodes WHERE node NOT IN (SELECT dst FROM link) UNION ALL SELECT c.first_kmer, o.dst, c.n + 1, c.seq || right(o.dst, 1) FROM chain c JOIN link o ON o.src = c.last_node), "
    "ring AS (SELECT node AS first_kmer, node AS last_node, 1 AS n, node AS seq FROM nodes WHERE node NOT IN (SELECT last_node FROM chain) UNION ALL SELECT r.first_kmer, o.dst, r.n + 1, r.seq || right(o.dst, 1) FROM ring r JOIN link o ON o.src = r.last_node WHERE o.dst > r.first_kmer) "
    "SELECT first_kmer, CAST(n AS BIGINT) AS n_nodes, seq FROM chain WHERE last_node NOT IN (SELECT src FROM link) "
    "UNION ALL SELECT r.first_kmer, r.n, r.seq FROM ring r JOIN link o ON o.src = r.last_node AND o.dst = r.first_kmer",
)
def unitigs(spark, d):
    return N.condensed(dna.reads(spark, d), K.K, 3)[0].select("first_kmer", "n_nodes", "seq")


@register("node_prevalence", sql("seqs", "reads", "k1", "edges", "nodes", body="SELECT node, coalesce(CAST(sum(cnt) AS BIGINT), 0) AS prevalence, coalesce(CAST(23 * count(src) AS BIGINT), 0) AS overlap_prevalence FROM nodes LEFT JOIN edges ON src = node GROUP BY node"))
def node_prevalence(spark, d):
    """Sum of out-edge counts, and the variant that sums overlap lengths instead."""
    return nodes(spark, d).select("node", F.col("w_out").alias("prevalence"), (F.col("outdeg") * (K.K - 1)).alias("overlap_prevalence"))


@register("seed_order", sql("seqs", "reads", "k1", body="SELECT kmer, cnt, rank() OVER (ORDER BY cnt DESC) AS weight_rank FROM k1"))
def seed_order(spark, d):
    """Rank of each k-mer's weight: weights are counted first, so ranking sees one row a weight."""
    k = solid(spark, d)
    from pyspark.sql import Window as W

    n = k.groupBy("cnt").agg(F.count(F.lit(1)).alias("n"))
    rank = n.withColumn("weight_rank", F.sum("n").over(W.orderBy(F.desc("cnt"))) - F.col("n") + 1).drop("n")
    return k.join(rank, "cnt").select("kmer", "cnt", "weight_rank")


@register("kmer_semi_anti", sql("seqs", "reads", "k1", "edges", "nodes", body="SELECT node, EXISTS (SELECT 1 FROM edges e WHERE e.src = node) AS extends FROM nodes"))
def kmer_semi_anti(spark, d):
    """Nodes, and whether some k-mer extends them."""
    return nodes(spark, d).select("node", (F.col("outdeg") > 0).alias("extends"))


@register(
    "tsv_kmer_merge",
    sql("seqs", "reads", body="SELECT upper(kmer) AS kmer, CAST(sum(c) AS DOUBLE) AS cnt FROM (SELECT lower(substr(seq, 1, 12)) AS kmer, 1.0 AS c FROM reads UNION ALL SELECT substr(seq, 89, 12), 0.5 FROM reads) GROUP BY 1"),
)
def tsv_kmer_merge(spark, d):
    """Weights of k-mer tables in mixed case merged by sum."""
    r = dna.reads(spark, d)
    both = r.select(F.lower(F.substring("seq", 1, 12)).alias("kmer"), F.lit(1.0).alias("c")).union(r.select(F.substring("seq", 89, 12), F.lit(0.5)))
    return both.groupBy(F.upper("kmer").alias("kmer")).agg(F.sum("c").alias("cnt"))
