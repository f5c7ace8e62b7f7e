"""Queries on assembly graphs, and the remaining scalar operators."""

from __future__ import annotations

from pyspark.sql import functions as F, Window as W

from readloom.catalog import register
from readloom.functions import sequence as S
from readloom.operators import graph as G
from readloom.operators import kmers as K
from readloom.operators import nodebins as N
from readloom.operators import superkmers as X
from readloom.plans.reads import _DEG, nodes, solid
from readloom.sources import dna
from readloom.sources.dna import SQL, sql

_DBG = ("seqs", "reads", "k1", "edges")
_UNITIGS = (
    "WITH RECURSIVE " + ", ".join(SQL[n] for n in (*_DBG, "nodes")) + f", {_DEG},"
    " link AS (SELECT e.src, e.dst FROM edges e JOIN deg a ON a.node = e.src AND a.outdeg = 1 JOIN deg b ON b.node = e.dst AND b.indeg = 1 WHERE e.src <> e.dst),"
    " chain AS (SELECT node AS first_kmer, node AS last_node, node AS seq FROM nodes WHERE node NOT IN (SELECT dst FROM link) UNION ALL SELECT c.first_kmer, o.dst, c.seq || right(o.dst, 1) FROM chain c JOIN link o ON o.src = c.last_node),"
    " ring AS (SELECT node AS first_kmer, node AS last_node, node AS seq FROM nodes WHERE node NOT IN (SELECT last_node FROM chain) UNION ALL SELECT r.first_kmer, o.dst, r.seq || right(o.dst, 1) FROM ring r JOIN link o ON o.src = r.last_node WHERE o.dst > r.first_kmer),"
    " u AS (SELECT first_kmer, last_node, seq FROM chain WHERE last_node NOT IN (SELECT src FROM link) UNION ALL SELECT r.* FROM ring r JOIN link o ON o.src = r.last_node AND o.dst = r.first_kmer),"
    " ue AS (SELECT a.first_kmer AS src, e.dst, e.cnt FROM edges e JOIN u a ON a.last_node = e.src JOIN u b ON b.first_kmer = e.dst),"
    " ud AS (SELECT first_kmer, coalesce(o, 0) AS outdeg, coalesce(i, 0) AS indeg FROM u LEFT JOIN (SELECT src, count(*) AS o FROM ue GROUP BY src) ON src = first_kmer LEFT JOIN (SELECT dst, count(*) AS i FROM ue GROUP BY dst) ON dst = first_kmer)"
)


def _edges(spark, d):
    return K.dbg_edges(solid(spark, d))


def _unitigs(spark, d):
    return N.condensed(dna.reads(spark, d), K.K, 3)


@register("unitig_edges", _UNITIGS + " SELECT src, dst, cnt FROM ue")
def unitig_edges(spark, d):
    return _unitigs(spark, d)[1].select("src", "dst", "cnt")


@register("graph_stats", _UNITIGS + " SELECT (SELECT count(*) FROM u) AS n_nodes, (SELECT count(*) FROM ue) AS n_edges, (SELECT CAST(sum(length(seq)) AS BIGINT) FROM u) AS n_bases")
def graph_stats(spark, d):
    u, e = _unitigs(spark, d)
    n = e.agg(F.count(F.lit(1)).alias("n_edges"))
    return u.agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(F.length("seq")).alias("n_bases")).join(n).select("n_nodes", "n_edges", "n_bases")


_UP = ", up AS (SELECT first_kmer, CAST(sum(coalesce(w, 0)) AS BIGINT) AS prevalence, count(*) AS n FROM (SELECT first_kmer, substr(seq, i, 24) AS src FROM u, unnest(range(1, length(seq) - 22)) t(i)) LEFT JOIN (SELECT src, sum(cnt) AS w FROM edges GROUP BY src) USING (src) GROUP BY first_kmer)"
_LAID = (
    ", uk AS (SELECT a.first_kmer AS src, b.first_kmer AS dst, e.src || right(e.dst, 1) AS kmer FROM edges e JOIN u a ON a.last_node = e.src JOIN u b ON b.first_kmer = e.dst),"
    " rk AS (SELECT read_id, substr(seq, i, 25) AS kmer FROM reads, unnest(range(1, 77)) t(i)),"
    " laid AS (SELECT read_id FROM rk SEMI JOIN k1 USING (kmer) GROUP BY read_id HAVING count(*) = 76),"
    " sup AS (SELECT src, dst, count(read_id) AS support FROM uk LEFT JOIN (SELECT read_id, kmer FROM rk SEMI JOIN laid USING (read_id)) USING (kmer) GROUP BY src, dst)"
)
#: Average prevalence below which a node of the query is rare; read length and overlap of k-mers.
RARE, LENGTH, OVERLAP = 12.0, 100, 23


@register("suspicious_nodes", _UNITIGS + _UP + f", pre AS (SELECT dst AS first_kmer, avg(outdeg) AS before FROM ue JOIN ud ON ud.first_kmer = ue.src GROUP BY dst), post AS (SELECT src AS first_kmer, avg(indeg) AS after FROM ue JOIN ud ON ud.first_kmer = ue.dst GROUP BY src) SELECT first_kmer FROM u JOIN ud USING (first_kmer) JOIN up USING (first_kmer) LEFT JOIN pre USING (first_kmer) LEFT JOIN post USING (first_kmer) WHERE ((indeg = 0 OR outdeg = 0) AND length(seq) <= 100) OR (prevalence / n::DOUBLE < {RARE} AND (indeg = 0 OR outdeg = 0 OR (before >= 2 AND after >= 2)))")
def suspicious_nodes(spark, d):
    u, links = _unitigs(spark, d)
    return G.suspicious(u, links, None, 100, RARE)


@register("average_prevalence", _UNITIGS + _UP + " SELECT first_kmer, prevalence, n, prevalence / n::DOUBLE AS average FROM up")
def average_prevalence(spark, d):
    """Weight of a node over its number of k-mers; also its approximate copy count, as that number is its normalisation."""
    return G.prevalences(_unitigs(spark, d)[0]).withColumn("average", F.col("prevalence") / F.col("n"))


def _support(spark, d):
    u, links = _unitigs(spark, d)
    return u, G.edge_support(G.laid_reads(dna.reads(spark, d), 3), links)


@register("known_edge_support", _UNITIGS + _LAID + " SELECT src, dst, support FROM sup")
def known_edge_support(spark, d):
    return _support(spark, d)[1]


@register("bubble_pairs", _UNITIGS + ", p AS (SELECT dst AS first_kmer, string_agg(DISTINCT src, ',' ORDER BY src) AS pred FROM ue GROUP BY dst), s AS (SELECT src AS first_kmer, string_agg(DISTINCT dst, ',' ORDER BY dst) AS succ FROM ue GROUP BY src), x AS (SELECT * FROM u JOIN p USING (first_kmer) JOIN s USING (first_kmer)) SELECT a.first_kmer AS a, b.first_kmer AS b, CAST(hamming(a.seq, b.seq) AS INT) AS n_mismatches FROM x a JOIN x b ON a.pred = b.pred AND a.succ = b.succ AND length(a.seq) = length(b.seq) AND a.first_kmer < b.first_kmer WHERE hamming(a.seq, b.seq) < 0.1 * length(a.seq)")
def bubble_pairs(spark, d):
    u, e = _unitigs(spark, d)
    return G.bubbles(u, e)


_BRANCH = _DEG + ", x AS (SELECT node, indeg, outdeg FROM deg WHERE indeg >= 2 OR outdeg >= 2)"
_BRIDGE = "br AS (SELECT node, read_id, i AS pos, substr(seq, i - 1, 1) AS before, substr(seq, i + 24, 1) AS after FROM (SELECT read_id, seq, i, substr(seq, i, 24) AS node FROM reads, unnest(range(2, 77)) t(i)) JOIN x USING (node))"


@register("bridging_reads", sql(*_DBG, _BRANCH, _BRIDGE, body="SELECT node, read_id, CAST(pos AS INT) AS pos, before, after FROM br"))
def bridging_reads(spark, d):
    return N.bridging_reads(dna.reads(spark, d), K.K, 3)


@register("bridged_xnodes", sql(*_DBG, _BRANCH, _BRIDGE, body="SELECT x.node, (any_value(indeg) - count(DISTINCT before) <= 0 AND any_value(outdeg) - count(DISTINCT after) <= 0) OR (any_value(indeg) - count(DISTINCT before) = 1 AND any_value(outdeg) - count(DISTINCT after) = 1) AS is_bridged FROM x LEFT JOIN br ON br.node = x.node GROUP BY x.node"))
def bridged_xnodes(spark, d):
    return N.bridged(dna.reads(spark, d), K.K, 3)


@register("copy_counts_exact", _UNITIGS + _LAID + " SELECT first_kmer, CAST(coalesce(sum(support), 0) AS BIGINT) AS copy_count FROM u LEFT JOIN sup ON src = first_kmer GROUP BY first_kmer")
def copy_counts_exact(spark, d):
    """Copy counts of nodes from reads laid on the graph; those of edges are in ``exported_edges``."""
    return G.node_support(*_support(spark, d))


@register("copy_counts_approx", _UNITIGS + _UP + " SELECT src, dst, 0.5 * (a.prevalence + b.prevalence) / 76.0::DOUBLE AS copy_count FROM ue JOIN up a ON a.first_kmer = src JOIN up b ON b.first_kmer = dst")
def copy_counts_approx(spark, d):
    u, links = _unitigs(spark, d)
    return G.approximate_copy_counts(G.prevalences(u), links, LENGTH, OVERLAP)


@register("self_loops", sql("seqs", "reads", body="SELECT kmer, count(*) AS cnt FROM (SELECT substr(seq, i, 5) AS kmer FROM reads, unnest(range(1, 97)) t(i)) WHERE left(kmer, 4) = right(kmer, 4) GROUP BY kmer"))
def self_loops(spark, d):
    """Edges from a node to itself, on short k-mers so that there are some."""
    e = K.dbg_edges(K.count_kmers(dna.reads(spark, d), k=5), 4)
    return e.where("src = dst").select(F.concat("src", F.substring("dst", -1, 1)).alias("kmer"), "cnt")


@register("exported_edges", _UNITIGS + _LAID + " SELECT src, dst, support / 76.0::DOUBLE AS copy_count FROM sup WHERE support > 0")
def exported_edges(spark, d):
    """Edges that reads go along."""
    return G.exact_copy_counts(_support(spark, d)[1], LENGTH, OVERLAP).where("copy_count > 0")


@register("path_pairs", sql("seqs", "contigs", body="SELECT contig_id, i AS step, substr(seq, i * 24 + 1, 24) AS src, substr(seq, i * 24 + 25, 24) AS dst FROM contigs, unnest(range(0, greatest(length(seq) // 24 - 1, 0))) t(i)"))
def path_pairs(spark, d):
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.length("seq") / 24).cast("int") - 1), lambda i: F.substring("seq", i * 24 + 1, F.lit(24)))
    t = dna.contigs(spark, d).where(F.length("seq") >= 24).select("contig_id", F.posexplode(cut).alias("step", "node"))
    nxt = F.lead("node").over(W.partitionBy("contig_id").orderBy("step"))
    return t.select("contig_id", F.col("step").cast("long").alias("step"), F.col("node").alias("src"), nxt.alias("dst")).where("dst is not null")


@register("path_sequences", sql("seqs", "contigs", body="SELECT contig_id, seq FROM contigs WHERE length(seq) >= 24"))
def path_sequences(spark, d):
    """Contigs spelled from the paths of their k-mers."""
    c = dna.contigs(spark, d).where(F.length("seq") >= 24)
    return c.select("contig_id", S.kmers(F.col("seq"), 24).alias("p")).select("contig_id", G.spell(F.col("p"), 24).alias("seq"))


@register("top_flows", sql(*_DBG, body="SELECT src, kmer_to, cnt FROM (SELECT left(src, 6) AS src, dst AS kmer_to, cnt, row_number() OVER (PARTITION BY left(src, 6) ORDER BY cnt DESC, dst) AS k FROM edges) WHERE k <= 10"))
def top_flows(spark, d):
    """The ten heaviest edges of each group, as the sparsity limit of a node's flows keeps them."""
    e = _edges(spark, d).select(F.substring("src", 1, 6).alias("src"), F.col("dst").alias("kmer_to"), "cnt")
    w = W.partitionBy("src").orderBy(F.desc("cnt"), "kmer_to")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


@register("source_sink_nodes", _UNITIGS + _LAID + ", cc AS (SELECT first_kmer AS node, indeg, outdeg, coalesce(s, 0) AS weight FROM ud LEFT JOIN (SELECT src AS first_kmer, sum(support) AS s FROM sup GROUP BY src) USING (first_kmer)) SELECT 'S' AS dummy, node, CAST(weight AS BIGINT) AS weight, CAST(CASE WHEN indeg = 0 THEN 0 ELSE -1 END AS INT) AS penalty FROM cc UNION ALL SELECT 'E', node, CAST(weight AS BIGINT), CASE WHEN outdeg = 0 THEN 0 ELSE -1 END FROM cc")
def source_sink_nodes(spark, d):
    """Edges from a dummy start and to a dummy end with the weights of their nodes.

    Those of nodes that nothing enters or leaves are without penalty; the others are of the penalised variant.
    """
    u, support = _support(spark, d)
    n = G.with_degrees(G.node_support(u, support), support, "first_kmer")
    side = lambda name, deg: n.select(F.lit(name).alias("dummy"), F.col("first_kmer").alias("node"), F.col("copy_count").alias("weight"), F.when(F.col(deg) == 0, 0).otherwise(-1).alias("penalty"))
    return side("S", "indeg").union(side("E", "outdeg"))


@register("prevalence_percentiles", sql(*_DBG, "p AS (SELECT src, CAST(sum(cnt) AS BIGINT) AS w FROM edges GROUP BY src)", body="SELECT w, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY w) AS BIGINT) * 100 // (SELECT count(*) FROM p) AS percentile FROM p GROUP BY w"))
def prevalence_percentiles(spark, d):
    p = nodes(spark, d).where("outdeg > 0").groupBy(F.col("w_out").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    upto, every = W.orderBy("w"), W.orderBy("w").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return p.select("w", "n", F.floor(F.sum("n").over(upto) * 100 / F.sum("n").over(every)).alias("percentile"))


@register("most_likely_extension", sql(*_DBG, body="SELECT src, dst, cnt FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY cnt DESC, position(right(dst, 1) IN 'AGCT')) = 1"))
def most_likely_extension(spark, d):
    """The heaviest next base of each node; ties go to A, G, C, T in this order."""
    return nodes(spark, d).where("outdeg > 0").select(F.col("node").alias("src"), "dst", "cnt")


@register("prefix_equality", sql("seqs", "reads", "pairs", body="SELECT pair_id, left(seq1, 3) = left(seq2, 3) AS same, CAST(hamming(seq1, seq2) AS INT) AS n_mismatches FROM pairs"))
def prefix_equality(spark, d):
    p = dna.pairs(spark, d)
    return p.select("pair_id", S.same_prefix(F.col("seq1"), F.substring("seq2", 1, 3)).alias("same"), S.mismatches(F.col("seq1"), F.col("seq2")).alias("n_mismatches"))


@register("key_parts", sql("seqs", "contigs", body="SELECT contig_id, substr(seq, 1, length(seq) // 3) AS p0, substr(seq, length(seq) // 3 + 1, 2 * length(seq) // 3 - length(seq) // 3) AS p1, substr(seq, 2 * length(seq) // 3 + 1, length(seq) - 2 * length(seq) // 3) AS p2 FROM contigs"))
def key_parts(spark, d):
    return dna.contigs(spark, d).select("contig_id", *(S.key_part(F.col("seq"), p, 3).alias(f"p{p}") for p in range(3)))


@register("common_string", sql("seqs", "reads", "pairs", body="SELECT pair_id, coalesce(string_agg(substr(seq1, i, 1), '' ORDER BY i) FILTER (substr(seq1, i, 1) = substr(seq2, i, 1)), '') AS common FROM pairs, unnest(range(1, 101)) t(i) GROUP BY pair_id"))
def common_string(spark, d):
    return dna.pairs(spark, d).select("pair_id", S.common_string(F.col("seq1"), F.col("seq2")).alias("common"))


_COUNTS = "b AS (SELECT contig_id, list_transform(['A','C','G','T'], lambda x: CAST(length(seq) - length(replace(seq, x, '')) AS DOUBLE)) AS n FROM contigs)"


@register("vector_functions", sql("seqs", "contigs", _COUNTS, body="SELECT contig_id, n[1] * n[1] + n[2] * n[2] + n[3] * n[3] + n[4] * n[4] AS dot, list_sort(n, 'DESC')[2] AS second FROM b"))
def vector_functions(spark, d):
    n = F.array(*((F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).cast("double") for b in "ACGT"))
    x = dna.contigs(spark, d).select("contig_id", n.alias("n"))
    return x.select("contig_id", S.dot(F.col("n"), F.col("n")).alias("dot"), S.nth_largest(F.col("n"), 2).alias("second"))


_THREES = "SELECT substr({0}, i, 3) FROM unnest(range(1, 99)) t(i)"


def _common(*of: str) -> str:
    return "(SELECT count(*) FROM (" + " INTERSECT ".join(_THREES.format(x) for x in of) + "))"


@register("list_intersections", sql("seqs", "reads", "pairs", body="SELECT pair_id, " + _common("seq1", "seq2", "reverse(seq1)") + " AS n_common, " + _common("seq1", "seq2", "reverse(seq1)", "reverse(seq2)", "translate(seq1, 'ACGT', 'TGCA')") + " AS n_common5 FROM pairs"))
def list_intersections(spark, d):
    return X.common_words(dna.pairs(spark, d), "pair_id")


@register("set_operations", sql("seqs", "reads", body="SELECT 'both' AS op, count(*) AS n FROM (SELECT left(seq, 10) FROM reads INTERSECT SELECT right(seq, 10) FROM reads) UNION ALL SELECT 'first', count(*) FROM (SELECT left(seq, 10) FROM reads EXCEPT SELECT right(seq, 10) FROM reads) UNION ALL SELECT 'any', count(*) FROM (SELECT left(seq, 10) FROM reads UNION SELECT right(seq, 10) FROM reads)"))
def set_operations(spark, d):
    r = dna.reads(spark, d)
    a, b = r.select(F.substring("seq", 1, 10).alias("s")), r.select(F.substring("seq", -10, 10).alias("s"))
    count = lambda x, name: x.agg(F.lit(name).alias("op"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "both").union(count(a.subtract(b), "first")).union(count(a.union(b).distinct(), "any"))


@register("rounded_weights", sql(*_DBG, body="SELECT src, CAST(floor(avg(cnt)) AS BIGINT) AS whole, round(avg(cnt), 3) AS rounded FROM edges GROUP BY src"))
def rounded_weights(spark, d):
    m = F.col("w_out") / F.col("outdeg")
    return nodes(spark, d).where("outdeg > 0").select(F.col("node").alias("src"), F.floor(m).alias("whole"), F.round(m, 3).alias("rounded"))


@register("header_tokens", "SELECT doc_id, '>Single_' || lang || ' ' || source AS header, source AS last_token, try_cast(substr(source, 4) AS DOUBLE) IS NOT NULL AS is_number FROM documents")
def header_tokens(spark, d):
    from readloom.session import table

    h = F.concat(F.lit(">Single_"), "lang", F.lit(" "), "source")
    t = table(spark, d, "documents").select("doc_id", h.alias("header"))
    last = F.element_at(F.split("header", r"\s+"), -1)
    return t.select("doc_id", "header", last.alias("last_token"), S.is_number(F.substring(last, 4, 100)).alias("is_number"))


@register("contigs_by_length", sql("seqs", "contigs", body="SELECT contig_id, length(seq) AS n, row_number() OVER (ORDER BY length(seq) DESC, contig_id) AS place FROM contigs"))
def contigs_by_length(spark, d):
    """Contigs from the longest to the shortest, ties by id, with their places."""
    from readloom.operators.numbering import row_numbers_within

    c = dna.contigs(spark, d).select("contig_id", F.length("seq").alias("n"))
    n = c.groupBy("n").agg(F.count(F.lit(1)).alias("k"))  # a row for each length
    longer = n.select("n", (F.sum("k").over(W.orderBy(F.desc("n"))) - F.col("k")).alias("before"))
    c = row_numbers_within(c, "n", "contig_id", "k").join(F.broadcast(longer), "n")
    return c.select("contig_id", "n", (F.col("before") + F.col("k")).alias("place")).orderBy("place")
