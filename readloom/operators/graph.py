"""One-pass relational operators on assembly graphs: nodes and edges as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from readloom.functions import sequence as S
from readloom.operators import superkmers as X
from readloom.operators.kmers import degrees


def unitig_graph(unitigs: DataFrame, edges: DataFrame, k: int = 24) -> DataFrame:
    """``(src, dst, cnt, kmer)`` between unitigs, named by their first k-mer: edges that leave a last and enter a first k-mer."""
    last = unitigs.select(F.col("first_kmer").alias("src_unitig"), F.substring("seq", -k, k).alias("src"))
    first = unitigs.select(F.col("first_kmer").alias("dst"))
    kmer = F.concat(F.col("src"), F.substring("dst", -1, 1)).alias("kmer")
    return edges.join(last, "src").join(first, "dst").select(F.col("src_unitig").alias("src"), "dst", "cnt", kmer)


def with_degrees(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``nodes`` with in- and out-degree, 0 where there are no edges."""
    d = degrees(edges).withColumnRenamed("node", key)
    return nodes.join(d, key, "left").fillna(0, ["indeg", "outdeg"])


def prevalences(unitigs: DataFrame, edges: DataFrame | None = None, k: int = 24) -> DataFrame:
    """``(first_kmer, prevalence, n)``: the weight that leaves a unitig's k-mers, and how many they are; without ``edges`` unitigs bring both."""
    if edges is None:
        return unitigs.select("first_kmer", "prevalence", F.col("n_nodes").alias("n"))
    p = edges.groupBy(F.col("src").alias("kmer")).agg(F.sum("cnt").alias("w"))
    at = S.explode_kmers(unitigs, ["first_kmer"], "seq", k)
    both = at.join(p, "kmer", "left").groupBy("first_kmer")
    return both.agg(F.sum(F.coalesce("w", F.lit(0))).alias("prevalence"), F.count(F.lit(1)).alias("n"))


def suspicious(unitigs: DataFrame, links: DataFrame, edges: DataFrame | None, longest: int, least: float, k: int = 24) -> DataFrame:
    """``(first_kmer)`` of unitigs to be removed: short ones without a way in or out, and those seen less than
    ``least`` times on average that have no way in or out or lie between neighbours with two ways on average."""
    u = with_degrees(unitigs.select("first_kmer", "seq"), links, "first_kmer").join(prevalences(unitigs, edges, k), "first_kmer")
    d = degrees(links)
    before = links.join(d.select(F.col("node").alias("src"), "outdeg"), "src").groupBy(F.col("dst").alias("first_kmer")).agg(F.avg("outdeg").alias("before"))
    after = links.join(d.select(F.col("node").alias("dst"), "indeg"), "dst").groupBy(F.col("src").alias("first_kmer")).agg(F.avg("indeg").alias("after"))
    u = u.join(before, "first_kmer", "left").join(after, "first_kmer", "left")
    hangs = (F.col("indeg") == 0) | (F.col("outdeg") == 0)
    between = (F.col("before") >= 2) & (F.col("after") >= 2)
    rare = (F.col("prevalence") / F.col("n") < least) & (hangs | between)
    return u.where((hangs & (F.length("seq") <= longest)) | rare).select("first_kmer")


def laid_reads(reads: DataFrame, hard: int, k: int = 24, key: str = "read_id") -> DataFrame:
    """Reads that the graph of (k+1)-mers spells that occur ``hard`` times in them: every (k+1)-mer of theirs is an edge."""
    n = X.frequent_runs(reads, k + 1, hard, key).groupBy(key).agg(F.sum("n").alias("_n"))
    return reads.join(n, key).where(F.col("_n") == F.length("seq") - k).drop("_n")


def edge_support(laid: DataFrame, links: DataFrame, k: int = 24, weight: str | None = None) -> DataFrame:
    """``(src, dst, support)`` of each unitig edge: how often laid reads go along it, each as often as it was seen."""
    if weight is None:
        n = X.counted_among(laid, links, k + 1).withColumnRenamed("n", "support")
    else:
        n = S.explode_kmers(laid, [weight], "seq", k + 1).groupBy("kmer").agg(F.sum(weight).alias("support"))
    return links.join(n, "kmer", "left").select("src", "dst", F.coalesce("support", F.lit(0)).cast("long").alias("support"))


def bubbles(unitigs: DataFrame, edges: DataFrame, share: float = 0.1) -> DataFrame:
    """``(a, b)``: unitigs of equal length and neighbours that differ in less than ``share`` of their bases."""
    pred = edges.groupBy(F.col("dst").alias("first_kmer")).agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("pred"))
    succ = edges.groupBy(F.col("src").alias("first_kmer")).agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("succ"))
    u = unitigs.join(pred, "first_kmer").join(succ, "first_kmer").withColumn("n", F.length("seq"))
    a, b = u.alias("a"), u.alias("b")
    same = (F.col("a.pred") == F.col("b.pred")) & (F.col("a.succ") == F.col("b.succ")) & (F.col("a.n") == F.col("b.n"))
    j = a.join(b, same & (F.col("a.first_kmer") < F.col("b.first_kmer")))
    miss = S.mismatches(F.col("a.seq"), F.col("b.seq"))
    return j.where(miss < share * F.col("a.n")).select(F.col("a.first_kmer").alias("a"), F.col("b.first_kmer").alias("b"), miss.alias("n_mismatches"))


def bridging_reads(nodes: DataFrame, reads: DataFrame, k: int = 24) -> DataFrame:
    """``(node, read_id, pos, before, after)``: reads that hold a node's k-mer with a base on either side."""
    at = S.explode_kmers(reads, ["read_id", "seq"], "seq", k).withColumnRenamed("kmer", "node")
    hit = at.join(nodes.select("node"), "node").where((F.col("pos") > 1) & (F.col("pos") + k <= F.length("seq")))
    return hit.select("node", "read_id", "pos", F.substring("seq", F.col("pos") - 1, F.lit(1)).alias("before"), F.substring("seq", F.col("pos") + k, F.lit(1)).alias("after"))


def bridged(nodes: DataFrame, bridges: DataFrame) -> DataFrame:
    """Nodes all of whose sides are bridged, or all but one on each side."""
    n = bridges.groupBy("node").agg(F.countDistinct("before").alias("b"), F.countDistinct("after").alias("a"))
    j = nodes.join(n, "node", "left").fillna(0, ["a", "b"])
    left, right = F.col("indeg") - F.col("b"), F.col("outdeg") - F.col("a")
    return j.select("node", (((left <= 0) & (right <= 0)) | ((left == 1) & (right == 1))).alias("is_bridged"))


def exact_copy_counts(support: DataFrame, read_length: int, overlap: int) -> DataFrame:
    """``(src, dst, copy_count)`` of edges: support over the places that a read along the edge can have."""
    return support.select("src", "dst", (F.col("support") / float(max(read_length - overlap - 1, 1))).alias("copy_count"))


def node_support(unitigs: DataFrame, support: DataFrame) -> DataFrame:
    """``(first_kmer, copy_count)`` of nodes: the support of all edges that leave them."""
    n = support.groupBy(F.col("src").alias("first_kmer")).agg(F.sum("support").alias("n"))
    return unitigs.join(n, "first_kmer", "left").select("first_kmer", F.coalesce("n", F.lit(0)).alias("copy_count"))


def approximate_copy_counts(prevalence: DataFrame, links: DataFrame, read_length: int, overlap: int) -> DataFrame:
    """``(src, dst, copy_count)`` of edges from the prevalence of both ends; 0 where no read can go along."""
    per = float(max(read_length - overlap - 1, 0))
    p = lambda side: prevalence.select(F.col("first_kmer").alias(side), F.col("prevalence").alias("p_" + side))
    both = links.join(p("src"), "src").join(p("dst"), "dst")
    return both.select("src", "dst", (0.5 * (F.col("p_src") + F.col("p_dst")) / per if per else F.lit(0.0)).alias("copy_count"))


def path_pairs(paths: DataFrame, key: str, step: str, node: str) -> DataFrame:
    """Consecutive nodes of each path."""
    nxt = F.lead(node).over(W.partitionBy(key).orderBy(step))
    return paths.select(key, F.col(node).alias("src"), nxt.alias("dst")).where("dst is not null")


def spell(nodes, k: int):
    """The sequence of a path of overlapping k-mers."""
    rest = F.array_join(F.transform(F.slice(nodes, 2, 2**30), lambda x: F.substring(x, -1, 1)), "")
    return F.when(F.size(nodes) > 0, F.concat(nodes[0], rest)).otherwise("")
