"""k-mer counting and the de Bruijn relations derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readloom.functions import sequence as S
from readloom.operators import superkmers as X
from readloom.session import Tables, dealt_if_long

K = 24


def count_kmers(reads: DataFrame, k: int = K + 1, hard: int = 1, is_canonical: bool = False) -> DataFrame:
    """``(kmer, cnt)`` of at least ``hard``. k-mers over an unread base are not counted:
    reads are cut there first.

    Runs of k-mers with a common minimiser are dealt and counted bin by bin. A
    k-mer that is hardly longer than a minimiser has few values: those are a map-side
    aggregation, as are k-mers that don't fit 64 bits.
    """
    if X.MINIMISER + 4 < k <= X.LONGEST:
        return X.counted(reads, k, hard, is_canonical)
    pieces = reads.select(F.explode(F.split("seq", "[^ACGT]+")).alias("seq"))
    rows = S.explode_kmers(pieces, [], "seq", k).select("kmer")
    if is_canonical:
        rows = rows.select(S.canonical(F.col("kmer")).alias("kmer"))
    return rows.groupBy("kmer").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= hard)


def double_strandify(k1: DataFrame) -> DataFrame:
    """Every k-mer and its reverse complement with the same weight; a palindrome counts twice."""
    both = k1.select("kmer", "cnt").union(k1.select(S.reverse_complement(F.col("kmer")), "cnt"))
    return both.groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def shorten(k1: DataFrame, k: int = K) -> DataFrame:
    """k-mer weights from (k+1)-mers: prefix and suffix both get the weight."""
    ends = F.explode(F.array(F.substring("kmer", 1, k), F.substring("kmer", 2, k))).alias("kmer")
    return k1.select(ends, "cnt").groupBy("kmer").agg(F.sum("cnt").alias("cnt"))


def dbg_edges(k1: DataFrame, k: int = K) -> DataFrame:
    """``(src, dst, cnt)``: an edge for each (k+1)-mer from its prefix to its suffix."""
    return k1.select(F.substring("kmer", 1, k).alias("src"), F.substring("kmer", 2, k).alias("dst"), "cnt")


def degrees(edges: DataFrame) -> DataFrame:
    """``(node, indeg, outdeg)`` in one aggregation over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.node").alias("node")).agg(F.sum("e.i").alias("indeg"), F.sum("e.o").alias("outdeg"))


def _walk(nodes: DataFrame, one: DataFrame, tables: Tables, max_rounds: int) -> DataFrame:
    """``(node, at, steps, done)``: the end of the chain of links ``one`` that each node is on, and how far it is.

    Nodes on rings are never done. Pointer doubling: after round r every node
    knows the node up to 2^r steps ahead, so a chain of n nodes takes log2 n
    rounds of one self-join each.
    """
    p = nodes.select("node").join(one.select(F.col("src").alias("node"), F.col("dst").alias("to")), "node", "left")
    p = tables.save(p.select("node", F.coalesce("to", "node").alias("at"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("to").isNull().alias("done")), "p")
    left, n = p.where("not done").count(), p.count()
    rounds = 0
    while left:
        if rounds == max_rounds:
            raise RuntimeError(f"chains not walked in {max_rounds} rounds")
        rounds += 1
        q = p.select(F.col("node").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("s2"), F.col("done").alias("d2"))
        nxt = p.join(dealt_if_long(q, n), "at").select("node", F.col("at2").alias("at"), (F.col("steps") + F.col("s2")).alias("steps"), F.col("d2").alias("done"))
        nxt = tables.save(nxt, "p")
        tables.drop(p)
        p, now = nxt, nxt.where("not done").count()
        # a chain that isn't done after round r is longer than 2^r, and gets nodes done in every later round
        if now == left and 1 << rounds > left:
            break
        left = now
    return p


def chain_ends(nodes: DataFrame, one: DataFrame, tables: Tables, max_rounds: int = 60) -> DataFrame:
    """``(node, at, steps)`` of ``nodes (node)`` on the links ``one``, of which each node has one out and one in at most: the end of
    a node's chain and how far it is. A closed ring is opened before its smallest node."""
    from readloom.operators.components import connected_components

    p = _walk(nodes, one, tables, max_rounds)
    ring = p.where("not done").select("node")
    walked = p.where("done").select("node", "at", "steps")
    if not ring.isEmpty():
        links = one.join(ring.select(F.col("node").alias("src")), "src", "left_semi")
        cc = connected_components(links)
        links = links.join(cc.select(F.col("node").alias("dst"), "component"), "dst").where("dst != component")
        walked = walked.union(_walk(ring, links, tables, max_rounds).select("node", "at", "steps"))
    return walked


def unitigs(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(first_kmer, n_nodes, seq)``: maximal chains of unambiguous edges; a closed ring starts at its smallest k-mer."""
    tables = Tables(edges.sparkSession, "unitigs")
    deg = degrees(edges)
    one = edges.where("src != dst").select("src", "dst")
    one = one.join(deg.where("outdeg = 1").select(F.col("node").alias("src")), "src", "left_semi")
    one = tables.save(one.join(deg.where("indeg = 1").select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst"), "one")
    walked = chain_ends(deg.select("node"), one, tables, max_rounds)
    chain = walked.groupBy("at").agg(F.sort_array(F.collect_list(F.struct((-F.col("steps")).alias("o"), "node"))).alias("c"))
    rest = F.array_join(F.transform(F.slice("c", 2, 2**30), lambda x: F.substring(x["node"], -1, 1)), "")
    return chain.select(F.col("c")[0]["node"].alias("first_kmer"), F.size("c").cast("long").alias("n_nodes"), F.concat(F.col("c")[0]["node"], rest).alias("seq"))
