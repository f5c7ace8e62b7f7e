"""Eulerian circuits and walks of a graph on edge tables.

At every node in-edges are paired with out-edges in any way: what follows what is a permutation of the edges,
and its cycles are rings that cover each edge once. A breadth-first tree over rings and the nodes
that they share tells where rings are joined: at a node of the tree, one in-edge of each of its rings
takes the successor of the next ring's. As it is a tree, all joins hold at once and leave one circuit
a component. Places on it are found by doubling. No node, ring or component is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from readloom.operators.components import connected_components
from readloom.operators.kmers import chain_ends
from readloom.operators.numbering import row_numbers_within
from readloom.operators.order import _together
from readloom.session import Tables


def balance(edges: DataFrame) -> DataFrame:
    """``(node, component, b)``: out- less in-edges of each node of ``(src, dst)``."""
    end = lambda c, b: F.struct(F.col(c).alias("node"), F.lit(b).alias("b"))
    b = edges.select(F.explode(F.array(end("src", 1), end("dst", -1))).alias("x")).groupBy("x.node").agg(F.sum("x.b").alias("b"))
    weak = connected_components(edges)
    return b.join(weak, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "b")


def _tree(on: DataFrame, tables: Tables, max_rounds: int) -> DataFrame:
    """``(v, ring)``: edges of a breadth-first tree over ``on (v, ring)`` from the least ring of each component."""
    cc = connected_components(on.select(F.concat(F.lit("r"), F.format_string("%020d", "ring")).alias("a"), F.concat(F.lit("v"), F.col("v").cast("string")).alias("b")), "a", "b")
    roots = cc.where("component = node").select(F.substring("component", 2, 20).cast("long").alias("ring"))
    front = tables.save(roots, "rings")
    rings, nodes, tree = [front], [], []
    for _ in range(max_rounds):
        up = front.join(on, "ring").groupBy("v").agg(F.min("ring").alias("ring"))
        up = up.join(_together(nodes), "v", "left_anti") if nodes else up
        up = tables.save(up.select("v", "ring"), "up")
        nodes.append(tables.save(up.select("v"), "v"))
        down = on.join(up.select("v"), "v").groupBy("ring").agg(F.min("v").alias("v")).join(_together(rings), "ring", "left_anti")
        down = tables.save(down.select("v", "ring"), "down")
        if down.isEmpty():
            return _together(tree) if tree else down
        tree += [up, down]
        front = tables.save(down.select("ring"), "rings")
        rings.append(front)
    raise RuntimeError(f"rings not joined in {max_rounds} rounds")


def eulerian_walks(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``(component, step, edge, src, dst)``, steps from 0, of edges ``(edge, src, dst)`` with unique long ids from 0 on: a circuit of each component
    whose nodes are all balanced, a walk of each with one start and one end; components with neither have no row.

    Several edges between two nodes and loops are edges like others.
    """
    tables = Tables(edges.sparkSession, "circuits")
    edges = tables.save(edges.select(F.col("edge").cast("long").alias("edge"), "src", "dst"), "edges")
    b = tables.save(balance(edges), "balance")
    odd = b.groupBy("component").agg(
        F.sum(F.abs("b")).alias("off"), F.max(F.when(F.col("b") == 1, F.col("node"))).alias("first"), F.max(F.when(F.col("b") == -1, F.col("node"))).alias("last"), F.max("b").alias("most")
    )
    odd = tables.save(odd.where("off = 0 or off = 2 and most = 1"), "whole")
    own = edges.join(b.select(F.col("node").alias("src"), "component"), "src").join(odd.select("component"), "component", "left_semi")
    # from a walk's end back to its start
    closing = odd.where("off = 2").select("component", (-1 - F.monotonically_increasing_id()).alias("edge"), F.col("last").alias("src"), F.col("first").alias("dst"))
    own = tables.save(own.select("component", "edge", "src", "dst").union(closing), "own")
    into = row_numbers_within(own.select(F.col("dst").alias("v"), "edge"), "v", "edge", "i")
    out = row_numbers_within(own.select(F.col("src").alias("v"), F.col("edge").alias("then")), "v", "then", "i")
    nxt = tables.save(into.join(out, ["v", "i"]).select("v", "edge", "then"), "next")
    cc = connected_components(nxt, "edge", "then").select(F.col("node").alias("edge"), F.col("component").alias("ring"))
    ringed = tables.save(nxt.join(cc, "edge", "left").select("v", "edge", "then", F.coalesce("ring", "edge").alias("ring")), "ringed")
    # rings have negative numbers where a closing edge is in them: count from the least
    low = ringed.agg(F.least(F.min("ring"), F.lit(0)).alias("low")).first().low or 0
    ringed = ringed.withColumn("ring", F.col("ring") - F.lit(low))
    on = tables.save(ringed.groupBy("v", "ring").agg(F.min("edge").alias("edge"), F.min_by("then", "edge").alias("then")), "on")
    tree = tables.save(_tree(on.select("v", "ring"), tables, max_rounds).distinct(), "tree")
    turn = row_numbers_within(tree.join(on, ["v", "ring"]), "v", "ring", "i")
    turn = tables.save(turn.join(tree.groupBy("v").agg(F.count(F.lit(1)).alias("m")), "v"), "turn")
    other = turn.select("v", F.col("i").alias("j"), F.col("then").alias("new"))
    turned = turn.withColumn("j", F.col("i") % F.col("m") + 1).join(other, ["v", "j"]).select("edge", "new")
    nxt = nxt.join(turned, "edge", "left").select("edge", F.coalesce("new", "then").alias("then"))
    # a circuit starts at its least edge; a walk's closing edge is the least, and is left out in the end
    least = own.groupBy("component").agg(F.min("edge").alias("start"))
    links = tables.save(nxt.join(least, nxt.then == least.start, "left_anti").select(F.col("edge").alias("src"), F.col("then").alias("dst")), "links")
    at = chain_ends(own.select(F.col("edge").alias("node")), links, tables)
    placed = own.join(at.select(F.col("node").alias("edge"), "steps"), "edge").join(own.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("low")), "component")
    step = F.col("n") - 1 - F.col("steps") - F.when(F.col("low") < 0, 1).otherwise(0)
    return placed.where("edge >= 0").select("component", step.alias("step"), "edge", "src", "dst")
