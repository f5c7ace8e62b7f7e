"""Connected components of an edge table by contraction to least neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readloom.session import Tables, dealt_if_long

#: Edges from which on edges are written between their two relabellings, so that each join can split a hub.
MANY = 1_000_000
#: So many edges that a contraction has left at most are finished in one task: rounds on them would cost seconds each.
FEW = 300_000


def _finish(e: DataFrame) -> DataFrame:
    """``(node, root)`` of at most ``FEW`` edges; nodes that are not their component's least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def find(x):
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a, b = find(a), find(b)
                up[max(a, b)] = min(a, b)
            kind = batch.schema.field(0).type
        gone = [x for x, y in up.items() if x != y]
        if gone:
            yield pa.RecordBatch.from_arrays([pa.array(gone, kind), pa.array([find(x) for x in gone], kind)], ["node", "root"])

    kind = e.schema["a"].dataType.simpleString()
    return e.select("a", "b").coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def _roots(e: DataFrame, n: int, tables: Tables, max_rounds: int) -> DataFrame:
    """``(node, root)``: where the way from each larger end over least smaller neighbours ends, by pointer doubling; ``n``: edges."""
    p = tables.save(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")), "least")
    for _ in range(max_rounds):
        on = p.select(F.col("node").alias("root"), F.col("root").alias("on"))
        far = p.join(dealt_if_long(on, n), "root", "left").select("node", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved"))
        far = tables.save(far, "roots")
        tables.drop(p)
        p = far
        if p.where("moved").isEmpty():
            return p.drop("moved")
    raise RuntimeError(f"roots not found in {max_rounds} rounds")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = its smallest node.

    Each round points every node that has a smaller neighbour at the least one. Those
    ways lead down to the nodes without one, and the edges are drawn between these
    instead. What a round has united is an edge no more, so that finished components
    take no part in later rounds, and at least half of the nodes of the others are
    gone. The nodes and roots of all rounds, each a fraction of those before, are
    joined at the end. Rounds are written tables: lineage stays short and a lost
    executor costs one round. Minima are aggregated map-side, so a hub is one partial
    minimum per task; relabelling joins are plain shuffles, where adaptive execution
    splits the partition of a hub. What a round has left of ``FEW`` edges or fewer is
    finished in one task. More than ``max_rounds`` rounds, or doublings in one, raise.

    Self loops and rows with a null end are ignored. Isolated nodes are the
    caller's: they have no edge.
    """
    tables = Tables(edges.sparkSession, "components")
    tidy = lambda df: df.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = tables.save(tidy(edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))), "edges")
    rounds: list[DataFrame] = []
    sizes: list[int] = []  # edges of each round
    while n := e.count():
        if rounds and n <= FEW:
            rounds.append(tables.save(_finish(e), "rest"))
            sizes.append(n)
            break
        if len(rounds) == max_rounds:
            raise RuntimeError(f"components not found in {max_rounds} rounds")
        p = _roots(e, n, tables, max_rounds)
        rounds.append(p)
        sizes.append(n)
        half = e.join(dealt_if_long(p.withColumnRenamed("node", "a"), n), "a").select(F.col("root").alias("a"), "b").where("a != b").distinct()
        half = tables.save(half, "half") if n > MANY else half
        both = half.join(dealt_if_long(p.select(F.col("node").alias("b"), "root"), n), "b", "left").select("a", F.coalesce("root", "b").alias("b"))
        nxt = tables.save(tidy(both), "round")
        tables.drop(e)
        tables.drop(half)
        e = nxt
    if not rounds:
        return e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found, n = rounds.pop(), sizes.pop()
    for p in reversed(rounds):
        later = found.select(F.col("node").alias("root"), F.col("root").alias("last"))
        found = p.join(dealt_if_long(later, n), "root", "left").select("node", F.coalesce("last", "root").alias("root")).union(found)
        found, n = tables.save(found, "found"), n + sizes.pop()
    roots = found.select("root").distinct()
    return found.select("node", F.col("root").alias("component")).union(roots.select(F.col("root").alias("node"), F.col("root").alias("component")))
