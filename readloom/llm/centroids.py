"""Centroid clustering (Lloyd's rounds in integers) with kd-tree filtering of the candidates.

Vectors are cut into blocks of at most ``TREE`` rows of a partition, and each block
is made a kd-tree once: halved at the median of its widest component down to
leaves of at most ``LEAF`` rows, every node with its count, componentwise integer
sum and bounding box. The trees are a written table that all rounds read.

In a round the candidates of a node are those of its parent, less every centroid
that another one, the nearest to the box's middle, dominates strictly: the point of
the box that lies farthest towards the former is nearer to the latter, in exact
integers, so no vector of the box is nearest to the former, ties included. A
node with one candidate left gives its count and sum as a whole; leaves that keep
several are resolved row by row. A task sends ``k`` rows of sums; the centroids,
also ``k`` rows, are all that the driver gets.

Kept are vectors of exactly ``width`` components, none null or non-finite; each
component x becomes floor(scale * x). What lies beyond ``FAR`` counts as ``FAR``,
so that a squared distance of 64 components fits a long; inertias beyond a long are
its largest value.

Defined results: other vectors are left out; null ids are kept and hashed as the
empty string, rows of equal id are vectors of their own, and of vectors with equal
hash the componentwise smaller one comes first; fewer vectors than ``k`` give as
many centroids; equal distances go to the smaller number, so of two equal centroids
the second stays empty and where it is; an empty table gives an empty result; only
the id is returned of the input's columns, so none can clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType

from readloom.llm.common import quoted, release, small_batches
from readloom.session import Tables, spread

K, WIDTH, SCALE, ROUNDS, SEED = 16, 64, 64, 3, 1
#: Rows of a tree and, at most, of a leaf; the largest magnitude of a component.
TREE, LEAF, FAR = 4096, 32, 1 << 27
_LONG = (1 << 63) - 1
_PARTS = (("v", np.int32), ("low", np.int32), ("high", np.int32), ("total", np.int64))


def whole_vectors(df: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", width: int = WIDTH, scale: int = SCALE) -> DataFrame:
    """``(id, v)`` of the kept vectors, ``v`` an array of integers."""
    x = F.transform(F.col(quoted(embedding)), lambda c: c.cast("double"))
    rows = df.select(F.col(quoted(vec_id)).alias("id"), x.alias("x")).where(F.size("x") == width)
    rows = rows.where(~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    near = lambda c: F.greatest(F.least(c * float(scale), F.lit(float(FAR))), F.lit(-float(FAR)))
    return rows.select("id", F.transform("x", lambda c: F.floor(near(c)).cast("int")).alias("v"))


def _square_distances(v: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows ``v`` to rows ``z``."""
    if max(np.abs(v).max(initial=0), np.abs(z).max(initial=0)) * v.shape[1] ** 0.5 < 1 << 24:
        v, z = v.astype(np.float64), z.astype(np.float64)  # all sums are integers below 2^53
        return ((v * v).sum(1)[:, None] - 2 * (v @ z.T) + (z * z).sum(1)).astype(np.int64)
    return np.stack([((v.astype(np.int64) - c) ** 2).sum(1) for c in z], 1)


def _cuts(n: int) -> list[np.ndarray]:
    """Row ranges of the nodes of each level of a tree of n rows."""
    out = [np.array([0, n])]
    while np.diff(out[-1]).max() > LEAF:
        a, b = out[-1][:-1], out[-1][1:]
        out.append(np.concatenate([[0], np.stack([a + (b - a) // 2, b], 1).ravel()]))
    return out


class Tree:
    """A kd-tree: ``v`` in tree order; for the nodes of all levels, one after the other, ``low``, ``high`` and ``total``."""

    def __init__(self, v: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray):
        self.v, self.low, self.high, self.total, self.cut = v, low, high, total, _cuts(len(v))

    @staticmethod
    def over(v: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree of rows ``v``, and their order in it."""
        order, cut = np.arange(len(v)), _cuts(len(v))
        for level in cut[:-1]:
            for a, b in zip(level[:-1], level[1:]):
                rows = v[order[a:b]]
                widest = int(np.argmax(rows.max(0).astype(np.int64) - rows.min(0)))
                order[a:b] = order[a:b][np.argsort(rows[:, widest], kind="stable")]
        v = v[order]
        nodes = [np.concatenate([f.reduceat(x, c[:-1], 0) for c in cut]) for f, x in ((np.minimum, v), (np.maximum, v), (np.add, v.astype(np.int64)))]
        return Tree(v, *nodes), order

    def filtered(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest centroid of each row in tree order; count and sum of each centroid's rows."""
        k = len(z)
        won, count, total = np.full(len(self.v), -1, np.int32), np.zeros(k, np.int64), np.zeros(z.shape, np.int64)
        stay, undone, base = np.ones((1, k), bool), np.ones(1, bool), 0
        for level, cut in enumerate(self.cut):
            at = np.flatnonzero(undone)
            low, high = (x[base + at].astype(np.int64) for x in (self.low, self.high))
            middle = (low + high) / 2.0
            off = ((middle[:, None, :] - z) ** 2).sum(2)  # only chooses whom to compare with
            star = np.where(stay[at], off, np.inf).argmin(1)
            for c in range(k):
                row = np.flatnonzero(stay[at, c] & (star != c))
                to = z[star[row]]
                corner = np.where(z[c] > to, high[row], low[row])
                stay[at[row], c] = ((corner - z[c]) ** 2).sum(1) <= ((corner - to) ** 2).sum(1)
            one = at[stay[at].sum(1) == 1]
            owner = stay[one].argmax(1)
            np.add.at(count, owner, cut[one + 1] - cut[one])
            np.add.at(total, owner, self.total[base + one])
            for i, c in zip(one, owner):
                won[cut[i] : cut[i + 1]] = c
            undone[one] = False
            base += len(undone)
            if level + 1 < len(self.cut):
                stay, undone = np.repeat(stay, 2, 0), np.repeat(undone, 2)
        left = np.flatnonzero(won < 0)
        if len(left):
            leaf = np.searchsorted(self.cut[-1], left, side="right") - 1
            near = np.where(stay[leaf], _square_distances(self.v[left], z), _LONG)
            won[left] = near.argmin(1)
            np.add.at(count, won[left], 1)
            np.add.at(total, won[left], self.v[left])
        return won, count, total


def grow(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """Blocks of a partition's rows as trees: ``ids`` in tree order, and the tree's arrays as bytes."""
    small_batches(vectors.sparkSession)
    names = ["ids", *(p for p, _ in _PARTS)]
    schema = StructType([StructField("ids", ArrayType(vectors.schema["id"].dataType)), *(StructField(p, BinaryType()) for p in names[1:])])

    def tree(held):
        block = pa.Table.from_batches(held).combine_chunks()
        v = block.column(1).combine_chunks().flatten().to_numpy().reshape(-1, width)
        made, order = Tree.over(v)
        ids = block.column(0).combine_chunks().take(pa.array(order))
        parts = [pa.array([getattr(made, p).astype(kind).tobytes()], pa.binary()) for p, kind in _PARTS]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *parts], names)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, TREE):
                part = batch.slice(a, TREE)
                if n + part.num_rows > TREE:
                    yield tree(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if n:
            yield tree(held)
        release()

    return vectors.mapInArrow(run, schema)


def _trees(batch: pa.RecordBatch, width: int):
    for i in range(batch.num_rows):
        yield Tree(*(np.frombuffer(batch.column(p)[i].as_buffer(), kind).reshape(-1, width) for p, kind in _PARTS))


def first_centroids(vectors: DataFrame, k: int = K, seed: int = SEED) -> np.ndarray:
    """The k vectors with the least ``sha256("seed:id")``, in that order."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    got = vectors.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()  # k rows
    return np.array([r.v for r in got], np.int64)


def next_centroids(trees: DataFrame, z: np.ndarray) -> np.ndarray:
    """Centroids after one round: floor(sum / count) of each one's rows, or where it was if it has none."""
    k, width = z.shape

    def run(batches):
        count, total = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        for batch in batches:
            for t in _trees(batch, width):
                _, n, s = t.filtered(z)
                count += n
                total += s
        c, i = np.divmod(np.arange(k * width), width)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(i, pa.int32()), pa.array(count[c]), pa.array(total.ravel())], ["c", "i", "n", "s"])
        release()

    sums = trees.mapInArrow(run, "c int, i int, n long, s long").groupBy("c", "i")
    out = z.copy()
    for r in sums.agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # k rows a component
        if r.n:
            out[r.c, r.i] = int(r.s) // r.n
    return out


def assign(trees: DataFrame, z: np.ndarray) -> DataFrame:
    """``(id, cluster, distance)`` of every vector."""
    schema = StructType([StructField("id", trees.schema["ids"].dataType.elementType), StructField("cluster", IntegerType()), StructField("distance", LongType())])
    width = z.shape[1]

    def run(batches):
        for batch in batches:
            for i, t in enumerate(_trees(batch, width)):
                won, _, _ = t.filtered(z)
                far = ((t.v.astype(np.int64) - z[won]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, pa.array(won), pa.array(far)], ["id", "cluster", "distance"])
        release()

    return trees.mapInArrow(run, schema)


def cluster(
    df: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id", k: int = K, rounds: int = ROUNDS, seed: int = SEED, width: int = WIDTH, scale: int = SCALE
) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid)`` of the kept vectors, ``centroid`` as array of integers."""
    spark = df.sparkSession
    tables = Tables(spark, "centroids")
    vectors = whole_vectors(df, embedding, vec_id, width, scale)
    trees = tables.save(grow(spread(vectors), width), "trees")
    z = first_centroids(vectors, k, seed).reshape(-1, width)
    for _ in range(rounds if len(z) else 0):
        z = next_centroids(trees, z)
    out = tables.save(assign(trees, z), "assigned")
    sums = out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    each = {r.cluster: int(r.s) for r in sums.collect()}  # k rows
    rows = [(c, min(s, _LONG), min(sum(each.values()), _LONG), z[c].tolist()) for c, s in each.items()]
    of = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    out = out.join(F.broadcast(of), "cluster")  # k rows
    return out.select(F.col("id").alias(vec_id), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
