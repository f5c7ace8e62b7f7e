"""Near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

Vectors of length one with cosine c lie ``sqrt(2 - 2c)`` apart. A hash is a
Gaussian projection, shifted at random and cut into steps of ``WIDTH``; a bucket
is ``depth`` hashes together, and there are as many tables of buckets as make the
chance to miss a pair at the threshold at most ``MISS``. Depth and tables follow
from the number of vectors by one formula.

Equal vectors are one class. Inside a bucket, all pairs of classes are compared
exactly in blocks and only a spanning set of links leaves the block. Once
components are known, links are counted by exact comparisons inside components:
every link of a vector lies in its component. Large buckets and components are
split into pairs of blocks, so no task gets a whole one.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different length never link; rows of
equal id are one vector for components, and each counts as a copy with the links
of its own vector; a row with a null id is its own component (null), links with
nothing and is kept; ties go to the smallest id; vectors may have any length (a
very long one is worked on in blocks of ``BLOCK`` rows like others); an empty
table gives an empty result; columns beside id and vector are not returned, so
none can clash.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from readloom.llm.common import in_blocks, small_batches
from readloom.operators.components import connected_components
from readloom.session import Tables, broadcast_if_small

THRESHOLD, WIDTH, MISS = 0.9, 2.5, 0.005
#: Expected number of unrelated vectors in a bucket.
STRAY = 0.1
#: Rows of a block.
BLOCK = 512
#: Rows whose buckets are made together; groups up to SMALL rows are compared pair by pair.
ROWS, SMALL = 128, 16


def collision(distance: float, width: float = WIDTH) -> float:
    """Chance that two vectors so far apart fall into the same step."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def layout(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Hashes in a bucket and number of tables for ``n`` vectors."""
    near, far = collision(math.sqrt(2 - 2 * threshold)), collision(math.sqrt(2))
    depth = max(4, math.ceil(math.log(max(n, 2) / STRAY) / -math.log(far)))
    return depth, math.ceil(math.log(MISS) / math.log(1 - near**depth))


def _unit(lists: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    m = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _hasher(depth: int, tables: int, seed: int):
    """A function that turns (id, vector) batches into (key, id) rows."""

    def run(batches):
        made: dict[int, tuple] = {}
        odd = np.random.default_rng(seed).integers(0, 2**63, depth, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                ids, vecs = batch.column(0).slice(a, ROWS), batch.column(1).slice(a, ROWS)
                sizes = pa.compute.list_value_length(vecs).to_numpy()
                for dim in np.unique(sizes).tolist():
                    if dim not in made:
                        rng = np.random.default_rng([seed, dim])
                        made[dim] = rng.normal(0, 1, (dim, tables * depth)), rng.uniform(0, WIDTH, tables * depth)
                    proj, shift = made[dim]
                    mine = np.flatnonzero(sizes == dim)
                    x = _unit(vecs.take(pa.array(mine)))
                    step = np.floor((x @ proj + shift) / WIDTH).astype(np.int64).view(np.uint64).reshape(len(mine), tables, depth)
                    key = (step * odd).sum(2, dtype=np.uint64) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)
                    key ^= key >> np.uint64(31)
                    key *= np.uint64(0xBF58476D1CE4E5B9)
                    key ^= key >> np.uint64(29)
                    who = np.repeat(ids.take(pa.array(mine)).to_numpy(), tables)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).reshape(-1)), pa.array(who)], ["key", "id"])

    return run


def _whole(batches, n_keys: int):
    """Tables of whole groups of rows that are equal in their first columns, with the groups' starts, from rows in that order."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t])
        at = _starts(t, n_keys)
        if len(at) > 1:
            yield t.slice(0, at[-1]).combine_chunks(), at[:-1]
        rest = t.slice(at[-1])
    if rest is not None and rest.num_rows:
        yield rest.combine_chunks(), _starts(rest, n_keys)


def _starts(t, n_keys: int) -> np.ndarray:
    keys = [t.column(i).to_numpy() for i in range(n_keys)]
    new = np.ones(t.num_rows, bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _vectors(t):
    """Unit vectors of a table's rows: one matrix if all have the same length, else a function of a range."""
    v = t.column("v").chunk(0)
    sizes = pa.compute.list_value_length(v).to_numpy()
    if len(sizes) and (sizes == sizes[0]).all():
        x = _unit(v)
        return x, lambda a, b: x[a:b]
    return None, lambda a, b: _unit(v.slice(a, b - a))


def _spanning(threshold: float):
    """(key, i, j, own, id, v) groups to links that connect what is linked inside the group."""

    def run(batches):
        for t, at in _whole(batches, 3):
            ids = t.column("id").to_numpy()
            ends = np.append(at[1:], len(ids))
            size = ends - at
            x, rows = _vectors(t)
            out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            large = size > (SMALL if x is not None else 1)
            if x is not None:
                group = np.repeat(np.where(large, -1 - np.arange(len(at)), np.arange(len(at))), size)
                for k in range(1, SMALL):
                    i = np.flatnonzero((group[k:] == group[:-k]) & (group[k:] >= 0))
                    if not len(i):
                        break
                    i = i[np.einsum("ij,ij->i", x[i], x[i + k]) >= threshold]
                    out_a.append(ids[i])
                    out_b.append(ids[i + k])
            for a, b in zip(at[large], ends[large]):
                y = rows(a, b)
                near, label = (y @ y.T) >= threshold, np.arange(b - a)
                while True:  # every row takes the least label among its links
                    low = np.where(near, label[None, :], b - a).min(1)
                    low = np.minimum(low, label)
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                moved = np.flatnonzero(label != np.arange(b - a))
                out_a.append(ids[a + label[moved]])
                out_b.append(ids[a + moved])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    return run


def _counting(threshold: float):
    """(key, i, j, own, id, c, v, w) groups to (id, c, links): what a row's links weigh in the other block."""

    def run(batches):
        for t, at in _whole(batches, 3):
            ids, cs, own, w = (t.column(c).to_numpy() for c in ("id", "c", "own", "w"))
            i, j = t.column("i").to_numpy(), t.column("j").to_numpy()
            n = np.zeros(len(ids), np.int64)
            _, rows = _vectors(t)
            for a, b in zip(at, np.append(at[1:], len(ids))):
                if b - a < 2:
                    continue
                y = rows(a, b)
                near = (y @ y.T) >= threshold
                np.fill_diagonal(near, False)
                if i[a] != j[a]:  # links inside a block are counted where the block meets itself
                    near &= own[a:b, None] != own[None, a:b]
                n[a:b] = near @ w[a:b]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(cs), pa.array(n)], ["id", "c", "links"])

    return run


def near_duplicates(df: DataFrame, vector: str = "embedding", vec_id: str = "vec_id", threshold: float = THRESHOLD, seed: int = 3) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row."""
    spark = df.sparkSession
    tables = Tables(spark, "embedding")
    small_batches(spark)
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    valid = F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), valid.alias("valid"))
    good = rows.where("valid and id is not null")
    classes = good.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"))
    # ids of rows that repeat an id with another vector don't tell their classes apart: a hash of the vector does
    classes = tables.save(classes.select("id", F.xxhash64("v").alias("c"), "v", "w"), "classes")
    n = classes.count()
    depth, count = layout(n, threshold)
    keys = classes.select("id", "v").mapInArrow(_hasher(depth, count, seed), "key long, id long")
    keys = tables.save(keys, "keys")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    placed = in_blocks(keys.join(shared, "key"), "n", BLOCK, "id").join(classes.select("id", "v"), "id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.select("key", "i", "j", "own", "id", "v").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id")
    links = tables.save(placed.mapInArrow(_spanning(threshold), "a long, b long").distinct(), "links")
    same_id = good.join(classes.select("v", F.col("id").alias("rep")), "v").where("id != rep").select("rep", "id")
    member = tables.save(connected_components(links, "a", "b"), "components")
    grouped = classes.join(member, classes.id == member.node).select(F.col("component").alias("key"), "id", "c", "w")
    grouped = tables.save(grouped, "grouped")
    sizes = tables.save(grouped.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "sizes")
    inside = in_blocks(grouped.join(broadcast_if_small(sizes), "key"), "n", BLOCK, "id", "c")
    inside = inside.join(classes.select("id", "c", "v"), ["id", "c"]).select("key", "i", "j", "own", "id", "c", "v", "w")
    inside = inside.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "id", "c")
    counted = inside.mapInArrow(_counting(threshold), "id long, c long, links long").groupBy("id", "c").agg(F.sum("links").alias("links"))
    info = classes.join(counted, ["id", "c"], "left").select("id", "v", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    info = tables.save(info, "info")
    everything = links.select("a", "b").union(same_id.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    whole = tables.save(connected_components(everything, "a", "b"), "whole")
    out = rows.join(info.select("v", "n_links").withColumn("valid", F.lit(True)), ["v", "valid"], "left")
    out = out.join(whole, out.id == whole.node, "left")
    component = F.coalesce("component", "id")
    return out.select(
        F.col("id").alias("vec_id"),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
