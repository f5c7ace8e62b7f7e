"""Uniform shuffle into shards of exact sizes, in SQL functions only.

Rows lie in partitions by a hash of their id, about ``ROWS`` in each. How many rows of each
partition go to each shard is a random matrix with the partitions' and the
shards' sizes as margins: the communication matrix of a uniform permutation,
whose law is multivariate hypergeometric. It is drawn by halving: the rows a
shard still wants from a range of partitions are split between the range's
halves by exact hypergeometric draws, so each level draws all its ranges at
once. Then every partition permutes its rows, gives each shard its number of
them, and every shard permutes what it got.

Shard sizes differ by one at most (law ``rows``). All randomness comes from
hashes of the seed, so that a lost executor's rows get the same place again.

ln n! is in double precision: beyond 1e11 rows its rounding (1e-4) shifts single
draws a little, never a size.

Defined results: null text has no bytes; rows with a null id are placed like
others; repeated rows are placed one by one (equal rows are interchangeable);
ties of a hash are ordered by id and ``ties``; a very long text is a row as any
other; an empty table gives an empty result; input columns named like an output
column are replaced by it, no other name clashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from readloom.llm.common import drop_names, hash_unit, hold, let, let_go
from readloom.session import Tables, broadcast_if_small

#: Rows of a partition, about; least number of partitions, a power of two; most rows of a matrix that is broadcast.
ROWS, PARTS, MOST_PARTS = 1_000_000, 256, 1_000_000
OUT = ("shard", "slot")

_LN_SMALL = [math.lgamma(k + 1) for k in range(16)]


def _ln_factorial(n: Column) -> Column:
    """ln n!: a list for small n, Stirling's series beyond (error below 1e-12)."""
    x = F.greatest(n, F.lit(16)).cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5)))
    small = F.get(F.array(*(F.lit(v) for v in _LN_SMALL)), n.cast("int"))
    return F.when(n < 16, small).otherwise(series)


def hypergeometric(wanted: Column, others: Column, draws: Column, u: Column) -> Column:
    """Number of ``wanted`` among ``draws`` out of ``wanted + others``, by inversion at ``u``.

    The cumulated law is built over the values within 12 standard deviations
    (and 30 steps) of the mode; what lies outside has a chance below 1e-20.
    """

    def at(s: Column) -> Column:
        w, o, n = s["w"], s["o"], s["n"]
        lo = F.greatest(F.lit(0).cast("long"), n - o)
        hi = F.least(n, w)
        total = (w + o).cast("double")
        mode = F.floor((n + 1) * ((w + 1) / (total + 2))).cast("long")
        share = w / total
        sd = F.sqrt(n * share * (1 - share) * F.greatest(total - n, F.lit(1.0)) / F.greatest(total - 1, F.lit(1.0)))
        width = F.ceil(12 * sd + 30).cast("long")
        a, b = F.greatest(lo, mode - width), F.least(hi, mode + width)
        ln = lambda k: -(_ln_factorial(k) + _ln_factorial(w - k) + _ln_factorial(n - k) + _ln_factorial(o - n + k))
        peak = F.least(F.greatest(mode, lo), hi)

        def pick(base: Column) -> Column:
            law = F.transform(F.sequence(a, b), lambda k: F.exp(ln(k) - base))

            def choose(p: Column) -> Column:
                mass = F.aggregate(p, F.lit(0.0), lambda x, y: x + y)

                def walk(goal: Column) -> Column:
                    start = F.struct(F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("k"))
                    step = lambda z, y: F.struct((z["c"] + y).alias("c"), (z["k"] + F.when(z["c"] + y < goal, 1).otherwise(0)).cast("long").alias("k"))
                    return F.aggregate(p, start, step)["k"]

                return let(mass * s["u"], walk)

            return F.least(a + let(law, choose), b)

        inner = let(ln(peak), pick)
        return F.when(lo >= hi, lo).otherwise(inner)

    return let(F.struct(wanted.alias("w"), others.alias("o"), draws.alias("n"), u.alias("u")), at)


def partitions(rows: int) -> int:
    """Number of partitions for so many rows, a power of two: their sizes stay alike however large the table is."""
    return max(PARTS, 1 << math.ceil(math.log2(max(rows / ROWS, 1))))


def shard_sizes(total: Column, shards: int) -> Column:
    """Sizes of the shards: the first ``total mod shards`` have one row more."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda j: (F.floor(total / shards) + F.when(j < total % shards, 1).otherwise(0)).cast("long"),
    )


def _split(caps: Column, draws: Column, node: Column, level: int, seed: int) -> Column:
    """How many of ``draws`` rows each shard takes, out of what it wants (``caps``)."""
    start = F.struct(
        draws.alias("left"),
        F.aggregate(caps, F.lit(0).cast("long"), lambda a, x: a + x).alias("rest"),
        F.array().cast("array<long>").alias("got"),
    )

    def step(z: Column, c: Column) -> Column:
        u = hash_unit(F.lit(seed), F.lit(level), node, F.size(z["got"]))
        take = hypergeometric(c, z["rest"] - c, z["left"], u)
        return let(
            take,
            lambda t: F.struct((z["left"] - t).alias("left"), (z["rest"] - c).alias("rest"), F.concat(z["got"], F.array(t)).alias("got")),
        )

    return F.aggregate(caps, start, step)["got"]


def communication_matrix(counts: DataFrame, shards: int, seed: int, parts: int = PARTS) -> DataFrame:
    """``(part, shard, lo, hi)``: the places of a partition's order that a shard takes.

    ``counts`` has ``(part, n)``. Its rows are at most ``parts``, which bounds the
    array that the halving starts from.
    """
    every = counts.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    every = every.join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    root = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("m"), F.sum("n").alias("total"))
    node = root.select(F.lit(0).alias("node"), F.transform("m", lambda x: x["n"]).alias("sizes"), shard_sizes(F.col("total"), shards).alias("caps"))
    for level in range(int(math.log2(parts))):
        half = parts >> (level + 1)
        add = lambda a, x: a + x
        node = node.withColumn("draws", F.aggregate(F.slice("sizes", 1, half), F.lit(0).cast("long"), add))
        node = node.withColumn("left", _split(F.col("caps"), F.col("draws"), F.col("node"), level, seed))
        node = node.select(
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.slice("sizes", 1, half).alias("sizes"), F.col("left").alias("caps")),
                    F.struct(
                        (F.col("node") * 2 + 1).alias("node"),
                        F.slice("sizes", half + 1, half).alias("sizes"),
                        F.zip_with("caps", "left", lambda a, b: a - b).alias("caps"),
                    ),
                )
            ).alias("s")
        ).select("s.*")
        if level == 3:  # sixteen ranges by now: draw the rest of the levels in parallel
            node = node.repartition(16, "node")
    upto = lambda j: F.aggregate(F.slice("caps", 1, j), F.lit(0).cast("long"), lambda a, x: a + x)
    cell = F.transform("caps", lambda c, j: F.struct(j.cast("int").alias("shard"), upto(j).alias("lo"), (upto(j) + c).alias("hi")))
    return node.select(F.col("node").alias("part"), F.explode(cell).alias("c")).select("part", "c.*").where("hi > lo")


def shuffle_into_shards(df: DataFrame, shards: int, doc_id: str = "doc_id", ties: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    ``ties``: columns that tell rows of equal id apart.
    """
    tables = Tables(df.sparkSession, "sharding")
    keep = drop_names(df, OUT)
    own = [F.col(doc_id), *(F.col(c) for c in ties)]
    rows = df.select(
        hold(df, keep),
        *(c.alias(f"o{i}") for i, c in enumerate(own)),
        *(F.xxhash64(F.lit(seed), F.lit(x), *own).alias(h) for h, x in (("h0", "part"), ("h1", "first"), ("h2", "second"))),
    )
    rows = tables.save(rows, "rows")
    parts = partitions(rows.count())
    rows = rows.withColumn("part", F.shiftrightunsigned("h0", 64 - int(math.log2(parts))).cast("int"))
    matrix = tables.save(communication_matrix(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")), shards, seed, parts), "matrix")
    # the matrix has a row for each partition and shard at most; as one list a partition it is ``parts`` rows
    lists = matrix.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard"))).alias("cells"))
    lists = broadcast_if_small(tables.save(lists, "lists"), MOST_PARTS // shards)
    order = [F.col(f"o{i}") for i in range(len(own))]
    first = W.partitionBy("part").orderBy("h1", *order)
    placed = rows.withColumn("k", F.row_number().over(first) - 1).join(lists, "part")
    mine = F.filter("cells", lambda c: (c["lo"] <= F.col("k")) & (F.col("k") < c["hi"]))
    sub = F.shiftrightunsigned(F.col("h2"), 64 - int(math.log2(parts))).cast("int")
    placed = tables.save(placed.select("held", "h2", *order, mine[0]["shard"].alias("shard"), sub.alias("sub")), "placed")
    sizes = placed.groupBy("shard", "sub").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("sub")) - F.col("n")).drop("n")
    before = broadcast_if_small(tables.save(before, "before"), MOST_PARTS)
    second = W.partitionBy("shard", "sub").orderBy("h2", *order)
    out = placed.withColumn("k", F.row_number().over(second) - 1).join(before, ["shard", "sub"])
    return out.select(*let_go(keep), "shard", (F.col("before") + F.col("k")).alias("slot"))
