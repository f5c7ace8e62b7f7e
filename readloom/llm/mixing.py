"""Mixing sources to target weights by systematic sampling, in SQL functions only.

Each document of a source expects ``target / source size`` copies. Within a
source, expected copies are prefix-summed in order of (size, id), one random
offset is added, and a document is emitted once for each integer boundary that
its part of the sum crosses. Because equal sizes stand together, the taken
words differ from the target by little more than the largest document.

The prefix is computed in levels. A source is summed over its sizes: one row
for each size that occurs, however many documents have it. Documents of one size
are cut into ranges of ids, about ``BLOCK`` documents each by the span of their
ids; ranges are summed within the size and rows are numbered within a range
only. So neither a source that holds a third of all rows nor a size that does
(all texts empty, say) is one task.

Defined results: null text has size 0; null source is the last source; a
source of size 0 has target 0 and gives no copy; rows with a null id stand last
of their size; repeated rows and rows of equal id are documents of their own,
their order among each other is free; a very long text is one document of its
size, split into words within its row; an empty table gives an empty result;
input columns named like an output column are replaced by it, no other name
clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from readloom.llm.common import drop_names, hold, let_go, quoted, words
from readloom.session import Tables, broadcast_if_small

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: No source gives more than so many times its size.
MOST = 3
#: Documents in a range of ids, if ids are spread evenly.
BLOCK = 100_000
#: Range of the documents without an id, behind all others.
NULL_RANGE = 1 << 60

OUT = ("size", "source_size", "target", "taken", "copies")


def source_targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Target of each source from rows ``(src, size, n)``, n documents of a size: one row per source.

    Shares of the total by weight; a share above ``most`` times the source's
    size stops there and the excess is shared out again by weight. With sources
    in order of cap over weight, those that stop are a prefix, so the level at
    which the rest stand follows from two running sums.
    """
    s = sizes.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    place = W.orderBy(F.col("src").asc_nulls_last())
    k = F.row_number().over(place) - 1
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (k % len(weights)) + 1)
    s = s.withColumn("w", w).withColumn("cap", most * F.col("source_size").cast("double"))
    order = W.orderBy(F.col("cap") / F.col("w"), F.col("src").asc_nulls_last())
    upto = order.rowsBetween(W.unboundedPreceding, -1)
    rest = order.rowsBetween(0, W.unboundedFollowing)
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy("src")
    s = s.withColumn("stopped", F.coalesce(F.sum("cap").over(upto), F.lit(0.0)))
    s = s.withColumn("w_rest", F.sum("w").over(rest)).withColumn("total", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("lvl", (F.col("total") - F.col("stopped")) / F.col("w_rest"))
    s = s.withColumn("open", F.col("lvl") * F.col("w") < F.col("cap"))
    s = s.withColumn("level", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("w"), F.col("lvl").alias("lvl")))).over(every)["lvl"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap")))
    return s.select("src", "source_size", target.alias("target"))


def offset(src: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), src), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


def mix(
    df: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", seed: int = 0, carry: list[str] | None = None
) -> DataFrame:
    """Rows of ``df`` (columns ``carry``, all by default) with ``size``,
    ``source_size``, ``target``, ``taken`` and ``copies``."""
    tables = Tables(df.sparkSession, "mixing")
    keep = drop_names(df.select(*map(quoted, df.columns if carry is None else carry)), OUT)
    rows = df.select(
        hold(df, keep),
        F.col(source).cast("string").alias("src"),
        F.col(doc_id).cast("long").alias("id"),
        F.size(words(F.col(text))).cast("long").alias("size"),
    )
    if text in keep:  # texts are split twice rather than written once more
        slim = tables.save(rows.select("src", "id", "size"), "sizes")
    else:
        slim = rows = tables.save(rows, "sizes")
    # a row for each size of a source: its documents and the span of their ids
    n = F.count(F.lit(1)).alias("n")
    cells = tables.save(slim.groupBy("src", "size").agg(n, F.min("id").alias("lo"), F.max("id").alias("hi")), "cells")
    targets = source_targets(cells.select("src", "size", "n"))
    cell = cells.withColumn("before", F.sum("n").over(W.partitionBy("src").orderBy("size")) - F.col("n")).alias("c")
    cell = cell.join(targets.alias("t"), F.col("c.src").eqNullSafe(F.col("t.src")))
    step = F.greatest(F.ceil((F.col("hi").cast("double") - F.col("lo") + 1) / F.ceil(F.col("n") / BLOCK)), F.lit(1))
    whole = F.col("n") <= BLOCK
    cell = cell.select(F.col("c.src").alias("s"), F.col("c.size").alias("z"), "before", "lo", step.alias("step"), whole.alias("whole"), "source_size", "target")
    cell = broadcast_if_small(tables.save(cell, "prefix"))

    def placed(d: DataFrame) -> DataFrame:
        """Rows with what their size has before it, and their range."""
        d = d.join(cell, F.col("src").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))).drop("s", "z")
        at = F.floor((F.col("id").cast("double") - F.col("lo")) / F.col("step")).cast("long")
        return d.withColumn("range", F.when(F.col("whole"), 0).otherwise(F.coalesce(at, F.lit(NULL_RANGE))))

    # ranges of the sizes that have several
    ranges = tables.save(placed(slim).where("not whole").groupBy("src", "size", "range").agg(n), "ranges")
    lower = W.partitionBy("src", "size").orderBy("range")
    ranges = ranges.withColumn("inside", F.sum("n").over(lower) - F.col("n"))
    ranges = broadcast_if_small(tables.save(ranges.select(F.col("src").alias("s"), F.col("size").alias("z"), F.col("range").alias("g"), "inside"), "inside"))
    at = W.partitionBy("src", "size", "range").orderBy(F.col("id").asc_nulls_last())
    r = placed(rows).withColumn("k", F.row_number().over(at))
    r = r.join(ranges, F.col("src").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")) & (F.col("range") == F.col("g")), "left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    upto = F.col("before") + F.coalesce("inside", F.lit(0)) + F.col("k")
    u = offset(F.col("src"), seed)
    copies = (F.floor(u + upto * rate) - F.floor(u + (upto - 1) * rate)).cast("long")
    return r.select(*let_go(keep), "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))


def emit(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: every document as often as it was taken."""
    again = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select(hold(mixed, columns), again).select(*let_go(columns))
