"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters of space in every word definition here, as a regex class body.
SPACE = r"\x20\x09-\x0D"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row, also when used inside lambdas."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; null gives an empty one."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def hash_unit(*cols: Column) -> Column:
    """A value in (0, 1) that depends on the columns only."""
    bits = F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double")
    return (bits + 0.5) / F.lit(float(2**53))


def drop_names(df, names) -> list[str]:
    """Columns of ``df`` that do not clash with ``names``."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def hold(df, names: list[str]) -> Column:
    """Columns ``names`` of ``df`` as one struct ``held``.

    Beside it an operator's own columns may have any name: they can't clash
    with the input's. ``let_go`` gives the columns back.
    """
    return F.struct(F.lit(0).alias(""), *(F.col(quoted(n)).alias(n) for n in names)).alias("held")


def let_go(names: list[str]) -> list[Column]:
    return [F.col("held").getField(n).alias(n) for n in names]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def numbered(df, names: list[str], last: Column):
    """Columns ``names`` and ``last`` as c0, c1, ..., on their way to Python; and the fields of the former."""
    rows = df.select(*(F.col(quoted(n)) for n in names), last)
    return rows.toDF(*(f"c{i}" for i in range(len(names) + 1))), rows.schema.fields[:-1]


def in_blocks(rows, size: str, block: int, *row: str):
    """Rows once for every pair of blocks ``(i, j)`` of their group that they belong to; ``own`` is a row's block.

    A group of ``size`` rows has a block for every ``block`` of them, and a hash
    of the columns ``row`` deals them out: no group is sorted or numbered.
    """
    blocks = F.ceil(F.col(size) / block).cast("int")
    n = rows.withColumn("own", F.pmod(F.xxhash64(*row), blocks).cast("int"))
    n = n.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return n.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other")


#: Bytes of a batch of rows on their way to Python.
BATCH_BYTES = 4 << 20


def small_batches(spark) -> None:
    """Let this session send rows to Python in batches of ``BATCH_BYTES``, so that long texts don't add up there."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def release() -> None:
    """Give freed memory back to the system at the end of a task: workers wait for their next one."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
