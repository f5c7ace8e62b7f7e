"""Session helpers: table access and intermediate tables that outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, read by Spark so that any Hadoop path works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores if its scan has fewer partitions than there are cores.

    A single small file is one task otherwise, however much is made of its
    rows later. A scan of many files is left as it is: nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    and all runs in this process, as in local tests, a temporary folder is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        own = tempfile.mkdtemp(prefix="readloom-")
        _OWN_DIR.append(own)
        import shutil

        atexit.register(shutil.rmtree, own, True)
    return "file://" + _OWN_DIR[0]


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a folder of the shared store."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(p).getLength()


def broadcast_if_small(df: DataFrame, rows: int = 2_000_000, size: int = 16 << 20) -> DataFrame:
    """``df`` with a broadcast hint if its table has at most ``rows`` rows and ``size`` bytes; else left to be shuffled.

    What isn't a written table yet is written once, so that it is not computed twice.
    """
    if not hasattr(df, "_readloom_path"):
        df = Tables(df.sparkSession, "broadcast").save(df)
    from pyspark.sql import functions as F

    is_small = size_of(df.sparkSession, df._readloom_path) <= size and df.count() <= rows
    return F.broadcast(df) if is_small else df


#: Rows from which on a side is dealt whatever its files' size says: packed ids are a few bytes a row on disk, and some 100 in a driver's heap.
DEALT = 200_000


def dealt_if_long(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of some ``rows`` rows, with a hint that keeps Spark from broadcasting it by the bytes of its files if it is long."""
    return df.hint("merge") if rows > DEALT else df


_ROOTS: list[str] = []


def sweep(spark: SparkSession | None = None) -> None:
    """Remove the intermediate tables that this process has written; what still reads them can't be run again."""
    spark = spark or SparkSession.getActiveSession()
    while spark is not None and _ROOTS:
        delete(spark, _ROOTS.pop())


@atexit.register
def _sweep_at_exit() -> None:
    try:
        sweep()
    except Exception:  # the session is gone: nothing can be removed any more
        _ROOTS.clear()


class Tables:
    """Intermediate Parquet tables of one operator call, written once each.

    A written table cuts the lineage: a lost executor makes Spark reread it
    instead of replaying everything before it. Tables stay until ``sweep`` or
    the end of the process, as results are read from them late.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.n = 0
        _ROOTS.append(self.root)

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._readloom_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = getattr(df, "_readloom_path", None)
        if path:
            delete(self.spark, path)
