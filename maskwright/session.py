"""Session helpers: shared folders, cutting lineage, input balance."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_MADE: list[str] = []
#: Rows of a stored frame beyond which it is not broadcast, however small its files are (a row may take some 100 bytes).
BROADCAST_ROWS = 500_000


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared folder the session names in ``spark.checkpoint.dir``.

    A cluster must name one: executors cannot read a folder of the driver's machine.
    Where everything runs in one process, as in tests, a temporary folder is made and recorded.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="maskwright-")
        spark.conf.set("spark.checkpoint.dir", root)
    _MADE.append(f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def clear_work(spark: SparkSession) -> None:
    """Remove the folders that this process has made by ``work_dir``: once their results have been used."""
    while _MADE:
        folder = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a frame as Parquet in the shared folder and read it back: computed once, columns prunable, and
    independent of executors that are lost later."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Remove the folder of a frame made by ``staged``, when nothing will read it any more, and let Spark remove the shuffle
    files of jobs that are over (it does when the driver's garbage is collected)."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        made = next((m for m in _MADE if path.endswith(m.split("://")[-1])), None)
        if made is not None:
            _MADE.remove(made)
            folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(made)
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)
    df.sparkSession._jvm.System.gc()


def measured(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A frame that Spark may broadcast by its size only if it has few rows (counted, if they are not given: of a stored frame).

    Files may be a tenth, or less, of the hash table that is made of them on the driver, and what is exploded from a row is
    sized like that row.
    """
    return df if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df.hint("merge")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame that is read several times, so that it is computed once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(work_dir(spark, "checkpoints"))
    return df.checkpoint()


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the size of a frame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on an input too small to fill them with file splits.

    A file of one row group is read by one task however many cores there are.
    Inputs that have at least one full split per core are left as they are: no
    shuffle is added where it would cost anything.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    if df.isStreaming or cores == 1 or input_bytes(df) >= cores * split:
        return df
    return df.repartition(cores, *keys)


def builder(name: str = "maskwright") -> SparkSession.Builder:
    """A session builder with what can only be set when a session is made.

    Expressions of thousands of nodes are built here; noting the Python line of each takes longer than many a job.
    """
    return SparkSession.builder.appName(name).config("spark.python.sql.dataFrameDebugging.enabled", "false")


def prepare(spark: SparkSession) -> SparkSession:
    """Settings the jobs rely on: UTC, and re-planning at run time with skewed joins split."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    if spark.sparkContext.master.startswith("local") and spark.conf.get("spark.sql.shuffle.partitions") == "200":
        # One machine: the default is meant for clusters.
        spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    return spark
