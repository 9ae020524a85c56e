"""What micro-batches remember, in tables whose cost does not grow with the length of the stream.

A state is a manifest: for every table the folder of a snapshot and those of the
batches since.  A batch reads the manifest of the batch before it, adds a folder
to the tables, and writes its own manifest; every few batches it writes a new
snapshot of what is still alive instead.  A repeated batch starts again from the
same manifest and overwrites its folders, so its result does not double; folders
that only older manifests name are removed.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups of conversations by hash; files are sorted by them, so that a batch skips what it does not need.
BUCKETS = 64
#: Batches after which a table's folders are merged.
MERGE = 8


def bucket_of(conv: Column) -> Column:
    return F.pmod(F.xxhash64(conv), F.lit(BUCKETS)).cast("int")


class Files:
    """Small files and folders of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [f.getPath().getName() for f in self.system.listStatus(path)] if self.system.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.system.open(self._path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write a file that is there in whole or not at all."""
        path, new = self._path(name), self._path(f"{name}.new")
        stream = self.system.create(new, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.system.delete(path, False)
        if not self.system.rename(new, path):
            raise OSError(f"cannot write {name}")

    def remove(self, name: str) -> None:
        self.system.delete(self._path(name), True)

    def size(self, name: str) -> int:
        return self.system.getContentSummary(self._path(name)).getLength()


@dataclass
class State:
    """The tables as a batch finds them: ``clock`` is the latest event time of all batches before it, in microseconds."""

    spark: SparkSession
    root: str
    batch_id: int
    folders: dict[str, list[str]] = field(default_factory=dict)
    clock: int | None = None

    @classmethod
    def before(cls, spark: SparkSession, root: str, batch_id: int) -> State:
        """What the batches before one have left."""
        files = Files(spark, root)
        earlier = [n for n in _manifests(files) if n < batch_id]
        if not earlier:
            return cls(spark, root, batch_id)
        known = json.loads(files.read(f"_manifests/{earlier[-1]}.json"))
        return cls(spark, root, batch_id, known["folders"], known["clock"])

    @classmethod
    def latest(cls, spark: SparkSession, root: str) -> State:
        return cls.before(spark, root, 1 << 62)

    def read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table with the number of the batch that wrote each row; ``buckets`` limits what is read."""
        schema = f"{schema}, batch long, bucket int"
        folders = [f"{self.root}/{f}" for f in self.folders.get(name, [])]
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return (rows if buckets is None else rows.where(F.col("bucket").isin(*buckets))).drop("bucket")

    def bytes(self) -> int:
        """Size of all that a batch may read."""
        files = Files(self.spark, self.root)
        return sum(files.size(f) for folders in self.folders.values() for f in folders)

    def commit(
        self, new: Mapping[str, DataFrame], schemas: Mapping[str, str], clock: int | None, merge: int = MERGE,
        alive: Callable[[str], DataFrame] | None = None,
    ) -> None:
        """Add a batch's rows to the tables; ``alive`` gives the older rows of a table that a merge keeps."""
        files = Files(self.spark, self.root)
        folders = {name: list(found) for name, found in self.folders.items()}
        merging = alive is not None and any(len(f) >= merge for f in folders.values())
        for name, rows in new.items():
            rows = rows.withColumn("batch", F.lit(self.batch_id).cast("long"))
            if merging:
                rows = alive(name).unionByName(rows)
            folder = f"{name}/{'snapshot' if merging else 'batch'}={self.batch_id}"
            typed = rows.select(*self.spark.createDataFrame([], schemas[name]).columns, "batch").withColumn("bucket", bucket_of(F.col("conv_id")))
            # Neighbours by bucket, however many rows one conversation has.
            typed.repartitionByRange("bucket", "conv_id", "batch").sortWithinPartitions("bucket", "conv_id").write.mode("overwrite").parquet(f"{self.root}/{folder}")
            folders[name] = [folder] if merging else [*folders.get(name, []), folder]
        times = [t for t in (clock, self.clock) if t is not None]
        files.write(f"_manifests/{self.batch_id}.json", json.dumps({"folders": folders, "clock": max(times, default=None)}))
        # This batch may be repeated, from the manifest before it; older ones are not needed any more.
        done = [n for n in _manifests(files) if n < self.batch_id]
        kept = {f for found in self.folders.values() for f in found} | {f for found in folders.values() for f in found}
        for old in done[:-1]:
            for name, found in json.loads(files.read(f"_manifests/{old}.json"))["folders"].items():
                for folder in set(found) - kept:
                    files.remove(folder)
            files.remove(f"_manifests/{old}.json")


def _manifests(files: Files) -> list[int]:
    return sorted(int(n.removesuffix(".json")) for n in files.names("_manifests") if n.endswith(".json"))
