"""One stream to several sinks: the source is read once a micro-batch, and each sink keeps count of what it has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

Sink = Callable[[DataFrame, int], None]


class Folder:
    """A folder in shared storage, by whatever path Spark can read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.of = jvm.org.apache.hadoop.fs.Path
        self.fs = self.of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        p = self.of(self.path)
        return [s.getPath().getName() for s in self.fs.listStatus(p)] if self.fs.exists(p) else []

    def touch(self, name: str) -> None:
        self.fs.create(self.of(f"{self.path}/{name}"), True).close()

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.of(f"{self.path}/{name}" if name else self.path), True)


class FanOut:
    """For foreachBatch: hands each micro-batch, persisted once, to all of ``sinks`` by name.

    Under ``path``, in shared storage, each sink has the number of the last micro-batch that it has taken. A sink that fails doesn't
    keep the others from theirs; the query then fails, and when it is started again the micro-batch comes again and
    goes only to sinks that haven't taken it. A sink that wrote and was lost before its number was noted gets its
    micro-batch once more: it should replace what it wrote under the same number, as writers to a folder of
    that number do. ``add`` and ``remove`` change the sinks from the next micro-batch on.
    """

    def __init__(self, path: str, **sinks: Sink):
        self.path, self.sinks = path.rstrip("/"), dict(sinks)
        self.errors: list[str] = []

    def add(self, name: str, sink: Sink) -> None:
        if name in self.sinks:
            raise ValueError(f"there is a sink {name!r} already")
        self.sinks[name] = sink

    def remove(self, name: str) -> None:
        del self.sinks[name]

    def taken(self, spark: SparkSession, name: str) -> int:
        """The last micro-batch that a sink has taken, -1 before the first."""
        return max((int(n) for n in Folder(spark, f"{self.path}/{name}").names() if n.isdigit()), default=-1)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        waiting = [n for n in self.sinks if self.taken(spark, n) < number]
        if not waiting:
            return
        held, failed = batch.persist(StorageLevel.MEMORY_AND_DISK), []
        try:
            for name in waiting:
                try:
                    self.sinks[name](held, number)
                except Exception as e:  # noqa: BLE001  the others go on; raised below
                    failed.append(f"{name}, batch {number}: {e}")
                    continue
                marks = Folder(spark, f"{self.path}/{name}")
                marks.touch(str(number))
                for old in marks.names():
                    if old.isdigit() and int(old) < number:
                        marks.delete(old)
        finally:
            held.unpersist()
        if failed:
            self.errors += failed
            raise RuntimeError("; ".join(failed))
