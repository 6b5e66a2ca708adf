"""Helpers of the corpus operators: batches of rows, and tables that cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkwave.session import importable

#: Rows and bytes of one Arrow batch. Long texts make a batch large, so few rows.
BATCH_ROWS, BATCH_BYTES = 512, 16 << 20
#: A task hands on its rows after so many bytes of text.
FLUSH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Workers that can import this package, and small Arrow batches: a worker holds one at a time, whatever the length of texts."""
    importable(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with none of ``df``, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def map_rows(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[Iterable[tuple]], Iterable[tuple]]]) -> DataFrame:
    """A narrow step in Python: ``make()`` runs once a task and gives a function from rows to rows (tuples).

    Rows arrive and leave in bounded Arrow batches; the partitioning stays.
    """
    spark = df.sparkSession
    prepare(spark)
    out = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)

        def rows() -> Iterator[tuple]:
            for b in batches:
                cols = [c.to_pylist() for c in b.columns]
                yield from zip(*cols)

        def packed(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), arrow.types)], schema=arrow)

        held, size = [], 0
        for row in make()(rows()):
            held.append(row)
            size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
            if len(held) >= 4096 or size >= FLUSH_BYTES:
                yield packed(held)
                held, size = [], 0
        if held:
            yield packed(held)

    return df.mapInArrow(run, out)


class Scratch:
    """Tables in the folder that all executors share (``spark.checkpoint.dir``).

    ``save`` writes a DataFrame once and reads it back: lineage ends there, lost executors cost no earlier work,
    and rows can't change between two uses. ``drop`` deletes one table when it has been superseded; what is left
    goes when the driver exits. Where no folder is named, a local master uses one of this machine; a cluster can't:
    each executor would write to its own disk.
    """

    made: list[Scratch] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            top = "file://" + tempfile.mkdtemp(prefix="sparkwave-")
            spark.conf.set("spark.checkpoint.dir", top)
        self.root = f"{top.rstrip('/')}/sparkwave-{uuid.uuid4().hex}"
        self.n = 0
        Scratch.made.append(self)
        atexit.register(self.clear)

    @staticmethod
    @contextmanager
    def inner():
        """Tables of operators that are called inside are deleted at the end: for results that are saved there."""
        before = len(Scratch.made)
        yield
        for s in Scratch.made[before:]:
            s.clear()
        del Scratch.made[before:]

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:04d}-{name}"

    def save(self, df: DataFrame, name: str = "table") -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sparkwave_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        if path := getattr(df, "_sparkwave_path", None):
            self.delete(path)

    def delete(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)

    def clear(self) -> None:
        try:
            self.delete(self.root)
        except Exception:  # noqa: BLE001  the session may have ended: nothing can be deleted through it then
            pass


def lookup(scratch: Scratch, rows: DataFrame, side: DataFrame, key: str, parts: int = 10_000) -> DataFrame:
    """``rows`` left-joined to ``side``, which has one row for each key.

    Keys that more than one in ``parts`` rows (and a thousand) share would gather in one task: their rows of ``side``,
    at most ``parts``, are sent to all executors instead. ``rows`` is a written table: it is read more than once.
    """
    least = max(1000, rows.count() // parts)
    hot = rows.groupBy(key).count().where(F.col("count") > least).select(key)
    known = scratch.save(side.join(F.broadcast(hot), key, "left_semi"), "hot")
    if known.isEmpty():
        return rows.join(side, key, "left")
    known = F.broadcast(known)
    return rows.join(known, key).unionByName(rows.join(known.select(key), key, "left_anti").join(side, key, "left"))
