"""A samples table in Parquet by day: appends, reads, levelled compaction and a manifest of its files.

Layout: ``data/commit=<id>/day=<d>/*.parquet`` holds what one append or compaction wrote, ``log/<n>.json`` says, in order,
which commits came and which they replace. A log file appears whole, by renaming, and never changes, so readers see
a state between two entries; an append beside a compaction takes the next number, and neither loses the other. A
commit whose name is in the log is not written again, so a repeated batch changes nothing.
"""

from __future__ import annotations

import json
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.select import dedup_last
from tidegrid.schema import SAMPLES

_STORED = T.StructType([*SAMPLES.fields, T.StructField("day", T.IntegerType())])
_DAY = "cast((ts - pmod(ts, 86400000L)) div 86400000L as int)"
MB = 1 << 20
#: So many of the oldest commits of a level are merged into one of the next.
LEVELS = {0: 3, 1: 4}
_commit_lock = threading.Lock()


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Store:
    """The table below ``root``. Files that cannot be read are left out of reads; Spark logs a warning for each."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- log ----------------------------------------------------------------------------------------------

    def log(self) -> list[dict]:
        """The entries so far: ``id``, ``level``, ``replaces``."""
        fs, p = _fs(self.spark, f"{self.root}/log")
        if not fs.exists(p):
            return []
        out = []
        for n in sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")):
            stream = fs.open(_fs(self.spark, f"{self.root}/log/{n}.json")[1])
            try:
                out.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return out

    def live(self) -> dict[str, dict]:
        """The entries that are not replaced, oldest first."""
        out: dict[str, dict] = {}
        for e in self.log():
            for gone in e["replaces"]:
                out.pop(gone, None)
            out[e["id"]] = e
        return out

    def _commit(self, name: str, level: int, replaces: list[str]) -> bool:
        """Add an entry; False if something it replaces is no longer live."""
        with _commit_lock:  # of this process; between processes the rename decides
            while True:
                live = self.live()
                if not all(r in live for r in replaces):
                    return False
                n = len(self.log())
                fs, tmp = _fs(self.spark, f"{self.root}/log/.{uuid.uuid4().hex}")
                stream = fs.create(tmp, True)
                try:
                    stream.write(bytearray(json.dumps({"id": name, "level": level, "replaces": replaces}).encode()))
                finally:
                    stream.close()
                to = _fs(self.spark, f"{self.root}/log/{n}.json")[1]
                if not fs.exists(to) and fs.rename(tmp, to):
                    return True
                fs.delete(tmp, False)

    # -- writing ------------------------------------------------------------------------------------------

    def _write(self, samples: DataFrame, name: str) -> None:
        out = samples.select(*[f.name for f in SAMPLES.fields]).withColumn("day", F.expr(_DAY))
        # Sorted within files so that metric and time prune row groups; adaptive execution splits large days and joins small ones.
        out = out.hint("rebalance", "day").sortWithinPartitions("day", "metric", "series_key", "ts", "seq")
        out.write.mode("overwrite").option("compression", "zstd").partitionBy("day").parquet(f"{self.root}/data/commit={name}")

    def append(self, samples: DataFrame, batch: str | None = None) -> bool:
        """Add samples as one commit; with a ``batch`` that is there already nothing happens (False)."""
        name = batch or uuid.uuid4().hex
        if batch and any(e["id"] == batch for e in self.log()):
            return False
        self._write(samples, name)
        return self._commit(name, 0, [])

    def compact(self) -> bool:
        """Everything in one commit with one row per reading; what is appended meanwhile stays beside it."""
        return self._merge(list(self.live()), max(LEVELS) + 1)

    def plan(self) -> list[tuple[list[str], int]]:
        """The merges that are due: of each level the oldest commits, once it has enough, and the level they go to."""
        live = self.live().values()
        by = {level: [e["id"] for e in live if e["level"] == level] for level in LEVELS}
        return [(by[level][:n], level + 1) for level, n in LEVELS.items() if len(by[level]) >= n]

    def cycle(self) -> int:
        """One round of levelled compaction, at most one merge a level; the number of merges."""
        return sum(self._merge(ids, level) for ids, level in self.plan())

    def _merge(self, ids: list[str], level: int) -> bool:
        if not ids:
            return False
        name = uuid.uuid4().hex
        self._write(dedup_last(self._read(ids).drop("day")), name)
        return self._commit(name, level, ids)

    def vacuum(self) -> int:
        """Delete the data of commits that are replaced or were never committed; not beside running appends."""
        live = self.live()
        fs, p = _fs(self.spark, f"{self.root}/data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().removeprefix("commit=") not in live] if fs.exists(p) else []
        return sum(bool(fs.delete(g, True)) for g in gone)

    # -- reading ------------------------------------------------------------------------------------------

    def _read(self, ids: list[str]) -> DataFrame:
        paths = [p for i in ids if _fs(self.spark, p := f"{self.root}/data/commit={i}")[0].exists(_fs(self.spark, p)[1])]
        if not paths:
            return self.spark.createDataFrame([], _STORED)
        return self.spark.read.schema(_STORED).option("basePath", f"{self.root}/data").option("ignoreCorruptFiles", "true").parquet(*paths).select(*_STORED.names)

    def raw(self) -> DataFrame:
        """Every stored row."""
        return self._read(list(self.live()))

    def scan(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """The samples table; a time range also prunes day folders."""
        df = self.raw()
        if start is not None:
            df = df.where((F.col("ts") >= start) & (F.col("day") >= start // 86_400_000))
        if end is not None:
            df = df.where((F.col("ts") <= end) & (F.col("day") <= end // 86_400_000))
        return df.drop("day")

    def num_files(self) -> int:
        return len(self.raw().inputFiles())

    def manifest(self) -> DataFrame:
        """(``file``, ``bytes``, ``min_time``, ``max_time``, ``num_series``, ``num_samples``) of every file, by time."""
        df = self.raw()
        if not df.inputFiles():
            return self.spark.createDataFrame([], "file string, bytes long, min_time long, max_time long, num_series long, num_samples long")
        m = df.select("ts", "series_key", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"))
        # By file and series first: the count of series is exact without a set of them in memory.
        m = m.groupBy("file", "series_key").agg(F.max("size").alias("bytes"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"), F.count(F.lit(1)).alias("n"))
        m = m.groupBy("file").agg(F.max("bytes").alias("bytes"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.count("series_key").alias("num_series"), F.sum("n").alias("num_samples"))
        return m.orderBy("min_time", "file")
