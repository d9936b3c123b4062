"""Continuous ingestion of lines and rollups kept up to date, exactly once by checkpoint and last write."""

from __future__ import annotations

import time
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegrid.functions.spelling import RESOLUTION_MS
from tidegrid.operators.rollup import bucket, downsample
from tidegrid.operators.select import dedup_last
from tidegrid.schema import SAMPLES
from tidegrid.sources.line_protocol import parse_lines
from tidegrid.sources.store import Store, _fs

#: Bytes of one micro-batch's file that the order of writes leaves room for.
_BATCH_BYTES = 1 << 40


def line_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """Lines (``value``) of the text files that appear in a folder and the split of the file (``file``, ``start``) each
    was read in; one file a batch keeps the order of arrival."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def in_file_order(batch: DataFrame) -> DataFrame:
    """The lines of a batch with ``at``, which grows with the position in the file, however the file was split.

    A line is at the start of its split plus its row there, which is never beyond its first byte: a line has a byte
    at least, and the first line of a later split begins behind the split's start.
    """
    rows = batch.withColumn("_row", F.monotonically_increasing_id())
    # A partition may hold several splits, so rows count from the first of the split.
    firsts = rows.groupBy("file", "start").agg(F.min("_row").alias("_first"))
    at = F.col("start") + (F.col("start") > 0).cast("long") + F.col("_row") - F.col("_first")
    return rows.join(F.broadcast(firsts), ["file", "start"]).select("value", at.alias("at"))


def ingest_lines(spark: SparkSession, folder: str, root: str, checkpoint: str, now_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Parse lines into a store, a commit per batch; a batch that is repeated after a failure is there once.

    Lines without a time get ``now_ms``, by default the time of their batch. Bad lines (``seq``, ``line``, ``error``) go to
    ``rejected/batch=<n>`` below ``root``, see :func:`read_rejected`.
    """
    store = Store(spark, root)
    # Several streams may write into one store.
    stream = f"{zlib.crc32(checkpoint.encode()):08x}"

    def write(batch: DataFrame, batch_id: int) -> None:
        # Arrival: the batch, then the position within its file; a repeated batch gives the same numbers.
        numbered = in_file_order(batch).select("value", (F.lit(batch_id * _BATCH_BYTES) + F.col("at")).alias("seq"))
        now = int(time.time() * 1000) if now_ms is None else now_ms
        parsed = parse_lines(numbered, now, "quarantine", seq="seq").persist()
        try:
            rejected = parsed.where(F.col("error").isNotNull()).select("seq", "line", "error")
            rejected.write.mode("overwrite").parquet(f"{store.root}/rejected/batch={batch_id}")
            store.append(parsed.where(F.col("error").isNull()).drop("error", "line"), f"stream-{stream}-{batch_id}")
        finally:
            parsed.unpersist()

    w = line_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="2 minutes")).start()


def read_rejected(spark: SparkSession, root: str) -> DataFrame:
    """(``seq``, ``line``, ``error``, ``batch``) of every line that :func:`ingest_lines` could not read."""
    return spark.read.schema("seq long, line string, error string, batch long").parquet(f"{root.rstrip('/')}/rejected")


def rollup_stream(spark: SparkSession, root: str, rollup_root: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Recompute the hours that a batch touches from the deduplicated samples of a store, so rewrites are not counted twice.

    Touched (series, hour) pairs semi-join the live samples of their days; results land in ``batch=<n>`` folders
    whose greatest number wins on reading, see :func:`read_rollups`. Compactions of the store pass through as
    rewrites that change nothing.
    """
    store = Store(spark, root)
    fs, p = _fs(spark, f"{store.root}/data")
    fs.mkdirs(p)
    hour = bucket(F.col("ts"), RESOLUTION_MS["1h"])

    def refresh(batch: DataFrame, batch_id: int) -> None:
        touched = batch.select("series_key", hour.alias("_hour")).distinct().persist()
        try:
            first, last = touched.agg(F.min("_hour"), F.max("_hour")).first()
            raw = store.scan(None if first is None else first - RESOLUTION_MS["1h"], None if last is None else last + RESOLUTION_MS["1h"])
            again = dedup_last(raw.withColumn("_hour", hour).join(touched, ["series_key", "_hour"], "left_semi").drop("_hour"))
            downsample(again).write.mode("overwrite").parquet(f"{rollup_root}/batch={batch_id}")
        finally:
            touched.unpersist()

    w = spark.readStream.schema(SAMPLES).parquet(f"{store.root}/data").writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 minutes")).start()


def read_rollups(spark: SparkSession, rollup_root: str) -> DataFrame:
    """The newest version of every point."""
    r = spark.read.parquet(rollup_root)
    keys = ["resolution", "metric", "labels", "series_key", "ts"]
    rest = [c for c in r.columns if c not in (*keys, "batch")]
    return r.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in rest])


def rollup_aggregate(samples: DataFrame, resolution: str = "1m", watermark: str | None = None) -> DataFrame:
    """A streaming aggregate per bucket for inputs without rewrites (update mode; no watermark: no late cut-off)."""
    s = samples.withColumn("at", F.timestamp_millis("ts"))
    if watermark:
        s = s.withWatermark("at", watermark)
    w = F.window("at", f"{RESOLUTION_MS[resolution] // 1000} seconds")
    out = s.groupBy("metric", "series_key", w.alias("w")).agg(F.min("value").alias("min"), F.max("value").alias("max"), F.sum("value").alias("sum"), F.count(F.lit(1)).alias("count"), F.min_by("value", "ts").alias("first"), F.max_by("value", "ts").alias("last"))
    return out.select(F.lit(resolution).alias("resolution"), "metric", "series_key", F.unix_millis(F.col("w.start")).alias("ts"), "min", "max", "sum", "count", "first", "last")
