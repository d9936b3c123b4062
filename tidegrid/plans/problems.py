"""The problem queries over the project's tables (the text ones are in the ``llm`` subpackage)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.spelling import RESOLUTION_MS, hex_number, is_finite, resolution, resolution_length, series_hash
from tidegrid.operators.common import current_rows, lookup_join
from tidegrid.operators.compaction import Compaction, point_records
from tidegrid.operators.delivery import deduplicate, repeated_messages, sample_set, without_repeats
from tidegrid.operators.grid import regular_grid
from tidegrid.operators.intervals import merge_intervals
from tidegrid.operators.outliers import implausible
from tidegrid.operators.trailing import trailing_totals
from tidegrid.session import materialize, shared_dir


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    """(series_ref, ts, value): current rows whose value is neither null, NaN nor infinite."""
    return current_rows(_table(spark, sf, "samples").select("series_ref", "ts", "value", "seq"), ["series_ref"]).where(is_finite(F.col("value")))


def _series(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "series").select("series_ref", series_hash(F.col("series_hash")).alias("series_hash"), resolution(F.col("resolution")).alias("resolution"), resolution_length(F.col("resolution")).alias("period_ms"))


def _sample_grid(spark: SparkSession, sf: str) -> DataFrame:
    # The grid goes by the 8 bytes of series_ref; hash and resolution are looked up for what comes out of it.
    timed = lookup_join(readings(spark, sf), _series(spark, sf).select("series_ref", "period_ms"), ["series_ref"])
    return regular_grid(timed, ["series_ref"], "ts", "value", "period_ms", unique_times=True)


def _rollup_readings(spark: SparkSession, sf: str) -> DataFrame:
    p = _table(spark, sf, "rollup_points").where(F.col("v_count") > 0)
    return p.select(
        series_hash(F.col("series_hash")).alias("series_hash"), resolution(F.col("resolution")).alias("resolution"), resolution_length(F.col("resolution")).alias("period_ms"), "ts", (F.col("v_sum") / F.col("v_count")).alias("value")
    )


def p1_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every series on the grid of its resolution, periods observed, filled or missing."""
    return lookup_join(_sample_grid(spark, sf), _series(spark, sf).drop("period_ms"), ["series_ref"])


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Grid periods without data, of samples and of rollup points."""
    samples = lookup_join(_sample_grid(spark, sf).where(F.col("n") == 0).select("series_ref", "period_start"), _series(spark, sf).drop("period_ms"), ["series_ref"])
    rollups = regular_grid(_rollup_readings(spark, sf), ["series_hash", "resolution"], "ts", "value", "period_ms").where(F.col("n") == 0)
    columns = ["origin", "series_hash", "resolution", F.col("period_start").alias("ts")]
    return samples.withColumn("origin", F.lit("samples")).select(*columns).unionByName(rollups.withColumn("origin", F.lit("rollup_points")).select(*columns))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Continuous periods and gaps of every store."""
    return merge_intervals(_table(spark, sf, "blocks"), "store", "min_time", "max_time")


def p3_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Totals and averages over the trailing 7 and 30 days of every series and day."""
    t = trailing_totals(readings(spark, sf), "series_ref", "ts", "value")
    return t.select("series_ref", "trailing_days", F.date_format("day", "yyyy-MM-dd").alias("day"), "total", "n", "average")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Silent days, and the peak day of each series and window."""
    # Two rows a day are left of all readings; written once, both kinds are read from them.
    t = materialize(trailing_totals(readings(spark, sf), "series_ref", "ts", "value").select("series_ref", "trailing_days", "day", "total", "n"), "trailing")
    silent = t.where(F.col("n") == 0).select(F.lit("silent").alias("kind"), "series_ref", "trailing_days", "day")
    best = F.max_by("day", F.struct("total", (-F.unix_date("day")).alias("early")))
    peak = t.where(F.col("n") > 0).groupBy("series_ref", "trailing_days").agg(best.alias("day")).select(F.lit("peak").alias("kind"), "series_ref", "trailing_days", "day")
    return silent.unionByName(peak).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _messages(spark: SparkSession, sf: str) -> DataFrame:
    w = _table(spark, sf, "wal_entries")
    return w.select("record_id", "producer", "series_ref", "written_at", hex_number(F.col("entry_id")).alias("message"), sample_set(F.col("samples")).alias("sample_set"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose message also stands in an entry with a smaller record id."""
    return repeated_messages(_messages(spark, sf), "record_id", "producer", "message", ["series_ref", "sample_set"])


def p4_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly one entry of each message that has an id: the one written first."""
    m = _messages(spark, sf).where(F.col("message").isNotNull())
    return deduplicate(m, ["producer", "message"], "record_id", ["written_at"]).select("record_id", "producer", "message")


def p4_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Every entry, with or without an id, that p4_found does not name: the whole table without repeats."""
    kept = without_repeats(_messages(spark, sf), "record_id", "producer", "message", ["series_ref", "sample_set"])
    return kept.select("record_id", "producer", "message")


def _points(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, list]:
    return point_records(_table(spark, sf, "rollup_points"), _table(spark, sf, "rollup_files"), series_hash(F.col("series_hash")), resolution(F.col("resolution")))


_POINT = ["series_hash", "resolution", "ts"]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct rollup point once, read from the compacted files."""
    records, listing, ranges = _points(spark, sf)
    job = Compaction(records, listing, shared_dir(spark, "compaction"), _POINT, ["file_written", "file_source"], ranges)
    return job.run().select(*_POINT)


def p5_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same in two runs of one journal: the files written before the last day there is, then those of that day."""
    records, listing, ranges = _points(spark, sf)
    root = shared_dir(spark, "compaction")
    top = _table(spark, sf, "rollup_files").agg(F.max("written_at") - F.expr("INTERVAL 1 DAY")).first()[0]
    early = records.where(F.coalesce(F.col("file_written") < F.lit(top), F.lit(True)))
    Compaction(early, listing, root, _POINT, ["file_written", "file_source"], ranges).run()
    return Compaction(records, listing, root, _POINT, ["file_written", "file_source"], ranges).run().select(*_POINT)


#: Bounds of the possible per metric; any other metric is not negative.
BOUNDS = {"cpu_busy_percent": (0.0, 100.0), "humidity_percent": (0.0, 100.0), "error_ratio": (0.0, 1.0), "temperature_celsius": (-273.15, None)}


def p6_readings(spark: SparkSession, sf: str) -> DataFrame:
    """Every implausible current sample with the reason."""
    low, high = F.lit(0.0), F.lit(None).cast("double")
    for metric, (a, b) in BOUNDS.items():
        low, high = F.when(F.col("metric") == metric, F.lit(a)).otherwise(low), F.when(F.col("metric") == metric, F.lit(b).cast("double")).otherwise(high)
    s = _table(spark, sf, "samples").select("series_ref", "ts", "value", "seq", low.alias("low"), high.alias("high"))
    return implausible(current_rows(s, ["series_ref"], carry=["low", "high"]), "series_ref", "ts", "value", "low", "high")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Spikes, stuck stretches and impossible values among the current samples."""
    return p6_readings(spark, sf).select("series_ref", "ts")


def p6_impossible(spark: SparkSession, sf: str) -> DataFrame:
    """The current samples that cannot be."""
    return p6_readings(spark, sf).where(F.col("reason") == "impossible").select("series_ref", "ts")


def p6_stuck(spark: SparkSession, sf: str) -> DataFrame:
    """The current samples of stuck stretches."""
    return p6_readings(spark, sf).where(F.col("reason") == "stuck").select("series_ref", "ts")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_grid": p1_grid, "p2_found": p2_found, "p3_found": p3_found, "p3_totals": p3_totals, "p4_found": p4_found, "p4_messages": p4_messages, "p4_delivered": p4_delivered, "p5_found": p5_found, "p5_incremental": p5_incremental, "p6_found": p6_found, "p6_impossible": p6_impossible, "p6_stuck": p6_stuck}
