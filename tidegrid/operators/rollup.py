"""Rollups: buckets of a minute, five minutes and an hour with minimum, maximum, sum, count, first and last."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import agg_max, agg_min
from tidegrid.functions.spelling import RESOLUTION_MS
from tidegrid.lang import Query
from tidegrid.operators.select import dedup_last, selector

ROLLUP_COLUMNS = ["resolution", "metric", "labels", "series_key", "ts", "min", "max", "sum", "count", "first", "last"]


def bucket(ts: Column, res_ms: int | Column) -> Column:
    """Start of the bucket, cut toward zero: the buckets around 1970 are one."""
    return ts - ts % res_ms


def downsample(samples: DataFrame, resolutions: Iterable[str] = tuple(RESOLUTION_MS)) -> DataFrame:
    """Every resolution from the samples themselves, in one aggregation: a sample is exploded to its buckets after
    column pruning, and partial aggregation folds them before the shuffle. Samples are to be deduplicated."""
    steps = F.array(*[F.struct(F.lit(r).alias("name"), F.lit(RESOLUTION_MS[r]).cast("long").alias("ms")) for r in resolutions])
    b = samples.withColumn("_r", F.explode(steps)).withColumn("_b", bucket(F.col("ts"), F.col("_r.ms")))
    t, v, s = F.col("ts"), F.col("value"), F.col("seq")
    order = F.struct(t, s)
    out = b.groupBy(F.col("_r.name").alias("resolution"), "metric", "labels", "series_key", "_b").agg(
        agg_min(t, v, s).alias("min"), agg_max(t, v, s).alias("max"), F.sum(v).alias("sum"), F.count(F.lit(1)).alias("count"), F.min_by(v, order).alias("first"), F.max_by(v, order).alias("last")
    )
    return out.withColumnRenamed("_b", "ts").select(*ROLLUP_COLUMNS)


def _least(c: str) -> Column:
    """The least of points' minima: NaN only if all are, so that points of nothing but NaN do not hide the others."""
    return F.min(c)  # NaN is the greatest to Spark, so any number comes before it


def _greatest(c: str) -> Column:
    """The greatest of points' maxima; NaN only if all are."""
    return F.coalesce(F.max(F.when(~F.isnan(c), F.col(c))), F.max(c))


def coarsen(rollup: DataFrame, resolution: str) -> DataFrame:
    """A coarser resolution from a finer one, equal to that from samples but for the order of float sums."""
    r = rollup.withColumn("_b", bucket(F.col("ts"), RESOLUTION_MS[resolution]))
    out = r.groupBy("metric", "labels", "series_key", "_b").agg(_least("min").alias("min"), _greatest("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min_by("first", "ts").alias("first"), F.max_by("last", "ts").alias("last"))
    return out.withColumnRenamed("_b", "ts").withColumn("resolution", F.lit(resolution)).select(*ROLLUP_COLUMNS)


def merge_rollups(a: DataFrame, b: DataFrame) -> DataFrame:
    """One point per bucket of both; ``a`` is the earlier part: first values come from it, last ones from ``b``.

    A point's minimum or maximum is NaN if its first value was; merged with others it counts only where all are NaN.
    """
    both = a.withColumn("_side", F.lit(0)).unionByName(b.withColumn("_side", F.lit(1)))
    return both.groupBy("resolution", "metric", "labels", "series_key", "ts").agg(
        _least("min").alias("min"), _greatest("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min_by("first", "_side").alias("first"), F.max_by("last", "_side").alias("last")
    ).select(*ROLLUP_COLUMNS)


def point_average() -> Column:
    """Sum by count, 0 for an empty point."""
    return F.coalesce(F.try_divide(F.col("sum"), F.col("count")), F.lit(0.0))


def reconstruct(rollup: DataFrame, use: str = "avg") -> DataFrame:
    """Points as samples, by their average or last value."""
    if use not in ("avg", "last"):
        raise ValueError("use is 'avg' or 'last'")
    return rollup.select("metric", "labels", "series_key", "ts", (point_average() if use == "avg" else F.col("last")).alias("value"))


def select_resolution(start: int, end: int) -> str | None:
    """The resolution for a span: an hour from a day on, 5 minutes from 6 hours, a minute from an hour, else raw."""
    span = end - start
    for least, name in ((86_400_000, "1h"), (21_600_000, "5m"), (3_600_000, "1m")):
        if span >= least:
            return name
    return None


def query_rollup(rollup: DataFrame, q: Query, resolution: str) -> DataFrame:
    """Points of a resolution that the query selects, merged where a bucket has several.

    A column ``part``, if there is one, gives the order in time of the parts a bucket's points come from.
    """
    r = rollup.where(F.col("resolution") == resolution).where(selector(q.metric, q.matchers, q.start, q.end))
    r = r if "part" in r.columns else r.withColumn("part", F.lit(0))
    return r.groupBy("resolution", "metric", "labels", "series_key", "ts").agg(
        _least("min").alias("min"), _greatest("max").alias("max"), F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.min_by("first", "part").alias("first"), F.max_by("last", "part").alias("last")
    ).select(*ROLLUP_COLUMNS)


def rebuild_rollups(samples: DataFrame, path: str, resolutions: Iterable[str] = tuple(RESOLUTION_MS)) -> None:
    """All rollups anew, one folder per resolution."""
    downsample(dedup_last(samples), resolutions).write.mode("overwrite").partitionBy("resolution").parquet(path)
