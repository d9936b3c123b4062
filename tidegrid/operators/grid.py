"""Irregular readings onto a regular grid.

Each source gets the sequence of its periods from first to last reading. Readings are aggregated per period;
the sequence is left-joined with those aggregates; an empty period carries the last observed value forward
while its age is within ``max_gap_periods`` and is marked missing beyond.

The sequence is generated by tiles of ``tile_periods`` periods, so a source of any size is spread over
tasks; only one row per tile meets in the window that hands the last observation from tile to tile, and the
periods of a tile are unrolled after the join, so the grid itself is never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.common import is_small
from tidegrid.session import materialize

OBSERVED, FILLED, MISSING = "observed", "filled", "missing"


def _floor_to(ts: Column, step: Column) -> Column:
    return ts - F.pmod(ts, step)


def regular_grid(readings: DataFrame, keys: list[str], ts: str, value: str, period_ms: str, max_gap_periods: int = 5, tile_periods: int = 1440, unique_times: bool = False) -> DataFrame:
    """One row per key and period from the period of the first to that of the last reading.

    ``readings`` holds the readings only; ``period_ms`` names the column with the length of the source's period
    (BIGINT, starting at multiples of it, also before 1970). Result: the keys, ``period_ms``, ``period_start``,
    ``n`` (readings in the period, 0 if none), ``value`` (last reading of the period, the greatest if several
    have the last time; in empty periods the one carried forward, null if missing), ``status`` observed / filled / missing.

    ``unique_times`` says that no key holds two readings of one time, which saves a shuffle.

    Defined cases: a null time or a null or non-positive period has no place on a grid and is left out; a null
    value counts as a reading without value; null keys form a source of their own; repeated rows count in ``n``;
    an empty table gives an empty grid; other columns are ignored, whatever their names.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    base = readings.select(
        *[F.col(f"`{c}`").alias(a) for c, a in zip(keys, k)], F.col(f"`{period_ms}`").cast("long").alias("_p"), F.col(f"`{ts}`").cast("long").alias("_t"), F.col(f"`{value}`").cast("double").alias("_v")
    ).where(F.col("_t").isNotNull() & (F.col("_p") > 0))
    if unique_times:
        at_once = base.withColumn("_c", F.lit(1).cast("long"))
    else:
        at_once = base.groupBy(*k, "_p", "_t").agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v"))
    start = _floor_to(F.col("_t"), F.col("_p"))
    tile = _floor_to(F.col("_t"), F.col("_p") * F.lit(tile_periods))
    observed = at_once.groupBy(*k, "_p", tile.alias("_tile"), start.alias("_s")).agg(F.sum("_c").alias("_n"), F.max_by("_v", "_t").alias("_v"))
    return _unroll(observed, keys, k, max_gap_periods, tile_periods, period_ms)


def _unroll(observed: DataFrame, keys: list[str], k: list[str], max_gap_periods: int, tile_periods: int, period_ms: str) -> DataFrame:
    packed = observed.groupBy(*k, "_p", "_tile").agg(F.array_sort(F.collect_list(F.struct("_s", "_n", "_v"))).alias("_obs"))
    packed = packed.select(*k, "_p", "_tile", F.element_at("_obs", 1)["_s"].alias("_from"), F.element_at("_obs", -1).alias("_end"), "_obs")
    # Written once: the frame of tiles reads its narrow columns, the grid its arrays.
    packed = materialize(packed, "grid-tiles")
    span = F.col("_p") * F.lit(tile_periods)
    narrow = packed.select(*k, "_p", "_tile", "_from", "_end")
    ends = narrow.groupBy(*k, "_p").agg(F.min("_tile").alias("_t0"), F.max("_tile").alias("_t1"), F.min("_from").alias("_first"), F.max("_end._s").alias("_last"))
    tiles = ends.withColumn("_tile", F.explode(F.sequence("_t0", "_t1", span))).drop("_t0", "_t1")

    def match(right: DataFrame) -> tuple[DataFrame, list[Column]]:
        names = {c: f"_r{c}" for c in [*k, "_p", "_tile"]}
        return right.withColumnsRenamed(names), [F.col(c).eqNullSafe(F.col(f"_r{c}")) for c in k] + [F.col(c) == F.col(f"_r{c}") for c in ("_p", "_tile")]

    # Only the last observation of each tile goes through the window; the arrays stay where they are.
    before = Window.partitionBy(*k, "_p").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    last, on = match(narrow.select(*k, "_p", "_tile", "_end"))
    tiles = tiles.join(last, on, "left").withColumn("_carry", F.last("_end", ignorenulls=True).over(before)).select(*k, "_p", "_tile", "_first", "_last", "_carry", F.col("_end").isNotNull().alias("_seen"))
    tiles = materialize(tiles, "grid-frame")
    # The left join of frame and observations in two parts, so that arrays are not shuffled where the frame is small.
    seen = tiles.where("_seen").drop("_seen")
    right, on = match(packed.select(*k, "_p", "_tile", "_obs"))
    joined = right.join(F.broadcast(seen) if is_small(seen) else seen, on).select(*k, "_p", "_tile", "_first", "_last", "_carry", "_obs")
    silent = tiles.where(~F.col("_seen")).select(*k, "_p", "_tile", "_first", "_last", "_carry", F.array().cast(packed.schema["_obs"].dataType).alias("_obs"))
    joined = joined.unionByName(silent)
    # Segments: from one observed period up to the next; the first begins with the tile and holds what was carried in.
    lo, hi = F.greatest("_tile", "_first"), F.least(F.col("_tile") + span - F.col("_p"), F.col("_last"))
    # They stand in a column of their own: looking at the next one must not build the array again.
    joined = joined.withColumn("_seg", F.concat(F.when(F.col("_carry").isNotNull(), F.array(F.col("_carry"))).otherwise(F.array()), "_obs"))
    segments = F.col("_seg")
    segments = F.transform(
        segments, lambda x, i: F.struct(x.alias("o"), F.greatest(x["_s"], lo).alias("from"), (F.coalesce(F.get(F.col("_seg"), i + 1)["_s"], hi + F.col("_p")) - F.col("_p")).alias("to"))
    )
    rows = joined.select(*k, "_p", F.explode(F.filter(segments, lambda x: x["from"] <= x["to"])).alias("_g"))
    rows = rows.select(*k, "_p", F.col("_g.o").alias("_o"), F.explode(F.sequence(F.col("_g.from"), F.col("_g.to"), F.col("_p"))).alias("_at"))
    hit = F.col("_at") == F.col("_o._s")
    near = F.col("_at") - F.col("_o._s") <= F.col("_p") * F.lit(max_gap_periods)
    return rows.select(
        *[F.col(a).alias(c) for c, a in zip(keys, k)],
        F.col("_p").alias(period_ms),
        F.col("_at").alias("period_start"),
        F.when(hit, F.col("_o._n")).otherwise(F.lit(0)).alias("n"),
        F.when(hit | near, F.col("_o._v")).alias("value"),
        F.when(hit, OBSERVED).when(near, FILLED).otherwise(MISSING).alias("status"),
    )
