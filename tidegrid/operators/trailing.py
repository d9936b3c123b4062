"""Rolling totals over trailing periods of days, silent days included.

Readings are first summed per entity and day. Entities by days are then packed into dense numpy blocks
(``block_entities`` x a tile of ``tile_days`` and the halo of days before it) and multiplied by banded window
operators, one band per trailing length. A tile is a key of its own, so an entity of any length is spread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000


def band(halo: int, days: int, width: int) -> np.ndarray:
    """(halo + days) x days operator whose product with a row of daily figures is the trailing sum of ``width`` days."""
    offset = np.arange(halo, halo + days)[None, :] - np.arange(halo + days)[:, None]
    return ((offset >= 0) & (offset < width)).astype(np.float64)


def split_exact(x: np.ndarray, widest: int) -> tuple[np.ndarray, np.ndarray]:
    """``x`` per row as a coarse and a fine part, each a multiple of a quantum, so that sums over ``widest`` days are exact.

    Equal sets of daily totals then give equal window totals wherever they stand in a block, and ties are ties.
    """
    top = np.max(np.abs(x), axis=1, keepdims=True)
    bits = 52 - int(np.ceil(np.log2(widest + 1)))
    _, e = np.frexp(top)
    with np.errstate(all="ignore"):
        scale = np.ldexp(1.0, np.clip(e - bits, -1000, 1000))
        coarse = np.rint(x / scale) * scale
        rest = x - coarse
        fine_scale = np.maximum(np.ldexp(scale, -bits), np.ldexp(1.0, -1060))
        fine = np.rint(rest / fine_scale) * fine_scale
    return coarse, fine


def _blocks(windows: list[int], tile_days: int, block_entities: int):
    halo = max(windows) - 1
    bands = [(w, band(halo, tile_days, w)) for w in windows]

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        """The days of one block: the rows of whole entities in one tile."""
        tile = int(pdf["_tile"].iloc[0])
        i, names = pd.factorize(pdf["_key"], use_na_sentinel=False)
        span = np.zeros((len(names), 2), np.int64)
        span[i] = pdf[["_first", "_last"]].to_numpy(np.int64)
        total, count = np.zeros((len(names), halo + tile_days)), np.zeros((len(names), halo + tile_days))
        n = pdf["_n"].to_numpy(np.int64)
        # An entity has one row a day, so cells are set, not summed; a row without readings only brings the span.
        held = n > 0
        at = i[held], pdf["_day"].to_numpy(np.int64)[held] - (tile * tile_days - halo)
        total[at], count[at] = pdf["_sum"].to_numpy(float)[held], n[held]
        coarse, fine = split_exact(total, max(windows))
        days = np.arange(tile_days) + tile * tile_days
        inside = (days[None, :] >= span[:, :1]) & (days[None, :] <= span[:, 1:])
        e, d = np.nonzero(inside)
        keys = np.asarray(names, dtype=object)[e]
        out = []
        for w, b in bands:
            sums, n = coarse @ b + fine @ b, count @ b
            out.append(pd.DataFrame({"_key": keys, "_day": days[d], "trailing_days": np.int32(w), "total": sums[e, d], "n": n[e, d].astype(np.int64)}))
        return pd.concat(out, ignore_index=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for pdf in batches:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            codes = pd.factorize(pdf["_key"], use_na_sentinel=False)[0]
            tiles = pdf["_tile"].to_numpy()
            # Numbers of the entities within their tile; the last entity may go on in the next batch.
            new = np.concatenate(([True], (codes[1:] != codes[:-1]) | (tiles[1:] != tiles[:-1])))
            starts = np.flatnonzero(new)
            block, ends = 0, []
            for k, s in enumerate(starts.tolist()):
                block = 1 if k == 0 or tiles[s] != tiles[s - 1] or block == block_entities else block + 1
                if block == 1:
                    ends.append(s)
            for a, b in zip(ends, ends[1:]):
                yield emit(pdf.iloc[a:b])
            held = pdf.iloc[ends[-1] :]
        if held is not None and len(held):
            yield emit(held)

    return run


def trailing_totals(readings: DataFrame, entity: str, ts: str, value: str, windows: tuple[int, ...] = (7, 30), tile_days: int = 128, block_entities: int = 256) -> DataFrame:
    """Per entity, UTC day and window: (``entity``, ``day`` DATE, ``trailing_days``, ``total``, ``n``, ``average``).

    Days run from the first to the last reading of the entity; a window holds its day and the days before it, and
    before the first day it holds what is there. ``average`` is null where ``n`` is 0.

    Defined cases: rows with a null time or a null, NaN or infinite value are no readings; repeated rows count
    each; a null entity is one entity; an empty table gives no rows; further columns are ignored.
    """
    kind = readings.schema[entity].dataType
    v = F.col(f"`{value}`").cast("double")
    ok = F.col(f"`{ts}`").isNotNull() & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    t = F.col(f"`{ts}`").cast("long")
    daily = readings.where(ok).groupBy(F.col(f"`{entity}`").cast("string").alias("_key"), F.expr(f"(`{ts}` - pmod(`{ts}`, {DAY_MS}L)) div {DAY_MS}L").alias("_day")).agg(F.sum(v).alias("_sum"), F.count(t).alias("_n"))
    bounds = daily.groupBy("_key").agg(F.min("_day").alias("_first"), F.max("_day").alias("_last"))
    tile_of = lambda c: F.floor(c / F.lit(tile_days)).cast("long")
    frame = bounds.withColumn("_tile", F.explode(F.sequence(tile_of(F.col("_first")), tile_of(F.col("_last"))))).select("_key", "_tile", "_first", "_last")
    halo = max(windows) - 1
    reach = daily.withColumn("_tile", F.explode(F.sequence(tile_of(F.col("_day")), tile_of(F.col("_day") + F.lit(halo)))))
    right = reach.select(F.col("_key").alias("_k2"), F.col("_tile").alias("_t2"), "_day", "_sum", "_n")
    cells = frame.join(right, [F.col("_key").eqNullSafe(F.col("_k2")), F.col("_tile") == F.col("_t2")], "left")
    cells = cells.select("_tile", "_key", F.coalesce("_day", "_first").alias("_day"), F.coalesce("_sum", F.lit(0.0)).alias("_sum"), F.coalesce("_n", F.lit(0)).alias("_n"), "_first", "_last")
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_day", T.LongType()), T.StructField("trailing_days", T.IntegerType()), T.StructField("total", T.DoubleType()), T.StructField("n", T.LongType())])
    cells = cells.repartition("_tile", "_key").sortWithinPartitions("_tile", "_key")
    out = cells.mapInPandas(_blocks(list(windows), tile_days, block_entities), schema)
    return out.select(
        F.col("_key").cast(kind).alias(entity), F.date_from_unix_date(F.col("_day").cast("int")).alias("day"), "trailing_days", "total", "n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("average")
    )
