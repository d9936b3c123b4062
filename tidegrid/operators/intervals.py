"""Overlapping, nested and gapped time intervals: continuous periods and the gaps between them.

The heart is :class:`IntervalMap`, an ordered map of disjoint intervals per entity; an insertion finds what it
overlaps by binary search and merges it. It is the state of a task here and of a streaming key in
``tidegrid.streaming.intervals``. An entity is cut into tiles by the start of its intervals, so one that holds
a third of all rows is many keys: maps are built per tile (first within each input partition, so copies and
overlaps are gone before the shuffle), and what earlier tiles reach over into later ones is one running
maximum over one row per tile.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIN = -(2**63)
#: Intervals held by a task of the first pass before it hands them on.
PARTIAL_INTERVALS = 200_000


class IntervalMap:
    """Ordered disjoint closed integer intervals; neighbours that touch (``end + 1 == start``) are one."""

    __slots__ = ("starts", "ends")

    def __init__(self, starts: list[int] | None = None, ends: list[int] | None = None):
        self.starts, self.ends = list(starts or []), list(ends or [])

    def insert(self, start: int, end: int) -> None:
        """Add one interval: binary search for the first that reaches ``start - 1`` and the last that begins by ``end + 1``."""
        a, b = self.starts, self.ends
        i, j = bisect_left(b, start - 1), bisect_right(a, end + 1)
        if i < j:
            start, end = min(start, a[i]), max(end, b[j - 1])
        a[i:j], b[i:j] = [start], [end]

    def periods(self) -> Iterator[tuple[int, int]]:
        return zip(self.starts, self.ends)

    def gaps(self) -> Iterator[tuple[int, int]]:
        return ((e + 1, s - 1) for e, s in zip(self.ends, self.starts[1:]))

    def __len__(self) -> int:
        return len(self.starts)


def _partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    maps: dict[tuple, IntervalMap] = {}
    held = 0

    def out() -> pd.DataFrame:
        rows = [(k, t, s, e) for (k, t), m in maps.items() for s, e in m.periods()]
        return pd.DataFrame(rows, columns=["_key", "_tile", "_start", "_end"])

    for pdf in batches:
        for k, t, s, e in zip(pdf["_key"].tolist(), pdf["_tile"].tolist(), pdf["_start"].tolist(), pdf["_end"].tolist()):
            m = maps.get((k, t))
            if m is None:
                m = maps[(k, t)] = IntervalMap()
            n = len(m)
            m.insert(s, e)
            held += len(m) - n
        if held > PARTIAL_INTERVALS:
            yield out()
            maps, held = {}, 0
    yield out()


def _merge_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, m = None, IntervalMap()
    rows: list[tuple] = []
    for pdf in batches:
        for k, t, s, e in zip(pdf["_key"].tolist(), pdf["_tile"].tolist(), pdf["_start"].tolist(), pdf["_end"].tolist()):
            if (k, t) != key:
                if key is not None:
                    rows.extend((*key, a, b) for a, b in m.periods())
                key, m = (k, t), IntervalMap()
            m.insert(s, e)
        if len(rows) > 50_000:
            yield pd.DataFrame(rows, columns=["_key", "_tile", "_start", "_end"])
            rows = []
    if key is not None:
        rows.extend((*key, a, b) for a, b in m.periods())
    yield pd.DataFrame(rows, columns=["_key", "_tile", "_start", "_end"])


def merge_intervals(df: DataFrame, entity: str, start: str, end: str, tile: int = 30 * 86_400_000) -> DataFrame:
    """Continuous periods and gaps per entity: (``entity``, ``kind`` 'period' | 'gap', ``start_ms``, ``end_ms``), ends inclusive.

    Intervals are closed and of whole units: one that starts a unit after another ends continues it. ``tile``
    is the span of starts that one task handles together (default 30 days of milliseconds).

    Defined cases: a null bound or ``start > end`` covers nothing; bounds may be any BIGINT; a null entity is an
    entity of its own; repeated intervals change nothing; no intervals, no rows; further columns are ignored.
    """
    name_type = df.schema[entity].dataType
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_tile", T.LongType()), T.StructField("_start", T.LongType()), T.StructField("_end", T.LongType())])
    src = df.select(F.col(f"`{entity}`").cast("string").alias("_key"), F.col(f"`{start}`").cast("long").alias("_start"), F.col(f"`{end}`").cast("long").alias("_end")).where(F.col("_start") <= F.col("_end"))
    src = src.select("_key", F.expr(f"_start div {tile}L - CASE WHEN _start % {tile}L < 0 THEN 1L ELSE 0L END").alias("_tile"), "_start", "_end")
    local = src.mapInPandas(_partial, schema)
    local = local.repartition("_key", "_tile").sortWithinPartitions("_key", "_tile", "_start", "_end").mapInPandas(_merge_sorted, schema)

    # What starts in earlier tiles reaches up to _reach; one row per tile takes part in the window.
    w = Window.partitionBy("_key").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    tiles = local.groupBy("_key", "_tile").agg(F.max("_end").alias("_top"))
    tiles = tiles.withColumn("_reach", F.max("_top").over(w)).select(F.col("_key").alias("_k2"), F.col("_tile").alias("_t2"), "_reach")
    same = [F.col("_key").eqNullSafe(F.col("_k2")), F.col("_tile") == F.col("_t2")]
    inner = Window.partitionBy("_key", "_tile").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    p = local.join(tiles, same).select("_key", "_tile", "_start", "_end", "_reach").withColumn("_before", F.greatest("_reach", F.max("_end").over(inner)))
    # A period begins where nothing before reaches the unit ahead of it.
    ahead = F.col("_start") - F.when(F.col("_start") > F.lit(_MIN), 1).otherwise(0)
    heads = p.where(F.col("_before").isNull() | (F.col("_before") < ahead))
    heads = heads.select("_key", "_tile", F.col("_start").alias("_head"), F.col("_before").alias("_prev"))

    # Each head ends the period before it, so a period's end is what its next head found before itself: the next
    # head of its tile, else the first head of the next tile that has one, else the last end of the entity.
    firsts = heads.groupBy("_key", "_tile").agg(F.min_by("_prev", "_head").alias("_fp"))
    after = Window.partitionBy("_key").orderBy("_tile").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy("_key")
    tail = local.groupBy("_key", "_tile").agg(F.max("_end").alias("_top")).join(firsts.select(F.col("_key").alias("_k3"), F.col("_tile").alias("_t3"), "_fp"), [F.col("_key").eqNullSafe(F.col("_k3")), F.col("_tile") == F.col("_t3")], "left")
    tail = tail.select(F.col("_key").alias("_k2"), F.col("_tile").alias("_t2"), F.coalesce(F.first("_fp", ignorenulls=True).over(after), F.max("_top").over(whole)).alias("_tail"))
    nxt = F.lead("_prev").over(Window.partitionBy("_key", "_tile").orderBy("_head"))
    out = heads.withColumn("_next", nxt).join(tail, same).select("_key", "_head", "_prev", F.coalesce("_next", "_tail").alias("_stop"))
    out = out.select(
        "_key",
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit("period").alias("kind"), F.col("_head").alias("a"), F.col("_stop").alias("b")),
                    F.struct(F.lit("gap").alias("kind"), F.when(F.col("_prev").isNotNull(), F.col("_prev") + 1).alias("a"), F.when(F.col("_prev").isNotNull(), F.col("_head") - 1).alias("b")),
                ),
                lambda x: x["a"].isNotNull(),
            )
        ).alias("x"),
    )
    return out.select(F.col("_key").cast(name_type).alias(entity), F.col("x.kind").alias("kind"), F.col("x.a").alias("start_ms"), F.col("x.b").alias("end_ms"))
