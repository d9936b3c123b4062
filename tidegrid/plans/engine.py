"""Running queries: text to plan to result."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import EXTRA, REGISTRY
from tidegrid.lang import EXTRA_FUNCTIONS, FUNCTIONS, Matcher, Query, parse
from tidegrid.operators.rollup import query_rollup, reconstruct, select_resolution
from tidegrid.operators.select import dedup_last, select_samples

INSTANT_MS = 300_000


@dataclass
class Result:
    """``kind`` scalar, vector or matrix, and its rows."""

    kind: str
    df: DataFrame

    def to_dict(self) -> dict:
        """The JSON shape of the HTTP surface; NaN and infinite numbers become text, absent parts null."""

        def number(v: float | None) -> float | str | None:
            return v if v is None or math.isfinite(v) else str(v)

        out: dict = {"Type": ["scalar", "vector", "matrix"].index(self.kind), "Scalar": None, "Vector": None, "Matrix": None}
        rows = self.df.collect()
        if self.kind == "scalar":
            out["Scalar"] = {"Value": number(rows[0]["value"])}
        elif self.kind == "vector":
            out["Vector"] = [{"Series": {"Name": r["metric"], "Labels": r["labels"]}, "Sample": {"Timestamp": r["ts"], "Value": number(r["value"])}} for r in rows]
        else:
            by: dict = {}
            for r in rows:
                by.setdefault(r["series_key"], {"Series": {"Name": r["metric"], "Labels": r["labels"]}, "Samples": []})["Samples"].append({"Timestamp": r["ts"], "Value": number(r["value"])})
            out["Matrix"] = list(by.values()) or None
        return out


class Engine:
    """Queries over a samples table (and, if given, rollups).

    ``honor_range`` lets instant queries use their ``[duration]`` instead of five minutes; ``extra_functions``
    admits the library's statistics to the text; ``use_rollups`` answers long ``avg`` ranges from rollups.
    """

    def __init__(self, samples: DataFrame, rollup: DataFrame | None = None, honor_range: bool = False, extra_functions: bool = False, use_rollups: bool = False, strict: bool = False):
        self.samples, self.rollup, self.honor_range, self.use_rollups, self.strict = samples, rollup, honor_range, use_rollups, strict
        self.functions = FUNCTIONS + (EXTRA_FUNCTIONS if extra_functions else ())

    def parse(self, text: str, now_ms: int) -> Query:
        return parse(text, now_ms, self.strict, self.functions)

    def execute(self, text: str, now_ms: int, shape: str = "auto") -> Result:
        """The query over its own range before ``now_ms``."""
        return self.evaluate(self.parse(text, now_ms), shape)

    def instant(self, text: str, at_ms: int, shape: str = "auto") -> Result:
        """The query over the five minutes up to ``at_ms``."""
        q = self.parse(text, at_ms)
        return self.evaluate(q if self.honor_range else q.over(at_ms - INSTANT_MS, at_ms), shape)

    def range(self, text: str, start: int, end: int, step_ms: int | None = None, shape: str = "auto", grid: bool = False) -> Result:
        """One evaluation over ``start``..``end``. ``step_ms`` matters only with ``grid``: see :meth:`stepped`."""
        q = self.parse(text, end)
        if grid and step_ms:
            return self.stepped(q, start, end, step_ms)
        return self.evaluate(q.over(start, end), shape)

    def selected(self, q: Query) -> DataFrame:
        """Deduplicated samples of the query; filters stand below the deduplication and reach the scan."""
        return dedup_last(select_samples(self.samples, q.matchers, q.metric, q.start, q.end))

    def evaluate(self, q: Query, shape: str = "auto") -> Result:
        """No function: a matrix. Else one number per series: none gives scalar 0, one a scalar, more a vector.

        The shape depends on the data, so ``auto`` looks at up to two result rows; ``vector`` stays lazy.
        """
        if q.function is None:
            return Result("matrix", self.selected(q).select("metric", "labels", "series_key", "ts", "value").orderBy("series_key", "ts"))
        resolution = select_resolution(q.start, q.end) if self.use_rollups and self.rollup is not None and q.function == "avg" else None
        if resolution:
            points = query_rollup(self.rollup, q, resolution)
            vector = points.groupBy("metric", "labels", "series_key").agg(F.max("ts").alias("ts"), F.coalesce(F.try_divide(F.sum("sum"), F.sum("count")), F.lit(0.0)).alias("value"))
        else:
            fn = (REGISTRY | EXTRA)[q.function]
            vector = self.selected(q).groupBy("metric", "labels", "series_key").agg(F.max("ts").alias("ts"), fn(F.col("ts"), F.col("value"), F.col("seq")).alias("value"))
        if shape == "vector":
            return Result("vector", vector)
        spark = self.samples.sparkSession
        few = vector.limit(2).collect()
        if len(few) < 2:
            return Result("scalar", spark.createDataFrame([(few[0]["value"] if few else 0.0,)], "value double"))
        return Result("vector", vector.orderBy("series_key"))

    def stepped(self, q: Query, start: int, end: int, step_ms: int) -> Result:
        """Opt-in: the function at every step over the range before it, as a matrix. A sample goes to each step whose window holds it."""
        fn = (REGISTRY | EXTRA)[q.function or "last"]
        wide = self.selected(q.over(start - q.range_ms, end))
        lo = F.greatest(F.lit(0), F.ceil((F.col("ts") - start) / step_ms)).cast("long")
        hi = F.least(F.lit((end - start) // step_ms), F.floor((F.col("ts") + q.range_ms - start) / step_ms)).cast("long")
        at = wide.withColumn("_lo", lo).withColumn("_hi", hi).where("_lo <= _hi").withColumn("_at", F.explode(F.sequence("_lo", "_hi")))
        out = at.groupBy("metric", "labels", "series_key", "_at").agg(fn(F.col("ts"), F.col("value"), F.col("seq")).alias("value"))
        return Result("matrix", out.select("metric", "labels", "series_key", (F.lit(start) + F.col("_at") * step_ms).alias("ts"), "value").orderBy("series_key", "ts"))

    def samples_from_rollups(self, q: Query, use: str = "avg") -> DataFrame:
        """Reconstructed samples at the resolution that suits the range; raw samples for short ones."""
        resolution = select_resolution(q.start, q.end)
        if resolution is None or self.rollup is None:
            return self.selected(q).select("metric", "labels", "series_key", "ts", "value")
        return reconstruct(query_rollup(self.rollup, q, resolution), use)

    def series(self, matchers: tuple[Matcher, ...] = (), start: int | None = None, end: int | None = None, metric: str | None = None) -> DataFrame:
        """Distinct series with a sample in the range."""
        return select_samples(self.samples, matchers, metric, start, end).select("metric", "labels", "series_key").dropDuplicates(["series_key"])

    def series_matching(self, names: list[str], start: int, end: int, distinct: bool = False) -> DataFrame:
        """Label maps with ``__name__`` for each literal metric name; results of several names are appended."""
        parts = [self.series((), start, end, n).select(F.map_concat(F.create_map(F.lit("__name__"), F.col("metric")), "labels").alias("series"), "series_key") for n in names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return (out.dropDuplicates(["series_key"]) if distinct else out).select("series")

    def label_names(self) -> DataFrame:
        """Every label name in use."""
        return self.samples.select(F.explode(F.map_keys("labels")).alias("name")).distinct().orderBy("name")

    def label_values(self, name: str) -> DataFrame:
        """Every value of a label."""
        return self.samples.select(F.col("labels")[name].alias("value")).where(F.col("value").isNotNull()).distinct().orderBy("value")

    def status(self) -> DataFrame:
        """One row: series, samples without rewrites, first and last time."""
        return dedup_last(self.samples).agg(F.countDistinct("series_key").alias("num_series"), F.count(F.lit(1)).alias("total_samples"), F.min("ts").alias("min_time"), F.max("ts").alias("max_time"))
