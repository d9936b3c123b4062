"""Schemas, the canonical key of a series and its display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = T.MapType(T.StringType(), T.StringType(), False)

SAMPLES = T.StructType(
    [
        T.StructField("metric", T.StringType()),
        T.StructField("labels", LABELS),
        T.StructField("series_key", T.StringType()),
        T.StructField("ts", T.LongType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("seq", T.LongType()),
    ]
)

ROLLUP = T.StructType(
    [T.StructField("resolution", T.StringType()), *SAMPLES.fields[:3], T.StructField("ts", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("min", "max", "sum")]
    + [T.StructField("count", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("first", "last")]
)


def _entries(labels: Column) -> Column:
    return F.array_sort(F.map_entries(F.coalesce(labels, F.create_map().cast("map<string,string>"))))


def series_key(metric: Column, labels: Column) -> Column:
    """One unambiguous text per metric and label set, whatever the order of the labels; null labels are none."""
    return F.concat(F.to_json(F.struct(F.coalesce(metric, F.lit("")).alias("metric"))), F.to_json(_entries(labels)))


def labels_text(labels: Column) -> Column:
    """``{k="v", k2="v2"}`` by key, for display only: values are not escaped. ``{}`` without labels."""
    return F.concat(F.lit("{"), F.array_join(F.transform(_entries(labels), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ", "), F.lit("}"))


def series_text(metric: Column, labels: Column) -> Column:
    """Metric name followed by the label text."""
    return F.concat(metric, labels_text(labels))
