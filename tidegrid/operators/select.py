"""Selecting samples by metric, labels and time; the last write of each reading; unions of hot and cold rows."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.lang import Kind, Matcher
from tidegrid.operators.common import lookup_join
from tidegrid.regex import to_java


def matcher_column(m: Matcher, labels: Column | None = None) -> Column:
    """The matcher as a predicate on a map of labels."""
    text = F.coalesce((F.col("labels") if labels is None else labels)[m.name], F.lit(""))
    if m.kind is Kind.EQ:
        return text == m.value
    if m.kind is Kind.NE:
        return text != m.value
    hit = text.rlike(to_java(m.value))
    return hit if m.kind is Kind.RE else ~hit


def selector(metric: str | None, matchers: Iterable[Matcher] = (), start: int | None = None, end: int | None = None) -> Column:
    """Metric (null or empty: any), every matcher, and times from ``start`` to ``end``, both inclusive."""
    parts = [F.col("metric") == metric] if metric else []
    if start is not None:
        parts.append(F.col("ts") >= F.lit(start).cast("long"))
    if end is not None:
        parts.append(F.col("ts") <= F.lit(end).cast("long"))
    return reduce(and_, [*parts, *map(matcher_column, matchers)], F.lit(True))


def select_samples(samples: DataFrame, matchers: Iterable[Matcher] = (), metric: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows that the selector takes; metric and time reach the scan as pushed filters."""
    return samples.where(selector(metric, matchers, start, end))


def dedup_last(samples: DataFrame) -> DataFrame:
    """One row per series and time: the one written last (greatest ``seq``). A hash aggregation, folded before the shuffle."""
    return samples.groupBy("metric", "labels", "series_key", "ts").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))


def unify(*parts: DataFrame) -> DataFrame:
    """Hot and cold rows as one table with the last write of each reading."""
    return dedup_last(reduce(DataFrame.unionByName, parts))


def series_catalogue(samples: DataFrame) -> DataFrame:
    """One row per series: (``metric``, ``labels``, ``series_key``)."""
    return samples.groupBy("metric", "series_key").agg(F.first("labels").alias("labels")).select("metric", "labels", "series_key")


def select_by_catalogue(samples: DataFrame, catalogue: DataFrame, matchers: Iterable[Matcher], metric: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """As :func:`select_samples`, the labels looked at once per series: the matching keys restrict the scan."""
    keys = catalogue.where(selector(metric, matchers)).select("series_key").distinct()
    return lookup_join(samples.where(selector(metric, (), start, end)), keys, ["series_key"], "left_semi")
