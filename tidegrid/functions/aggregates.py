"""Aggregates over time within one series, as aggregate expressions.

All take the columns of time, value and order of arrival; "first" and "last" go by (time, order). NaN is
skipped by ``max`` and ``min`` unless the first value is NaN, and nothing at all gives 0.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Aggregate = Callable[[Column, Column, Column], Column]


def _order(ts: Column, seq: Column) -> Column:
    return F.struct(ts, seq)


def agg_first(ts: Column, value: Column, seq: Column) -> Column:
    """Value at the least time."""
    return F.coalesce(F.min_by(value, _order(ts, seq)), F.lit(0.0))


def agg_last(ts: Column, value: Column, seq: Column) -> Column:
    """Value at the greatest time."""
    return F.coalesce(F.max_by(value, _order(ts, seq)), F.lit(0.0))


def agg_sum(ts: Column, value: Column, seq: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def agg_avg(ts: Column, value: Column, seq: Column) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def agg_count(ts: Column, value: Column, seq: Column) -> Column:
    return F.count(F.lit(1)).cast("double")


def _extreme(pick: Callable[[Column], Column]) -> Aggregate:
    def agg(ts: Column, value: Column, seq: Column) -> Column:
        # An aggregate without NaN, unless NaN came first.
        first = F.min_by(value, _order(ts, seq))
        return F.coalesce(F.when(F.isnan(first), first).otherwise(pick(F.when(~F.isnan(value), value))), F.lit(0.0))

    return agg


agg_max, agg_min = _extreme(F.max), _extreme(F.min)


def agg_delta(ts: Column, value: Column, seq: Column) -> Column:
    """Last less first value; 0 with fewer than two samples. Counter resets are not undone."""
    return F.when(F.count(F.lit(1)) < 2, F.lit(0.0)).otherwise(agg_last(ts, value, seq) - agg_first(ts, value, seq))


def agg_rate(ts: Column, value: Column, seq: Column) -> Column:
    """Delta per second between first and last sample; 0 without a span."""
    span = (F.max(ts) - F.min(ts)) / F.lit(1000.0)
    return F.coalesce(F.when(span > 0, F.try_divide(agg_delta(ts, value, seq), span)), F.lit(0.0))


def agg_stddev(ts: Column, value: Column, seq: Column) -> Column:
    """Of the population; 0 with fewer than two samples."""
    return F.coalesce(F.stddev_pop(value), F.lit(0.0))


def agg_variance(ts: Column, value: Column, seq: Column) -> Column:
    """Of the population; 0 with fewer than two samples."""
    return F.coalesce(F.var_pop(value), F.lit(0.0))


def agg_percentile(value: Column, p: float) -> Column:
    """Linear interpolation at rank ``p / 100 * (n - 1)``; 0 for ``p`` outside 0-100 and for no values.

    It holds the values of a group, one series of one query range; the radix operator serves groups of any size.
    """
    if not 0 <= p <= 100:
        return F.max(F.lit(0.0))
    return F.coalesce(F.percentile(value, F.lit(p / 100)), F.lit(0.0))


#: Functions of the query text.
REGISTRY: dict[str, Aggregate] = {"sum": agg_sum, "avg": agg_avg, "max": agg_max, "min": agg_min, "delta": agg_delta, "count": agg_count, "rate": agg_rate}
#: The library's, offered to the query text only on request.
EXTRA: dict[str, Aggregate] = {"stddev": agg_stddev, "variance": agg_variance, "first": agg_first, "last": agg_last, "median": lambda t, v, s: agg_percentile(v, 50)}
