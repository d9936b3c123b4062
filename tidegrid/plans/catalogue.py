"""The engine's own operators as queries over the fixture tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import EXTRA, REGISTRY, agg_percentile
from tidegrid.lang import Kind, Matcher
from tidegrid.operators.rollup import downsample, merge_rollups, query_rollup, reconstruct
from tidegrid.operators.select import dedup_last, select_by_catalogue, select_samples, series_catalogue, unify
from tidegrid.plans.engine import Engine
from tidegrid.sources.adapters import events, lineitem, orders
from tidegrid.sources.line_protocol import parse_lines, to_lines

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]

# 2024-01-10 00:00:00 to 2024-01-20 00:00:00 UTC.
START, END = 1_704_844_800_000, 1_705_708_800_000
#: A moment with several clicks in the five minutes before it.
BUSY = 1_704_737_100_000
#: A time inside the hour, so that parts split there share a bucket.
CUT = 1_705_318_234_567
_USER = "labels.user_id"


def _flat(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("metric", _USER, *columns)


def _matched(*matchers: Matcher, metric: str | None = "click") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: _flat(select_samples(events(spark, sf), matchers, metric), "ts", "value")


def _function(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = dedup_last(events(spark, sf))
        fn = (REGISTRY | EXTRA)[name]
        v = e.groupBy("metric", "labels", "series_key").agg(F.max("ts").alias("ts"), fn(F.col("ts"), F.col("value"), F.col("seq")).alias("value"))
        return _flat(v, "ts", F.round("value", 8 if name == "variance" else 6).alias("value") if name not in ("first", "last", "max", "min", "count") else "value")

    return run


def _percentile(spark: SparkSession, sf: str) -> DataFrame:
    v = dedup_last(events(spark, sf)).groupBy("metric", "labels").agg(F.round(agg_percentile(F.col("value"), 90), 5).alias("value"))
    return _flat(v, "value")


def _line_statistics(spark: SparkSession, sf: str) -> DataFrame:
    t, v, s = F.col("ts"), F.col("value"), F.col("seq")
    g = lineitem(spark, sf).groupBy("labels").agg(*[F.round((REGISTRY | EXTRA)[f](t, v, s), d).alias(f) for f, d in (("sum", 1), ("avg", 3), ("max", 2), ("min", 2), ("count", 0), ("stddev", 3))])
    return g.select(F.col("labels")["returnflag"].alias("returnflag"), F.col("labels")["linestatus"].alias("linestatus"), "sum", "avg", "max", "min", "count", "stddev")


def _points(df: DataFrame) -> DataFrame:
    return df.select("resolution", "metric", _USER, "ts", "min", "max", F.round("sum", 5).alias("sum"), "count", "first", "last")


def _rolled(*resolutions: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: _points(downsample(dedup_last(events(spark, sf)), resolutions))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    e = dedup_last(events(spark, sf))
    return _points(merge_rollups(downsample(e.where(F.col("ts") < CUT), ["1h"]), downsample(e.where(F.col("ts") >= CUT), ["1h"])))


def _reconstructed(use: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: _flat(reconstruct(downsample(dedup_last(events(spark, sf)), ["1h"]), use), "ts", F.round("value", 5).alias("value"))


def _rollup_query(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(events(spark, sf))
    q = engine.parse("avg(click)", END).over(START + 1_234_567, END)
    return _points(query_rollup(downsample(dedup_last(events(spark, sf)), ["1h"]), q, "1h"))


def _orders(df: DataFrame) -> DataFrame:
    return df.select(F.col("labels")["status"].alias("status"), F.col("labels")["priority"].alias("priority"), "ts", "value")


def _hot_cold(spark: SparkSession, sf: str) -> DataFrame:
    o = orders(spark, sf)
    return _orders(unify(o.where("seq % 2 = 0"), o.where("seq % 2 = 1")))


def _range_vector(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(Engine(events(spark, sf)).range('avg(click{user_id=~"1.*"})', START, END, shape="vector").df, "ts", F.round("value", 6).alias("value"))


def _instant(spark: SparkSession, sf: str) -> DataFrame:
    engine = Engine(events(spark, sf), honor_range=True)
    return _flat(engine.instant("count(click[1d])", END, shape="vector").df, "ts", "value")


def _window(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(Engine(events(spark, sf)).instant("click", BUSY).df, "ts", "value")


def _matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(Engine(events(spark, sf)).range("click", START - 10 * 86_400_000, END + 20 * 86_400_000).df, "ts", "value")


def _stepped(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(Engine(events(spark, sf)).range("sum(click[1d])", START, END, 86_400_000, grid=True).df, "ts", F.round("value", 5).alias("value"))


def _by_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf)
    return _flat(select_by_catalogue(e, series_catalogue(e), [Matcher(Kind.RE, "user_id", "[0-4]+")], "view"), "ts", "value")


def _series(spark: SparkSession, sf: str) -> DataFrame:
    s = Engine(events(spark, sf)).series_matching(["click", "view"], START, END)
    return s.select(F.col("series")["__name__"].alias("metric"), F.col("series")["user_id"].alias("user_id"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(parse_lines(to_lines(events(spark, sf)), 0, seq="seq"), "ts", "value", "seq")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """``avg(click)`` over everything, from the query text."""
    return _flat(Engine(events(spark, sf)).range("avg(click)", 0, 1 << 42, shape="vector").df, "ts", "value")


def queries() -> Queries:
    out: Queries = {
        "scan_time_range": lambda spark, sf: _flat(select_samples(events(spark, sf), (), "click", START, END), "ts", "value"),
        "instant_window": _window,
        "instant_range": _instant,
        "range_vector": _range_vector,
        "range_stepped": _stepped,
        "match_eq": _matched(Matcher(Kind.EQ, "user_id", "7")),
        "match_neq": _matched(Matcher(Kind.NE, "user_id", "7")),
        "match_re": _matched(Matcher(Kind.RE, "user_id", "1[0-9]?")),
        "match_nre": _matched(Matcher(Kind.NRE, "user_id", "1.*")),
        "match_missing_empty": _matched(Matcher(Kind.EQ, "zone", "")),
        "match_missing_some": _matched(Matcher(Kind.RE, "zone", ".+")),
        "match_any_metric": _matched(Matcher(Kind.NE, "zone", "x"), Matcher(Kind.RE, "user_id", "2.|3."), metric=None),
        "select_by_catalogue": _by_catalogue,
        "dedup_last_write": lambda spark, sf: _orders(dedup_last(orders(spark, sf))),
        "union_hot_cold": _hot_cold,
        "fn_percentile": _percentile,
        "fn_lineitem": _line_statistics,
        "downsample_1m": _rolled("1m"),
        "downsample_5m": _rolled("5m"),
        "downsample_1h": _rolled("1h"),
        "downsample_all": _rolled("1m", "5m", "1h"),
        "merge_points": _merged,
        "reconstruct_avg": _reconstructed("avg"),
        "reconstruct_last": _reconstructed("last"),
        "rollup_query": _rollup_query,
        "matrix_sorted": _matrix,
        "series_list": _series,
        "label_names": lambda spark, sf: Engine(events(spark, sf)).label_names(),
        "label_values": lambda spark, sf: Engine(events(spark, sf)).label_values("user_id"),
        "status": lambda spark, sf: Engine(events(spark, sf)).status(),
        "line_protocol_roundtrip": _lines,
    }
    return out | {f"fn_{name}": _function(name) for name in ("sum", "avg", "max", "min", "count", "delta", "rate", "stddev", "variance", "first", "last")}


_EV = "ev AS (SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts, value, event_id AS seq FROM events)"
CLICK = "metric = 'click'"
_ALL = "SELECT metric, user_id, ts, value FROM ev"
_BY = "GROUP BY metric, user_id"
_POINT = "min(value) AS min, max(value) AS max, round(sum(value), 5) AS sum, count(*) AS count, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS last"


def _rollup_sql(name: str, ms: int, where: str = "TRUE") -> str:
    return f"SELECT '{name}' AS resolution, metric, user_id, ts - ts % {ms} AS ts, {_POINT} FROM ev WHERE {where} GROUP BY metric, user_id, ts - ts % {ms}"


def oracle_sql() -> dict[str, str]:
    ms = {"1m": 60_000, "5m": 300_000, "1h": 3_600_000}
    rolled = {f"downsample_{k}": f"WITH {_EV} {_rollup_sql(k, v)}" for k, v in ms.items()}
    value = {
        "sum": "round(sum(value), 6)", "avg": "round(avg(value), 6)", "max": "max(value)", "min": "min(value)", "count": "CAST(count(*) AS DOUBLE)",
        "delta": "round(CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(value, (ts, seq)) - arg_min(value, (ts, seq)) END, 6)",
        "rate": "round(CASE WHEN count(*) < 2 OR max(ts) = min(ts) THEN 0 ELSE (arg_max(value, (ts, seq)) - arg_min(value, (ts, seq))) / ((max(ts) - min(ts)) / 1000.0) END, 6)",
        "stddev": "round(stddev_pop(value), 6)", "variance": "round(var_pop(value), 8)", "first": "arg_min(value, (ts, seq))", "last": "arg_max(value, (ts, seq))",
    }
    functions = {f"fn_{k}": f"WITH {_EV} SELECT metric, user_id, max(ts) AS ts, {v} AS value FROM ev {_BY}" for k, v in value.items()}
    last = "SELECT o_orderstatus AS status, o_orderpriority AS priority, epoch_us(o_orderdate) // 1000 AS ts, arg_max(o_totalprice, o_orderkey) AS value FROM orders GROUP BY 1, 2, 3"
    match = lambda cond, metric="metric = 'click'": f"WITH {_EV} {_ALL} WHERE {metric} AND {cond}"
    hour = f"SELECT metric, user_id, ts - ts % 3600000 AS ts, {{}} AS value FROM ev GROUP BY metric, user_id, ts - ts % 3600000"
    return {
        **rolled,
        **functions,
        "downsample_all": f"WITH {_EV} " + " UNION ALL ".join(_rollup_sql(k, v) for k, v in ms.items()),
        "scan_time_range": match(f"ts BETWEEN {START} AND {END}"),
        "instant_window": match(f"ts BETWEEN {BUSY - 300_000} AND {BUSY}"),
        "instant_range": f"WITH {_EV} SELECT metric, user_id, max(ts) AS ts, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE metric = 'click' AND ts BETWEEN {END - 86_400_000} AND {END} {_BY}",
        "range_vector": f"WITH {_EV} SELECT metric, user_id, max(ts) AS ts, round(avg(value), 6) AS value FROM ev WHERE metric = 'click' AND regexp_full_match(user_id, '1.*') AND ts BETWEEN {START} AND {END} {_BY}",
        "range_stepped": f"WITH {_EV}, steps AS (SELECT unnest(generate_series({START}, {END}, 86400000)) AS stop) SELECT metric, user_id, stop AS ts, round(sum(value), 5) AS value FROM ev JOIN steps ON ts BETWEEN stop - 86400000 AND stop WHERE metric = 'click' GROUP BY metric, user_id, stop",
        "match_eq": match("user_id = '7'"),
        "match_neq": match("user_id <> '7'"),
        "match_re": match("regexp_full_match(user_id, '1[0-9]?')"),
        "match_nre": match("NOT regexp_full_match(user_id, '1.*')"),
        "match_missing_empty": match("TRUE"),
        "match_missing_some": match("FALSE"),
        "match_any_metric": match("regexp_full_match(user_id, '2.|3.')", "TRUE"),
        "select_by_catalogue": match("regexp_full_match(user_id, '[0-4]+')", "metric = 'view'"),
        "dedup_last_write": last,
        "union_hot_cold": last,
        "fn_percentile": f"WITH {_EV} SELECT metric, user_id, round(quantile_cont(value, 0.9), 5) AS value FROM ev {_BY}",
        "fn_lineitem": "SELECT l_returnflag AS returnflag, l_linestatus AS linestatus, round(sum(l_extendedprice), 1) AS sum, round(avg(l_extendedprice), 3) AS avg, round(max(l_extendedprice), 2) AS max, round(min(l_extendedprice), 2) AS min, CAST(count(*) AS DOUBLE) AS count, round(stddev_pop(l_extendedprice), 3) AS stddev FROM lineitem GROUP BY 1, 2",
        "merge_points": f"WITH {_EV} {_rollup_sql('1h', 3_600_000)}",
        "reconstruct_avg": f"WITH {_EV} " + hour.format("round(sum(value) / count(*), 5)"),
        "reconstruct_last": f"WITH {_EV} " + hour.format("round(arg_max(value, (ts, seq)), 5)"),
        "rollup_query": f"WITH {_EV}, r AS ({_rollup_sql('1h', 3_600_000, CLICK)}) SELECT * FROM r WHERE ts BETWEEN {START + 1_234_567} AND {END}",
        "matrix_sorted": match("TRUE"),
        "series_list": f"WITH {_EV} SELECT DISTINCT metric, user_id FROM ev WHERE metric IN ('click', 'view') AND ts BETWEEN {START} AND {END}",
        "label_names": "SELECT 'user_id' AS name",
        "label_values": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM events",
        "status": f"WITH {_EV} SELECT count(DISTINCT (metric, user_id)) AS num_series, count(*) AS total_samples, min(ts) AS min_time, max(ts) AS max_time FROM ev",
        "line_protocol_roundtrip": f"WITH {_EV} SELECT metric, user_id, ts, value, seq FROM ev",
    }
