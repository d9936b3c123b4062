"""The writers, streams, service and texts of the engine as queries, each with its SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.api import Service
from tidegrid.functions.aggregates import REGISTRY
from tidegrid.lang import Kind, Matcher, QueryError, parse, parse_duration, parse_time, selector_text
from tidegrid.operators.rollup import coarsen, downsample, merge_rollups, rebuild_rollups, select_resolution
from tidegrid.operators.select import dedup_last, select_samples
from tidegrid.plans.engine import Engine
from tidegrid.session import shared_dir
from tidegrid.sources.adapters import events, samples
from tidegrid.sources.line_protocol import to_lines
from tidegrid.sources.store import Store
from tidegrid.streaming.ingest import ingest_lines, read_rejected, read_rollups, rollup_stream

Queries = dict[str, Callable[[SparkSession, str], DataFrame]]

def _region() -> Column:
    return F.coalesce(F.col("labels")["region"], F.lit("")).alias("region")


def _dirty(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("metric", F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("labels"), *columns)


def _matched(*matchers: Matcher) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: select_samples(samples(spark, sf), matchers).select("metric", _region(), "ts", "value", "seq")


def _dirty_function(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = dedup_last(samples(spark, sf)).groupBy("metric", "labels", "series_key")
        return _dirty(e.agg(REGISTRY[name](F.col("ts"), F.col("value"), F.col("seq")).alias("value")), "value")

    return run


def _filled(spark: SparkSession, sf: str, parts: int) -> Store:
    """A store that the samples reached in ``parts`` appends, each a part of all series and times."""
    store = Store(spark, shared_dir(spark, "store"))
    for i in range(parts):
        store.append(samples(spark, sf).where(F.pmod("seq", F.lit(parts)) == i), f"part-{i}")
    return store


def _store_scan(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled(spark, sf, 3)
    top = 1_741_500_000_000
    return _dirty(store.scan(top - 7 * 86_400_000, top), "ts", "value", "seq")


def _store_compacted(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled(spark, sf, 4)
    store.cycle()
    store.append(samples(spark, sf), "again")
    store.compact()
    return _dirty(store.scan(), "ts", "value")


def _store_levels(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled(spark, sf, 7)
    rows = []
    for turn in range(3):
        store.cycle()
        rows += [(turn, e["level"], len(e["replaces"])) for e in store.live().values()]
    return spark.createDataFrame(rows, "turn int, level int, merged int").groupBy("turn", "level", "merged").agg(F.count(F.lit(1)).alias("commits"))


def _store_manifest(spark: SparkSession, sf: str) -> DataFrame:
    store = _filled(spark, sf, 2)
    store.compact()
    m = store.manifest()
    return m.agg(F.sum("num_samples").alias("num_samples"), F.min("min_time").alias("min_time"), F.max("max_time").alias("max_time"), F.min((F.col("num_series") > 0) & (F.col("bytes") > 0)).alias("filled"))


def _stream_lines(spark: SparkSession, sf: str, bad: bool) -> str:
    root = shared_dir(spark, "stream")
    lines = to_lines(events(spark, sf)).select("value")
    if bad:
        lines = lines.unionByName(spark.read.parquet(f"{sf}/nation.parquet").select(F.concat(F.lit("broken-"), F.col("n_nationkey").cast("string")).alias("value")))
    lines.coalesce(1).write.text(f"{root}/in")
    ingest_lines(spark, f"{root}/in", f"{root}/db", f"{root}/ck", 0).awaitTermination()
    return root


def _ingested(spark: SparkSession, sf: str) -> DataFrame:
    return Store(spark, f"{_stream_lines(spark, sf, False)}/db").scan().select("metric", F.col("labels")["user_id"].alias("user_id"), "ts", "value")


def _rejected(spark: SparkSession, sf: str) -> DataFrame:
    return read_rejected(spark, f"{_stream_lines(spark, sf, True)}/db").select("line")


_POINT = ["resolution", "metric", "labels.user_id", "ts", "min", "max", "count", "first", "last"]


def _rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "rollups")
    rebuild_rollups(events(spark, sf), path)
    return spark.read.parquet(path).select(*_POINT)


def _streamed_rollups(spark: SparkSession, sf: str) -> DataFrame:
    root = shared_dir(spark, "rollup-stream")
    store = Store(spark, f"{root}/db")
    for i in range(2):
        store.append(events(spark, sf).where(F.pmod("seq", F.lit(2)) == i))
        rollup_stream(spark, f"{root}/db", f"{root}/out", f"{root}/ck").awaitTermination()
    return read_rollups(spark, f"{root}/out").select(*_POINT)


def _coarsened(spark: SparkSession, sf: str) -> DataFrame:
    return coarsen(downsample(dedup_last(events(spark, sf)), ["5m"]), "1h").select(*_POINT)


def _merged_nan(spark: SparkSession, sf: str) -> DataFrame:
    nan = float("nan")
    rows = [("a", 1.0, 2.0, nan, nan), ("b", nan, nan, 1.0, 2.0), ("c", nan, nan, nan, nan), ("d", 3.0, 4.0, 1.0, 9.0)]
    df = spark.createDataFrame(rows, "name string, amin double, amax double, bmin double, bmax double")
    fixed = [F.lit("1m").alias("resolution"), F.col("name").alias("metric"), F.create_map(F.lit("n"), "name").alias("labels"), F.col("name").alias("series_key"), F.lit(0).cast("long").alias("ts")]
    rest = [F.lit(1.0).alias("sum"), F.lit(1).cast("long").alias("count"), F.lit(0.0).alias("first"), F.lit(0.0).alias("last")]
    a, b = (df.select(*fixed, F.col(f"{side}min").alias("min"), F.col(f"{side}max").alias("max"), *rest) for side in "ab")
    return merge_rollups(a, b).select(F.col("metric").alias("name"), "min", "max")


def _executed(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(events(spark, sf)).execute("count(view[36h])", 1_705_708_800_000, shape="vector").df.select("metric", F.col("labels")["user_id"].alias("user_id"), "value")


def _series_of(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(samples(spark, sf)).series((Matcher(Kind.RE, "region", ".+"),)).select("metric", _region()).distinct()


def _label_names(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(samples(spark, sf)).label_names()


def _status(spark: SparkSession, sf: str) -> DataFrame:
    return Engine(samples(spark, sf)).status()


def _texts(rows: list[tuple[str, object]]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: spark.createDataFrame([(a, str(b)) for a, b in rows], "text string, result string")


def _tried(f: Callable[[str], object], texts: list[str]) -> list[tuple[str, object]]:
    out = []
    for t in texts:
        try:
            out.append((t, f(t)))
        except QueryError:
            out.append((t, "error"))
    return out


def _query(text: str) -> str:
    q = parse(text, 1_000_000_000)
    return f"{q.function} {q} {q.start} {q.end}"


def _routes(spark: SparkSession, sf: str) -> DataFrame:
    """What the routes answer, as JSON, after two writes of lines."""
    s = Service(spark, shared_dir(spark, "service"), clock=lambda: 400_000)
    s.write("tank,site=a value=1 100000\n# note\ntank,site=a 3 200000\ntank,site=b 5 200000\n")
    s.write("tank,site=a 4 200000")
    answers = {
        "query": s.query("sum(tank{site=\"a\"})", "300"), "instant": s.query("count(tank)", None), "range": s.query_range("max(tank)", "0", "300", "60"), "series": sorted(s.series(["tank"], "0", "300"), key=str),
        "labels": s.labels(), "values": s.label_values("site"), "status": {k: v for k, v in s.status().items() if k != "numBlocks"},
    }
    s.compact()
    s.downsample()
    answers["compacted"] = s.query("sum(tank{site=\"a\"})", "300")
    answers["rollups"] = spark.read.parquet(s.rollups).count()
    return spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in answers.items()], "route string, answer string")


TIMES = ["0", "1700000000", "32503679999", "32503680000", "-5", "2024-01-10T00:00:00Z", "2024-01-10T02:30:00.250+02:30", "1.5", "", "1_0", "2024-02-30T00:00:00Z"]
DURATIONS = ["60", "0.25", "1h30m", "500ms", "-2s", "1.5h", "90us", "x", "", "1_0"]
QUERIES = ["tank", "SUM( tank )", 'rate(tank{site="a", n!="2"}[10m])', 'tank{site=~"a.*",n!~"x"}[2h]', "sum(tank[1d])", "median(tank)", 'tank{site="a"', "", 'tank{site=~"("}']
SPANS = [0, 3_599_999, 3_600_000, 21_599_999, 21_600_000, 86_399_999, 86_400_000]


def queries() -> Queries:
    out: Queries = {
        "dirty_last_write": lambda spark, sf: _dirty(dedup_last(samples(spark, sf)), "ts", "value", "seq"),
        "dirty_match_empty": _matched(Matcher(Kind.EQ, "region", "")),
        "dirty_match_some": _matched(Matcher(Kind.RE, "region", ".+")),
        "dirty_match_not": _matched(Matcher(Kind.NE, "region", ""), Matcher(Kind.NRE, "job", "gate.*")),
        "dirty_status": _status,
        "dirty_label_names": _label_names,
        "dirty_series": _series_of,
        "dirty_rollup_count": lambda spark, sf: _dirty(downsample(dedup_last(samples(spark, sf)), ["1h"]), "ts", "count", "min", "max"),
        "store_scan": _store_scan,
        "store_compacted": _store_compacted,
        "store_levels": _store_levels,
        "store_manifest": _store_manifest,
        "stream_ingest": _ingested,
        "stream_rejected": _rejected,
        "stream_rollups": _streamed_rollups,
        "rollups_rebuilt": _rebuilt,
        "rollups_coarsened": _coarsened,
        "rollups_merged_nan": _merged_nan,
        "execute_own_range": _executed,
        "text_times": _texts(_tried(parse_time, TIMES)),
        "text_durations": _texts(_tried(parse_duration, DURATIONS)),
        "text_queries": _texts(_tried(_query, QUERIES)),
        "text_selector": _texts([("two", selector_text("m", (Matcher(Kind.EQ, "a", "1"), Matcher(Kind.NRE, "b", "x.*")))), ("none", selector_text("m", ()))]),
        "text_resolution": _texts([(str(s), select_resolution(0, s)) for s in SPANS]),
        "service_routes": _routes,
    }
    return out | {f"dirty_fn_{n}": _dirty_function(n) for n in ("max", "min", "count", "delta")}


_S = """s AS (SELECT metric, labels['region'] AS region, labels['job'] AS job, coalesce(array_to_string(list_sort(list_transform(map_entries(labels), lambda e: concat(e.key, '=', e.value))), ','), '') AS labels, ts, value, seq FROM samples WHERE value IS NOT NULL),
c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY metric, labels, ts ORDER BY seq DESC) AS rn FROM s) WHERE rn = 1)"""
_EV = "ev AS (SELECT event_type AS metric, CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS ts, value, event_id AS seq FROM events)"
_FIRST = "arg_min(value, ts)"


def _points(name: str, ms: int) -> str:
    return f"SELECT '{name}' AS resolution, metric, user_id, ts - ts % {ms} AS ts, min(value) AS min, max(value) AS max, count(*) AS count, arg_min(value, (ts, seq)) AS first, arg_max(value, (ts, seq)) AS last FROM ev GROUP BY metric, user_id, ts - ts % {ms}"


def _values(rows: list[tuple[str, str]], columns: str = "text, result") -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows) + f") AS t({columns})"


def _extreme(f: str) -> str:
    return f"coalesce(CASE WHEN isnan({_FIRST}) THEN {_FIRST} ELSE {f}(value) FILTER (WHERE NOT isnan(value)) END, 0)"


def oracle_sql() -> dict[str, str]:
    rolled = " UNION ALL ".join(_points(k, v) for k, v in (("1m", 60_000), ("5m", 300_000), ("1h", 3_600_000)))
    fn = {"max": _extreme("max"), "min": _extreme("min"), "count": "CAST(count(*) AS DOUBLE)", "delta": "CASE WHEN count(*) < 2 THEN 0 ELSE arg_max(value, ts) - arg_min(value, ts) END"}
    matched = "SELECT metric, coalesce(region, '') AS region, ts, value, seq FROM s WHERE "
    vector = '{"Matrix": null, "Scalar": null, "Type": 1, "Vector": [{"Sample": {"Timestamp": 200000, "Value": %s}, "Series": {"Labels": {"site": "a"}, "Name": "tank"}}, {"Sample": {"Timestamp": 200000, "Value": %s}, "Series": {"Labels": {"site": "b"}, "Name": "tank"}}]}'
    scalar = '{"Matrix": null, "Scalar": {"Value": 5.0}, "Type": 0, "Vector": null}'
    return {
        **{f"dirty_fn_{k}": f"WITH {_S} SELECT metric, labels, {v} AS value FROM c GROUP BY metric, labels" for k, v in fn.items()},
        "dirty_last_write": f"WITH {_S} SELECT metric, labels, ts, value, seq FROM c",
        "dirty_match_empty": f"WITH {_S} {matched} coalesce(region, '') = ''",
        "dirty_match_some": f"WITH {_S} {matched} length(coalesce(region, '')) > 0",
        "dirty_match_not": f"WITH {_S} {matched} region <> '' AND NOT starts_with(coalesce(job, ''), 'gate')",
        "dirty_status": f"WITH {_S} SELECT count(DISTINCT (metric, labels)) AS num_series, count(*) AS total_samples, min(ts) AS min_time, max(ts) AS max_time FROM c",
        "dirty_label_names": "SELECT DISTINCT unnest(map_keys(labels)) AS name FROM samples WHERE value IS NOT NULL",
        "dirty_series": f"WITH {_S} SELECT DISTINCT metric, region FROM s WHERE region <> ''",
        "dirty_rollup_count": f"WITH {_S} SELECT metric, labels, ts - ts % 3600000 AS ts, count(*) AS count, {_extreme('min')} AS min, {_extreme('max')} AS max FROM c GROUP BY metric, labels, ts - ts % 3600000",
        "store_scan": f"WITH {_S} SELECT metric, labels, ts, value, seq FROM s WHERE ts BETWEEN 1741500000000 - 7 * 86400000 AND 1741500000000",
        "store_compacted": f"WITH {_S} SELECT metric, labels, ts, value FROM c",
        "store_levels": "SELECT CAST(turn AS INT) AS turn, CAST(level AS INT) AS level, CAST(merged AS INT) AS merged, CAST(commits AS BIGINT) AS commits FROM (VALUES (0, 0, 0, 4), (0, 1, 3, 1), (1, 0, 0, 1), (1, 1, 3, 2), (2, 0, 0, 1), (2, 1, 3, 2)) AS t(turn, level, merged, commits)",
        "store_manifest": f"WITH {_S} SELECT count(*) AS num_samples, min(ts) AS min_time, max(ts) AS max_time, TRUE AS filled FROM c",
        "stream_ingest": f"WITH {_EV} SELECT metric, user_id, ts, value FROM ev",
        "stream_rejected": "SELECT concat('broken-', n_nationkey) AS line FROM nation",
        "stream_rollups": f"WITH {_EV} {rolled}",
        "rollups_rebuilt": f"WITH {_EV} {rolled}",
        "rollups_coarsened": f"WITH {_EV} {_points('1h', 3_600_000)}",
        "rollups_merged_nan": "SELECT name, min, max FROM (VALUES ('a', 1.0::DOUBLE, 2.0::DOUBLE), ('b', 1.0, 2.0), ('c', 'nan'::DOUBLE, 'nan'::DOUBLE), ('d', 1.0, 9.0)) AS t(name, min, max)",
        "execute_own_range": f"WITH {_EV} SELECT metric, user_id, CAST(count(*) AS DOUBLE) AS value FROM ev WHERE metric = 'view' AND ts BETWEEN 1705708800000 - 129600000 AND 1705708800000 GROUP BY metric, user_id",
        "text_times": _values(list(zip(TIMES, ["0", "1700000000000", "32503679999000", "32503680000", "-5000", "1704844800000", "1704844800250", "error", "error", "error", "error"]))),
        "text_durations": _values(list(zip(DURATIONS, ["60000", "250", "5400000", "500", "-2000", "5400000", "0", "error", "error", "error"]))),
        "text_queries": _values(list(zip(QUERIES, ["None tank 999700000 1000000000", "sum tank 999700000 1000000000", 'rate tank{site="a", n!="2"} 999400000 1000000000', 'None tank{site=~"a.*", n!~"x"} 992800000 1000000000', "sum tank 913600000 1000000000", "error", "error", "error", "error"]))),
        "text_selector": _values([("two", 'm{a="1", b!~"x.*"}'), ("none", "m")]),
        "text_resolution": _values(list(zip(map(str, SPANS), ["None", "None", "1m", "1m", "5m", "5m", "1h"]))),
        "service_routes": _values([
            ("query", scalar), ("instant", vector % ("2.0", "1.0")), ("range", vector % ("4.0", "5.0")), ("series", '[{"__name__": "tank", "site": "a"}, {"__name__": "tank", "site": "b"}]'), ("labels", '["site"]'), ("values", '["a", "b"]'),
            ("status", '{"maxTime": 200000, "minTime": 100000, "numSeries": 2, "totalSamples": 3}'), ("compacted", scalar), ("rollups", "7"),
        ], "route, answer"),
    }
