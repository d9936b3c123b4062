import math

import pytest
from pyspark.sql import functions as F

from tidegrid.functions.aggregates import EXTRA, REGISTRY, agg_percentile
from tidegrid.lang import Kind, Matcher
from tidegrid.operators.rollup import coarsen, downsample, merge_rollups, point_average, query_rollup, reconstruct, select_resolution
from tidegrid.operators.select import dedup_last, select_samples
from tidegrid.plans.engine import Engine
from tidegrid.schema import SAMPLES, labels_text, series_key, series_text
from tidegrid.sources.line_protocol import parse_lines, to_lines
from tidegrid.sources.store import Store


def samples(spark, rows):
    """rows of (metric, labels, ts, value[, seq])"""
    full = [(r[0], r[1], r[2], float(r[3]), r[4] if len(r) > 4 else i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, "metric string, labels map<string,string>, ts long, value double, seq long")
    return df.withColumn("series_key", series_key(F.col("metric"), F.col("labels"))).select(*[f.name for f in SAMPLES.fields])


def one(spark, fn, rows):
    df = samples(spark, [("m", {}, t, v) for t, v in rows])
    return df.agg(fn(F.col("ts"), F.col("value"), F.col("seq")).alias("v")).first()[0]


AGG5 = [(1000 * i, 10 * i) for i in range(1, 6)]


@pytest.mark.parametrize(("name", "want"), [("sum", 150), ("avg", 30), ("max", 50), ("min", 10), ("delta", 40), ("count", 5), ("rate", 10)])
def test_functions(spark, name, want):
    assert one(spark, REGISTRY[name], AGG5) == want


@pytest.mark.parametrize("name", list(REGISTRY) + list(EXTRA))
def test_nothing_gives_zero(spark, name):
    assert one(spark, (REGISTRY | EXTRA)[name], [(0, 1)][:0]) == 0


def test_rate_and_delta_need_a_span(spark):
    assert one(spark, REGISTRY["rate"], [(5, 1)]) == 0
    assert one(spark, REGISTRY["rate"], [(5, 1), (5, 9)]) == 0
    assert one(spark, REGISTRY["delta"], [(5, 1)]) == 0
    assert one(spark, REGISTRY["rate"], [(1000, 100), (5000, 60)]) == -10


def test_nan_counts_only_first(spark):
    nan = float("nan")
    assert math.isnan(one(spark, REGISTRY["max"], [(1, nan), (2, 3)]))
    assert one(spark, REGISTRY["max"], [(1, 2), (2, nan), (3, 1)]) == 2
    assert one(spark, REGISTRY["min"], [(1, 2), (2, nan), (3, 1)]) == 1


def test_percentiles(spark):
    df = samples(spark, [("m", {}, i, 10 * (i + 1)) for i in range(10)])
    got = df.agg(*[agg_percentile(F.col("value"), p).alias(f"p{p}") for p in (0, 50, 100, 101)]).first()
    assert tuple(got) == (10, 55, 100, 0)


def test_texts_and_keys(spark):
    r = samples(spark, [("m", {"b": "2", "a": "1"}, 0, 0), ("m", {"a": '1", b="2'}, 0, 0), ("m", {}, 0, 0)])
    got = r.select(labels_text(F.col("labels")), series_text(F.col("metric"), F.col("labels")), "series_key").collect()
    assert got[0][0] == got[1][0] == '{a="1", b="2"}' and got[2][1] == "m{}"
    assert len({x[2] for x in got}) == 3


def test_range_is_inclusive_and_matchers_read_missing_as_empty(spark):
    df = samples(spark, [("r", {}, 1000 * i, 100 * i) for i in range(1, 6)] + [("r", {"l": "x\n"}, 3000, 1)])
    assert select_samples(df, (), "r", 2000, 4000).count() == 4
    count = lambda *m: select_samples(df, m).count()
    assert count(Matcher(Kind.EQ, "l", "")) == 5
    assert count(Matcher(Kind.NE, "l", "y")) == 6
    assert count(Matcher(Kind.RE, "l", "x")) == 0
    assert count(Matcher(Kind.NRE, "l", "x")) == 6
    assert count(Matcher(Kind.RE, "l", ".*")) == 5


def test_filters_reach_the_scan(spark, tmp_path):
    samples(spark, [("r", {}, 1, 1)]).write.parquet(str(tmp_path / "s"))
    e = Engine(spark.read.parquet(str(tmp_path / "s")))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = e.range("sum(r)", 0, 9, shape="vector").df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(metric,r)" in plan and "LessThanOrEqual(ts,9)" in plan


def test_last_write_wins_whatever_the_order(spark):
    df = samples(spark, [("m", {"a": "1"}, 5, 1, 3), ("m", {"a": "1"}, 5, 2, 7), ("m", {"a": "1"}, 5, 3, 1), ("m", {}, 5, 4, 0)])
    once = dedup_last(df)
    assert sorted(r.value for r in once.collect()) == [2, 4]
    assert sorted(map(str, dedup_last(once).collect())) == sorted(map(str, once.collect()))


def test_shape_follows_the_number_of_series(spark):
    e = Engine(samples(spark, [("m", {"h": "1"}, 1000, 4), ("m", {"h": "1"}, 2000, 6), ("m", {"h": "2"}, 1500, 1)]))
    assert e.range("sum(none)", 0, 9999).to_dict()["Scalar"] == {"Value": 0}
    assert e.range('sum(m{h="1"})', 0, 9999).to_dict()["Scalar"] == {"Value": 10}
    v = e.range("sum(m)", 0, 9999)
    assert v.kind == "vector" and [(r.ts, r.value) for r in v.df.collect()] == [(2000, 10), (1500, 1)]
    m = e.range("m", 0, 9999).to_dict()
    assert m["Type"] == 2 and len(m["Matrix"]) == 2 and m["Scalar"] is None
    assert e.instant("count(m)", 301_500).kind == "vector" and e.instant("count(m)", 301_600).df.first()[0] == 1
    assert e.range("none", 0, 1).to_dict()["Matrix"] is None


def test_instant_window_and_options(spark):
    df = samples(spark, [("m", {}, 0, 1), ("m", {}, 3_600_000, 2)])
    assert Engine(df).instant("count(m[2h])", 3_600_000).df.first()[0] == 1
    assert Engine(df, honor_range=True).instant("count(m[2h])", 3_600_000).df.first()[0] == 2
    assert Engine(df, extra_functions=True).range("last(m)", 0, 10**7).df.first()[0] == 2
    grid = Engine(df).range("count(m[1h])", 0, 7_200_000, 3_600_000, grid=True).df.collect()
    assert [(r.ts, r.value) for r in grid] == [(0, 1), (3_600_000, 2), (7_200_000, 1)]


def test_infinite_results_are_text(spark):
    r = Engine(samples(spark, [("m", {}, 1, float("inf"))])).range("sum(m)", 0, 9).to_dict()
    assert r["Scalar"] == {"Value": "inf"}


def test_metadata(spark):
    e = Engine(samples(spark, [("m", {"a": "1"}, 1, 1), ("n", {"a": "2", "b": "x"}, 2, 1)]))
    assert [r[0] for r in e.label_names().collect()] == ["a", "b"]
    assert [r[0] for r in e.label_values("a").collect()] == ["1", "2"]
    assert tuple(e.status().first()) == (2, 2, 1, 2)
    assert e.series_matching(["m", "m"], 0, 9).count() == 2
    assert e.series_matching(["m", "m"], 0, 9, distinct=True).first()[0] == {"__name__": "m", "a": "1"}


def test_rollups(spark):
    df = samples(spark, [("m", {}, 1000 * i, i) for i in range(300)])
    r = downsample(df, ["1m"]).orderBy("ts").collect()
    assert len(r) == 5 and (r[0]["count"], r[0]["min"], r[0]["max"], r[0]["first"], r[0]["last"]) == (60, 0, 59, 0, 59)
    df = samples(spark, [("m", {}, 60_000 * i, i) for i in range(120)])
    all_of = downsample(df)
    assert {x.resolution: x["count"] for x in all_of.groupBy("resolution").count().collect()} == {"1m": 120, "5m": 24, "1h": 2}
    key = ["ts", "min", "max", "sum", "count", "first", "last"]
    a = coarsen(all_of.where("resolution = '1m'"), "1h").select(*key).orderBy("ts").collect()
    assert a == all_of.where("resolution = '1h'").select(*key).orderBy("ts").collect()
    assert downsample(df.limit(0)).count() == 0
    neg = downsample(samples(spark, [("m", {}, -1, 1), ("m", {}, 1, 2)]), ["1m"]).collect()
    assert [(x.ts, x["count"]) for x in neg] == [(0, 2)]


def points(spark, rows):
    return spark.createDataFrame([("1m", "m", {}, "k", t, float(a), float(b), float(s), n, float(a), float(b)) for t, a, b, s, n in rows], "resolution string, metric string, labels map<string,string>, series_key string, ts long, min double, max double, sum double, count long, first double, last double")


def test_merge_and_reconstruct(spark):
    a, b = points(spark, [(0, 10, 20, 100, 10), (60000, 15, 25, 200, 10)]), points(spark, [(60000, 12, 28, 150, 8), (120000, 20, 30, 250, 10)])
    m = merge_rollups(a, b).orderBy("ts").collect()
    assert len(m) == 3 and tuple(m[1])[5:] == (12, 28, 350, 18, 15, 28)
    r = points(spark, [(0, 5, 15, 100, 10), (60000, 0, 0, 0, 0)])
    assert [x.value for x in reconstruct(r).orderBy("ts").collect()] == [10, 0]
    assert [x.value for x in reconstruct(r, "last").orderBy("ts").collect()] == [15, 0]
    assert r.select(point_average().alias("v")).first()[0] == 10
    q = Engine(samples(spark, [])).parse("m", 99_999)
    twice = query_rollup(a.unionByName(a), q.over(0, 99_999), "1m").orderBy("ts").collect()
    assert [x["count"] for x in twice] == [20, 20]


@pytest.mark.parametrize(("hours", "want"), [(0.5, None), (2, "1m"), (12, "5m"), (48, "1h")])
def test_resolution_choice(hours, want):
    assert select_resolution(0, int(hours * 3_600_000)) == want


def test_rollup_answers_long_averages(spark):
    df = samples(spark, [("m", {}, 600_000 * i, i) for i in range(300)])
    plain, rolled = Engine(df), Engine(df, downsample(df), use_rollups=True)
    assert plain.range("avg(m)", 0, 10**9).df.first()[0] == pytest.approx(rolled.range("avg(m)", 0, 10**9).df.first()[0])


def test_lines(spark):
    text = ["cpu,host=a,flag,host=b,x=1=2 value=45.5 1000", "  # note", "", "m 1e2", "m value=-inf 5", "m nan 2000000000000000000 rest", ",a=b 3 7", "m 7 8"]
    got = parse_lines(spark.createDataFrame([(t,) for t in text], "value string"), 42).collect()
    by = [(r.metric, r.labels, r.ts, r.value) for r in got]
    assert by[0] == ("cpu", {"host": "b", "x": "1=2"}, 1000, 45.5)
    assert by[1] == ("m", {}, 42, 100) and by[2][3] == -math.inf
    assert by[3][2] == 2_000_000_000_000 and math.isnan(by[3][3])
    assert by[4][:3] == ("", {"a": "b"}, 7) and by[5][2:] == (8, 7)


def test_bad_lines(spark):
    df = spark.createDataFrame([("m",), ("m 1d 5",), ("m 1e999 5",), ("m 1 1.5",), ("m 1 99999999999999999999",), ("m 1 5",)], "value string")
    errors = [r.error for r in parse_lines(df, 0, "quarantine").collect()]
    assert [e and e.split(":")[0] for e in errors] == ["invalid line protocol", "invalid value", "invalid value", "invalid timestamp", "invalid timestamp", None]
    with pytest.raises(Exception, match="invalid (line protocol|value|timestamp)"):
        parse_lines(df, 0).collect()


def test_lines_there_and_back(spark):
    df = samples(spark, [("m", {"a": "1", "b": "x"}, i, i / 3) for i in range(20)])
    back = parse_lines(to_lines(df), 0, seq="seq")
    assert sorted(map(str, back.select(*df.columns).collect())) == sorted(map(str, df.collect()))


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "t"))
    assert s.scan().count() == 0
    rows = [("http", {"method": "GET"}, 1000 + 100 * i, i) for i in range(100)]
    s.append(samples(spark, rows))
    s.append(samples(spark, [("http", {"method": "GET"}, 1000, 5.5, 10_000), ("neg", {}, -1, 1, 1)]))
    before = sorted(map(str, dedup_last(s.scan()).collect()))
    assert len(before) == 101 and s.scan(1000, 1200).count() == 4
    s.compact()
    s.compact()
    assert sorted(map(str, s.scan().select("metric", "labels", "series_key", "ts", "value", "seq").collect())) == sorted(map(str, dedup_last(s.scan()).select("metric", "labels", "series_key", "ts", "value", "seq").collect()))
    assert sorted(map(str, dedup_last(s.scan()).collect())) == before
    m = s.manifest().collect()
    assert sum(r.num_samples for r in m) == 101 and min(r.min_time for r in m) == -1
