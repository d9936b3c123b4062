import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.llm.floatkeys import from_key, to_key
from tidegrid.llm.percentiles import histogram_percentiles, merge_histograms, radix_histogram, radix_percentiles

INF, NAN = float("inf"), float("nan")


def test_float_keys(spark):
    rng = random.Random(1)
    xs = [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(4000)]
    xs += [0.0, -0.0, INF, -INF, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, *[2.0**e for e in range(-1074, 1024, 7)], *[np.nextafter(2.0**e, s) for e in range(-1000, 1023, 31) for s in (0, INF)]]
    xs = [float(x) for x in xs if not math.isnan(x)]
    df = spark.createDataFrame([(x,) for x in xs], "x double").withColumn("k", to_key(F.col("x"))).withColumn("y", from_key(F.col("k")))
    got = df.collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.x)))[0]
        assert r.k == (-bits if r.x < 0 else bits), r
        assert r.y == r.x
    assert spark.createDataFrame([(NAN,), (None,)], "x double").where(to_key(F.col("x")).isNotNull()).count() == 0


def test_percentiles(spark):
    rng = np.random.default_rng(7)
    data = {"a": rng.normal(0, 1e3, 3001), "b": np.repeat(5.0, 40), "c": np.array([-INF, 1.0, INF]), None: np.exp(rng.normal(0, 9, 500))}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("a", None), ("a", NAN), ("only nan", NAN)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "g string, x double, n int")
    got = {(r.g, r.p): r for r in radix_percentiles(df, ["g"], "x", [0.0, 0.5, 0.9, 1.0]).collect()}
    assert len(got) == 4 * 4
    for (g, p), r in got.items():
        v = np.sort(data[g])
        pos = p * (len(v) - 1)
        assert (r.n, r.lower, r.upper) == (len(v), v[math.floor(pos)], v[math.ceil(pos)])
        if np.isfinite(v).all():
            assert r.value == pytest.approx(np.quantile(v, p), rel=1e-12)
    assert radix_percentiles(df.limit(0), ["g"], "x", [0.5]).count() == 0


def test_histograms_of_parts_combine(spark):
    rng = np.random.default_rng(8)
    v = np.exp(rng.normal(0, 3, 4000)) * rng.choice([-1, 1], 4000)
    df = spark.createDataFrame([("g", float(x), i % 3) for i, x in enumerate(v)], "g string, x double, day int")
    parts = [radix_histogram(df.where(F.col("day") == d), ["g"], "x") for d in range(3)]
    for r in histogram_percentiles(merge_histograms(parts, ["g"]), ["g"], [0.1, 0.5, 0.99]).collect():
        exact = np.sort(v)[math.ceil(r.p * len(v)) - 1]
        assert abs(r.value - exact) <= abs(exact) * 2.0**-12


def test_scopes_come_from_the_same_counts(spark):
    rng = np.random.default_rng(9)
    rows = [(rng.choice(["a", "b"]), rng.choice(["x", "y", None]), float(v)) for v in np.round(rng.normal(0, 50, 900), 1)]
    rows += [("a", "x", 7.0)] * 600
    df = spark.createDataFrame([(str(a), None if b is None else str(b), v) for a, b, v in rows], "m string, r string, v double")
    got = radix_percentiles(df, ["m", "r"], "v", [0.25, 0.9], scopes={"all": [], "m": ["m"], "both": ["m", "r"]}).collect()
    assert len(got) == 2 * (1 + 2 + 6)
    for x in got:
        v = np.sort([v for m, r, v in rows if x.scope == "all" or (m == x.m and (x.scope == "m" or r == x.r))])
        pos = x.p * (len(v) - 1)
        assert (x.n, x.lower, x.upper) == (len(v), v[math.floor(pos)], v[math.ceil(pos)])
