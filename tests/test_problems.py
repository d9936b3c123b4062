import math
import random
from datetime import date

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.functions.spelling import duration_ms, hex_number, resolution, series_hash
from tidegrid.operators.common import current_rows, lookup_join
from tidegrid.operators.compaction import Compaction
from tidegrid.operators.delivery import deduplicate, repeated_messages, sample_set, without_repeats
from tidegrid.operators.grid import regular_grid
from tidegrid.operators.intervals import IntervalMap, merge_intervals
from tidegrid.operators.outliers import implausible, judge, natural_range
from tidegrid.operators.trailing import trailing_totals
from tidegrid.session import shared_dir

INF, NAN = float("inf"), float("nan")
EPOCH = date(1970, 1, 1)


# -- helpers ----------------------------------------------------------------------------------------------


def test_spellings(spark):
    cases = {"00ffAA0000000001": "00ffaa0000000001", " 0xFF ": "00000000000000ff", "18446744073709551615": "f" * 16, "10000000000000000": "002386f26fc10000", "99999999999999999999": "99999999999999999999", "nope": "nope", "1234567890123456": "1234567890123456"}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert [r[0] for r in df.select(series_hash(F.col("h"))).collect()] == list(cases.values())
    df = spark.createDataFrame([(x,) for x in ("1H", "60m", "3600s", "1h0m0s", "5M", "60s", "7m", "", None)], "r string")
    assert [r[0] for r in df.select(resolution(F.col("r"))).collect()] == ["1h", "1h", "1h", "1h", "5m", "1m", "7m", "", None]
    assert [r[0] for r in df.select(duration_ms(F.col("r"))).collect()][-3:] == [420_000, None, None]
    df = spark.createDataFrame([(x,) for x in (" 0002a", "0x0002A", "0000-0002-a", "0", "", "--", None, "{2A}")], "x string")
    assert [r[0] for r in df.select(hex_number(F.col("x"))).collect()] == ["2a", "2a", "2a", "0", None, None, None, "2a"]


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.range(300).select((F.col("id") % 3).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    key = lambda df: sorted(map(str, df.select("k", "id", "v").collect()))
    for how in ("inner", "left"):
        assert key(lookup_join(big, small, ["k"], how, broadcast_rows=1, salts=4)) == key(lookup_join(big, small, ["k"], how))


# -- 1: grid ----------------------------------------------------------------------------------------------

CLASH = "k string, t long, v double, p long, _tile long, _n long, value string"


def brute_grid(rows, gap):
    out = {}
    by = {}
    for k, t, v, p in rows:
        if t is not None and p and p > 0:
            by.setdefault((k, p), []).append((t, v))
    for (k, p), r in by.items():
        periods = {}
        for t, v in r:
            periods.setdefault(t - t % p, []).append((t, -INF if v is None else v))
        last = None
        for at in range(min(periods), max(periods) + p, p):
            if at in periods:
                last = (at, max(periods[at])[1])
                last = (at, None if last[1] == -INF else last[1])
                out[k, p, at] = (len(periods[at]), last[1], "observed")
            else:
                near = at - last[0] <= gap * p
                out[k, p, at] = (0, last[1] if near else None, "filled" if near else "missing")
    return out


@pytest.mark.parametrize("tile", [1, 3, 1440])
def test_grid(spark, tile):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.randint(-500, 900), float(rng.randint(0, 9)), 10) for _ in range(60)]
    rows += [rows[0]] * 3 + [("a", None, 1.0, 10), ("a", 5, 1.0, None), ("a", 5, 1.0, 0), ("c", 7, 2.0, 5)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], CLASH)
    got = {(r.k, r.p, r.period_start): (r.n, r.value, r.status) for r in regular_grid(df, ["k"], "t", "v", "p", 3, tile).collect()}
    assert got == brute_grid(rows, 3)
    assert regular_grid(df.limit(0), ["k"], "t", "v", "p").count() == 0


def test_current_rows(spark):
    df = spark.createDataFrame([(1, 5, 1.0, 1), (1, 5, None, 3), (1, 6, NAN, None), (2, 5, 4.0, 1)], "k long, ts long, value double, seq long")
    got = {(r.k, r.ts): r.value for r in current_rows(df, ["k"]).collect()}
    # The last write of (1, 5) is the null one.
    assert got == {(1, 5): None, (1, 6): None, (2, 5): 4.0}


# -- 2: intervals -----------------------------------------------------------------------------------------

LO, HI = -(2**63), 2**63 - 1


def brute_intervals(rows):
    out = []
    by = {}
    for k, s, e in rows:
        if s is not None and e is not None and s <= e:
            by.setdefault(k, []).append((s, e))
    for k, r in by.items():
        merged = []
        for s, e in sorted(r):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out, key=str)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 60), st.integers(0, 9))))
def test_interval_map(pairs):
    m = IntervalMap()
    for s, n in pairs:
        m.insert(s, s + n)
    want = brute_intervals([("k", s, s + n) for s, n in pairs])
    assert sorted([("k", "period", *p) for p in m.periods()] + [("k", "gap", *g) for g in m.gaps()], key=str) == want


@pytest.mark.parametrize("tile", [3, 1000])
def test_merge_intervals(spark, tile):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.randint(-1, 12)) for s in (rng.randint(-100, 300) for _ in range(90))]
    rows += [("x", LO, LO), ("x", LO + 1, 5), ("x", HI, HI), ("x", 9, HI - 2), ("y", LO, HI), ("y", 1, 2), ("z", None, 3), ("z", 3, None), *[("h", 1, 4)] * 40, ("h", 5, 5), ("h", 7, 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "e string, s long, t long, kind int").repartition(3)
    got = sorted((tuple(r) for r in merge_intervals(df, "e", "s", "t", tile).collect()), key=str)
    assert got == brute_intervals(rows)
    assert merge_intervals(df.limit(0), "e", "s", "t").count() == 0


# -- 3: trailing totals -----------------------------------------------------------------------------------


@pytest.mark.parametrize(("tile", "block"), [(4, 2), (128, 256)])
def test_trailing(spark, tile, block):
    day = 86_400_000
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, None]), rng.randint(-9 * day, 60 * day), rng.choice([1.5, -2.25, 0.1, None, NAN, INF, 1e15])) for _ in range(80)] + [(7, None, 1.0)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "e long, t long, v double, n int")
    got = {(r.e, (r.day - EPOCH).days, r.trailing_days): (r.total, r.n) for r in trailing_totals(df, "e", "t", "v", (3, 7), tile, block).collect()}
    want = {}
    for e in (1, 2, None):
        days = {}
        for k, t, v in rows:
            if k == e and t is not None and v is not None and math.isfinite(v):
                days.setdefault(t // day, []).append(v)
        for d in range(min(days), max(days) + 1):
            for w in (3, 7):
                part = [v for x in range(d - w + 1, d + 1) for v in days.get(x, [])]
                want[e, d, w] = (math.fsum(part), len(part))
    assert got.keys() == want.keys()
    for k, (total, n) in want.items():
        assert got[k][1] == n and got[k][0] == pytest.approx(total, rel=1e-12, abs=1e-6)
    assert trailing_totals(df.limit(0), "e", "t", "v").count() == 0


# -- 4: delivery ------------------------------------------------------------------------------------------


def test_deduplicate(spark):
    df = spark.createDataFrame([(1, "a", 5, "x"), (2, "a", 4, "y"), (3, "a", 4, "z"), (4, None, 1, "u"), (5, None, None, "v")], "row long, id string, at long, _id0 string")
    got = {r.row for r in deduplicate(df, ["id"], "row", ["at"]).collect()}
    assert got == {2, 5}
    assert deduplicate(df.limit(0), ["id"], "row", ["at"]).count() == 0


def test_sample_sets(spark):
    sets = [[(1, 2.0), (3, 4.0)], [(3, 4.0), (1, 2.0), (1, 2.0)], [(1, 0.0)], [(1, -0.0)], [(1, NAN)], [(1, None)], [], None, [None]]
    df = spark.createDataFrame([(s,) for s in sets], "s array<struct<ts:long,value:double>>")
    f = [r[0] for r in df.select(sample_set(F.col("s"))).collect()]
    assert f[0] == f[1] and f[2] == f[3] and len(set(f)) == 7


def test_repeated_messages(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["p", "q", None]), rng.choice([None, "1", "2", "3"]), rng.choice([1, None]), rng.choice("ab")) for i in range(120)]
    rows += [(1000 + i, "hot", "9", 1, "h") for i in range(60)] + [(2000 + i, "beat", str(i), 1, "same") for i in range(40)] + [(1999, "beat", None, 1, "same"), (3000, "beat", None, 1, "same")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "row long, p string, m string, s int, c string, _row int")
    got = sorted(r[0] for r in repeated_messages(df, "row", "p", "m", ["s", "c"]).collect())
    want = [a[0] for a in rows if any(b[0] < a[0] and b[1] == a[1] and ((a[2] == b[2] and a[2] is not None) or ((a[2] is None or b[2] is None) and a[3:5] == b[3:5])) for b in rows)]
    assert got == sorted(want)


def test_whole_table_without_repeats(spark):
    rows = [(1, "p", None, "a"), (2, "p", None, "a"), (3, "p", "1", "a"), (4, "p", "2", "b"), (5, "p", "2", "c"), (6, "p", None, "b"), (7, "p", None, "d"), (8, None, None, "a"), (9, "q", "2", "b")]
    df = spark.createDataFrame(rows, "row long, p string, m string, c string")
    got = without_repeats(df, "row", "p", "m", ["c"])
    assert got.columns == df.columns and sorted(tuple(r) for r in got.collect()) == [rows[i] for i in (0, 3, 6, 7, 8)]
    assert without_repeats(df.limit(0), "row", "p", "m", ["c"]).count() == 0


# -- 5: compaction ----------------------------------------------------------------------------------------


def small_files(spark, n=60):
    rows = [(str(f), "p" if f % 2 else None, f"k{(f * 7 + i) % 50}", i % 3, f, float(f)) for f in range(n) for i in range(4)]
    records = spark.createDataFrame(rows, "file string, part string, k string, ts long, written long, v double")
    listing = spark.createDataFrame([(str(f), "p" if f % 2 else None, 100 * (1 + f % 9) if f != 3 else None) for f in range(n - 5)] + [("empty", "p", 0)], "file string, part string, bytes long")
    return rows, records, listing


def newest(rows):
    best = {}
    for f, _, k, ts, w, v in rows:
        best[k, ts] = max(best.get((k, ts), (-1, 0)), (w, v))
    return {k: v[1] for k, v in best.items()}


def contents(df):
    rows = [((r.k, r.ts), r.v) for r in df.collect()]
    assert len(rows) == len({k for k, _ in rows})
    return dict(rows)


def test_compaction(spark):
    rows, records, listing = small_files(spark)
    root = shared_dir(spark, "test")
    make = lambda: Compaction(records, listing, root, ["k", "ts"], ["written"], fan_in=8)
    job = make()
    assert contents(job.run()) == newest(rows)
    assert len(job.committed()) >= 2 and job.files().count() == 1
    before = job.committed()
    assert contents(make().run()) == newest(rows) and make().committed() == before


def test_compaction_keeps_records_of_a_null_file(spark):
    rows, records, listing = small_files(spark, 8)
    rows += [(None, None, f"lost{i}", 0, 99, 1.0) for i in range(5)] + [(None, "p", "k1", 1, 99, 2.0)]
    records = spark.createDataFrame(rows, records.schema)
    for files in (listing, listing.unionByName(spark.createDataFrame([(None, "p", 7), (None, None, None)], listing.schema))):
        root = shared_dir(spark, "nameless")
        make = lambda: Compaction(records, files, root, ["k", "ts"], ["written"], fan_in=8)  # noqa: E731, B023
        assert contents(make().run()) == newest(rows)
        before = make().committed()
        assert contents(make().run()) == newest(rows) and make().committed() == before


def test_later_files_cost_what_they_bring(spark):
    rows = [(str(f), f"k{f % 40}", f * 10 + i, f, float(f)) for f in range(400) for i in range(10)]
    schema = "file string, k string, ts long, written long, v double"
    make = lambda rows, root: Compaction(spark.createDataFrame(rows, schema), spark.createDataFrame([(f, 400) for f in {r[0] for r in rows}], "file string, bytes long"), root, ["k", "ts"], ["written"], target_bytes=20_000, fan_in=16)
    root = shared_dir(spark, "increment")
    job = make(rows, root)
    assert contents(job.run()) == {(r[1], r[2]): r[4] for r in rows}
    txns, before = job.committed(), job.files().collect()
    assert job.ranges() == 8 and len(before) == 8 and all(x.txn >= 0 for x in before)
    more = [("late%d" % f, f"k{f}", 7 + f, 999, -1.0) for f in range(5)]
    job = make(rows + more, root)
    assert contents(job.run()) == {(r[1], r[2]): r[4] for r in rows + more}
    assert {tuple(x) for x in before} <= {tuple(x) for x in job.files().collect()}
    written = sum(spark.read.parquet(f"{root}/data/txn={n}").count() for n in job.committed()[len(txns) :]) if len(job.committed()) > len(txns) else 0
    assert written <= len(more)
    assert job.vacuum() > 0 and contents(job.read()) == {(r[1], r[2]): r[4] for r in rows + more}


def test_compaction_survives_a_crash_before_any_commit(spark, monkeypatch):
    rows, records, listing = small_files(spark)
    for failing in range(2):
        root = shared_dir(spark, "crash")
        job, done = Compaction(records, listing, root, ["k", "ts"], ["written"], fan_in=8), []
        original = Compaction._commit

        def commit(self, txn, outputs):
            if txn == failing and not done:
                done.append(1)
                raise RuntimeError("lost")
            original(self, txn, outputs)

        monkeypatch.setattr(Compaction, "_commit", commit)
        with pytest.raises(RuntimeError, match="lost"):
            job.run()
        assert contents(job.read()) == newest(rows)
        assert contents(job.run()) == newest(rows)
        monkeypatch.undo()


def test_compaction_takes_later_files(spark):
    rows, records, listing = small_files(spark)
    root = shared_dir(spark, "later")
    Compaction(records, listing, root, ["k", "ts"], ["written"], fan_in=8).run()
    more = [("new", "p", "k1", 0, 999, -1.0), ("new", "p", "fresh", 0, 999, -2.0)]
    job = Compaction(records.unionByName(spark.createDataFrame(more, records.schema)), listing, root, ["k", "ts"], ["written"], fan_in=8)
    assert contents(job.run()) == newest(rows + more)
    # Values from the journal's own files; a name it knows is not read again.
    empty = Compaction(records.limit(0), listing.limit(0), shared_dir(spark, "none"), ["k", "ts"], ["written"])
    assert empty.run().count() == 0


# -- 6: implausible readings ------------------------------------------------------------------------------


def wave(n, seed=6):
    rng = np.random.default_rng(seed)
    return 50 + 10 * np.sin(np.arange(n) / 20) + rng.normal(0, 1, n)


def test_judging():
    y = wave(2000)
    assert not any(m.any() for m in judge(y, np.zeros(2000, bool), y.min() - 1, y.max() + 1))
    x = y.copy()
    x[[100, 101, 700]] = [300, 280, -200]
    x[900:915] = x[900]
    spike, stuck = judge(x, np.zeros(2000, bool), y.min(), y.max())
    assert np.flatnonzero(spike).tolist() == [100, 101, 700]
    assert np.flatnonzero(stuck).tolist() == list(range(900, 915))
    level = np.concatenate([y, y[:500] + 1000])
    assert not judge(level, np.zeros(2500, bool), y.min(), y.max())[0].any()
    assert natural_range(5.0, (4.0, 6.0), np.array([3.5, 4, 5, 6, 6.5, 20]), np.array([3.5, 4, 5, 6, 6.5, 21])) == (3.5, 6.5)


@pytest.mark.parametrize("tile", [300, 100_000])
def test_implausible(spark, tile):
    hour = 3_600_000
    rows, want = [], set()
    for key in ("a", "b", None):
        y = wave(1500, ord((key or "z")[0]))
        y[[5, 640, 641]] = [400, 500, -100]
        y[295:309] = y[295]
        want |= {(key, i, "spike") for i in (5, 640)} | {(key, 641, "impossible")} | {(key, i, "stuck") for i in range(295, 309)}
        rows += [(key, i * hour // 10, float(v)) for i, v in enumerate(y)]
    rows += [("a", None, 1.0), ("a", 10**9, None), ("a", 10**9 + 1, NAN), ("c", 1, 7.0), ("d", 1, INF)] + [("e", i, 3.0) for i in range(50)]
    want.add(("d", None, "impossible"))
    df = spark.createDataFrame([(*r, 0.0, 1) for r in rows], "k string, t long, v double, low double, reason int")
    got = implausible(df, "k", "t", "v", "low", None, tile).collect()
    key = lambda r: (r.k, None if r.k == "d" else round(r.t / (hour // 10)), r.reason)
    assert len(got) == len(want) and {key(r) for r in got} == want
    assert implausible(df.limit(0), "k", "t", "v").count() == 0


def test_stuck_runs_do_not_depend_on_tiles(spark):
    a, b, c = wave(1500, 1), np.full(1500, 7.0), wave(1500, 2)
    a[150:950] = a[150]  # two whole tiles and the readings around three cuts
    b[300:600] = wave(300, 3)  # constant by nature, restless in one tile
    b[400:420] = b[400]
    c[293:304] = c[293]  # too short
    c[595:607] = c[595]
    rows = [(k, i * 360_000, float(v)) for k, y in (("a", a), ("b", b), ("c", c)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, t long, v double")
    want = {("a", i) for i in range(150, 950)} | {("c", i) for i in range(595, 607)}
    for tile in (300, 100_000):
        got = [(r.k, r.t // 360_000) for r in implausible(df, "k", "t", "v", tile_rows=tile).collect() if r.reason == "stuck"]
        assert len(got) == len(want) and set(got) == want, tile


def test_a_reading_far_off_its_neighbours_is_a_spike_within_the_daily_range():
    rng = np.random.default_rng(9)
    y = 50 + 40 * np.sin(np.arange(4000) / 300) + rng.normal(0, 0.3, 4000)
    planted = [500, 1200, 2000, 2001, 3300]
    y[planted] += [30, -30, 25, 25, 45]
    found = lambda y, **k: np.flatnonzero(judge(y, np.zeros(len(y), bool), y.min(), y.max(), **k)[0]).tolist()
    assert found(y) == planted
    # Short visits to a level that the source also stays at are ordinary.
    levels = np.repeat(rng.permutation([20.0, 400.0] * 60), rng.integers(2, 30, 120)) + rng.normal(0, 5, 1)
    assert found(levels + rng.normal(0, 2, len(levels))) == []


def test_the_ellipsoid_decides():
    rng = np.random.default_rng(10)
    y = rng.uniform(0, 10, 4000)
    y[[698, 699, 700, 701, 702, 2000]] = [8, 6, 13.6, 4, 8, 60]
    lo, hi = natural_range(5.0, (0.5, 9.5), np.sort(y), np.sort(y))
    assert hi < 10
    found = lambda **k: np.flatnonzero(judge(y, np.zeros(4000, bool), lo, hi, **k)[0]).tolist()
    assert found() == [2000] and found(ellipsoid=False) == [700, 2000]


def test_sources_that_count_in_steps_have_no_gaps():
    values = np.array([0.0, 1, 2, 3, 4, 5, 60])
    assert natural_range(1.0, (0.0, 2.0), values, values) == (0, 5)


def test_results_do_not_depend_on_tiles(spark):
    rng = np.random.default_rng(11)
    rows = []
    for key, step in (("slow", 360_000), ("dense", 40)):  # of the dense source whole hours hold more than a tile
        y = 50 + 40 * np.sin(np.arange(9000) / 300) + rng.normal(0, 0.3, 9000)
        for a, n in ((250, 200), (1900, 700), (5000, 1500)):
            y[a : a + n] = y[a]
        for i in (3, 298, 299, 300, 301, 600, 1997, 2000, 4000, 4001, 8999):
            y[i] += rng.choice([-300, 400])
        y[[700, 6000]] = np.inf
        rows += [(key, i * step, float(v)) for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    got = {tile: sorted(tuple(r) for r in implausible(df, "k", "t", "v", tile_rows=tile).collect()) for tile in (300, 2000, 100_000)}
    assert got[300] == got[2000] == got[100_000]
    reasons = {r: sum(x[3] == r for x in got[300]) for r in ("spike", "stuck", "impossible")}
    assert reasons["stuck"] > 4700 and reasons["spike"] == 22 and reasons["impossible"] == 4
