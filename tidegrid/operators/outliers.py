"""Implausible readings, judged by the usual behaviour of their own source: phase-space thresholding.

In time order, robust ellipsoids over value, first and second difference, with centre and axes from the whole
source, flag the readings outside them. Flagged ones are spikes if they last for a few readings only and lie
beyond what is natural for the source; they give way to the reading before and the flags are taken again until
nothing is added. Natural are, against long tails, levels and cycles, two ranges found by a gap rule on mergeable
histograms: that of the values, and that of the distance from the median of the readings around, which is no less
than the level changes of the source. So a reading far off its neighbours is a spike even where other times of the
day have such values. Longer stays beyond the ranges are level changes. Runs of equal values too long for how often the source repeats itself are stuck; bounds
catch the impossible.

Sources of more than ``tile_rows`` readings are cut into tiles, at whole hours or, in hours with more readings than
that, at whole seconds. All that judges a reading comes from the whole source: tiles give counts, histograms,
the runs and the readings at their ends; these add up to the ellipsoid, the ranges, the true lengths of runs across
cuts and the least length of a stuck run; then each tile is judged with the readings around its cuts. The results
are those of the uncut source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.common import lookup_join
from tidegrid.session import materialize

#: A value is beyond the natural if it leaves a gap of this share of the distance natural so far.
GAP, LOCAL_GAP = 0.7, 5.0
#: Longest spike, least stuck run, readings on each side of one that its local median takes.
SPIKE_RUN, STUCK_RUN, AROUND = 5, 12, 5
#: Readings of its neighbours that a tile is judged with on each side.
HALO = 128
#: Fewer readings than that have no usual distance from their neighbours.
LOCAL_LEAST = 64
#: Readings on each side that the behaviour at a reading depends on.
MARGIN = 2 * AROUND + 1
_AXES = ("slope", "bend", "off", "shift")
#: Expected number of runs of that length by chance above which a run is ordinary.
CHANCE = 0.01
_HOUR, _SECOND = 3_600_000, 1_000


# -- histograms that add up -------------------------------------------------------------------------------


@dataclass
class Histogram:
    """Counts and extremes of non-negative numbers in bins of a sixteenth of a doubling; zero has a bin of its own."""

    bins: np.ndarray
    count: np.ndarray
    least: np.ndarray
    most: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray) -> Histogram:
        with np.errstate(divide="ignore"):
            b = np.where(a > 0, np.floor(np.log2(a) * 16), -(10**6)).astype(np.int64)
        return cls(b, np.ones(len(a), np.int64), a, a).folded()

    @classmethod
    def together(cls, parts: list[Histogram]) -> Histogram:
        return cls(*(np.concatenate([getattr(p, c) for p in parts]) for c in ("bins", "count", "least", "most"))).folded()

    def folded(self) -> Histogram:
        if not len(self.bins):
            return self
        order = np.argsort(self.bins, kind="stable")
        b = self.bins[order]
        at = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        return Histogram(b[at], np.add.reduceat(self.count[order], at), np.minimum.reduceat(self.least[order], at), np.maximum.reduceat(self.most[order], at))

    def quantile(self, q: float) -> float:
        """The middle of the bin that holds the quantile; 0 without numbers."""
        if not len(self.bins):
            return 0.0
        k = np.searchsorted(np.cumsum(self.count), q * self.count.sum())
        k = min(int(k), len(self.bins) - 1)
        return float(self.least[k] / 2 + self.most[k] / 2)

    def natural(self, start: float, gap: float) -> float:
        """How far numbers go from ``start`` without a gap."""
        reach = start
        for n, f in zip(self.least, self.most):
            if n > reach * (1 + gap):
                break
            reach = max(reach, float(f))
        return reach


def natural_range(median: float, start: tuple[float, float], lows: np.ndarray, highs: np.ndarray) -> tuple[float, float]:
    """Ends of the natural range of values from bins sorted by value, each with its least and greatest value.

    Neighbouring values of a source that counts in steps leave no gap: it must be wider than the least step seen
    within ``start``.
    """
    within = (highs[:-1] >= start[0]) & (lows[1:] <= start[1])
    steps = (lows[1:] - highs[:-1])[within]
    step = 1.5 * float(steps[steps > 0].min(initial=np.inf)) if (steps > 0).any() else 0.0

    def walk(near: np.ndarray, far: np.ndarray, value: np.ndarray, end: float) -> float:
        # The end is a value as it stands, not a sum that rounding may put beside it.
        reach = abs(end - median)
        for n, f, v in zip(near, far, value):
            if n > reach * (1 + GAP) and n - reach > step:
                break
            if f > reach:
                reach, end = f, float(v)
        return end

    first, last = min(start[0], median), max(start[1], median)
    up, down = highs > last, lows < first
    above = walk(lows[up] - median, highs[up] - median, highs[up], last)
    below = walk((median - highs[down])[::-1], (median - lows[down])[::-1], lows[down][::-1], first)
    return below, above


# -- phase space ------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Fit:
    """What is usual for a source: natural range, centre and axes of its ellipsoid, readings, natural distance from neighbours."""

    lo: float
    hi: float
    mid: float
    scale: float
    slope: float
    bend: float
    local: float
    n: int


def _axis(middle: float, about: float = 0.0) -> float:
    return max(1.4826 * middle, 1e-12 * (1 + abs(about)))


def local_median(y: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Median of each reading (of those ``at``) and ``AROUND`` readings on each side, mirrored at the ends."""
    if len(y) <= AROUND:
        return y if at is None else y[at]
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(y, AROUND, mode="reflect"), 2 * AROUND + 1)
    if at is not None:
        return np.partition(windows[at], AROUND, axis=1)[:, AROUND]
    out = np.empty(len(y))
    for i in range(0, len(y), 65_536):
        out[i : i + 65_536] = np.partition(windows[i : i + 65_536], AROUND, axis=1)[:, AROUND]
    return out


def behaviour(y: np.ndarray, ours: slice = slice(None)) -> list[Histogram]:
    """Of the readings ``ours`` histograms of slope, bend and distance from neighbours, and the greatest shift.

    A shift is the difference of the local medians before and after a reading: what changes and stays.
    """
    if len(y) < 2:
        return [Histogram.of(np.empty(0))] * len(_AXES)
    slope, middle = np.gradient(y), local_median(y)
    shift = np.zeros(len(y))
    shift[AROUND + 1 : -AROUND - 1] = np.abs(middle[2 * AROUND + 2 :] - middle[: -2 * AROUND - 2])
    return [*(Histogram.of(np.abs(a[ours])) for a in (slope, np.gradient(slope), y - middle)), Histogram.of(shift[ours].max(initial=0.0, keepdims=True))]


def fitted(lo: float, hi: float, mid: float, scale: float, n: int, h: list[Histogram]) -> Fit:
    """The fit of a source from its natural range, centre, axis, number of readings and :func:`behaviour`."""
    slope, bend, off, shift = h
    usual, local = off.quantile(0.95), float("inf")
    if n >= LOCAL_LEAST and usual > 0:
        # Short visits to a level that the source also stays at are no spikes.
        local = (1 + GAP) * max(off.natural(usual, LOCAL_GAP), float(shift.most.max(initial=0.0)))
    return Fit(lo, hi, mid, scale, _axis(slope.quantile(0.5), mid), _axis(bend.quantile(0.5), mid), local, n)


def phase_flags(y: np.ndarray, fit: Fit, ellipsoid: bool = True) -> np.ndarray:
    """Readings outside the ellipsoid and beyond what is natural, flagged until no more are found.

    ``ellipsoid=False`` leaves the natural ranges alone to decide, for comparison.
    """
    n = len(y)
    flags = np.zeros(n, bool)
    if n < 2:
        return (y < fit.lo) | (y > fit.hi)
    limit = np.sqrt(2 * np.log(max(fit.n, 2)))
    good, off = y.copy(), y - local_median(y) if np.isfinite(fit.local) else np.zeros(n)
    while True:
        slope = np.gradient(good)
        u, a, b = (good - fit.mid) / (fit.scale * limit), slope / (fit.slope * limit), np.gradient(slope) / (fit.bend * limit)
        u, a, b = u * u, a * a, b * b
        outside = (u + a > 1) | (a + b > 1) | (u + b > 1) if ellipsoid else np.ones(n, bool)
        new = outside & ((good < fit.lo) | (good > fit.hi) | (np.abs(off) > fit.local)) & ~flags
        if not new.any():
            return flags
        flags |= new
        keep = np.flatnonzero(~flags)
        if not len(keep):
            return flags
        # Flagged readings give way to the last one that is not flagged, or the first such.
        at = np.maximum.accumulate(np.where(~flags, np.arange(n), -1))
        before, good = good, y[np.where(at < 0, keep[0], at)]
        if np.isfinite(fit.local):
            changed = np.flatnonzero(before != good)
            near = np.unique(np.clip((changed[:, None] + np.arange(-AROUND, AROUND + 1)).ravel(), 0, n - 1))
            off[near] = good[near] - local_median(good, near)


def _run_lengths(same_as_before: np.ndarray) -> np.ndarray:
    """Length of the run each element is in; an element starts one where it differs from the one before."""
    run = np.cumsum(~same_as_before)
    return np.bincount(run)[run]


def spikes(y: np.ndarray, fit: Fit, ellipsoid: bool = True) -> np.ndarray:
    """Mask of spikes among the possible readings ``y`` of one source in time order."""
    if not len(y):
        return np.zeros(0, bool)
    flags = phase_flags(y, fit, ellipsoid)
    out = (y < fit.lo) | (y > fit.hi) | flags
    return flags & (_run_lengths(np.concatenate(([False], out[1:] == out[:-1]))) <= SPIKE_RUN)


# -- stuck runs -------------------------------------------------------------------------------------------


def least_run(n: int, short: int, again: int) -> float:
    """Least length of a stuck run in a source of ``n`` readings, ``short`` of them in runs below ``STUCK_RUN`` and
    ``again`` of these equal to the one before; infinite where the source is constant by nature."""
    if not n or short / n < 0.25:
        return float("inf")
    p = again / short
    return STUCK_RUN if p == 0 else max(STUCK_RUN, 1 + np.log(CHANCE / n) / np.log(min(p, 0.999)))


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which readings equal the one before, and the length of the run each is in."""
    same = np.concatenate(([False], x[1:] == x[:-1]))
    return same, _run_lengths(same)


def judge(x: np.ndarray, impossible: np.ndarray, lo: float, hi: float, mid: float | None = None, scale: float | None = None, ellipsoid: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Masks of spikes and of stuck readings among all the readings ``x`` of one source in time order."""
    if not len(x):
        return np.zeros(0, bool), np.zeros(0, bool)
    same, length = _runs(x)
    short = length < STUCK_RUN
    spike = np.zeros(len(x), bool)
    y = x[~impossible]
    if len(y):
        mid = float(np.median(y)) if mid is None else mid
        scale = _axis(float(np.median(np.abs(y - mid))), mid) if scale is None else scale
        spike[~impossible] = spikes(y, fitted(lo, hi, mid, scale, len(y), behaviour(y)), ellipsoid)
    return spike, (length >= least_run(len(x), short.sum(), (same & short).sum())) & ~spike


# -- tiles ------------------------------------------------------------------------------------------------

_HISTS = [f"_{a}_{c}" for a in _AXES for c in ("bins", "count", "least", "most")]
_SOURCE = ["_lo", "_hi", "_mid", "_scale", "_usual"]
#: A found reading, or (``reason`` 'tile') what a tile of a cut source adds to it.
_FIRST = (
    "_key string, _ts long, _v double, reason string, _tile long, _cuts long, _n long, _short long, _again long, _head long, _tail long, _first double, _last double, "
    + "".join(f"{c} double, " for c in _SOURCE)
    + "_begin array<double>, _end array<double>, "
    + ", ".join(f"{c} array<{'long' if c.endswith(('bins', 'count')) else 'double'}>" for c in _HISTS)
)
_FIRST_COLUMNS = [c.split()[0] for c in _FIRST.split(", ")]
_HEADER = "_key string, _tile long, _cuts long, _before array<double>, _after array<double>, _fit array<double>, _starts_with long, _ends_with long, _least double"


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups from batches sorted by group."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), bool)
        for c in by:
            v = pdf[c].to_numpy()
            if v.dtype == object:
                v = pd.factorize(v)[0]
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(pdf)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            part = pdf.iloc[a:b]
            if held and a == 0:
                last = held[-1].iloc[-1]
                first = part.iloc[0]
                if any((last[c] != first[c]) and not (pd.isna(last[c]) and pd.isna(first[c])) for c in by):
                    yield pd.concat(held) if len(held) > 1 else held[0]
                    held = []
            elif held:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(part)
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _found(key: object, ts: np.ndarray, v: np.ndarray, spike: np.ndarray, stuck: np.ndarray) -> pd.DataFrame:
    mask = spike | stuck
    return pd.DataFrame({"_key": pd.Series([key] * int(mask.sum()), dtype=object), "_ts": ts[mask], "_v": v[mask], "reason": np.where(spike[mask], "spike", "stuck")})


def _first_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole sources judged; of cut ones what each tile adds."""
    out, size = [], 0

    def emit() -> pd.DataFrame:
        df = pd.concat(out, ignore_index=True).reindex(columns=_FIRST_COLUMNS)
        for c in ("_begin", "_end", *_HISTS):
            df[c] = df[c].astype(object).where(df[c].notna(), None)
        return df

    for g in _groups(batches, ["_key", "_tile"]):
        x, bad, ts, key = g["_v"].to_numpy(), g["_bad"].to_numpy(), g["_ts"].to_numpy(), g["_key"].iloc[0]
        tile, cuts = int(g["_tile"].iloc[0]), int(g["_cuts"].iloc[0])
        lo, hi, mid, scale, usual = (float(g[c].iloc[0]) for c in _SOURCE)
        if not cuts:
            spike, stuck = judge(x, bad, lo, hi, mid, scale)
            out.append(_found(key, ts, x, spike, stuck & ~bad))
        else:
            y = x[~bad]
            same, length = _runs(x)
            at = np.arange(len(x))
            edge = ((tile > 0) & (at < length[0])) | ((tile < cuts) & (at >= len(x) - length[-1]))
            short = (length < STUCK_RUN) & ~edge
            # What depends on readings beyond a cut is counted there, see _sources.
            h = behaviour(y, slice(MARGIN if tile else 0, max(0, len(y) - MARGIN) if tile < cuts else None))
            row = {"_key": key, "reason": "tile", "_tile": tile, "_cuts": cuts, "_n": len(x), "_short": int(short.sum()), "_again": int((same & short).sum()), "_head": int(length[0]), "_tail": int(length[-1]), "_first": x[0], "_last": x[-1]}
            row |= dict(zip(_SOURCE, (lo, hi, mid, scale, usual))) | {"_begin": y[:HALO], "_end": y[-HALO:]}
            row |= dict(zip(_HISTS, (v for a in h for v in (a.bins, a.count, a.least, a.most))))
            out.append(pd.DataFrame([row]))
        size += len(out[-1])
        if size > 20_000 or len(out) > 400:
            yield emit()
            out, size = [], 0
    if out:
        yield emit()


def _true_runs(n: list[int], head: list[int], tail: list[int], first: list[float], last: list[float]) -> tuple[list[int], list[tuple[int, int]]]:
    """Lengths of the runs that touch cuts, and of each tile which of them it begins and ends with (-1: none)."""
    runs, ends = [], []
    for i in range(len(n)):
        starts = ends_in = -1
        if i > 0:
            if first[i] == last[i - 1]:
                starts = ends[-1][1]
            else:
                starts = len(runs)
                runs.append(0)
            runs[starts] += head[i]
        if i < len(n) - 1:
            if i > 0 and head[i] == n[i]:
                ends_in = starts
            else:
                ends_in = len(runs)
                runs.append(tail[i])
        ends.append((starts, ends_in))
    return runs, ends


def _sources(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of every tile of a cut source what judges it: the fit of the source, its neighbours, the true runs at its cuts."""
    tiles: list[dict] = []
    hists: list[Histogram] | None = None

    def take(r: dict) -> None:
        nonlocal hists
        own = [Histogram(*(np.asarray(r.pop(f"_{a}_{c}")) for c in ("bins", "count", "least", "most"))) for a in _AXES]
        r["_begin"], r["_end"] = np.asarray(r["_begin"], float), np.asarray(r["_end"], float)
        parts = [own] if hists is None else [hists, own]
        if tiles:
            left, right = tiles[-1]["_end"][-2 * MARGIN :], r["_begin"][: 2 * MARGIN]
            parts.append(behaviour(np.concatenate([left, right]), slice(max(0, len(left) - MARGIN), len(left) + min(MARGIN, len(right)))))
        hists = [Histogram.together(list(p)) for p in zip(*parts)]
        tiles.append(r)

    def finish() -> pd.DataFrame:
        get = lambda c: [r[c] for r in tiles]
        runs, ends = _true_runs(get("_n"), get("_head"), get("_tail"), get("_first"), get("_last"))
        short = [r for r in runs if r < STUCK_RUN]
        least = float(least_run(sum(get("_n")), sum(get("_short")) + sum(short), sum(get("_again")) + sum(short) - len(short)))
        f = fitted(*(float(tiles[0][c]) for c in _SOURCE[:4]), int(tiles[0]["_usual"]), hists)
        fit = [f.lo, f.hi, f.mid, f.scale, f.slope, f.bend, f.local, float(f.n)]
        rows = []
        for i, (r, (a, b)) in enumerate(zip(tiles, ends)):
            before, after = tiles[i - 1]["_end"] if i else np.empty(0), tiles[i + 1]["_begin"] if i + 1 < len(tiles) else np.empty(0)
            rows.append((r["_key"], r["_tile"], r["_cuts"], before, after, fit, runs[a] if a >= 0 else 0, runs[b] if b >= 0 else 0, least))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _HEADER.split(", ")])

    for pdf in batches:
        for r in pdf.to_dict("records"):
            if tiles and (r["_key"] != tiles[0]["_key"]):
                yield finish()
                tiles, hists = [], None
            take(r)
    if tiles:
        yield finish()


def _second_pass(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles of cut sources judged, each led by its header."""
    for g in _groups(batches, ["_key", "_tile"]):
        top, g = g.iloc[0], g.iloc[1:]
        x, bad, ts = g["_v"].to_numpy(), g["_bad"].to_numpy(bool), g["_ts"].to_numpy(np.int64)
        fit = Fit(*(float(v) for v in top["_fit"][:7]), int(top["_fit"][7]))
        before, after = (np.asarray(top[c], float) for c in ("_before", "_after"))
        spike = np.zeros(len(x), bool)
        y = x[~bad]
        spike[~bad] = spikes(np.concatenate([before, y, after]), fit)[len(before) : len(before) + len(y)]
        _, length = _runs(x)
        at, n, tile = np.arange(len(x)), len(x), int(top["_tile"])
        head, tail = length[0], length[-1]
        if tile < int(top["_cuts"]):
            length[at >= n - tail] = int(top["_ends_with"])
        if tile > 0:
            length[at < head] = int(top["_starts_with"])
        yield _found(top["_key"], ts, x, spike, (length >= float(top["_least"])) & ~spike & ~bad)


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Natural range, centre, axis and number of the possible readings of each source."""
    rows = []
    for g in _groups(batches, ["_key"]):
        q = g["_q"].iloc[0]
        start = (q[1], q[3]) if q[1] < q[3] else (q[0], q[4])
        low, high, n = g["_least"].to_numpy(), g["_most"].to_numpy(), g["_n"].to_numpy()
        lo, hi = natural_range(q[2], start, low, high)
        far = np.abs(low / 2 + high / 2 - q[2])
        order = np.argsort(far, kind="stable")
        middle = far[order][np.searchsorted(np.cumsum(n[order]), n.sum() / 2)]
        rows.append((g["_key"].iloc[0], lo, hi, q[2], _axis(middle, q[2]), n.sum()))
    yield pd.DataFrame(rows, columns=["_key", *_SOURCE]).astype({c: "float64" for c in _SOURCE})


def _tiles(rows: DataFrame, tile_rows: int) -> DataFrame:
    """``rows`` with ``_tile`` and the number of cuts of their source, ``_cuts``."""
    floor = lambda ms: F.expr(f"_ts - pmod(_ts, {ms}L)")
    count = F.count(F.lit(1)).alias("_n")
    hourly = materialize(rows.groupBy("_key", floor(_HOUR).alias("_at")).agg(count), "plausible-hours")
    big = hourly.groupBy("_key").agg(F.sum("_n").alias("_all")).where(F.col("_all") > tile_rows).select("_key")
    big = materialize(big, "plausible-big")
    if big.limit(1).count() == 0:
        return rows.withColumn("_tile", F.lit(0).cast("long")).withColumn("_cuts", F.lit(0).cast("long"))
    hours = lookup_join(hourly, big, ["_key"])
    dense = materialize(hours.where(F.col("_n") > tile_rows).select("_key", F.col("_at").alias("_hour"), F.lit(True).alias("_dense")), "plausible-dense")
    rows = rows.withColumn("_hour", floor(_HOUR))
    if dense.limit(1).count():
        rows = lookup_join(rows, dense, ["_key", "_hour"], "left")
        rows = rows.withColumn("_at", F.when(F.col("_dense"), floor(_SECOND)).otherwise(F.col("_hour"))).drop("_dense")
        hours = hours.where(F.col("_n") <= tile_rows).unionByName(lookup_join(rows, dense.drop("_dense"), ["_key", "_hour"]).groupBy("_key", "_at").agg(count))
    else:
        rows = rows.withColumnRenamed("_hour", "_at")
    w = Window.partitionBy("_key").orderBy("_at")
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    hours = hours.withColumn("_piece", F.floor(before / tile_rows))
    # A piece smaller than the halo joins its neighbour: its start is no cut.
    w = Window.partitionBy("_key").orderBy("_piece")
    pieces = hours.groupBy("_key", "_piece").agg(F.sum("_n").alias("_n"))
    pieces = pieces.withColumn("_i", F.row_number().over(w)).withColumn("_prior", F.lag("_n").over(w))
    cut = (F.col("_i") > 1) & (F.col("_n") >= HALO) & ~((F.col("_i") == 2) & (F.col("_prior") < HALO))
    pieces = pieces.withColumn("_tile", F.sum(cut.cast("long")).over(w)).withColumn("_cuts", F.max("_tile").over(Window.partitionBy("_key")))
    # One row per hour (second) of the cut sources; none has more than about a tile's readings, so no key of the join is hot.
    where = materialize(hours.join(pieces.select("_key", "_piece", "_tile", "_cuts"), ["_key", "_piece"]).select("_key", "_at", "_tile", "_cuts"), "plausible-tiles")
    rows = lookup_join(rows, where, ["_key", "_at"], "left")
    return rows.withColumn("_tile", F.coalesce("_tile", F.lit(0).cast("long"))).withColumn("_cuts", F.coalesce("_cuts", F.lit(0).cast("long")))


def implausible(readings: DataFrame, entity: str, ts: str, value: str, low: str | None = None, high: str | None = None, tile_rows: int = 100_000) -> DataFrame:
    """(``entity``, ``ts``, ``value``, ``reason``) of every implausible reading; reason impossible, spike or stuck.

    ``low`` and ``high`` name columns with the bounds of what is possible (inclusive; null: no bound). Readings
    are to be unique by (entity, ts), as :func:`~tidegrid.operators.common.current_rows` makes them.

    Defined cases: rows with a null time or a null or NaN value are no readings; an infinite value is impossible;
    a null entity is a source of its own; of readings repeated at one time each is judged, and they stay in one
    tile; sources of a single value have no spikes unless other values are there; an empty table gives no rows;
    other columns are ignored.
    """
    kind = readings.schema[entity].dataType
    v = F.col(f"`{value}`").cast("double")
    bound = lambda c: F.col(f"`{c}`").cast("double") if c else F.lit(None).cast("double")
    bad = (F.abs(v) == F.lit(float("inf"))) | F.coalesce(v < bound(low), F.lit(False)) | F.coalesce(v > bound(high), F.lit(False))
    rows = readings.where(F.col(f"`{ts}`").isNotNull() & v.isNotNull() & ~F.isnan(v))
    rows = rows.select(F.coalesce(F.concat(F.lit("="), F.col(f"`{entity}`").cast("string")), F.lit("-")).alias("_key"), F.col(f"`{ts}`").cast("long").alias("_ts"), v.alias("_v"), bad.alias("_bad"))
    rows = materialize(rows, "plausible-rows")

    usual = rows.where(~F.col("_bad"))
    middle = materialize(usual.groupBy("_key").agg(F.percentile_approx("_v", [0.02, 0.05, 0.5, 0.95, 0.98], 2000).alias("_q")), "plausible-middle")
    width = (F.col("_q")[3] - F.col("_q")[1]) / 2
    width = F.when(width > 0, width).otherwise(F.abs(F.col("_q")[2]) * 1e-3 + F.lit(1e-300))
    off = (F.col("_v") - F.col("_q")[2]) / width
    # Some 30 bins for each doubling of the distance from the median; the extremes keep gaps exact.
    step = (F.signum(off) * F.floor(F.log1p(F.least(F.abs(off), F.lit(1e300)) * 8) * 40)).cast("int")
    bins = lookup_join(usual, middle, ["_key"]).groupBy("_key", step.alias("_bin")).agg(F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.count(F.lit(1)).alias("_n"))
    bins = lookup_join(bins, middle, ["_key"]).repartition("_key").sortWithinPartitions("_key", "_least")
    sources = materialize(bins.mapInPandas(_ranges, "_key string, " + ", ".join(f"{c} double" for c in _SOURCE)), "plausible-sources")

    tiled = _tiles(rows, tile_rows)
    # A source without any possible reading has no range and needs none.
    judged = lookup_join(tiled, sources, ["_key"], "left").select("_key", "_tile", "_cuts", "_ts", "_v", "_bad", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in _SOURCE])
    judged = judged.repartition("_key", "_tile").sortWithinPartitions("_key", "_tile", "_ts").mapInPandas(_first_pass, _FIRST)
    judged = materialize(judged, "plausible-judged")
    found = judged.where(F.col("reason") != "tile").select("_key", "_ts", "_v", "reason")

    parts = judged.where(F.col("reason") == "tile").drop("_ts", "_v", "reason").repartition("_key").sortWithinPartitions("_key", "_tile")
    headers = materialize(parts.mapInPandas(_sources, _HEADER), "plausible-headers")
    if headers.limit(1).count():
        flat = tiled.where(F.col("_cuts") > 0).select("_key", "_tile", "_ts", "_v", "_bad")
        both = headers.unionByName(flat, allowMissingColumns=True)
        both = both.repartition("_key", "_tile").sortWithinPartitions("_key", "_tile", F.col("_fit").isNull(), "_ts")
        found = found.unionByName(both.mapInPandas(_second_pass, "_key string, _ts long, _v double, reason string"))
    found = found.unionByName(rows.where("_bad").select("_key", "_ts", "_v", F.lit("impossible").alias("reason")))
    name = F.when(F.col("_key") != "-", F.substring("_key", 2, 1 << 30)).cast(kind)
    return found.select(name.alias(entity), F.col("_ts").alias(ts), F.col("_v").alias(value), "reason")
