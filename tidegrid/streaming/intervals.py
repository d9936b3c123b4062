"""Continuous periods of a stream of intervals: the disjoint-interval map of each entity is its keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidegrid.operators.intervals import IntervalMap

OUTPUT = "entity string, kind string, start_ms long, end_ms long"
STATE = "starts array<long>, ends array<long>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    m = IntervalMap(*state.get) if state.exists else IntervalMap()
    for pdf in batches:
        pdf = pdf[pdf["start_ms"].notna() & pdf["end_ms"].notna() & (pdf["start_ms"] <= pdf["end_ms"])]
        for s, e in zip(pdf["start_ms"].astype("int64").tolist(), pdf["end_ms"].astype("int64").tolist()):
            m.insert(s, e)
    state.update((m.starts, m.ends))
    rows = [(key[0], "period", s, e) for s, e in m.periods()] + [(key[0], "gap", s, e) for s, e in m.gaps()]
    yield pd.DataFrame(rows, columns=["entity", "kind", "start_ms", "end_ms"])


def stream_periods(intervals: DataFrame) -> DataFrame:
    """For a stream of (``entity``, ``start_ms``, ``end_ms``): all periods and gaps of each entity a batch touches (update mode)."""
    return intervals.groupBy("entity").applyInPandasWithState(_update, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)
