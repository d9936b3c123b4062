"""Repetition inside a single document, by suffix arrays.

The documents of a batch are laid end to end, each unit (word, or letter in CJK text) led by its document, so
one suffix array serves them all and none reaches into another. It is built by prefix doubling, whole arrays
at a time; the ranks of the doubling also give the longest common prefix of neighbours. Runs of neighbours
whose common prefix has the wanted length are the LCP intervals: their first position in text order is the
original, all others begin repeated spans. The union of the spans over the length is the repeated share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.llm.text import letter_units, plain

#: Units of one suffix array; a longer document has one of its own.
BATCH_UNITS = 400_000
RESULT = "units long, repeated long, share double, longest long"


def suffix_array(units: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the suffix of their document, and the common prefix of each with the one before it."""
    n = len(units)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, rank = np.unique(doc.astype(np.int64) * (int(units.max()) + 1) + units, return_inverse=True)
    rank = rank.astype(np.int64)
    ranks, k = [rank.astype(np.int32)], 1
    # A suffix that ends within its document sorts before any longer one with the same beginning.
    last = np.searchsorted(doc, doc, side="right")
    at = np.arange(n)
    while True:
        nxt = at + k
        second = np.where(nxt < last, rank[np.minimum(nxt, n - 1)] + 1, 0)
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], s[1:] != s[:-1])))
        rank = new
        if rank[order[-1]] == n - 1 or k >= n:
            break
        ranks.append(rank.astype(np.int32))
        k *= 2
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        r, step = ranks[level], 1 << level
        inside = (a + step <= last[order[:-1]]) & (b + step <= last[order[1:]])
        same = inside & (r[np.minimum(a, n - 1)] == r[np.minimum(b, n - 1)])
        a, b, common = a + step * same, b + step * same, common + step * same
    lcp[1:] = common
    return order, lcp


def repeated_units(units: np.ndarray, doc: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position whether it lies in a run of ``least`` units that occurred earlier, and per position its LCP."""
    n = len(units)
    order, lcp = suffix_array(units, doc)
    covered, longest = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    if n == 0:
        return covered[:0] > 0, longest
    longest[order] = lcp
    heads = np.flatnonzero(~(lcp >= least[order]) | (np.arange(n) == 0))
    first = np.minimum.reduceat(order, heads)
    size = np.diff(np.append(heads, n))
    begins = order[np.repeat(first, size) != order]
    covered = np.zeros(n + 1, np.int64)
    np.add.at(covered, begins, 1)
    np.add.at(covered, begins + least[begins], -1)
    return np.cumsum(covered[:n]) > 0, longest


def _measure(texts: list[str | None], words_run: int, letters_run: int) -> pd.DataFrame:
    ids: dict[str, int] = {}
    parts, sizes, runs = [], [], []
    for t in texts:
        u, cjk = letter_units(plain(t))
        parts.extend([ids.setdefault(x, len(ids)) for x in u])
        sizes.append(len(u))
        runs.append(letters_run if cjk else words_run)
    sizes_a = np.asarray(sizes, np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes_a)
    hit, longest = repeated_units(np.asarray(parts, np.int64), doc, np.repeat(np.asarray(runs, np.int64), sizes_a))
    repeated = np.bincount(doc, weights=hit, minlength=len(texts)).astype(np.int64)
    top = np.zeros(len(texts), np.int64)
    np.maximum.at(top, doc, longest)
    return pd.DataFrame({"units": sizes_a, "repeated": repeated, "share": repeated / np.maximum(sizes_a, 1), "longest": top})


def repetition(text: Column, words_run: int = 4, letters_run: int = 10) -> Column:
    """STRUCT (``units``, ``repeated``, ``share``, ``longest``) of a text, all of it.

    ``units`` counts words (letters in mainly Japanese or Chinese text); case, punctuation, digits, spacing,
    accents and markup do not count. ``repeated`` counts those in runs of ``words_run`` (``letters_run``) units
    that began earlier in the text, be it overlapping; ``longest`` is the longest repeated run.
    A null or empty text has 0 units and share 0; each row stands for itself, so copies and ties do not matter.
    """

    @F.pandas_udf(RESULT)
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            out, part, size = [], [], 0
            for t in s.tolist():
                n = len(t or "")
                if part and size + n > BATCH_UNITS:
                    out.append(_measure(part, words_run, letters_run))
                    part, size = [], 0
                part.append(t)
                size += n
            out.append(_measure(part, words_run, letters_run))
            yield pd.concat(out, ignore_index=True)

    return measure(text)
