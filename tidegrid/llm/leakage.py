"""Evaluation texts leaking into training text: size-partitioned MinHash containment search, verified exactly.

The queries are windows of the test passages, as long as the shortest passage that counts (12 words; 25
characters of text without spaces). The sets searched are overlapping segments of the documents, so that a
short query inside a very long document still makes up a fair part of some set. A segment and a query share a
minimum of one of the hash functions with the probability of their Jaccard similarity. Segments are
partitioned by the size of their set: the containment wanted, the query's size and the segment's size give
the similarity, and that gives how many functions are looked up to miss at most ``MISS`` of such pairs.

Pairs that share a minimum are verified on the text: shingles of the document that the passage contains are
joined to runs along the alignment, across one altered word at a time, and the longest run decides.

An altered word is crossed only beside telling words, those that few sentences of all the test items have: sentence
patterns filled with other names share the rest. The counts come from one aggregation over all items.

The index over the items is built by tasks, in blocks of about ``block`` items, and goes to the workers by
broadcast, as many blocks at once as stay within ``INDEX_BYTES``: one pass over the corpus for each such load, in
which a text is cut and hashed once. Which items share a block changes nothing. The corpus is never shuffled.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.llm.text import has_cjk, is_cjk, mix, plain, shingle_hashes, words
from tidegrid.session import materialize

#: Share of qualifying pairs that the search may miss.
MISS = 5e-4
#: Bytes of index that a worker holds at once, and characters of passages in a block.
INDEX_BYTES, BLOCK_CHARS = 192 << 20, 2_000_000
#: A word is telling if at most so many sentences of the test items have it, or so large a share of them.
TELLING, TELLING_SHARE = 2, 5e-4
_SENTENCE = re.compile(r"[.!?。！？]+\s*")


@dataclass(frozen=True)
class Mode:
    """How a kind of text is cut: units per shingle, least run, shingle starts per half segment, widest alteration."""

    width: int
    least: int
    half: int
    altered: int
    #: Exact units that a run bridged across an alteration must hold, and its least span is ``least``.
    bridged: int

    @property
    def query(self) -> int:
        """Shingles of a query window."""
        return self.least - self.width + 1

    @property
    def kept(self) -> int:
        """Shingles of a window that one altered word leaves at worst."""
        return max(1, self.least - self.altered - 2 * (self.width - 1))


WORDS = Mode(width=5, least=12, half=8, altered=1, bridged=11)
LETTERS = Mode(width=8, least=25, half=16, altered=6, bridged=19)


def functions_for(mode: Mode, size: int) -> int:
    """Hash functions looked up for segments of at most ``size`` shingles."""
    kept = min(mode.kept, size)
    jaccard = kept / (size + mode.query - kept)
    return int(np.ceil(np.log(MISS) / np.log(1 - min(jaccard, 0.999))))


def size_classes(mode: Mode) -> list[tuple[int, int]]:
    """(largest size, functions) of each class of segments: sizes double up to a whole segment."""
    out, size = [], mode.half // 2
    while size < 2 * mode.half:
        out.append((size, functions_for(mode, size)))
        size *= 2
    return [*out, (2 * mode.half, functions_for(mode, 2 * mode.half))]


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Units:
    """Hashes of words and letters, the same in every process."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def hashes(self, units: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        if len(known) > 500_000:
            known.clear()
        out = []
        for u in units:
            h = known.get(u)
            if h is None:
                h = known[u] = xxhash.xxh64_intdigest(u)
            out.append(h)
        return np.asarray(out, np.uint64)


def _letters(text: str) -> list[str]:
    return list("".join(words(text)))


def _sentences(passage: str, cut) -> list[tuple[int, list[str]]]:
    """The sentences of a passage as units, each with the place of its first unit."""
    out, at = [], 0
    for text in _SENTENCE.split(passage):
        own = cut(plain(text))
        if own:
            out.append((at, own))
        at += len(own)
    return out


class Index:
    """The passages of one block of test items, of one mode; ``telling`` holds the telling words among theirs."""

    def __init__(self, mode: Mode, items: list[tuple[object, str]], telling: set[str]):
        self.mode, self.telling, units = mode, telling, Units()
        cut = words if mode == WORDS else _letters
        self.items = [i for i, _ in items]
        self.tokens = [cut(plain(p)) for _, p in items]
        self.sentences = [[(a, a + len(u)) for a, u in _sentences(p, cut)] for _, p in items]
        seeds = _seeds(max(n for _, n in size_classes(mode)))
        shingles, item, pos = [], [], []
        minima: list[list[np.ndarray]] = [[] for _ in seeds]
        for i, t in enumerate(self.tokens):
            h = shingle_hashes(units.hashes(t), mode.width)
            shingles.append(h)
            item.append(np.full(len(h), i))
            pos.append(np.arange(len(h)))
            if not len(h):
                continue
            starts = np.arange(max(1, len(h) - mode.query + 1))
            for f, seed in enumerate(seeds):
                mixed = np.concatenate([mix(h ^ seed), np.full(mode.query, np.iinfo(np.uint64).max)])
                least = np.lib.stride_tricks.sliding_window_view(mixed, mode.query)[starts].min(axis=1)
                minima[f].append(np.unique(_short(least)).astype(np.uint64) << np.uint64(32) | np.uint64(i))
        # Per function the minima, shortened to 32 bits, and the items that have them: what is looked up is verified.
        self.keys: list[tuple[np.ndarray, np.ndarray]] = []
        for pairs in minima:
            both = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
            self.keys.append(((both >> np.uint64(32)).astype(np.uint32), both.astype(np.uint32)))
        h = np.concatenate(shingles) if shingles else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.shingle = h[order]
        self.item = (np.concatenate(item) if item else np.empty(0))[order].astype(np.uint32)
        self.pos = (np.concatenate(pos) if pos else np.empty(0))[order].astype(np.uint32)

    def verify(self, tokens: list[str], h: np.ndarray, among: set[int] | None) -> list[int]:
        """The items of ``among`` (None: of all) of which the document holds a sentence or a long enough run."""
        lo, hi = np.searchsorted(self.shingle, h, "left"), np.searchsorted(self.shingle, h, "right")
        hits = np.flatnonzero(hi > lo)
        by: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for d in hits.tolist():
            for k in range(lo[d], hi[d]):
                i = int(self.item[k])
                if among is None or i in among:
                    by[i].append((d, int(self.pos[k])))
        return [i for i, pairs in by.items() if self._qualifies(i, tokens, pairs)]

    def _qualifies(self, i: int, tokens: list[str], pairs: list[tuple[int, int]]) -> bool:
        mode, passage = self.mode, self.tokens[i]
        lines: dict[int, list[int]] = defaultdict(list)
        for d, p in pairs:
            lines[d - p].append(p)
        runs = []  # (start in the passage, end, diagonal): exactly equal
        for diagonal, at in lines.items():
            at = sorted(set(at))
            a = b = at[0]
            for p in [*at[1:], None]:
                if p is None or p != b + 1:
                    s, e = a, b + mode.width
                    runs.append((s, e, diagonal))
                    a = p
                b = p
        # Short equal stretches beside an alteration have no shingle of their own; extend runs over them.
        best = []
        for s, e, diagonal in runs:
            if e - s >= mode.least or any(a >= s and b <= e for a, b in self.sentences[i]):
                return True
            best.append(self._bridge(passage, tokens, s, e, diagonal))
        for spans in best:
            for s, e, exact, changed in spans:
                span = e - s
                telling = len({u for u in passage[s:e] if u in self.telling})
                if span >= mode.least and exact >= mode.bridged and (mode == LETTERS or telling >= 2):
                    return True
                if any(a >= s and b <= e for a, b in self.sentences[i]) and changed <= 1:
                    return True
        return False

    def _bridge(self, passage: list[str], tokens: list[str], s: int, e: int, diagonal: int) -> list[tuple[int, int, int, int]]:
        """The run with one altered stretch crossed to the right, and to the left: (start, end, equal units, alterations)."""
        out = []
        widest = self.mode.altered
        for gone in range(0, widest + 1):  # units of the passage that were altered
            for put in range(0, widest + 1):  # units that stand there in the document
                if not gone and not put:
                    continue
                p, d, n = e + gone, e + diagonal + put, 0
                while p + n < len(passage) and d + n < len(tokens) and passage[p + n] == tokens[d + n]:
                    n += 1
                if n:
                    out.append((s, p + n, e - s + n, 1))
                p, d, n = s - gone - 1, s + diagonal - put - 1, 0
                while p - n >= 0 and d - n >= 0 and passage[p - n] == tokens[d - n]:
                    n += 1
                if n:
                    out.append((p - n + 1, e, e - s + n, 1))
        # A sentence whose first or last unit is the altered one.
        if self.mode == WORDS:
            out.append((max(0, s - 1), e, e - s, 1))
            out.append((s, min(len(passage), e + 1), e - s, 1))
        return out


def _short(minima: np.ndarray) -> np.ndarray:
    return (minima >> np.uint64(32)).astype(np.uint32)


def candidates(mode: Mode, indexes: list[Index], h: np.ndarray, owner: np.ndarray) -> list[dict[int, set[int]]]:
    """Per index the items by document that share a minimum with one of its segments; ``h`` and ``owner`` by shingle."""
    out: list[dict[int, set[int]]] = [defaultdict(set) for _ in indexes]
    start = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1))
    length = np.diff(np.append(start, len(h)))
    halves = np.concatenate([np.arange(s, s + n, mode.half) for s, n in zip(start.tolist(), length.tolist())])
    of = owner[halves]
    size = np.diff(np.append(halves, len(h)))
    joined = np.append(of[1:] == of[:-1], False)
    full = size + np.where(joined, np.append(size[1:], 0), 0)
    # The last half of a longer document is already inside the segment that begins before it.
    use = joined | np.concatenate(([True], of[1:] != of[:-1]))
    number = np.zeros(len(full), np.int64)
    classes = size_classes(mode)
    for top, n in reversed(classes):
        number[full <= top] = n
    number[~use] = 0
    for f, seed in enumerate(_seeds(max(n for _, n in classes))):
        rows = np.flatnonzero(number > f)
        if not len(rows):
            break
        m = np.minimum.reduceat(mix(h ^ seed), halves)
        both = _short(np.where(joined, np.minimum(m, np.append(m[1:], np.iinfo(np.uint64).max)), m)[rows])
        for index, found in zip(indexes, out):
            keys, items = index.keys[f]
            lo = np.searchsorted(keys, both, "left")
            hits = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == both) if len(keys) else lo[:0]
            hi = np.searchsorted(keys, both[hits], "right")
            for r, a, b in zip(rows[hits].tolist(), lo[hits].tolist(), hi.tolist()):
                found[int(of[r])].update(items[a:b].tolist())
    return out


#: Documents whose segments are hashed together.
_TOGETHER = 1_000


def _search(blocks: list[Broadcast], exact: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        units = Units()
        indexes = [i for b in blocks for i in b.value if i.items]
        modes = [(m, [i for i in indexes if i.mode == m]) for m in (WORDS, LETTERS)]

        def part(ids: list, texts: list[str]) -> Iterator[tuple]:
            for mode, own in modes:
                if not own:
                    continue
                tokens = {i: words(t) if mode == WORDS else _letters(t) for i, t in enumerate(texts) if mode == WORDS or has_cjk(t)}
                hashes = {i: shingle_hashes(units.hashes(t), mode.width) for i, t in tokens.items() if len(t) >= mode.width}
                if not hashes:
                    continue
                if exact:
                    among = [dict.fromkeys(hashes) for _ in own]
                else:
                    owner = np.repeat(np.fromiter(hashes, np.int64), [len(h) for h in hashes.values()])
                    among = candidates(mode, own, np.concatenate(list(hashes.values())), owner)
                for index, by in zip(own, among):
                    for i, some in by.items():
                        for k in index.verify(tokens[i], hashes[i], some):
                            yield index.items[k], ids[i]

        for pdf in batches:
            found: list[tuple] = []
            for at in range(0, len(pdf), _TOGETHER):
                some = pdf.iloc[at : at + _TOGETHER]
                found.extend(part(some["_doc"].tolist(), [plain(t) for t in some["_text"].tolist()]))
            yield pd.DataFrame(found, columns=["_item", "_doc"])

    return run


def _spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of each item's sentences: (``_i``, ``word``, ``sentence``)."""
    for pdf in batches:
        rows = []
        for i, p in zip(pdf["_i"].tolist(), pdf["_p"].tolist()):
            if not is_cjk(plain(p)):
                for _, own in _sentences(p, words):
                    rows.extend((i, w, " ".join(own)) for w in set(own))
        yield pd.DataFrame(rows, columns=["_i", "word", "sentence"])


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per block, from rows sorted by block: its indexes, pickled."""
    held: list[pd.DataFrame] = []

    def build() -> pd.DataFrame:
        pdf = pd.concat(held, ignore_index=True)
        cjk = [is_cjk(plain(p)) for p in pdf["_p"].tolist()]
        items = list(zip(pdf["_item"].tolist(), pdf["_p"].tolist()))
        telling = {w for ws in pdf["_words"].tolist() if ws is not None for w in ws}
        indexes = [Index(WORDS, [x for x, c in zip(items, cjk) if not c], telling), Index(LETTERS, [x for x, c in zip(items, cjk) if c], set())]
        return pd.DataFrame({"_block": [int(pdf["_block"].iloc[0])], "payload": [pickle.dumps(indexes)]})

    for pdf in batches:
        for b, rows in pdf.groupby("_block", sort=False):
            if held and held[0]["_block"].iloc[0] != b:
                yield build()
                held.clear()
            held.append(rows)
    if held:
        yield build()


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, passage: str, block: int = 2_000, exact: bool = False, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """(``item_id``, ``doc_id``) of every document that holds a sentence or a long run of a test passage.

    A run is 12 words or more (25 letters in text without spaces) of the passage; case, punctuation, accents,
    spacing, markup and one altered word within it do not count. Items are indexed in blocks of about ``block``;
    neither that nor the order of rows changes the result. Documents are searched whole. ``exact`` leaves the
    MinHash search out and verifies every pair that shares a shingle, for measuring the recall of the search.

    Sentences of fewer than 5 words (8 letters), and altered ones without 5 equal words in a row, are not found.

    Defined cases: null or empty texts and passages match nothing; repeated documents each count, as do items that
    share a sentence; a null id comes back as null; empty tables give no rows; further columns are ignored.
    """
    spark = documents.sparkSession
    schema = T.StructType([T.StructField("_item", items.schema[item_id].dataType), T.StructField("_doc", documents.schema[doc_id].dataType)])
    docs = documents.select(F.col(f"`{doc_id}`").alias("_doc"), F.col(f"`{text}`").alias("_text"))
    rows = items.select(F.col(f"`{item_id}`").alias("_item"), F.col(f"`{passage}`").alias("_p")).where(F.length("_p") > 0)
    rows = materialize(rows.withColumn("_i", F.monotonically_increasing_id()), "leak-items")
    n, chars = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_p")), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], schema).select(F.col("_item").alias(item_id), F.col("_doc").alias(doc_id))

    spoken = materialize(rows.select("_i", "_p").mapInPandas(_spoken, "_i long, word string, sentence string"), "leak-words")
    sentences = spoken.select("sentence").distinct().count()
    often = spoken.select("word", "sentence").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("_n"))
    telling = often.where(F.col("_n") <= max(TELLING, int(TELLING_SHARE * sentences))).select("word")
    own = spoken.select("_i", "word").distinct().join(telling, "word").groupBy("_i").agg(F.collect_list("word").alias("_words"))
    blocks = max(-(-n // block), -(-chars // BLOCK_CHARS))
    cut = rows.join(own, "_i", "left").withColumn("_block", F.pmod(F.xxhash64("_i"), F.lit(blocks)))
    index = materialize(cut.repartition("_block").sortWithinPartitions("_block", "_i").mapInPandas(_blocks, "_block long, payload binary"), "leak-index")

    out, load, size = [], [], 0
    search = lambda: docs.mapInPandas(_search(list(load), exact), schema)
    for r in index.toLocalIterator():  # a block at a time on its way to the workers
        if load and size + len(r["payload"]) > index_bytes:
            out.append(search())
            load, size = [], 0
        load.append(spark.sparkContext.broadcast(pickle.loads(r["payload"])))
        size += len(r["payload"])
    out.append(search())
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole.select(F.col("_item").alias(item_id), F.col("_doc").alias(doc_id)).distinct()
