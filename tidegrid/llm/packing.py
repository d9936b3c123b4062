"""Filling containers of fixed capacity with items: vector best fit.

An item is a vector of tokens, one document and attention cost (tokens squared); a container has a capacity in
each. Items are taken by falling size; the container is the one, of those with room under every constraint,
with the greatest weighted dot product of item and room, room taken to length 1 (or the least weighted norm of
what remains). Weights are how scarce each capacity is for the items at hand. For the dot product as many containers
are open from the start as the scarcest capacity asks for, so large items do not crowd into containers whose
other capacities then stay unused.

Items are dealt by hash to blocks of a fixed size, so each sees the common mix of sizes and no task holds more than
a block. What stays underfilled at the end of its block is dealt anew and packed with its like, round by round,
until one block is left. Blocks depend on the items only, so the result does on neither partitions nor arrival.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.session import materialize

_encoders: dict[str, object] = {}


def encoder(path: str, pattern: str):
    """A byte-level BPE of a public rank file (base64 token and rank per line), kept per process."""
    if path not in _encoders:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_count(text: Column, path: str, pattern: str) -> Column:
    """Tokens of the whole text; 0 for null or empty text. Strings of special tokens are ordinary text."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoder(path, pattern)
        for s in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in s.tolist()], dtype="int64")

    return count(text)


class Packer:
    """Open containers and their room, in units of the capacity. :meth:`place` returns the number of an item's container."""

    def __init__(self, items: np.ndarray, rule: str, weights: tuple[float, ...] | None = None):
        """``items`` are in units of the capacity; those that fit into no container are not to be placed."""
        demand = items.sum(axis=0)
        self.weights = np.asarray(weights, float) if weights else demand / max(demand.max(initial=0.0), 1e-300)
        self.rule, self.made = rule, 0
        self.room, self.number = np.empty((0, 3)), np.empty(0, np.int64)
        self._open(int(np.ceil(demand.max(initial=0.0) - 1e-9)) if rule == "dot" else 0)

    def _open(self, n: int) -> None:
        self.room = np.concatenate([self.room, np.ones((n, 3))])
        self.number = np.concatenate([self.number, np.arange(self.made, self.made + n)])
        self.made += n

    def place(self, item: np.ndarray) -> int:
        fits = np.flatnonzero((self.room >= item - 1e-12).all(axis=1))
        if not len(fits):
            self._open(1)
            best = len(self.number) - 1
        elif self.rule == "dot":
            room = self.room[fits] * self.weights
            best = fits[np.argmax(room @ (item * self.weights) / np.sqrt(np.einsum("ij,ij->i", room, room) + 1e-300))]
        else:
            rest = (self.room[fits] - item) * self.weights
            best = fits[np.argmin(np.einsum("ij,ij->i", rest, rest))]
        self.room[best] -= item
        return int(self.number[best])

    def close(self, least: np.ndarray) -> None:
        """Forget containers that an item of ``least`` does not fit into."""
        keep = (self.room >= least - 1e-12).all(axis=1)
        self.room, self.number = self.room[keep], self.number[keep]


def _pack(capacity: np.ndarray, weights: tuple[float, ...] | None, rule: str, open_share: float, final: bool):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        """One block, its pieces by falling size."""
        sizes = pdf["_n"].to_numpy(np.float64)
        items = np.stack([sizes, np.ones(len(sizes)), sizes * sizes], axis=1) / capacity
        fits = (items <= 1).all(axis=1)
        packer = Packer(items[fits], rule, weights)
        got = np.empty(len(items), np.int64)
        # Pieces that alone exceed a limit stand alone.
        got[~fits] = -1 - np.arange((~fits).sum())
        smallest = items[fits].min(axis=0) if fits.any() else np.zeros(3)
        for k, i in enumerate(np.flatnonzero(fits).tolist()):
            if k % 256 == 255:
                packer.close(smallest)
            got[i] = packer.place(items[i])
        number, first, at = np.unique(got, return_index=True, return_inverse=True)
        used = np.stack([np.bincount(at, weights=items[:, d]) for d in range(3)], axis=1)
        unused = np.where((number < 0) | (1 - used[:, 1] < 1 / capacity[1] - 1e-9) | (used[:, 2] > 0.99), 0.0, 1 - used[:, 0])
        labels = (pdf["_id"].astype(str) + "-" + pdf["_piece"].astype(str)).to_numpy(object)
        pdf["container"] = labels[first][at]
        pdf["again"] = False if final else unused[at] > open_share
        return pdf.drop(columns="_block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            for b, rows in pdf.groupby("_block", sort=False):
                if held and held[0]["_block"].iloc[0] != b:
                    yield work(pd.concat(held, ignore_index=True))
                    held = []
                held.append(rows)
        if held:
            yield work(pd.concat(held, ignore_index=True))

    return run


def pack(
    items: DataFrame,
    item_id: str,
    tokens: str,
    capacity: int = 2048,
    max_items: int = 256,
    max_attention: int | None = None,
    weights: tuple[float, float, float] | None = None,
    rule: str = "dot",
    block: int = 8192,
    open_share: float = 0.02,
) -> DataFrame:
    """Every item in containers: (``item_id``, ``piece``, ``first_token``, ``tokens``, ``container``).

    A container holds at most ``capacity`` tokens, ``max_items`` pieces and ``max_attention`` (default
    ``capacity ** 2``, which tokens reach first) of summed squared tokens. Only an item of more than ``capacity``
    tokens is split, into pieces of the capacity and a rest; a piece that alone exceeds a limit has a container to
    itself. Containers that could take more and have over ``open_share`` unused go through another round.
    ``container`` is the label of its first piece.

    Defined cases: null, negative or zero ``tokens`` are an item of 0 tokens, still assigned once; repeated ids
    must not occur (labels would clash); an empty table gives no rows; further columns are ignored.
    """
    limits = np.array([capacity, max_items, max_attention or capacity**2], float)
    kind = items.schema[item_id].dataType.simpleString()
    n = F.greatest(F.coalesce(F.col(f"`{tokens}`").cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(n / F.lit(capacity)), F.lit(1)).cast("long") - 1
    pieces = items.select(F.col(f"`{item_id}`").alias("_id"), n.alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("_piece"))
    pieces = pieces.select("_id", "_piece", F.least(F.lit(capacity), F.col("_all") - F.col("_piece") * F.lit(capacity)).alias("_n"))
    # Sizes may be dear to find (tokenizers): they are found once.
    rest = materialize(pieces, "packing-sizes")
    waiting, before, done, turn = rest.count(), None, None, 0
    tasks = 10 * int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while done is None or waiting:
        blocks = max(1, -(-waiting // block))
        # Another round must at least halve what is open; else, or with one block, this one is the last.
        final = blocks == 1 or (before is not None and 2 * waiting > before)
        dealt = rest.withColumn("_block", F.pmod(F.xxhash64("_id", "_piece", F.lit(turn)), F.lit(blocks)))
        dealt = dealt.repartition(min(blocks, tasks), "_block").sortWithinPartitions("_block", F.desc("_n"), "_id", "_piece")
        packed = materialize(dealt.mapInPandas(_pack(limits, weights, rule, open_share, final), f"_id {kind}, _piece long, _n long, container string, again boolean"), "packing")
        ended = packed.where(~F.col("again"))
        done = ended if done is None else done.unionByName(ended)
        rest = packed.where("again").select("_id", "_piece", "_n")
        before, waiting, turn = waiting, rest.count(), turn + 1
    return done.select(F.col("_id").alias(item_id), F.col("_piece").alias("piece"), (F.col("_piece") * F.lit(capacity)).alias("first_token"), F.col("_n").alias("tokens"), "container")
