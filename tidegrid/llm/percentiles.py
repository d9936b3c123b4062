"""Exact percentiles of very large columns by radix selection.

Values become order-preserving integers. A first pass counts the leading digit per group, a histogram that
adds up across partitions, files and days; the digit that holds a target rank is known from its running
counts, and only values with that digit are counted by the next one. With four digits of 16 bits the rank is
found exactly; stopping after fewer digits gives the value within a known relative error. No pass sorts or
collects values: each is a hash aggregation with map-side combine, so a hot group costs what others do.

Percentiles of several groupings (``scopes``) come from the same passes: rows are counted once per finest group,
and the counts of a coarser group are sums of those.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.floatkeys import from_key, to_key
from tidegrid.operators.common import lookup_join
from tidegrid.session import materialize

KEY_BITS = 64


def _digit(key: Column, shift: int, bits: int, first: bool) -> Column:
    # The first digit keeps the sign; later ones are the plain bits below it.
    d = F.shiftright(key, shift)
    return d if first else d.bitwiseAND(F.lit((1 << bits) - 1))


def radix_histogram(values: DataFrame, groups: list[str], value: str, bits: int = 24) -> DataFrame:
    """Counts per group and leading ``bits`` of the order-preserving key: (groups, ``digit``, ``n``).

    Histograms of parts of the data combine by :func:`merge_histograms`; ``bits`` leaves ``bits - 12`` of the
    fraction, so a percentile read from it is off by a factor of at most ``1 + 2 ** (12 - bits)``.
    Null and NaN values are not counted.
    """
    keyed = values.select(*groups, to_key(F.col(f"`{value}`")).alias("_key")).where(F.col("_key").isNotNull())
    return keyed.groupBy(*groups, F.shiftright("_key", KEY_BITS - bits).alias("digit")).agg(F.count(F.lit(1)).alias("n"))


def merge_histograms(parts: list[DataFrame], groups: list[str]) -> DataFrame:
    """One histogram from histograms of disjoint parts (days, files, clusters); ``groups`` may be coarser than theirs."""
    return reduce(DataFrame.unionByName, [p.select(*groups, "digit", "n") for p in parts]).groupBy(*groups, "digit").agg(F.sum("n").alias("n"))


def histogram_percentiles(histogram: DataFrame, groups: list[str], probs: list[float], bits: int = 24) -> DataFrame:
    """Percentiles of a (merged) histogram: (groups, ``p``, ``value``, ``n``), the nearest rank's bin centre in key space.

    The value with rank ``ceil(p * n)`` lies in the bin; the result differs from it by a factor of at most
    ``1 + 2 ** (12 - bits)`` (absolutely by 2**-1022 for subnormal numbers). No rows give no percentile.
    """
    w = Window.partitionBy(*groups).orderBy("digit")
    h = histogram.withColumn("_to", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("n").over(Window.partitionBy(*groups)))
    h = h.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    rank = F.greatest(F.ceil(F.col("p") * F.col("_all")), F.lit(1))
    h = h.where((rank <= F.col("_to")) & (rank > F.col("_to") - F.col("n")))
    shift = KEY_BITS - bits
    return h.select(*groups, "p", from_key(F.shiftleft(F.col("digit"), shift) + F.lit(1 << (shift - 1))).alias("value"), F.col("_all").alias("n"))


def radix_percentiles(values: DataFrame, groups: list[str], value: str, probs: list[float], digit_bits: int = 16, scopes: dict[str, list[str]] | None = None) -> DataFrame:
    """Exact percentiles per group: (groups, ``p``, ``value``, ``lower``, ``upper``, ``n``), with ``scopes`` also ``scope``.

    ``lower`` and ``upper`` are the values at the whole ranks around ``p * (n - 1)``, ``value`` the linear
    interpolation between them. ``scopes`` names groupings by some of ``groups`` each; columns that a scope leaves
    out are null in its rows.

    Keys are made once and written to the shared folder; those that share the first digit with a target, all that
    later digits look at, are written there too. Targets are at most ``2 * len(probs)`` rows per group.

    Defined cases: null and NaN values do not count, infinities do; a group without values gives no rows; null
    groups are a group; ties and repeated rows count each; -0.0 and 0.0 are one value; further columns are ignored.
    """
    if KEY_BITS % digit_bits:
        raise ValueError("digit_bits must divide 64")
    scoped = scopes or {"": groups}
    g = [f"_g{i}" for i in range(len(groups))]
    alias = dict(zip(groups, g))
    # Groups compare as text with a mark of their own for null.
    text = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")).alias(a) for c, a in alias.items()]
    rows = materialize(values.select(*text, to_key(F.col(f"`{value}`")).alias("_key")).where(F.col("_key").isNotNull()), "radix-keys")

    def of_scope(counts: DataFrame, name: str, by: list[str]) -> DataFrame:
        """``counts`` per group of a scope, ``*`` standing for the columns that it leaves out."""
        own = {alias[c] for c in scoped[name]}
        keep = [c if c in own else F.lit("*").alias(c) for c in g]
        return counts.select(F.lit(name).alias("_sc"), *keep, *by, "_c").groupBy("_sc", *g, *by).agg(F.sum("_c").alias("_c"))

    def of_scopes(counts: DataFrame, *by: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [of_scope(counts, n, list(by)) for n in scoped])

    shift = KEY_BITS - digit_bits
    counts = materialize(rows.groupBy(*g, _digit(F.col("_key"), shift, digit_bits, True).alias("_d")).agg(F.count(F.lit(1)).alias("_c")), "radix-counts")
    counts = of_scopes(counts, "_d")
    w = Window.partitionBy("_sc", *g).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("_to", F.sum("_c").over(w)).withColumn("_n", F.sum("_c").over(Window.partitionBy("_sc", *g)))
    ranks = F.array(*[f(F.lit(float(p)) * (F.col("_n") - 1)).cast("long") for p in probs for f in (F.floor, F.ceil)])
    targets = counts.withColumn("_rank", F.explode(F.array_distinct(ranks)))
    # _below: values of the group that sort before the digit followed.
    targets = targets.where((F.col("_rank") < F.col("_to")) & (F.col("_rank") >= F.col("_to") - F.col("_c")))
    targets = targets.select("_sc", *g, "_n", "_rank", (F.col("_to") - F.col("_c")).alias("_below"), F.col("_d").alias("_prefix"))
    shared = [alias[c] for c in groups if all(c in s for s in scoped.values())]
    while shift > 0:
        lower = shift - digit_bits
        targets = materialize(targets, "radix-targets")  # a few rows per group; the next pass starts from the table
        follow = materialize(targets.select(*shared, "_prefix").distinct(), "radix-follow")
        rows = lookup_join(rows.select(*g, "_key", F.shiftright("_key", shift).alias("_prefix")), follow, [*shared, "_prefix"], "left_semi")
        if shift == KEY_BITS - digit_bits:
            rows = materialize(rows.select(*g, "_key", "_prefix"), "radix-candidates")
        counts = of_scopes(rows.groupBy(*g, "_prefix", _digit(F.col("_key"), lower, digit_bits, False).alias("_d")).agg(F.count(F.lit(1)).alias("_c")), "_prefix", "_d")
        rows = rows.drop("_prefix")
        w = Window.partitionBy("_sc", *g, "_prefix").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        counts = counts.withColumn("_to", F.sum("_c").over(w))
        found = targets.join(counts, ["_sc", *g, "_prefix"]).where((F.col("_rank") - F.col("_below") < F.col("_to")) & (F.col("_rank") - F.col("_below") >= F.col("_to") - F.col("_c")))
        targets = found.select("_sc", *g, "_n", "_rank", (F.col("_below") + F.col("_to") - F.col("_c")).alias("_below"), (F.shiftleft(F.col("_prefix"), digit_bits) + F.col("_d")).alias("_prefix"))
        shift = lower
    found = targets.select("_sc", *g, "_n", "_rank", from_key(F.col("_prefix")).alias("_v")).groupBy("_sc", *g, "_n").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"))
    found = found.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
    pos = F.col("p") * (F.col("_n") - 1)
    lo, hi = F.col("_at")[F.floor(pos).cast("long")], F.col("_at")[F.ceil(pos).cast("long")]
    frac = pos - F.floor(pos)
    # Equal ends stay as they are, so infinities do not meet their own difference.
    v = F.when(lo == hi, lo).otherwise(lo + (hi - lo) * frac)
    named = [F.when(F.col(a).startswith("="), F.substring(a, 2, 1 << 30)).cast(values.schema[c].dataType).alias(c) for c, a in alias.items()]
    out = found.select(*([F.col("_sc").alias("scope")] if scopes else []), *named, "p", v.alias("value"), lo.alias("lower"), hi.alias("upper"), F.col("_n").alias("n"))
    return out
