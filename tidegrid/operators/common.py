"""Joins against tables of unproven size, and the current row of a rewritten reading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side of a join is broadcast only if it has been counted and holds at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32 << 20
#: Copies of the unique side where neither that holds nor the session splits skewed joins by itself.
SALTS = 16


def _width(df: DataFrame) -> Column:
    """Bytes of a row, near enough: text by its length, nested values by theirs as JSON."""
    parts: list[Column] = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c), F.lit(0)) + 8)
        elif isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0)) + 8)
        else:
            parts.append(F.lit(8))
    return sum(parts[1:], parts[0]).cast("long")


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` is within the bounds of a broadcast; at most ``rows + 1`` rows of it are looked at."""
    n, b = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(_width(df)), F.lit(0))).first()
    return n <= rows and b <= size


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", broadcast_rows: int = BROADCAST_ROWS, salts: int | None = None) -> DataFrame:
    """``big`` joined with ``small``, whose ``on`` columns are unique, safe against hot keys in ``big``.

    ``small`` is measured and broadcast if it is within the bounds. Beyond them the join is a shuffle, in which
    adaptive execution splits hot keys into as many tasks as their size asks for; where the session has that
    switched off, or ``salts`` is given, every row of ``small`` is copied to so many sub-keys and ``big`` spread
    over them. Repeat ``small`` cheaply: it is measured before it is joined.
    """
    conf = big.sparkSession.conf
    if is_small(small, broadcast_rows):
        return big.join(F.broadcast(small), on, how)
    if salts is None and conf.get("spark.sql.adaptive.enabled") == "true" and conf.get("spark.sql.adaptive.skewJoin.enabled") == "true":
        return big.join(small, on, how)
    salts = salts or SALTS
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c, t in big.dtypes if not t.startswith(("map", "array", "struct"))]), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", spread).join(copies, [*on, "_salt"], how).drop("_salt")


def current_rows(samples: DataFrame, keys: list[str], ts: str = "ts", value: str = "value", seq: str = "seq", carry: list[str] | None = None) -> DataFrame:
    """The last written value of each (keys, ts): the row with the highest ``seq``.

    A hash aggregation with map-side combine, so any number of rewrites of one reading is folded before the
    shuffle. Rows of equal ``seq`` give the value that Spark meets first; rows whose ``seq`` is null lose
    against any other and give a null value if alone. ``carry`` names fixed-width columns that depend on the keys.
    """
    return samples.groupBy(*keys, ts).agg(F.max_by(value, seq).alias(value), *[F.max(c).alias(c) for c in carry or []])
