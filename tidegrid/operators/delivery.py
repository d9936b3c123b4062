"""Messages delivered at least once: exactly one copy of each.

A hash aggregation by identifier keeps the row with the least order: ``min_by`` of the unique row id over
delivery time and row id. A struct of the two would make Spark sort, as hash buffers hold fixed-width values only,
so the pair is one decimal of 38 digits. Map-side partial aggregation folds copies within a task before the
shuffle, so a message that makes up a third of all rows costs one row per task. Which rows are copies follows
by an anti join on the unique row id, where no key is hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.common import lookup_join
from tidegrid.session import materialize

#: What stands for a missing delivery time: before any that a timestamp can have.
_NEVER = -(10**18)


def _rank(df: DataFrame, order: list[str], row_id: str) -> Column:
    """The order of a row and its id as one value of fixed width; a struct for orders that do not fit into one."""
    if not order:
        return F.col(f"`{row_id}`")
    kind = df.schema[order[0]].dataType
    by = F.col(f"`{order[0]}`")
    if len(order) > 1 or not isinstance(df.schema[row_id].dataType, (T.LongType, T.IntegerType)) or not isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType, T.IntegerType)):
        return F.struct(*[F.col(f"`{c}`") for c in (*order, row_id)])
    number = by.cast("long") if isinstance(kind, T.IntegerType) else F.unix_micros(by.cast("timestamp"))
    high = F.coalesce(number, F.lit(_NEVER)).cast("decimal(19,0)") * F.lit(str(2**64)).cast("decimal(20,0)")
    return (high.cast("decimal(38,0)") + F.col(f"`{row_id}`").cast("decimal(20,0)")).cast("decimal(38,0)")


def first_copies(df: DataFrame, identifier: list[str], row_id: str, order: list[str]) -> DataFrame:
    """(``_id0``, …, ``row_id``) of the first copy of every message: least by ``order``, then by ``row_id``.

    With at most one order column, a time or an INT, the plan is a plain hash aggregation. Null identifiers are a
    value like any other, a null order comes first; ``row_id`` must be a unique integer that is not null.
    """
    rows = df.select(*[F.col(f"`{c}`").alias(f"_id{i}") for i, c in enumerate(identifier)], F.col(f"`{row_id}`").alias("_row"), _rank(df, order, row_id).alias("_rank"))
    return rows.groupBy(*[f"_id{i}" for i in range(len(identifier))]).agg(F.min_by("_row", "_rank").alias(row_id))


def deduplicate(df: DataFrame, identifier: list[str], row_id: str, order: list[str]) -> DataFrame:
    """Exactly one row per identifier, whole: the one delivered first (least ``order``, ties by ``row_id``).

    Defined cases: a null in the identifier is an ordinary value, so rows whose ids are all null are one message;
    a null order sorts first; an empty table stays empty; columns of any other name pass through unchanged.
    """
    keep = first_copies(df, identifier, row_id, order).select(row_id)
    return df.join(keep, row_id, "left_semi")


def sample_set(samples: Column) -> Column:
    """A 256-bit fingerprint of an array of (ts, value) as a set: order and repetition do not count, -0.0 is 0.0.

    A null array, an empty one and one with null elements are three different sets.
    """
    plain = F.transform(samples, lambda s: F.when(s.isNotNull(), F.concat_ws(":", F.coalesce(s["ts"].cast("string"), F.lit("-")), F.coalesce((s["value"] + F.lit(0.0)).cast("string"), F.lit("-")))).otherwise(F.lit("null")))
    return F.sha2(F.coalesce(F.concat(F.lit("="), F.array_join(F.array_sort(F.array_distinct(plain)), ",")), F.lit("none")), 256)


def repeated_messages(entries: DataFrame, row_id: str, producer: str, message_id: str, content: list[str]) -> DataFrame:
    """The ``row_id`` of every entry whose message also stands in an entry with a smaller ``row_id``.

    Two entries carry one message if producer and ``message_id`` are equal or, where at least one of them has no
    ``message_id``, if producer and ``content`` are equal (fixed-width or string columns, nulls equal to nulls).

    An entry with an id repeats if it is not the first of its (producer, id), or if an entry without id and with
    its content came before it; one without id repeats if it is not the first of its content.
    """
    e = entries.select(F.col(row_id).alias("_row"), F.col(producer).alias("_p"), F.col(message_id).alias("_m"), F.unhex(F.sha2(F.to_json(F.struct(*content)), 256)).alias("_c"))
    # Ids and contents are spelled out once; the table of them is all that is read from here on.
    e = materialize(e, "delivered")
    named = e.where(F.col("_m").isNotNull())
    again = named.join(first_copies(named, ["_p", "_m"], "_row", []).select("_row"), "_row", "left_anti").select("_row")

    # Of the contents that came without id at least once: the first row with an id, the first without.
    has_id = F.col("_m").isNotNull()
    contents = e.groupBy("_p", "_c").agg(F.min(F.when(has_id, F.col("_row"))).alias("_named"), F.min(F.when(~has_id, F.col("_row"))).alias("_bare"))
    contents = materialize(contents.where(F.col("_bare").isNotNull()), "delivered-bare")
    kept = contents.where(F.col("_named").isNull() | (F.col("_named") > F.col("_bare"))).select(F.col("_bare").alias("_row"))
    bare_again = e.where(~has_id).join(kept, "_row", "left_anti").select("_row")
    # Null producers are equal here; content may be shared by many ids (heartbeats), which the lookup is safe against.
    key = F.coalesce(F.concat(F.lit("="), "_p"), F.lit("-"))
    bare = contents.select(key.alias("_k"), "_c", "_bare")
    named_after = lookup_join(named.select("_row", key.alias("_k"), "_c"), bare, ["_k", "_c"]).where(F.col("_row") > F.col("_bare")).select("_row")
    return again.unionByName(bare_again).unionByName(named_after).distinct().select(F.col("_row").alias(row_id))


def without_repeats(entries: DataFrame, row_id: str, producer: str, message_id: str, content: list[str]) -> DataFrame:
    """The entries, with and without ``message_id``, less those of :func:`repeated_messages`, whole.

    An entry goes if any entry with a smaller ``row_id`` carries its message, be that one a repeat itself: two ids
    of equal content with an entry without id between them leave the first entry only.
    """
    return entries.join(repeated_messages(entries, row_id, producer, message_id, content), row_id, "left_anti")
