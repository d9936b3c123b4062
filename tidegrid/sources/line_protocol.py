"""Lines ``metric,label=v,… [value=]N [time]`` as samples, all in expressions, so batch and stream read them alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.schema import series_key

#: Fixed value: a time above this is nanoseconds.
_NANOS_ABOVE = 10**15
_FLOAT = r"(?i)\A[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:e[+-]?[0-9]+)?|inf|infinity|nan)\z"
# White space as Unicode has it.
_SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _number(text: Column) -> Column:
    """A float text as a double; null if it is none or too large for one."""
    t = F.lower(text)
    special = F.when(t.rlike(r"^[+]?inf"), F.lit(float("inf"))).when(t.rlike(r"^-inf"), F.lit(float("-inf"))).when(t.rlike(r"^[+-]?nan"), F.lit(float("nan")))
    plain = F.when(text.rlike(_FLOAT), text).try_cast("double")
    return F.when(~text.rlike(_FLOAT), None).when(special.isNotNull(), special).when(F.abs(plain) != F.lit(float("inf")), plain)


def parse_lines(lines: DataFrame, now_ms: int | Column, on_error: str = "fail", line: str = "value", seq: str | None = None) -> DataFrame:
    """Samples (``metric``, ``labels``, ``series_key``, ``ts``, ``value``, ``seq``) of a table of lines.

    Blank lines and those that begin with ``#`` are skipped. A first field is split at commas without escapes;
    parts without ``=`` are dropped, of a repeated label the last stays. Fields after the third are ignored; a
    missing time is ``now_ms``. With ``on_error`` 'fail' a bad line ends the job (of several, whichever task meets its own first), with 'quarantine' the
    column ``error`` names what is wrong (null for good lines) and ``line`` holds the text.
    """
    trimmed = F.regexp_replace(F.regexp_replace(F.col(f"`{line}`"), r"\A" + _SPACE, ""), _SPACE + r"\z", "")
    src = lines.select(trimmed.alias("line"), (F.col(seq) if seq else F.lit(None)).cast("long").alias("seq")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    f = src.withColumn("_f", F.split("line", _SPACE))
    head = F.split(F.col("_f")[0], ",", -1)
    pairs = F.filter(F.slice(head, 2, F.greatest(F.size(head) - 1, F.lit(0))), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(pairs, lambda p: F.regexp_replace(p, r"(?s)\A[^=]*=", ""))
    # The last of equal keys: a pair stays if its key does not come again behind it.
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    f = f.select("line", "seq", "_f", head[0].alias("metric"), entries.alias("_e"))
    f = f.withColumn("_e", F.filter("_e", lambda e, i: ~F.exists(F.slice(F.col("_e"), i + 2, F.greatest(F.size("_e") - i - 1, F.lit(0))), lambda later: later["k"] == e["k"])))
    raw = F.regexp_replace(F.get("_f", F.lit(1)), r"\Avalue=", "")
    when = F.get("_f", F.lit(2))
    number = when.try_cast("long")
    whole = when.rlike(r"\A[+-]?[0-9]+\z") & number.isNotNull()
    f = f.withColumn("value", _number(raw))
    now = F.lit(now_ms).cast("long") if isinstance(now_ms, int) else now_ms
    f = f.withColumn("ts", F.when(when.isNull(), now).when(whole & (number > _NANOS_ABOVE), F.expr("try_cast(get(_f, 2) as bigint) div 1000000")).when(whole, number))
    error = (
        F.when(F.size("_f") < 2, F.concat(F.lit("invalid line protocol: "), "line"))
        .when(F.col("value").isNull(), F.concat(F.lit("invalid value: "), raw))
        .when(F.col("ts").isNull(), F.concat(F.lit("invalid timestamp: "), when))
    )
    out = f.withColumn("labels", F.map_from_entries(F.transform("_e", lambda e: F.struct(e["k"], e["v"]))))
    columns = ["metric", "labels", series_key(F.col("metric"), F.col("labels")).alias("series_key"), "ts", "value", "seq"]
    if on_error == "quarantine":
        return out.withColumn("error", error).select(*columns, "error", "line")
    checked = F.when(error.isNotNull(), F.raise_error(error).cast("string")).otherwise(F.col("metric"))
    return out.withColumn("metric", checked).select(*columns)


def to_lines(samples: DataFrame) -> DataFrame:
    """Samples as lines (``value``), labels by key; the way back of :func:`parse_lines` for texts without separators."""
    parts = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    text = F.concat(F.array_join(F.concat(F.array(F.col("metric")), parts), ","), F.lit(" value="), F.col("value").cast("string"), F.lit(" "), F.col("ts").cast("string"))
    return samples.select(text.alias("value"), "seq")
