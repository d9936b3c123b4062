"""Canonical spellings of series hashes, resolutions, message ids and durations, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rollup resolutions and their lengths in milliseconds.
RESOLUTION_MS = {"1m": 60_000, "5m": 300_000, "1h": 3_600_000}


def series_hash(c: Column) -> Column:
    """A 64-bit series hash as 16 lower-case hex digits.

    Accepts hex in any case with or without ``0x`` and, if longer than 16 characters without ``0x``, the same
    unsigned number in decimal. Text that is neither comes back trimmed and lower-cased; null stays null.
    """
    t = F.lower(F.trim(c))
    digits = F.regexp_replace(t, r"^0x", "")
    is_hex = digits.rlike(r"\A[0-9a-f]{1,16}\z")
    is_dec = t.rlike(r"\A0*[0-9]{1,20}\z") & (F.length(t) > 16)
    number = F.when(is_dec, t).otherwise(F.lit("0")).cast("decimal(38,0)")
    fits = number <= F.lit("18446744073709551615").cast("decimal(38,0)")
    as_text = F.when(is_dec & fits, number.cast("string")).otherwise(F.lit("0"))
    from_dec = F.lpad(F.lower(F.conv(as_text, 10, 16)), 16, "0")
    # The common spelling first: the other branches are then not evaluated.
    return F.when(c.rlike(r"\A[0-9a-f]{16}\z"), c).when(t.startswith("0x") & is_hex, F.lpad(digits, 16, "0")).when(is_dec & fits, from_dec).when(is_hex, F.lpad(digits, 16, "0")).otherwise(t)


def duration_ms(c: Column) -> Column:
    """Milliseconds of duration text made of ``h``, ``m`` and ``s`` parts (``1h0m0s``, ``300s``, ``60M``); null if it is none."""
    t = F.lower(F.trim(c))
    ok = t.rlike(r"\A(?=.)(?:[0-9]{1,9}h)?(?:[0-9]{1,9}m)?(?:[0-9]{1,9}s)?\z")

    def part(unit: str, ms: int) -> Column:
        n = F.regexp_extract(t, rf"([0-9]{{1,9}}){unit}", 1)
        return F.when(ok & (n != ""), n).otherwise(F.lit("0")).cast("long") * F.lit(ms)

    return F.when(ok, part("h", 3_600_000) + part("m", 60_000) + part("s", 1_000))


def resolution(c: Column) -> Column:
    """``1m``, ``5m`` or ``1h`` for any spelling of these lengths; other text comes back trimmed and lower-cased."""
    ms = duration_ms(c)
    out = F.lower(F.trim(c))
    plain = F.lower(c)
    for name, length in RESOLUTION_MS.items():
        out = F.when(ms == length, F.lit(name)).otherwise(out)
    return F.when(plain.isin(*RESOLUTION_MS), plain).otherwise(out)


def resolution_length(c: Column) -> Column:
    """Milliseconds of a resolution text in any spelling; null where it is not a positive duration."""
    ms = duration_ms(c)
    out = F.when(ms > 0, ms)
    for name, length in RESOLUTION_MS.items():
        out = F.when(c == name, F.lit(length).cast("long")).otherwise(out)
    return out


def hex_number(c: Column) -> Column:
    """The number that the hex digits of an id spell, as lower-case digits without leading zeros.

    ``0x``, spaces, dashes, braces and other separators do not count. Null if there is no digit.
    """
    t = F.regexp_replace(F.lower(c), r"^[^0-9a-z]*0x", "")
    digits = F.regexp_replace(t, r"[^0-9a-f]", "")
    return F.when(digits != "", F.regexp_replace(digits, r"^0+(?=.)", ""))


def is_finite(c: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
