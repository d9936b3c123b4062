"""Order-preserving integers for doubles and back, a whole Arrow batch at a time.

A double is sign, exponent and fraction; its bits read as one integer sort like the numbers themselves once
negative ones are mirrored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_MAGNITUDE = np.int64(2**63 - 1)


def keys_of(x: np.ndarray) -> np.ndarray:
    """The key of each double, which must not be NaN: its bits, those of negative numbers as minus the magnitude."""
    bits = np.ascontiguousarray(x, np.float64).view(np.int64)
    return np.where(bits < 0, -(bits & _MAGNITUDE), bits)


def doubles_of(k: np.ndarray) -> np.ndarray:
    """The double of each key."""
    size = np.abs(k).view(np.float64)
    return np.where(k < 0, -size, size)


def to_key(x: Column) -> Column:
    """BIGINT that sorts as ``x``; ``-0.0`` equals ``0.0``; infinities are the extremes; null and NaN give null."""

    @F.arrow_udf("long")
    def key(v: pa.Array) -> pa.Array:
        plain = v.to_numpy(zero_copy_only=False)  # null as NaN
        return pa.array(keys_of(plain), mask=np.isnan(plain))

    return key(x.cast("double"))


def from_key(k: Column) -> Column:
    """The double whose :func:`to_key` is ``k``; null for null."""

    @F.arrow_udf("double")
    def value(v: pa.Array) -> pa.Array:
        absent = v.is_null().to_numpy(zero_copy_only=False)
        return pa.array(doubles_of(v.fill_null(0).to_numpy(zero_copy_only=False)), mask=absent)

    return value(k)
