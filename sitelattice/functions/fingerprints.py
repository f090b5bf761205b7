"""Perceptual fingerprints as Column expressions: 64-bit channel hashes and their distance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitelattice.functions import constants as C
from sitelattice.functions.urls import _text


def channel_mean(values) -> Column:
    """Integer mean of a channel's 64 samples."""
    v = _text(values)
    return F.floor(F.aggregate(v, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")) / F.size(v)).cast("long")


def channel_hash(values, mean: Column | None = None) -> Column:
    """Bit i is set where sample i is no less than the mean; as a signed 64-bit number.

    A channel of equal samples therefore has all bits set.
    """
    v = _text(values)
    both = F.struct(v.alias("v"), (channel_mean(v) if mean is None else mean).alias("level"))

    def hashed(x: Column) -> Column:  # of samples and mean that are each computed once
        bits = F.zip_with(x["v"], F.sequence(F.lit(0), F.size(x["v"]) - 1), lambda s, i: F.when(s >= x["level"], F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))

    return F.element_at(F.transform(F.array(both), hashed), 1)


def distance(a, b) -> Column:
    return F.bit_count(_text(a).bitwiseXOR(_text(b)))


def pixel_area(width, height) -> Column:
    return _text(width).cast("long") * _text(height).cast("long")


def is_near(left: dict[str, Column], right: dict[str, Column], bits: int = C.NEAR_BITS) -> Column:
    """Whether all three channels differ in at most ``bits`` bits."""
    out = F.lit(True)
    for channel in ("r", "g", "b"):
        out = out & (distance(left[channel], right[channel]) <= bits)
    return out
