"""Colour arithmetic on columns of '#rrggbb' texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(colour: Column) -> list[Column]:
    return [F.conv(F.substring(colour, i, 2), 16, 10).cast("int") for i in (2, 4, 6)]


def luminance(colour: Column) -> Column:
    """Relative luminance of sRGB."""
    linear = lambda c: F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))
    return sum((w * linear(c / 255) for w, c in zip((0.2126, 0.7152, 0.0722), channels(colour))), F.lit(0.0))


def contrast(a: Column, b: Column) -> Column:
    hi, lo = F.greatest(luminance(a), luminance(b)), F.least(luminance(a), luminance(b))
    return (hi + 0.05) / (lo + 0.05)


def mixed(a: Column, b: Column, share: float) -> Column:
    """The colour `share` of the way from a to b."""
    part = lambda x, y: F.lpad(F.lower(F.hex(F.floor(x + (y - x) * share + 0.5).cast("bigint"))), 2, "0")
    return F.concat(F.lit("#"), *[part(x, y) for x, y in zip(channels(a), channels(b))])
