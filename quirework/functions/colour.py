"""Colours: structs (r, g, b, a) of shares from 0 to 1, and 8-bit channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_bytes(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.struct(*[(c / F.lit(255.0)).alias(k) for k, c in zip("rgba", (r, g, b, a), strict=True)])


def to_bytes(colour: Column) -> Column:
    """Rounded half up, clamped to a byte."""
    return F.struct(*[F.least(F.greatest(F.floor(colour[k] * 255 + 0.5), F.lit(0)), F.lit(255)).cast("int").alias(k) for k in "rgba"])
