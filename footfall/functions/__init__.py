"""Scalar expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import BILLING_PREFIXES, ENTRY_CAMERA_PREFIXES


def is_billing_zone(zone: Column) -> Column:
    """Whether a zone name marks the billing area; null is not."""
    return F.coalesce(F.upper(zone).rlike("^(" + "|".join(BILLING_PREFIXES) + ")"), F.lit(False))


def is_entry_camera(camera: Column) -> Column:
    return F.upper(camera).rlike("^(" + "|".join(ENTRY_CAMERA_PREFIXES) + ")")


def camera_number(camera: Column) -> Column:
    """The last all-digit part of a camera name, or null."""
    return F.try_element_at(F.filter(F.split(camera, "_"), lambda p: p.rlike("^[0-9]+$")), F.lit(-1)).cast("int")


def half_even(value: Column, digits: int = 0) -> Column:
    return F.bround(value, digits)


def text_number(value: Column, digits: int) -> Column:
    """A number as text with so many decimals, ties to even (Java's formatter rounds ties up)."""
    return F.when(value.isNotNull(), F.format_string(f"%.{digits}f", F.bround(value, digits)))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded half to even; 0 where the whole is 0."""
    return F.when(whole > 0, F.bround(part / whole, digits)).otherwise(F.lit(0.0))


def clamp(value: Column, low: float, high: float) -> Column:
    """The value held within the bounds; null stays null (greatest and least alone would skip it)."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for nulls, unequal lengths or a norm under 1e-8."""
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    fits = (F.size(a) == F.size(b)) & (na >= 1e-8) & (nb >= 1e-8)
    return F.when(F.coalesce(fits, F.lit(False)), dot(a, b) / (na * nb)).otherwise(F.lit(0.0))
