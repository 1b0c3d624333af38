"""Numbers: rounding that agrees across engines, clamps, bands, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def rounded(x: Column, places: int = 2) -> Column:
    """x to `places` decimals by way of a decimal, half up. Doubles rounded in place differ between engines."""
    return F.round(x.cast("decimal(28,10)"), places).cast("double")


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def banded(x: Column, bands: tuple[tuple[float, object], ...]) -> Column:
    """The label of the first band (from, label), highest first, that x reaches; null for a null x."""
    out = F.when(x.isNull(), F.lit(None))
    for least, label in bands:
        out = out.when(x >= least, F.lit(label)) if least != float("-inf") else out.otherwise(F.lit(label))
    return out


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere of EARTH_KM radius; latitudes and longitudes in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
