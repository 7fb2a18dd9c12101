"""Column expressions on coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Radii of the earth in km (distances) and m (projection).
EARTH_KM, EARTH_M = 6371.0, 6371008.8


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; the argument of asin is clamped to [0, 1]."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))))


def project_m(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """Metres east and north of the centre of a box (lon0, lat0, lon1, lat1), equirectangular."""
    lat0, lon0 = (bbox[1] + bbox[3]) / 2, (bbox[0] + bbox[2]) / 2
    return EARTH_M * math.cos(math.radians(lat0)) * F.radians(lon - lon0), EARTH_M * F.radians(lat - lat0)


def idw_weight(km: Column, power: float, floor_km: float = 0.05) -> Column:
    return F.pow(F.greatest(km, F.lit(floor_km)), F.lit(-float(power)))


def exponential_variogram(km: Column, nugget: float, sill: float, reach: float) -> Column:
    """sill is the part above the nugget; 95 % of it is reached at `reach`."""
    return F.lit(nugget) + F.lit(sill) * (1 - F.exp(-3 * km / reach))


def beyond(x: Column, lo: float, hi: float) -> Column:
    """How far x lies outside [lo, hi]; 0 within."""
    return F.greatest(F.lit(lo) - x, F.lit(0.0), x - F.lit(hi))


def cell(x: Column, lo: float, hi: float, n: int) -> Column:
    """Index of the nearest of n cell centres, the lower one at a tie."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.ceil((x - lo) / ((hi - lo) / n)) - 1)).cast("int")
