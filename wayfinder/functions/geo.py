"""Distances and prices as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM, UNKNOWN_KM = 6371.0, 999999.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * RADIUS_KM * F.atan2(F.sqrt(h), F.sqrt(1 - h))


def geo_score(km: Column, decay: float = 25.0, unknown: float = 0.5) -> Column:
    return F.when(km.isNull(), F.lit(unknown)).otherwise(F.greatest(F.lit(0.0), 1 - km / decay))


def range_fit(price: Column, lo: Column, hi: Column) -> Column:
    low, high = F.least(lo, hi), F.greatest(lo, hi)
    span = F.greatest(F.lit(1.0), high - low)
    inside = F.greatest(F.lit(0.7), 1 - F.abs(price - (low + high) / 2) / span)
    return F.when(price < low, F.greatest(F.lit(0.0), 1 - (low - price) / span)).when(price > high, F.greatest(F.lit(0.0), 1 - (price - high) / span)).otherwise(inside)


def budget_fit(price: Column, etype: Column, lo: Column, hi: Column, daily: Column) -> Column:
    """How well a price fits the meal range and its share of a day's activity budget."""
    share = daily * F.when(etype == "restaurant", 0.3).when(etype == "attraction", 0.55).otherwise(1.0)
    cap = F.when(share.isNull(), 1.0).when(share <= 0, F.when(price <= 0, 1.0).otherwise(0.0)).when(price <= share, 1.0)
    cap = cap.otherwise(F.greatest(F.lit(0.0), share / F.greatest(price, F.lit(1.0))))
    return F.when((etype == "restaurant") & lo.isNotNull(), 0.6 * range_fit(price, lo, hi) + 0.4 * cap).otherwise(cap)
