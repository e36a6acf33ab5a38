"""Boxes, radii and nearest points on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import haversine_km

KM_PER_DEGREE = 111.0


def in_box(df: DataFrame, south: float, west: float, north: float, east: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Borders included."""
    return df.where(F.col(lat).between(south, north) & F.col(lng).between(west, east))


def in_radius(df: DataFrame, at: tuple[float, float], km: float, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """The rows with distance_km, no more than ``km``. A box around the circle goes to the scan first, where it is one box."""
    dlat = km / KM_PER_DEGREE
    near = df
    if abs(at[0]) + dlat < 89:
        dlng = km / (KM_PER_DEGREE * math.cos(math.radians(abs(at[0]) + dlat)))
        near = in_box(df, at[0] - dlat, -180 if dlng >= 180 else at[1] - dlng, at[0] + dlat, 180 if dlng >= 180 else at[1] + dlng, lat, lng) if abs(at[1]) + dlng <= 180 or dlng >= 180 else near
    d = haversine_km(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lng))
    return near.withColumn("distance_km", d).where(F.col("distance_km") <= km)


def nearest(df: DataFrame, at: tuple[float, float], most: int, key: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Each task keeps its ``most`` nearest rows before any are moved."""
    d = haversine_km(F.lit(at[0]), F.lit(at[1]), F.col(lat), F.col(lng))
    return df.withColumn("distance_km", d).orderBy("distance_km", key).limit(most)


def parse_token(text: str) -> tuple[str, tuple[float, ...]]:
    """lat,lng,km as a radius, south,west,north,east as a box; ValueError for anything else."""
    numbers = tuple(float(x) for x in text.split(","))
    if len(numbers) not in (3, 4):
        raise ValueError("give lat,lng,km or south,west,north,east")
    return ("radius" if len(numbers) == 3 else "box"), numbers


def by_token(df: DataFrame, text: str, lat: str = "lat", lng: str = "lng") -> DataFrame:
    kind, n = parse_token(text)
    return in_radius(df, n[:2], n[2], lat, lng).drop("distance_km") if kind == "radius" else in_box(df, *n, lat=lat, lng=lng)
