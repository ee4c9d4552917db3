"""Coordinates: parsing, regions, scaling, features."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from specimen_spark.fixed_values import (
    NORMALIZE_BOUNDS, REGION_BOXES, SERVICE_BOX, US_COUNTRY, US_STATES,
)
from specimen_spark.functions.numbers import is_finite, parse_float_finite
from specimen_spark.functions.text import as_column, let, normalize_country, normalize_state


def _point(lat: Column, lon: Column) -> Column:
    return F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))


def parse_geopoint_struct(c) -> Column:
    value = as_column(c)
    lat, lon = value["lat"], value["lon"]
    return F.when(lat.isNotNull() & lon.isNotNull(), _point(lat, lon))


def parse_geopoint_array(c) -> Column:
    """``[lon, lat, ...]``."""
    value = as_column(c)
    lon, lat = F.get(value, F.lit(0)), F.get(value, F.lit(1))
    return F.when((F.size(value) >= 2) & lat.isNotNull() & lon.isNotNull(), _point(lat, lon))


def parse_geopoint_text(c) -> Column:
    """First two numbers as (lat, lon) when they fit, swapped when only that fits."""
    found = F.transform(
        F.regexp_extract_all(as_column(c), F.lit(r"(-?\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.try_cast("double")
    )

    def choose(numbers: Column) -> Column:
        first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
        return F.when(
            first.between(-90, 90) & second.between(-180, 180), _point(first, second)
        ).when(first.between(-180, 180) & second.between(-90, 90), _point(second, first))

    return let(found, choose)


def classify_region(lat, lon) -> Column:
    lat, lon = as_column(lat), as_column(lon)
    region = F.lit("")
    for name, lat_min, lat_max, lon_min, lon_max in reversed(REGION_BOXES):
        region = F.when(lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max), F.lit(name)).otherwise(region)
    return region


def scope_rejection(country, state) -> Column:
    """Why a point outside all boxes is rejected, from the normalised country and state."""
    in_metadata = (as_column(country) == US_COUNTRY) & F.lower(as_column(state)).isin(*US_STATES)
    return F.when(in_metadata, F.lit("us_metadata_but_out_of_bounds")).otherwise(F.lit("non_us_coordinate"))


def us_scope(lat, lon, country, state) -> Column:
    """``struct<in_scope, label>``: the region, or why the point is out of scope."""
    why = scope_rejection(normalize_country(country), normalize_state(state))
    return let(classify_region(lat, lon), lambda region: F.struct(
        (region != "").alias("in_scope"), F.when(region != "", region).otherwise(why).alias("label")))


def within_service_bounds(lat, lon) -> Column:
    lat_min, lat_max, lon_min, lon_max = SERVICE_BOX
    return as_column(lat).between(lat_min, lat_max) & as_column(lon).between(lon_min, lon_max)


def has_valid_latlon(lat, lon) -> Column:
    """Both texts (or numbers) are finite numbers."""
    return parse_float_finite(lat).isNotNull() & parse_float_finite(lon).isNotNull()


def finite_pair(lat, lon) -> Column:
    return is_finite(lat) & is_finite(lon)


def _clamp(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def normalize_latlon(lat, lon, bounds=NORMALIZE_BOUNDS, clamp: bool = True) -> Column:
    """``struct<lat_norm, lon_norm>`` in [0, 1] when clamped."""
    lat_min, lat_max, lon_min, lon_max = bounds
    if lat_min >= lat_max or lon_min >= lon_max:
        raise ValueError("lower bounds must be below upper bounds")
    lat, lon = as_column(lat).cast("double"), as_column(lon).cast("double")
    if clamp:
        lat, lon = _clamp(lat, lat_min, lat_max), _clamp(lon, lon_min, lon_max)
    return F.struct(
        ((lat - lat_min) / (lat_max - lat_min)).alias("lat_norm"),
        ((lon - lon_min) / (lon_max - lon_min)).alias("lon_norm"),
    )


def denormalize_latlon(lat_norm, lon_norm, bounds=NORMALIZE_BOUNDS) -> Column:
    lat_min, lat_max, lon_min, lon_max = bounds
    return F.struct(
        (as_column(lat_norm) * (lat_max - lat_min) + lat_min).alias("lat"),
        (as_column(lon_norm) * (lon_max - lon_min) + lon_min).alias("lon"),
    )


def fourier_features(lat_norm, lon_norm, n: int = 32) -> Column:
    """Array of 4n values: sin lat, sin lon, cos lat, cos lon per octave."""
    lat, lon = as_column(lat_norm), as_column(lon_norm)
    octaves = F.sequence(F.lit(0), F.lit(n - 1))

    def one_octave(k):
        scale = F.pow(F.lit(2.0), k) * math.pi
        return F.array(F.sin(scale * lat), F.sin(scale * lon), F.cos(scale * lat), F.cos(scale * lon))

    return F.flatten(F.transform(octaves, one_octave))


def hash_uniform(seed, *parts) -> Column:
    """Reproducible uniform in [0, 1) from the md5 of ``seed:parts``."""
    text = F.concat_ws(":", F.lit(str(seed)), *[as_column(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def jitter_latlon(lat, lon, degrees: float, seed, key, bounds=NORMALIZE_BOUNDS) -> Column:
    """Uniform shift of at most ``degrees`` per axis, then clamped to the bounds."""
    lat_min, lat_max, lon_min, lon_max = bounds
    lat, lon = as_column(lat).cast("double"), as_column(lon).cast("double")
    if degrees > 0:
        lat = lat + (hash_uniform(seed, F.lit("lat"), key) * 2 - 1) * degrees
        lon = lon + (hash_uniform(seed, F.lit("lon"), key) * 2 - 1) * degrees
    return F.struct(_clamp(lat, lat_min, lat_max).alias("lat"), _clamp(lon, lon_min, lon_max).alias("lon"))
