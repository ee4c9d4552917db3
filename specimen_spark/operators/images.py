"""Measurements on image tables. Pixels are handled in Arrow batches inside tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pixels_rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Height x width x 3 array in red-green-blue order from the image source's bytes."""
    array = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(array, 3, axis=2)
    return array[:, :, 2::-1]


def channel_stats(images: DataFrame) -> DataFrame:
    """Pixel-weighted mean and deviation per channel over all decodable images.

    A batch becomes one histogram of levels per channel, from which the sums
    follow; Spark adds the sums.
    """
    level = np.arange(256) / 255.0

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            histogram = np.zeros((3, 256), dtype=np.int64)
            for row in batch.itertuples(index=False):
                planes = pixels_rgb(row.data, row.height, row.width, row.nChannels).reshape(-1, 3)
                histogram += [np.bincount(plane, minlength=256) for plane in planes.T]
            pixels = int(histogram[0].sum())
            yield pd.DataFrame([[len(batch), pixels, *(histogram @ level), *(histogram @ level ** 2)]], columns=names)

    names = ["images", "pixels", "s0", "s1", "s2", "q0", "q1", "q2"]
    schema = "images bigint, pixels bigint, " + ", ".join(f"{n} double" for n in names[2:])
    partial = (
        images.where(F.col("height") > 0)
        .select("height", "width", "nChannels", "data")
        .mapInPandas(sums, schema)
    )
    added = partial.agg(*[F.sum(n).alias(n) for n in names])
    out = [F.col("images").alias("images_used"), F.col("pixels").alias("total_pixels")]
    for i, channel in enumerate(("r", "g", "b")):
        mean = F.col(f"s{i}") / F.col("pixels")
        variance = F.greatest(F.col(f"q{i}") / F.col("pixels") - mean * mean, F.lit(0.0))
        out += [mean.alias(f"mean_{channel}"), F.sqrt(variance).alias(f"std_{channel}")]
    return added.select(*out)


def image_profile(images: DataFrame, min_size: int = 256) -> DataFrame:
    """``path, decodable, width, height, channel_mode, large_enough`` from the image columns alone."""
    decodable = F.col("height") > 0
    mode = F.when(~decodable, F.lit("")).when(F.col("nChannels") == 1, F.lit("L")).when(
        F.col("nChannels") == 3, F.lit("RGB")).otherwise(F.lit("RGBA"))
    return images.select(
        "path",
        decodable.alias("decodable"),
        F.greatest("width", F.lit(0)).alias("width"),
        F.greatest("height", F.lit(0)).alias("height"),
        mode.alias("channel_mode"),
        (decodable & (F.col("width") >= min_size) & (F.col("height") >= min_size)).alias("large_enough"),
    )


_METRICS = (
    "found boolean, x0 int, y0 int, x1 int, y1 int, area bigint, fill_ratio double, coverage_ratio double, "
    "horizontal_ratio double, symmetry_score double, wing_balance_ratio double, centroid_x_ratio double, "
    "centroid_y_ratio double, touches_border boolean, mean_saturation double, low_saturation_fraction double"
)


def extent(projection: np.ndarray) -> tuple[int, int]:
    """First and one past the last position that is not empty."""
    used = np.flatnonzero(projection)
    return int(used[0]), int(used[-1]) + 1


def measure_mask(rgb: np.ndarray, mask: np.ndarray) -> tuple:
    """Geometry of a binary mask, from its row and column counts, and saturation below it."""
    on = mask > 0
    per_row, per_column = on.sum(axis=1), on.sum(axis=0)
    area = int(per_row.sum())
    if area == 0:
        return (False, None, None, None, None, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.5, 0.5, False, 0.0, 1.0)
    height, width = on.shape
    (y0, y1), (x0, x1) = extent(per_row), extent(per_column)
    # Columns at equal distance from both sides of the box are mirror images in a symmetric mask.
    left = np.arange(x0, x0 + (x1 - x0) // 2)
    right = x0 + x1 - 1 - left
    in_both = int((on[:, left] & on[:, right]).sum())
    left_area, right_area = int(per_column[left].sum()), int(per_column[right].sum())
    in_either = left_area + right_area - in_both
    pixels = rgb[on].astype(np.float64)
    high, low = pixels.max(axis=1), pixels.min(axis=1)
    # 8-bit saturation, rounded half to even; black has none.
    saturation = np.rint((high - low) * 255.0 / np.where(high > 0, high, 1.0))
    edge = max(2, min(height, width) // 100)
    gap = min(x0, y0, width - x1, height - y1)
    return (
        True, x0, y0, x1, y1, area, area / ((x1 - x0) * (y1 - y0)), area / on.size, (x1 - x0) / (y1 - y0),
        in_both / in_either if in_either else 0.0, min(left_area, right_area) / max(left_area, right_area, 1),
        float(per_column @ np.arange(width)) / area / width, float(per_row @ np.arange(height)) / area / height,
        gap <= edge, float(saturation.mean()), float((saturation < 28).mean()),
    )


def relative_path(path, root: str):
    """Path below ``root`` (a scheme in front does not count) without its ending; images and their masks share it."""
    inner = F.regexp_replace(path, f"^(?:[a-z0-9]+:(?://)?)?{re.escape(root.rstrip('/'))}/", "")
    return F.regexp_replace(inner, r"\.[^./]*$", "")


def mask_metrics(images: DataFrame, masks: DataFrame, image_root: str, mask_root: str) -> DataFrame:
    """Mask measurements per image with a ``reason`` where there are none.

    Image and mask pair by their path below the roots. The reason is
    ``missing_mask`` or ``size_mismatch``; such rows hold the values of an
    empty mask.
    """
    left = images.where(F.col("height") > 0).select(
        relative_path("path", image_root).alias("pair"), "path", "height", "width", "nChannels", "data")
    right = masks.where(F.col("height") > 0).select(
        relative_path("path", mask_root).alias("pair"), F.col("nChannels").alias("mask_channels"), F.col("data").alias("mask_data"),
        F.col("height").alias("mask_height"), F.col("width").alias("mask_width"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "reason"] + [part.strip().split(" ")[0] for part in _METRICS.split(",")]
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                rgb, reason = pixels_rgb(r.data, r.height, r.width, r.nChannels), None
                mask = np.zeros((r.height, r.width), np.uint8)
                if r.mask_data is None:
                    reason = "missing_mask"
                elif (r.mask_height, r.mask_width) != (r.height, r.width):
                    reason = "size_mismatch"
                else:
                    mask = np.frombuffer(r.mask_data, dtype=np.uint8).reshape(r.height, r.width, int(r.mask_channels))[:, :, 0]
                rows.append((r.path, reason, *measure_mask(rgb, mask)))
            out = pd.DataFrame(rows, columns=names)
            for box in ("x0", "y0", "x1", "y1"):
                out[box] = out[box].astype("Int32")
            yield out

    return left.join(right, "pair", "left").drop("pair").mapInPandas(measure, "path string, reason string, " + _METRICS)


def cache_features(
    df: DataFrame, infer_factory: Callable[[], Callable[[pd.DataFrame], dict]], feature_schema: str, keep=("path",)
) -> DataFrame:
    """Model outputs per image beside the ``keep`` columns.

    ``infer_factory`` builds the model once per task; the model maps a batch
    to columns of ``feature_schema``, one value per row.
    """
    keep = list(keep)
    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [feature_schema])

    def infer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = infer_factory()
        for batch in batches:
            columns = model(batch)
            wrong = [name for name, values in columns.items() if len(values) != len(batch)]
            if wrong:
                raise ValueError(f"feature columns with mismatched counts: {wrong}")
            yield batch[keep].reset_index(drop=True).assign(**columns)

    return df.mapInPandas(infer, schema)


def check_cache(source: DataFrame, cache: DataFrame, feature_columns) -> DataFrame:
    """One row: rows of both sides, rows lacking a feature, and whether the cache is complete."""
    lacking = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in feature_columns], F.lit(0)) > 0)
    checked = cache.agg(F.count(F.lit(1)).alias("cached_rows"), lacking.alias("incomplete_rows"))
    wanted = source.agg(F.count(F.lit(1)).alias("n")).scalar()
    return checked.select(
        wanted.alias("source_rows"), "cached_rows", "incomplete_rows",
        ((F.col("cached_rows") == wanted) & (F.col("incomplete_rows") == 0)).alias("complete"),
    )
