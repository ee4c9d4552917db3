"""Quality of masks, crops and generated candidates, from measured columns."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.numbers import flag_column, integer_column, number_column
from specimen_spark.functions.text import as_column, let, normalize_text


def _num(df: DataFrame, name: str) -> Column:
    return F.coalesce(number_column(df, name), F.lit(0.0))


def _int(df: DataFrame, name: str) -> Column:
    return F.coalesce(integer_column(df, name), F.lit(0))


def _text(df: DataFrame, name: str) -> Column:
    return normalize_text(name) if name in df.columns else F.lit("")


def _view(df: DataFrame) -> Column:
    return F.lower(_text(df, "view_hint"))


def is_preprocess_ok(df: DataFrame) -> Column:
    return (_text(df, "preprocess_status") == "ok") & flag_column(df, "keep_for_training")


def is_rectangular_fp(df: DataFrame) -> Column:
    """A rectangle (label, tray, card) mistaken for a specimen."""
    vertices = _int(df, "polygon_vertices")
    return (
        _view(df).isin("", "unknown")
        & (vertices > 0) & (vertices <= 6)
        & (_num(df, "mask_solidity") >= 0.90)
        & (_num(df, "fill_ratio") >= 0.80)
    )


def rank_score(df: DataFrame) -> Column:
    """Preference among images of one specimen."""
    view = _view(df)
    fill = _num(df, "fill_ratio")
    coverage = F.least(F.greatest(_num(df, "coverage_ratio"), F.lit(0.0)), F.lit(0.35))
    return (
        _num(df, "mask_quality_score")
        + F.when(view == "dorsal", 0.35).otherwise(0.0)
        - F.when(view == "unknown", 0.10).otherwise(0.0)
        + F.lit(0.20) * (F.least(_num(df, "mask_mean_saturation"), F.lit(140.0)) / 140.0)
        + F.lit(0.15) * (F.least(_int(df, "polygon_vertices"), F.lit(12)) / F.lit(12.0))
        + F.lit(0.10) * coverage / 0.35
        - F.when(fill >= 0.88, 0.15).otherwise(0.0)
    )


def gaussian_score(value, target: float, sigma: float) -> Column:
    sigma = max(sigma, 1.0e-6)
    gap = as_column(value) - F.lit(target)
    return F.exp(-(gap * gap) / (2.0 * sigma * sigma))


def candidate_quality(
    coverage="coverage", symmetry="symmetry_score", rgb_symmetry="rgb_symmetry", border_touch="border_touch",
    fill_ratio="fill_ratio", aspect_ratio="aspect_ratio", largest_component="largest_component_ratio",
    component_count="component_count", luminance="foreground_luminance", texture="foreground_std",
    center_distance="center_distance",
) -> Column:
    """Blend of nine terms in [0, 1]; 0 when almost nothing is covered."""
    light = as_column(luminance)
    darkness = F.when(light < 0.07, 0.2).when(light < 0.10, 0.45).when(light < 0.13, 0.72).otherwise(1.0)
    crowd = F.greatest(as_column(component_count) - 2, F.lit(0)) * 0.18
    terms = (
        (0.15, gaussian_score(coverage, 0.18, 0.11)),
        (0.16, as_column(symmetry) * 0.6 + F.greatest(as_column(rgb_symmetry), F.lit(0.0)) * 0.4),
        (0.12, F.greatest(F.lit(0.0), F.lit(1.0) - as_column(border_touch) / 0.08)),
        (0.10, gaussian_score(fill_ratio, 0.48, 0.18)),
        (0.08, gaussian_score(F.log(F.greatest(as_column(aspect_ratio), F.lit(1.0e-6))), math.log(1.25), 0.55)),
        (0.12, F.greatest(F.lit(0.0), F.lit(1.0) - crowd) * as_column(largest_component)),
        (0.07, gaussian_score(center_distance, 0.0, 0.18)),
        (0.16, gaussian_score(luminance, 0.24, 0.08) * darkness),
        (0.06, gaussian_score(texture, 0.16, 0.08)),
    )
    blend = reduce(lambda a, b: a + b, [F.lit(weight) * term for weight, term in terms])
    return F.when(as_column(coverage) < 0.01, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), blend))
    )


def _tiers(value: Column, inner: tuple, middle: tuple | None, scores: tuple) -> Column:
    """Score of the first interval that holds the value."""
    score = F.when(value.between(*inner), scores[0])
    if middle is not None:
        score = score.when(value.between(*middle), scores[1])
    return score.otherwise(scores[-1])


def mask_quality(
    coverage="coverage_ratio", horizontal="horizontal_ratio", fill="fill_ratio", saturation="mean_saturation",
    low_saturation="low_saturation_fraction", symmetry="symmetry_score", balance="wing_balance_ratio",
    centroid_x="centroid_x_ratio", centroid_y="centroid_y_ratio", touches_border="touches_border",
    vertices="polygon_vertices", solidity="solidity",
) -> Column:
    """Product of twelve factors of a mask's measured ratios."""
    coverage, fill = as_column(coverage), as_column(fill)
    rectangle = (as_column(vertices) <= 6) & (as_column(solidity) >= 0.92) & (fill >= 0.78)
    factors = (
        F.lit(0.45) + F.least(F.sqrt(F.greatest(coverage, F.lit(0.0))), F.lit(0.75)),
        _tiers(coverage, (0.02, 0.40), (0.01, 0.55), (1.0, 0.68, 0.18)),
        _tiers(as_column(horizontal), (1.05, 4.2), (0.85, 5.2), (1.0, 0.68, 0.18)),
        _tiers(fill, (0.10, 0.86), None, (1.0, 0.65)),
        F.lit(0.40) + F.least(as_column(saturation), F.lit(150.0)) / 150.0,
        F.greatest(F.lit(0.18), F.lit(1.0) - as_column(low_saturation) * 0.9),
        F.lit(0.45) + as_column(symmetry),
        F.lit(0.35) + F.least(as_column(balance), F.lit(1.0)),
        F.greatest(F.lit(0.25), F.lit(1.15) - F.abs(as_column(centroid_x) - 0.50) * 1.6),
        F.greatest(F.lit(0.45), F.lit(1.08) - F.abs(as_column(centroid_y) - 0.43) * 1.5),
        F.when(as_column(touches_border), 0.72).otherwise(1.0),
        F.when(rectangle, 0.25).otherwise(1.0),
    )
    return reduce(mul, factors)


def is_strong_mask(
    coverage="coverage_ratio", horizontal="horizontal_ratio", symmetry="symmetry_score",
    balance="wing_balance_ratio", saturation="mean_saturation", low_saturation="low_saturation_fraction",
    touches_border="touches_border",
) -> Column:
    return reduce(and_, [
        as_column(coverage).between(0.02, 0.42),
        as_column(horizontal).between(1.0, 4.8),
        as_column(symmetry) >= 0.42,
        as_column(balance) >= 0.28,
        as_column(saturation) >= 45.0,
        as_column(low_saturation) <= 0.32,
        ~as_column(touches_border),
    ])


def assess_readiness(
    require_dorsal: bool = False, reject_unknown: bool = False, *, has_mask=None, view="view_hint",
    coverage="coverage_ratio", horizontal="horizontal_ratio", symmetry="symmetry_score",
    balance="wing_balance_ratio", saturation="mean_saturation", low_saturation="low_saturation_fraction",
    fill="fill_ratio", touches_border="touches_border", vertices="polygon_vertices", solidity="solidity",
) -> Column:
    """``struct<keep, view_status, reason>``: the first failing test names the reason."""
    view, coverage, horizontal = as_column(view), as_column(coverage), as_column(horizontal)
    fill, border = as_column(fill), as_column(touches_border)
    dorsal, unknown = view == "dorsal", view == "unknown"
    tests = []
    if require_dorsal:
        tests.append((view.isin("ventral", "lateral"), F.concat(F.lit("metadata_view_"), view)))
        if reject_unknown:
            tests.append((unknown, F.lit("unknown_view")))
    tests += [
        (unknown & (coverage < 0.08) & (horizontal < 1.25), F.lit("compact_unknown_view")),
        (horizontal < 1.0, F.lit("not_spread_horizontal")),
        (horizontal > 5.2, F.lit("too_wide_for_specimen")),
        (as_column(symmetry) < F.when(dorsal, 0.28).otherwise(0.38), F.lit("low_bilateral_symmetry")),
        (as_column(balance) < F.when(dorsal, 0.20).otherwise(0.26), F.lit("one_sided_specimen")),
        (coverage < 0.02, F.lit("specimen_too_small")),
        (unknown & (as_column(vertices) <= 6) & (as_column(solidity) >= 0.92) & (fill >= 0.78),
         F.lit("rectangular_non_specimen")),
        (as_column(saturation) < 24.0, F.lit("low_color_saturation")),
        (fill < 0.08, F.lit("fragmented_mask")),
        (border & (as_column(low_saturation) > 0.20), F.lit("border_connected_artifact")),
        (border & (coverage > 0.48), F.lit("touches_image_border")),
    ]
    reason = F.when(*tests[0])
    for test, label in tests[1:]:
        reason = reason.when(test, label)
    reason = reason.otherwise(F.lit(""))

    def result(reason: Column) -> Column:
        status = (
            F.when(reason != "", F.concat(F.lit("rejected_"), reason))
            .when(view.isin("dorsal", "ventral", "lateral"), F.concat(F.lit("metadata_"), view))
            .otherwise(F.lit("accepted"))
        )
        if has_mask is not None:
            found = as_column(has_mask)
            reason = F.when(~found, F.lit("missing_mask")).otherwise(reason)
            status = F.when(~found, F.lit("missing_mask")).otherwise(status)
        return F.struct((reason == "").alias("keep"), status.alias("view_status"), reason.alias("reason"))

    return let(reason, result)


def bbox_area_ratio(x0, y0, x1, y1, width, height) -> Column:
    area = (as_column(x1) - as_column(x0)) * (as_column(y1) - as_column(y0))
    return area / F.greatest(as_column(width) * as_column(height), F.lit(1))


def bbox_touches_border(x0, y0, x1, y1, width, height, margin=2) -> Column:
    margin = F.lit(margin) if isinstance(margin, int) else margin
    return (
        (as_column(x0) <= margin) | (as_column(y0) <= margin)
        | (as_column(x1) >= as_column(width) - margin) | (as_column(y1) >= as_column(height) - margin)
    )


def expand_bbox(x0, y0, x1, y1, width, height, margin_x: float, margin_top: float | None = None,
                margin_bottom: float | None = None) -> Column:
    """Box grown by fractions of its sides (rounded half to even) and cut at the image."""
    x0, y0, x1, y1 = (as_column(c) for c in (x0, y0, x1, y1))

    def margin(side: Column, fraction: float | None) -> Column:
        return F.rint(side * F.lit(margin_x if fraction is None else fraction)).cast("int")

    dx = margin(x1 - x0, margin_x)
    return F.struct(
        F.greatest(F.lit(0), x0 - dx).alias("left"),
        F.greatest(F.lit(0), y0 - margin(y1 - y0, margin_top)).alias("top"),
        F.least(as_column(width), x1 + dx).alias("right"),
        F.least(as_column(height), y1 + margin(y1 - y0, margin_bottom)).alias("bottom"),
    )


def fallback_bbox(width, height) -> Column:
    """Centred square of 92 % of the shorter side."""
    width, height = as_column(width), as_column(height)
    side = F.floor(F.least(width, height) * F.lit(0.92)).cast("int")
    left, top = F.floor((width - side) / 2).cast("int"), F.floor((height - side) / 2).cast("int")
    return F.struct(left.alias("left"), top.alias("top"), (left + side).alias("right"), (top + side).alias("bottom"))
