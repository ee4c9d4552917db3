"""Filters, ranking, naming and rewriting of processed manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.fixed_values import FALLBACK_CROP, RECOVERED_CROP
from specimen_spark.functions.geo import has_valid_latlon
from specimen_spark.functions.media import license_allowed
from specimen_spark.functions.numbers import flag_column, integer_column, number_column
from specimen_spark.functions.quality import is_preprocess_ok, is_rectangular_fp, rank_score
from specimen_spark.functions.species import group_key
from specimen_spark.functions.text import (
    blank_to_null, file_name, guess_extension_simple, is_not_blank, normalize_text, path_suffix, file_stem, stable_name,
)
from specimen_spark.operators.keyed import attach, first_per_key, group_rank, is_small, number_rank, sized, sorted_rank, stored
from specimen_spark.schemas import optional

GROUP_COLUMNS = ("specimen_key", "record_id", "image_url", "image_path")


def manifest_group_key(df: DataFrame):
    return group_key(*[optional(df, c) for c in GROUP_COLUMNS])


def trainable(df: DataFrame) -> DataFrame:
    """Rows whose status is blank or ok and whose keep flag is blank or true."""
    status = normalize_text(optional(df, "preprocess_status"))
    keep = F.lower(normalize_text(optional(df, "keep_for_training")))
    return df.where(status.isin("", "ok") & keep.isin("", "true"))


def coordinate_rows(df: DataFrame, require_coordinates: bool = True) -> DataFrame:
    """Rows with species, species id and (by default) two finite coordinates."""
    rows = df.where((normalize_text("species") != "") & (normalize_text("species_id") != ""))
    return rows.where(has_valid_latlon("latitude", "longitude")) if require_coordinates else rows


def _preprocess_reason(df: DataFrame):
    status = F.coalesce(blank_to_null(optional(df, "preprocess_status")), F.lit("other"))
    return F.when(~is_preprocess_ok(df), F.concat(F.lit("preprocess:"), status))


def filter_processed(
    df: DataFrame, *, min_mask_quality: float = 0.0, min_coverage_ratio: float = 0.0,
    min_symmetry_score: float = 0.0, drop_recovered_output: bool = False, base_only: bool = False,
) -> DataFrame:
    """All rows with ``reject_reason`` (null = kept). A threshold binds only where a value is present.

    ``base_only`` stops after the rectangle test.
    """
    reason = _preprocess_reason(df)
    tests = [(is_rectangular_fp(df), "rectangular_false_positive")]
    if not base_only:
        if drop_recovered_output:
            tests.append((normalize_text(optional(df, "crop_method")) == RECOVERED_CROP, "recovered_output"))
        for column, low, label in (
            ("mask_quality_score", min_mask_quality, "mask_quality_below_threshold"),
            ("coverage_ratio", min_coverage_ratio, "coverage_below_threshold"),
            ("symmetry_score", min_symmetry_score, "symmetry_below_threshold"),
        ):
            present = normalize_text(optional(df, column)) != ""
            tests.append((present & (F.coalesce(number_column(df, column), F.lit(0.0)) < low), label))
    for test, label in tests:
        reason = F.coalesce(reason, F.when(test, F.lit(label)))
    return df.withColumn("reject_reason", reason)


def curate(
    df: DataFrame, *, min_mask_quality_score: float = 0.75, min_symmetry_score: float = 0.84,
    min_fill_ratio: float = 0.56, min_coverage_ratio: float = 0.045, max_coverage_ratio: float = 0.43,
    min_horizontal_ratio: float = 1.12, min_wing_balance_ratio: float = 0.92, drop_border_touch: bool = False,
    allowed_view_statuses=("accepted", "metadata_dorsal"),
) -> DataFrame:
    """All rows with ``reject_reason`` (null = kept). A missing measurement fails; nan passes every comparison."""

    def low(column: str, bound: float):
        value = number_column(df, column)
        return value.isNull() | (value < bound)

    coverage = number_column(df, "coverage_ratio")
    tests = [
        (low("mask_quality_score", min_mask_quality_score), "mask_quality_score"),
        (low("symmetry_score", min_symmetry_score), "symmetry_score"),
        (low("fill_ratio", min_fill_ratio), "fill_ratio"),
        (low("coverage_ratio", min_coverage_ratio), "coverage_ratio_low"),
        ((coverage > max_coverage_ratio) & ~F.isnan(coverage), "coverage_ratio_high"),
        (low("horizontal_ratio", min_horizontal_ratio), "horizontal_ratio"),
        (low("wing_balance_ratio", min_wing_balance_ratio), "wing_balance_ratio"),
    ]
    if drop_border_touch:
        tests.append((flag_column(df, "mask_touches_border", ("true", "1", "yes")), "mask_touches_border"))
    allowed = [s.strip() for s in allowed_view_statuses if s.strip()]
    if allowed:
        status = normalize_text(optional(df, "view_status"))
        tests.append(((status != "") & ~status.isin(*allowed), "view_status"))
    reason = F.when(tests[0][0], F.lit(tests[0][1]))
    for test, label in tests[1:]:
        reason = reason.when(test, F.lit(label))
    return df.withColumn("reject_reason", reason)


def kept(df: DataFrame) -> DataFrame:
    """Accepted rows of a cascade."""
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def preprocess_status(df: DataFrame, allow_fallback: bool = False) -> DataFrame:
    """Final status of each row from readiness, crop method and presence of the input.

    Needs ``input_exists``, ``keep``, ``view_status``, ``reason`` and ``crop_method``.
    """
    missing = ~F.col("input_exists")
    dropped_crop = (F.col("crop_method") == FALLBACK_CROP) & F.lit(not allow_fallback)
    status = (
        F.when(missing, F.lit("missing_input"))
        .when(dropped_crop | ~F.col("keep"), F.lit("rejected_view"))
        .otherwise(F.lit("ok"))
    )

    def cell(column, on_crop):
        return F.when(missing, F.lit("")).when(dropped_crop, F.lit(on_crop)).otherwise(column)

    return df.select(
        *[c for c in df.columns if c not in
          ("input_exists", "keep", "view_status", "reason", "crop_method", "preprocess_status",
           "rejection_reason", "keep_for_training")],
        status.alias("preprocess_status"),
        cell(F.col("view_status"), "rejected_fallback_crop").alias("view_status"),
        cell(F.col("reason"), "fallback_crop").alias("rejection_reason"),
        cell(F.initcap(F.col("keep").cast("string")), "False").alias("keep_for_training"),
        F.when(missing, F.lit("")).otherwise(F.col("crop_method")).alias("crop_method"),
    )


def gate_images(
    df: DataFrame, images: DataFrame, existing: DataFrame | None, min_size: int = 256,
    raw_dir: str = "images_raw", licensed_dir: str = "images_licensed",
) -> DataFrame:
    """Status of each row of the simple manifest: licence first, then file, then pixel size.

    ``images`` has the profile of the raw files by ``path``; ``existing`` the
    listing of already licensed files. Rows that no file can belong to never
    reach a join.
    """
    key, url = F.trim(F.coalesce("occurrence_key", F.lit(""))), F.trim(F.coalesce("image_url", F.lit("")))
    name = F.concat(stable_name(key, url), guess_extension_simple(url))
    wanted = (key != "") & (url != "") & license_allowed("license")
    rows = df.select(
        "*",
        F.when(wanted, F.concat(F.lit(raw_dir.rstrip("/") + "/"), name)).alias("image_path_raw"),
        F.when(wanted, F.concat(F.lit(licensed_dir.rstrip("/") + "/"), name)).alias("image_path"),
    )
    done = (
        existing.select(F.col("path").alias("image_path")).distinct().withColumn("__done", F.lit(True))
        if existing is not None
        else df.select(F.lit(None).cast("string").alias("image_path"), F.lit(True).alias("__done")).limit(0)
    )
    rows = attach(rows, done, ["image_path"])
    sizes = images.select(
        F.col("path").alias("image_path_raw"), F.col("width").alias("__w"), F.col("height").alias("__h")
    )
    rows = attach(rows, sizes, ["image_path_raw"])
    decodable = F.col("__h") > 0
    status = (
        F.when(F.col("image_path_raw").isNull(), F.lit("skip"))
        .when(F.col("__done"), F.lit("done_existing"))
        .when(F.col("__h").isNull(), F.lit("fail_download"))
        .when(decodable & (F.col("__w") >= min_size) & (F.col("__h") >= min_size), F.lit("ok"))
        .otherwise(F.lit("fail_quality"))
    )
    measured = F.col("status").isin("ok", "fail_quality")
    return rows.withColumn("status", status).select(
        *df.columns, "image_path_raw", "image_path", "status",
        F.when(measured, F.greatest("__w", F.lit(0))).alias("width"),
        F.when(measured, F.greatest("__h", F.lit(0))).alias("height"),
    )


def rank_in_group(df: DataFrame, k: int, order_cols) -> DataFrame:
    """Best ``k`` rows of each specimen group with score, rank and group size.

    The row-number filter is applied per task before the shuffle, so a hot
    group sends at most ``k`` rows per task; sizes are a separate aggregate.
    """
    k = max(1, int(k))
    scored = df.withColumn("rank_score", rank_score(df)).withColumn("group_key", manifest_group_key(df))
    sizes = scored.groupBy("group_key").agg(F.count(F.lit(1)).alias("group_size"))
    order = Window.partitionBy("group_key").orderBy(F.desc("rank_score"), *order_cols)
    best = scored.withColumn("group_rank", F.row_number().over(order)).where(F.col("group_rank") <= k)
    return best.join(sizes, "group_key").select(
        *df.columns, "rank_score", "group_key", "group_size", "group_rank", F.lit(True).alias("keep")
    )


def group_drop_count(df: DataFrame, k: int) -> DataFrame:
    """``unique_groups, kept_rows, duplicate_drop_count`` of ``rank_in_group``."""
    sizes = df.select(manifest_group_key(df).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    taken = F.least(F.col("n"), F.lit(max(1, int(k))))
    return sizes.agg(
        F.count(F.lit(1)).alias("unique_groups"),
        F.coalesce(F.sum(taken), F.lit(0)).alias("kept_rows"),
        F.coalesce(F.sum(F.col("n") - taken), F.lit(0)).alias("duplicate_drop_count"),
    )


def destination_names(df: DataFrame, path_col: str, order_col: str) -> DataFrame:
    """``path, name``: one collision-free file name per distinct source path.

    The first path of a base name keeps it, later ones get ``_001``, ``_002``
    and so on. A suffixed name that is itself the base name of some path is
    passed over for the next free number; only numbers spelled as these are block.

    The j-th later path takes the j-th free number. A blocked number ``b``, the k-th of its base name, has ``b - k``
    free numbers before it. So if the blocked and the wanted ones of a base name are sorted together by that count,
    a wanted one's place is its number, and no list of numbers is gathered. Only base names with a blocked number are
    sorted again; a later path of the others takes its own place.
    """
    # Stored, since ranking reads its input more than once and the blocked names once more.
    paths = stored(df.where(is_not_blank(path_col)).groupBy(F.col(path_col).alias("path")).agg(
        F.min(order_col).alias("__seen")
    ).withColumn("base", file_name("path")))
    ranked = stored(group_rank(paths, ["base"], ["__seen", "path"], "__n").select("path", "base", "__n"))
    firsts = ranked.where(F.col("__n") == 1).select("path", F.col("base").alias("name"))
    wanted = ranked.where(F.col("__n") > 1).select("base", (F.col("__n") - 1).alias("__free"), F.lit(0).alias("__taken"), "path")
    taken = stored(_taken_numbers(paths))
    touched = taken.select("base").distinct()
    touched = F.broadcast(touched) if is_small(taken) else touched
    plain = attach(wanted, touched, ["base"], "left_anti").withColumnRenamed("__free", "__number")
    blocked = attach(taken, wanted.select("base").distinct(), ["base"], "left_semi")
    blocked = number_rank(blocked, ["base"], "__number", [], "__k").select(
        "base", (F.col("__number") - F.col("__k")).alias("__free"), F.lit(1).alias("__taken"), F.lit(None).cast("string").alias("path"))
    crossed = attach(wanted, touched, ["base"], "left_semi")
    merged = sorted_rank(crossed.union(blocked), ["base"], ["__free", "__taken"], "__number").where("__taken = 0")
    names = plain.select("path", "base", "__number").unionByName(merged.select("path", "base", "__number")).select("path", F.concat(
        file_stem("base"), F.lit("_"), _spelled("__number"), path_suffix_raw("base")).alias("name"))
    return firsts.unionByName(names)


def _spelled(number: str):
    digits = F.col(number).cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(3)), F.lit("0"))


def _taken_numbers(paths: DataFrame) -> DataFrame:
    """(base, __number) of base names that look like a numbered variant of another, once for each such base name."""
    variant = r"^(.*)_(\d{3,})(?:\.[^.]*)?$"
    digits = F.regexp_extract("base", variant, 2)
    spelled_so = F.col("base").rlike(r"_(?:\d{3}|[1-9]\d{3,})(?:\.[^.]*)?$")  # saves the others the dearer search below
    looks = paths.where(spelled_so).select("base", digits.alias("__digits"), digits.try_cast("bigint").alias("__number"))
    # Few look so: they are found before base names are made distinct.
    taken = looks.where((F.col("__number") > 0) & (F.col("__digits") == _spelled("__number"))).select("base", "__number").distinct()
    root = F.concat(F.regexp_extract("base", variant, 1), path_suffix_raw("base"))
    return taken.select(root.alias("base"), "__number")


def path_suffix_raw(c):
    """File ending as written (case kept)."""
    return F.regexp_extract(F.regexp_replace(file_name(c), r"^\.+", ""), r"(\.[^.]*)$", 1)


def destination_names_simple(df: DataFrame, path_col: str, order_col: str, index: str) -> DataFrame:
    """Per row: base name for its first user, ``<stem>_<row index>`` for every later row.

    Later rows with the same index (or none) go on with ``_2``, ``_3`` and so
    on. A row with a blank path has no name.
    """
    tail = F.coalesce(blank_to_null(index).cast("string"), F.lit("dup"))
    named = df.where(blank_to_null(path_col).isNotNull()).withColumn("__base", file_name(path_col))
    ranked = number_rank(named, ["__base"], order_col, [index], "__n")
    later = ranked.where("__n > 1").withColumn("__tail", tail)
    # Only rows that share their index are ranked again.
    shared = stored(later.groupBy("__base", "__tail").agg(F.count(F.lit(1)).alias("__rows")).where("__rows > 1").drop("__rows"))
    again = later.join(sized(shared), ["__base", "__tail"], "left_semi")
    again = number_rank(again.select(*later.columns), ["__base", "__tail"], order_col, ["__n"], "__m")
    later = later.join(sized(shared), ["__base", "__tail"], "left_anti").select(*later.columns, F.lit(1).cast("bigint").alias("__m")).unionByName(again)
    more = F.when(F.col("__m") > 1, F.concat(F.lit("_"), F.col("__m").cast("string"))).otherwise(F.lit(""))
    firsts = ranked.where("__n = 1").select(*df.columns, F.col("__base").alias("destination_name"), F.lit(False).alias("renamed"))
    others = later.select(
        *df.columns,
        F.concat(file_stem("__base"), F.lit("_"), "__tail", more, path_suffix_raw("__base")).alias("destination_name"),
        F.lit(True).alias("renamed"),
    )
    blank = df.where(blank_to_null(path_col).isNull()).select(
        "*", F.lit(None).cast("string").alias("destination_name"), F.lit(False).alias("renamed"))
    return firsts.union(others).union(blank)


def portable_manifest(df: DataFrame, names: DataFrame, path_col: str, folder: str = "images") -> DataFrame:
    """Relative image path in place of absolute ones; originals are preserved."""
    lookup = names.select(F.col("path").alias(path_col), F.col("name").alias("__name"))
    joined = attach(df, lookup, [path_col], how="inner")
    new = {
        "original_processed_image_absolute_path": F.col(path_col),
        "processed_image_absolute_path": F.lit(""),
        "original_image_path": normalize_text(optional(df, "image_path")),
        "original_source_image_path": normalize_text(optional(df, "source_image_path")),
        "image_path": F.lit(""),
        "source_image_path": F.lit(""),
        "processed_image_path": F.concat(F.lit(folder + "/"), F.col("__name")),
    }
    return joined.select(*[c for c in df.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def materialized_manifest(df: DataFrame, name_col: str, root: str, folder: str = "images") -> DataFrame:
    """Relative and absolute path of the copied image on each row."""
    relative = F.concat(F.lit(folder + "/"), F.col(name_col))
    new = {
        "original_processed_image_path": normalize_text(optional(df, "processed_image_path")),
        "processed_image_path": relative,
        "processed_image_absolute_path": F.concat(F.lit(root.rstrip("/") + "/"), relative),
        "image_path": relative,
    }
    return df.select(*[c for c in df.columns if c not in new], *[v.alias(c) for c, v in new.items()])


def order_by_source(df: DataFrame, index: str = "source_row_index") -> DataFrame:
    """Total order by source row number, blank numbers first as 0."""
    return df.orderBy(F.coalesce(integer_column(df, index), F.lit(0)))


def cap_rows(df: DataFrame, n: int, order_cols) -> DataFrame:
    """First ``n`` rows; 0 or less means all."""
    return df.orderBy(*order_cols).limit(n) if n > 0 else df


__all__ = [
    "cap_rows", "coordinate_rows", "curate", "destination_names", "destination_names_simple",
    "filter_processed", "first_per_key", "gate_images", "group_drop_count", "kept", "manifest_group_key",
    "materialized_manifest", "order_by_source", "path_suffix", "portable_manifest", "preprocess_status",
    "rank_in_group", "trainable",
]
