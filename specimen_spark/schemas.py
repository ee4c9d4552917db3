"""Column lists and Spark schemas of the manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

RAW_REQUIRED = ["source", "record_id", "genus", "scientific_name", "latitude", "longitude", "image_url"]
RAW_OPTIONAL = [
    "media_id", "institution_code", "catalog_number", "family", "species", "raw_species", "country",
    "state_province", "locality", "event_date", "basis_of_record", "license", "rights_holder",
    "image_format", "publisher", "dataset_key", "record_url", "local_image_path", "download_status",
    "download_error",
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_REQUIRED + RAW_OPTIONAL])

# Text columns copied (whitespace-normalised) from the raw to the clean manifest.
CLEAN_COPIED = [
    "source", "record_id", "media_id", "scientific_name", "locality", "event_date", "basis_of_record",
    "license", "rights_holder", "institution_code", "catalog_number", "image_format", "record_url",
    "download_status", "download_error", "raw_species",
]
CLEAN_COLUMNS = [
    "image_path", "source", "record_id", "media_id", "specimen_key", "record_image_count", "family",
    "genus", "species", "species_source", "scientific_name", "latitude", "longitude", "has_coordinates",
    "us_region", "country", "state_province", "locality", "event_date", "month", "basis_of_record",
    "license", "rights_holder", "institution_code", "catalog_number", "image_url", "image_format",
    "record_url", "download_status", "download_error", "raw_species",
]
CLEAN_REQUIRED = ["image_path", "latitude", "longitude", "species", "species_id"]
_CLEAN_TYPES = {
    "record_image_count": T.LongType(), "latitude": T.DoubleType(), "longitude": T.DoubleType(),
    "has_coordinates": T.BooleanType(),
}
CLEAN_SCHEMA = T.StructType(
    [T.StructField(c, _CLEAN_TYPES.get(c, T.StringType())) for c in CLEAN_COLUMNS]
    + [T.StructField("species_id", T.IntegerType())]
)

_DOUBLES = [
    "symmetry_score", "wing_balance_ratio", "horizontal_ratio", "fill_ratio", "coverage_ratio",
    "mask_quality_score", "mask_mean_saturation", "mask_solidity", "working_scale",
]
PROCESSED_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in (
        "source_image_path", "processed_image_path", "processed_mask_path", "preprocess_status",
        "crop_method", "view_hint", "view_source", "view_status", "rejection_reason")]
    + [T.StructField(c, T.DoubleType()) for c in _DOUBLES]
    + [T.StructField("keep_for_training", T.BooleanType()),
       T.StructField("clean_background", T.BooleanType()),
       T.StructField("mask_touches_border", T.BooleanType()),
       T.StructField("candidate_count", T.IntegerType()),
       T.StructField("polygon_vertices", T.IntegerType()),
       T.StructField("crop_bbox", T.ArrayType(T.IntegerType())),
       T.StructField("working_image_size", T.ArrayType(T.IntegerType())),
       T.StructField("source_row_index", T.LongType())]
)

SIMPLE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in
     ("occurrence_key", "species", "lat", "lon", "image_url", "license")]
)

# Schema of the Spark image source, minus the nesting.
IMAGE_FIELDS = ["origin", "height", "width", "nChannels", "mode", "data"]


def validate_required(df: DataFrame, columns) -> DataFrame:
    """Return ``df`` or raise when a required column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df


def optional(df: DataFrame, name: str, type_: str = "string"):
    """The column, or a typed null when the manifest does not have it."""
    from pyspark.sql import functions as F

    return F.col(name) if name in df.columns else F.lit(None).cast(type_)
