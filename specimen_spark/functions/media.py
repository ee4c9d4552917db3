"""Media columns: licences, image tests, view hints."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from specimen_spark.fixed_values import (
    ALLOWED_LICENSES, ARCHIVE_IMAGE_FORMATS, ARCHIVE_IMAGE_TYPES, IMAGE_SUFFIXES, VIEW_PATTERNS,
)
from specimen_spark.functions.text import as_column, blank_to_null, let, normalize_text


def _any_of(words) -> str:
    return "|".join(re.escape(word) for word in words)


def license_allowed(c) -> Column:
    return F.lower(F.coalesce(as_column(c), F.lit(""))).rlike(_any_of(ALLOWED_LICENSES))


def has_image_suffix(url) -> Column:
    # What follows the last dot; the slash in front is what is left of text without a dot.
    ending = F.substring_index(F.concat(F.lit("/"), F.lower(normalize_text(url))), ".", -1)
    return ending.isin(*[suffix[1:] for suffix in IMAGE_SUFFIXES])


def is_occurrence_image(media_type, image_format, url) -> Column:
    """Image test of occurrence media: exact type, ``image/`` format or image ending."""
    return (
        (normalize_text(media_type) == "StillImage")
        | normalize_text(image_format).startswith("image/")
        | has_image_suffix(url)
    )


def is_image_like(media_type, image_format, url) -> Column:
    """Image test of archive media, case-insensitive and with bare formats."""
    image_form = f"^image/|^(?:{_any_of(ARCHIVE_IMAGE_FORMATS)})$"
    return (
        F.lower(normalize_text(media_type)).isin(*ARCHIVE_IMAGE_TYPES)
        | F.lower(normalize_text(image_format)).rlike(image_form)
        | has_image_suffix(url)
    )


def _decoded(text: Column) -> Column:
    """Percent-decoded text; bad escapes and '+' stay as they are."""
    safe = F.regexp_replace(F.replace(text, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
    return F.lower(F.url_decode(safe))


def infer_view_hint(*columns) -> Column:
    """``struct<hint, source>`` from the pattern families found in the joined text."""
    joined = F.concat_ws(" ", *[blank_to_null(c) for c in columns])

    def families(text: Column) -> Column:
        return F.array_compact(F.array(*[
            F.when(text.rlike("|".join(patterns)), F.lit(label)) for label, patterns in VIEW_PATTERNS.items()
        ]))

    def judge(found: Column) -> Column:
        single = F.size(found) == 1
        return F.struct(
            F.when(single, F.get(found, F.lit(0))).otherwise(F.lit("unknown")).alias("hint"),
            F.when(single, F.lit("metadata")).when(F.size(found) > 1, F.lit("metadata_ambiguous"))
            .otherwise(F.lit("none")).alias("source"),
        )

    return let(let(_decoded(joined), families), judge)


__all__ = [
    "blank_to_null", "has_image_suffix", "infer_view_hint", "is_image_like", "is_occurrence_image",
    "license_allowed",
]
