"""Unpacked Darwin-Core archives: occurrence table joined to media table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.fixed_values import ARCHIVE_SOURCE, SPECIMEN_RECORD_URL
from specimen_spark.functions.geo import parse_geopoint_text
from specimen_spark.functions.media import is_image_like
from specimen_spark.functions.text import blank_to_null, first_nonempty, normalize_text
from specimen_spark.operators.keyed import attach, best_orders, last_per_key, one_per_key, rows_at, sized, stored
from specimen_spark.sources.manifest import read_manifest
from specimen_spark.sources.pages import manifest_row


def read_archive(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = folder.rstrip("/")
    return read_manifest(spark, f"{base}/occurrence.csv"), read_manifest(spark, f"{base}/multimedia.csv")


def _column(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def import_dwca(occurrence: DataFrame, media: DataFrame, occurrence_order, media_order) -> DataFrame:
    """Image rows of an archive, first row per URL. The last occurrence row of an id counts.

    The first rows are found on keys and orders alone, so only they are joined to occurrences, and only occurrences of
    their ids are read whole.
    """
    o = lambda n: _column(occurrence, n)
    m = lambda n: _column(media, n)
    records = occurrence.select(
        *occurrence_order,
        blank_to_null("coreid").alias("core"),
        parse_geopoint_text(o("idigbio:geoPoint")).alias("point"),
        normalize_text(o("dwc:institutionCode")).alias("institution_code"),
        normalize_text(o("dwc:catalogNumber")).alias("catalog_number"),
        normalize_text(o("dwc:family")).alias("family"),
        normalize_text(o("dwc:genus")).alias("genus"),
        normalize_text(first_nonempty(o("gbif:canonicalName"), o("dwc:scientificName"))).alias("species"),
        normalize_text(o("dwc:specificEpithet")).alias("epithet"),
        normalize_text(o("dwc:scientificName")).alias("scientific_name"),
        normalize_text(o("dwc:country")).alias("country"),
        normalize_text(o("dwc:stateProvince")).alias("state_province"),
        normalize_text(first_nonempty(o("dwc:locality"), o("dwc:verbatimLocality"))).alias("locality"),
        normalize_text(first_nonempty(o("idigbio:eventDate"), o("dwc:eventDate"))).alias("event_date"),
        normalize_text(o("dwc:basisOfRecord")).alias("basis_of_record"),
    ).where(F.col("core").isNotNull())

    url, form = normalize_text(m("ac:accessURI")), normalize_text(m("dcterms:format"))
    kind = first_nonempty(m("dc:type"), m("idigbio:mediaType"))
    images = media.where((url != "") & is_image_like(kind, form, url)).select(
        *media_order,
        blank_to_null("coreid").alias("core"),
        normalize_text(first_nonempty(m("idigbio:uuid"), m("coreid"))).alias("media_id"),
        url.alias("image_url"),
        form.alias("image_format"),
        normalize_text(first_nonempty(m("xmpRights:WebStatement"), m("dcterms:rights"))).alias("license"),
    )
    known = attach(images.select("core", "image_url", *media_order), records.select("core").distinct(), ["core"], how="left_semi")
    firsts = stored(rows_at(images, best_orders(known, ["image_url"], media_order), ["image_url"], media_order))
    wanted = stored(firsts.select("core").distinct())
    latest = last_per_key(records.join(sized(wanted), "core", "left_semi"), ["core"], occurrence_order).drop(*occurrence_order)
    # A row whose id has no occurrence goes here, before rows that share URL and order are settled.
    joined = one_per_key(attach(firsts, latest, ["core"], how="inner"), ["image_url"])
    c = F.col
    return joined.select(*media_order, *manifest_row(
        source=F.lit(ARCHIVE_SOURCE), record_id=c("core"), media_id=c("media_id"),
        institution_code=c("institution_code"), catalog_number=c("catalog_number"), family=c("family"),
        genus=c("genus"), species=first_nonempty("species", "epithet"), scientific_name=c("scientific_name"),
        latitude=c("point.lat"), longitude=c("point.lon"), country=c("country"),
        state_province=c("state_province"), locality=c("locality"), event_date=c("event_date"),
        basis_of_record=c("basis_of_record"), license=c("license"), image_url=c("image_url"),
        image_format=c("image_format"), record_url=F.concat(F.lit(SPECIMEN_RECORD_URL), c("core")),
    ))
