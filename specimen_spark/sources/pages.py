"""Flattening landed API pages into manifest rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.fixed_values import (
    OCCURRENCE_RECORD_URL, OCCURRENCE_SOURCE, SPECIMEN_RECORD_URL, SPECIMEN_SOURCE,
)
from specimen_spark.functions.geo import parse_geopoint_array, parse_geopoint_struct, parse_geopoint_text
from specimen_spark.functions.media import is_occurrence_image
from specimen_spark.functions.species import ingest_binomial
from specimen_spark.functions.text import first_nonempty, normalize_text


def field(df_or_type, path: str, name: str) -> Column:
    """Nested field, null when the landed schema lacks it."""
    names = df_or_type if isinstance(df_or_type, (list, set, tuple)) else _struct_fields(df_or_type, path)
    return F.col(path)[name] if name in names else F.lit(None).cast("string")


def _struct_fields(df: DataFrame, path: str) -> list[str]:
    kind = df.schema
    for part in path.split("."):
        kind = kind[part].dataType
    return list(getattr(kind, "names", []))


def each_element(df: DataFrame, array: str, name: str, keep=()) -> DataFrame:
    """One row per element of ``array``, with the columns ``keep``.

    A plain ``explode`` makes Spark filter by the size of the array first. Where the array is made from other columns,
    that filter makes it a second time, inside a join even.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("__at", name)).where("__at IS NOT NULL").drop("__at")


def manifest_row(**values) -> list[Column]:
    """Raw-manifest columns in order; text is normalised, coordinates stay numbers."""
    genus, species, name = (values.get(k, F.lit("")) for k in ("genus", "species", "scientific_name"))
    binomial = ingest_binomial(name, genus, species)
    text = {
        k: normalize_text(values.get(k, F.lit("")))
        for k in (
            "source", "record_id", "media_id", "institution_code", "catalog_number", "family", "genus",
            "scientific_name", "country", "state_province", "locality", "event_date", "basis_of_record",
            "license", "rights_holder", "image_url", "image_format", "publisher", "dataset_key", "record_url",
        )
    }
    columns = {
        **text,
        "species": F.coalesce(binomial, normalize_text(species)),
        "raw_species": normalize_text(species),
        "is_species_level": binomial.isNotNull(),
        "latitude": values["latitude"].cast("double"),
        "longitude": values["longitude"].cast("double"),
        "local_image_path": F.lit(""),
        "download_status": F.lit("pending"),
        "download_error": F.lit(""),
    }
    ordered = (
        "source", "record_id", "media_id", "institution_code", "catalog_number", "family", "genus", "species",
        "raw_species", "scientific_name", "is_species_level", "latitude", "longitude", "country",
        "state_province", "locality", "event_date", "basis_of_record", "license", "rights_holder",
        "image_url", "image_format", "publisher", "dataset_key", "record_url", "local_image_path",
        "download_status", "download_error",
    )
    return [columns[c].alias(c) for c in ordered]


def flatten_occurrences(pages: DataFrame, keep=()) -> DataFrame:
    """One row per image medium of ``results[].media[]``.

    ``keep`` names page columns to carry along (an order key for instance).
    """
    occ = each_element(pages, "results", "o", keep)
    names = _struct_fields(occ, "o")
    media = occ.select("*", F.posexplode("o.media").alias("media_pos", "m"))
    m_names = _struct_fields(media, "m")
    get_o = lambda n: field(names, "o", n)
    get_m = lambda n: field(m_names, "m", n)
    images = media.where(
        (normalize_text(get_m("identifier")) != "")
        & is_occurrence_image(get_m("type"), get_m("format"), get_m("identifier"))
    )
    key = get_o("key").cast("string")
    return images.select(*keep, "media_pos", *manifest_row(
        source=F.lit(OCCURRENCE_SOURCE),
        record_id=key,
        # The identifier is never blank here, so it always serves as the media id.
        media_id=get_m("identifier"),
        institution_code=get_o("institutionCode"),
        catalog_number=get_o("catalogNumber"),
        family=get_o("family"),
        genus=get_o("genus"),
        species=get_o("species"),
        scientific_name=first_nonempty(get_o("acceptedScientificName"), get_o("scientificName")),
        latitude=get_o("decimalLatitude"),
        longitude=get_o("decimalLongitude"),
        country=get_o("country"),
        state_province=get_o("stateProvince"),
        locality=get_o("locality"),
        event_date=get_o("eventDate"),
        basis_of_record=get_o("basisOfRecord"),
        license=first_nonempty(get_m("license"), get_o("license")),
        rights_holder=first_nonempty(get_m("rightsHolder"), get_o("rightsHolder"), get_m("creator")),
        image_url=get_m("identifier"),
        image_format=get_m("format"),
        publisher=get_o("publisher"),
        dataset_key=get_o("datasetKey"),
        record_url=F.concat(F.lit(OCCURRENCE_RECORD_URL), F.coalesce(key, F.lit("None"))),
    ))


def flatten_simple(pages: DataFrame, max_rows: int | None = None, keep=(), order_cols=()) -> DataFrame:
    """Six columns per medium that has an identifier; ``max_rows`` takes the first by ``order_cols``."""
    if max_rows is not None and not order_cols:
        raise ValueError("max_rows needs order_cols")
    occ = each_element(pages, "results", "o", keep)
    media = occ.select("*", F.explode("o.media").alias("m"))
    names, m_names = _struct_fields(media, "o"), _struct_fields(media, "m")
    url = field(m_names, "m", "identifier")
    rows = media.where(F.coalesce(url, F.lit("")) != "").select(
        *keep,
        field(names, "o", "key").cast("string").alias("occurrence_key"),
        field(names, "o", "species").alias("species"),
        field(names, "o", "decimalLatitude").alias("lat"),
        field(names, "o", "decimalLongitude").alias("lon"),
        url.alias("image_url"),
        field(m_names, "m", "license").alias("license"),
    )
    return rows.orderBy(*order_cols).limit(max_rows) if max_rows is not None else rows


def _geopoint(df: DataFrame, path: str) -> Column:
    """Parse a landed geopoint by the type it was landed with."""
    kind = dict(df.select(F.col(path).alias("g")).dtypes)["g"]
    if kind.startswith("struct"):
        return parse_geopoint_struct(path)
    if kind.startswith("array"):
        return parse_geopoint_array(path)
    return parse_geopoint_text(F.nullif(F.col(path), F.lit("")))


def flatten_records(pages: DataFrame, keep=()) -> DataFrame:
    """Specimen records: index terms first, raw data as stand-in for uuid and geopoint."""
    items = each_element(pages, "items", "i", keep)
    sides = set(_struct_fields(items, "i"))
    terms = _struct_fields(items, "i.indexTerms") if "indexTerms" in sides else []
    data = _struct_fields(items, "i.data") if "data" in sides else []
    get = lambda n: field(terms, "i.indexTerms", n)
    points = [
        _geopoint(items, f"i.{side}.geopoint")
        for side, names in (("indexTerms", terms), ("data", data)) if "geopoint" in names
    ]
    # A present index geopoint hides the raw one even when it cannot be parsed.
    if len(points) == 2:
        shown = F.col("i.indexTerms.geopoint")
        kind = dict(items.select(shown.alias("g")).dtypes)["g"]
        present = shown.isNotNull()
        if kind == "string":
            present = present & (shown != "")
        elif kind.startswith("array"):
            present = present & (F.size(shown) > 0)
        point = F.when(present, points[0]).otherwise(points[1])
    else:
        point = points[0] if points else F.lit(None).cast("struct<lat:double,lon:double>")
    text = {
        "record_uuid": first_nonempty(get("uuid"), field(data, "i.data", "idigbio:uuid")),
        "institution_code": get("institutioncode"),
        "catalog_number": get("catalognumber"),
        "family": get("family"),
        "genus": get("genus"),
        "species": get("specificepithet"),
        "scientific_name": get("scientificname"),
        "country": get("country"),
        "state_province": get("stateprovince"),
        "locality": get("locality"),
        "event_date": first_nonempty(get("datecollected"), get("eventdate")),
        "basis_of_record": get("basisofrecord"),
    }
    return items.select(*keep, point.alias("__p"), *[normalize_text(c).alias(n) for n, c in text.items()]).select(
        *keep, *text, F.col("__p.lat").alias("latitude"), F.col("__p.lon").alias("longitude")
    )


def flatten_media(pages: DataFrame, keep=()) -> DataFrame:
    """Media with uuid and URI, one row per linked record; unlinked media keep a blank record."""
    items = each_element(pages, "items", "i", keep)
    terms = _struct_fields(items, "i.indexTerms")
    get = lambda n: field(terms, "i.indexTerms", n)
    links = F.col("i.indexTerms.records") if "records" in terms else F.lit(None).cast("array<string>")
    if "records" in terms and not dict(items.select(links.alias("r")).dtypes)["r"].startswith("array"):
        links = F.when(links.isNotNull(), F.array(links))
    media = items.select(
        *keep,
        links.alias("__links"),
        normalize_text(get("uuid")).alias("media_uuid"),
        normalize_text(get("accessuri")).alias("image_url"),
        normalize_text(get("format")).alias("image_format"),
        normalize_text(first_nonempty(get("webstatement"), get("rights"))).alias("license"),
    ).where((F.col("media_uuid") != "") & (F.col("image_url") != ""))
    return media.select("*", F.explode_outer("__links").alias("__link")).select(
        *keep, normalize_text("__link").alias("record_uuid"), "media_uuid", "image_url", "image_format", "license"
    )


def specimen_manifest_row(record_id="record_uuid") -> list[Column]:
    """Manifest columns of a joined record and medium."""
    c = F.col
    return manifest_row(
        source=F.lit(SPECIMEN_SOURCE), record_id=c(record_id), media_id=c("media_uuid"),
        institution_code=c("institution_code"), catalog_number=c("catalog_number"), family=c("family"),
        genus=c("genus"), species=c("species"), scientific_name=c("scientific_name"), latitude=c("latitude"),
        longitude=c("longitude"), country=c("country"), state_province=c("state_province"),
        locality=c("locality"), event_date=c("event_date"), basis_of_record=c("basis_of_record"),
        license=c("license"), image_url=c("image_url"), image_format=c("image_format"),
        record_url=F.concat(F.lit(SPECIMEN_RECORD_URL), c(record_id)),
    )
