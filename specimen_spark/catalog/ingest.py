"""Queries of landed pages, archives, merging and ingest reports."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.scalars import INGEST_BINOMIAL
from specimen_spark.catalog.views import view
from specimen_spark.functions.text import normalize_text
from specimen_spark.operators import dedupe, joins
from specimen_spark.operators.processed import cap_rows
from specimen_spark.plans import summaries
from specimen_spark.sources import archive, manifest, pages, vocab
from specimen_spark.session import scratch_path

ORDER = ["row_idx"]
_FLAT = ["record_id", "media_id", "genus", "raw_species", "scientific_name", "latitude", "longitude", "country",
         "license", "rights_holder", "image_url", "image_format", "record_url"]


def occurrence_pages(spark, sf):
    """Nested pages of one occurrence each, built from the flat manifest.

    Media of line numbers 1, 2 and 3 are recognised by type, format and ending;
    the others by none of them when their URL has no image ending.
    """
    raw = view(spark, sf, "raw_manifest")
    line = F.substring_index("media_id", "-", -1).cast("int")
    media = F.struct(
        F.nullif(F.col("image_url"), F.lit("")).alias("identifier"),
        F.when(line == 1, F.lit("StillImage")).otherwise(F.lit("Sound")).alias("type"),
        F.when(line == 2, F.lit("image/tiff")).otherwise(F.lit("")).alias("format"),
        F.when(line == 4, F.lit("")).otherwise(F.col("license")).alias("license"),
        F.lit("").alias("rightsHolder"), F.col("source").alias("creator"),
    )
    occurrence = F.struct(
        F.col("row_idx").alias("key"), F.col("genus").alias("genus"), F.col("species").alias("species"),
        F.lit("").alias("acceptedScientificName"), F.col("scientific_name").alias("scientificName"),
        F.col("latitude").try_cast("double").alias("decimalLatitude"),
        F.col("longitude").try_cast("double").alias("decimalLongitude"),
        F.col("country").alias("country"), F.lit("CC0 record").alias("license"),
        F.when(line == 5, F.lit("holder")).alias("rightsHolder"), F.array(media, media).alias("media"),
    )
    return raw.select("row_idx", F.array(occurrence).alias("results"))


_OCC = """occ AS (
  SELECT *, CAST(split_part(media_id, '-', 2) AS INT) AS line FROM {raw_manifest}, range(2) twice(copy))"""
_NUM = lambda c: f"try_cast({c} AS DOUBLE)"


@query("A4_flatten_occurrences", f"""WITH {_OCC}
SELECT row_idx, CAST(copy AS INT) AS media_pos, CAST(row_idx AS VARCHAR) AS record_id, image_url AS media_id, genus, trim(species) AS raw_species,
  trim(scientific_name) AS scientific_name, CASE WHEN isnan({_NUM('latitude')}) THEN -999.0 ELSE {_NUM('latitude')} END AS latitude, {_NUM('longitude')} AS longitude,
  trim(regexp_replace(country, '\\s+', ' ', 'g')) AS country, CASE WHEN line = 4 OR license = '' THEN 'CC0 record' ELSE license END AS license,
  CASE WHEN line = 5 THEN 'holder' ELSE source END AS rights_holder, image_url,
  CASE WHEN line = 2 THEN 'image/tiff' ELSE '' END AS image_format,
  'https://www.gbif.org/occurrence/' || row_idx AS record_url
FROM occ WHERE image_url <> '' AND (line IN (1, 2) OR regexp_matches(lower(image_url), '\\.(jpg|jpeg|png|webp|tif|tiff|bmp|gif)$'))""")
def flatten_occurrences(spark, sf):
    rows = pages.flatten_occurrences(occurrence_pages(spark, sf), keep=("row_idx",))
    latitude = F.when(F.isnan("latitude"), F.lit(-999.0)).otherwise(F.col("latitude"))
    return rows.withColumn("latitude", latitude).select("row_idx", "media_pos", *_FLAT)


@query("A5_flatten_simple", f"""WITH {_OCC}
SELECT CAST(row_idx AS VARCHAR) AS occurrence_key, species, CASE WHEN isnan({_NUM('latitude')}) THEN -999.0 ELSE {_NUM('latitude')} END AS lat, {_NUM('longitude')} AS lon, image_url,
  CASE WHEN line = 4 THEN '' ELSE license END AS license
FROM occ WHERE image_url <> ''""")
def flatten_simple(spark, sf):
    rows = pages.flatten_simple(occurrence_pages(spark, sf))
    return rows.withColumn("lat", F.when(F.isnan("lat"), F.lit(-999.0)).otherwise(F.col("lat")))


def record_pages(spark, sf):
    """Specimen records: three of four in the index, the uuid of the rest only in the raw data."""
    orders = view(spark, sf, "orders")
    indexed = F.col("o_custkey") % 4 != 0
    uuid = F.concat(F.lit("u-"), F.col("o_orderkey").cast("string"))
    point = F.concat_ws(", ", (F.col("o_orderkey") % 90).cast("string"), (F.col("o_custkey") % 180).cast("string"))
    item = F.struct(
        F.struct(
            F.when(indexed, uuid).otherwise(F.lit("")).alias("uuid"),
            F.when(indexed, F.struct((F.col("o_orderkey") % 80).cast("double").alias("lat"),
                                     (F.col("o_custkey") % 170).cast("double").alias("lon"))).alias("geopoint"),
            F.concat(F.lit(" "), F.col("o_orderpriority")).alias("family"),
            F.lit("smallus").alias("genus"), F.lit("ringus").alias("specificepithet"),
            F.when(F.col("o_custkey") % 3 == 0, F.lit("")).otherwise(F.lit("1999-05-01")).alias("datecollected"),
            F.lit("2001-07-02").alias("eventdate"),
        ).alias("indexTerms"),
        F.struct(uuid.alias("idigbio:uuid"), point.alias("geopoint")).alias("data"),
    )
    return orders.select(F.col("o_orderkey").alias("page"), F.array(item).alias("items"))


_RECORDS = """records AS (
  SELECT o_orderkey AS page, 'u-' || o_orderkey AS record_uuid, trim(o_orderpriority) AS family, 'smallus' AS genus, 'ringus' AS species,
    CAST(CASE WHEN o_custkey % 4 <> 0 THEN o_orderkey % 80 ELSE o_orderkey % 90 END AS DOUBLE) AS latitude,
    CAST(CASE WHEN o_custkey % 4 <> 0 THEN o_custkey % 170 ELSE o_custkey % 180 END AS DOUBLE) AS longitude,
    CASE WHEN o_custkey % 3 = 0 THEN '2001-07-02' ELSE '1999-05-01' END AS event_date
  FROM orders)"""


@query("A6_flatten_records", f"WITH {_RECORDS} SELECT * FROM records")
def flatten_records(spark, sf):
    return pages.flatten_records(record_pages(spark, sf), keep=("page",)).select(
        "page", "record_uuid", "family", "genus", "species", "latitude", "longitude", "event_date")


def media_pages(spark, sf):
    """Media linked to no, one or two records; some lack a uuid or URI."""
    lines = view(spark, sf, "raw_manifest")
    record = F.concat(F.lit("u-"), F.substring_index("media_id", "-", 1))
    line = F.substring_index("media_id", "-", -1).cast("int")
    item = F.struct(F.struct(
        F.when(line == 6, F.lit("")).otherwise(F.concat(F.lit("m-"), F.col("row_idx").cast("string"))).alias("uuid"),
        F.col("image_url").alias("accessuri"), F.lit("image/jpeg").alias("format"),
        F.col("license").alias("webstatement"), F.lit("some rights").alias("rights"),
        F.when(line == 1, F.array().cast("array<string>")).when(line == 2, F.array(record, F.lit("u-none")))
        .when(line != 3, F.array(record)).alias("records"),
    ).alias("indexTerms"))
    return lines.select("row_idx", F.array(item).alias("items"))


_MEDIA = """media AS (
  SELECT row_idx, r AS record_uuid, 'm-' || row_idx AS media_uuid, image_url, 'image/jpeg' AS image_format,
    CASE WHEN license = '' THEN 'some rights' ELSE license END AS license
  FROM (SELECT *, CAST(split_part(media_id, '-', 2) AS INT) AS line, unnest(CASE CAST(split_part(media_id, '-', 2) AS INT)
      WHEN 1 THEN [''] WHEN 3 THEN [''] WHEN 2 THEN ['u-' || split_part(media_id, '-', 1), 'u-none']
      ELSE ['u-' || split_part(media_id, '-', 1)] END) AS r FROM {raw_manifest}) t
  WHERE line <> 6 AND image_url <> '')"""


@query("A7_flatten_media", f"WITH {_MEDIA} SELECT * FROM media")
def flatten_media(spark, sf):
    return pages.flatten_media(media_pages(spark, sf), keep=("row_idx",))


@query("D1_join_records_media", f"""WITH {_RECORDS}, {_MEDIA}
SELECT row_idx, m.record_uuid AS record_id, media_uuid AS media_id, 'Smallus ringus' AS species, latitude, longitude, event_date, license,
  'https://search.idigbio.org/v2/view/records/' || m.record_uuid AS record_url
FROM media m JOIN records r ON m.record_uuid = r.record_uuid""")
def join_records_media(spark, sf):
    records = pages.flatten_records(record_pages(spark, sf), keep=("page",))
    media = pages.flatten_media(media_pages(spark, sf), keep=("row_idx",))
    return joins.join_records_media(records, media, ["page"], ORDER).select(
        "row_idx", "record_id", "media_id", "species", "latitude", "longitude", "event_date", "license", "record_url")


@query("A8_import_archive", """WITH occ AS (
  SELECT record_id AS core, scientific_name, genus, species, raw_species, latitude, longitude FROM (
    SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY row_idx DESC) AS n FROM {raw_manifest} WHERE record_id <> '') t WHERE n = 1),
rows AS (
  SELECT row_idx, core AS record_id, m.media_id, image_url, trim(o.scientific_name) AS scientific_name, trim(image_format) AS image_format,
    CASE WHEN o.latitude IN ('', 'nan') THEN NULL ELSE CAST(o.latitude AS DOUBLE) END AS latitude,
    row_number() OVER (PARTITION BY image_url ORDER BY row_idx) AS n
  FROM {raw_manifest} m JOIN occ o ON m.record_id = o.core
  WHERE image_url <> '' AND (starts_with(image_format, 'image/') OR regexp_matches(lower(image_url), '\\.(jpg|jpeg|png|webp|tif|tiff|bmp|gif)$')))
SELECT * EXCLUDE (n) FROM rows WHERE n = 1""")
def import_archive(spark, sf):
    raw = view(spark, sf, "raw_manifest")
    occurrence = raw.select(
        "row_idx", F.col("record_id").alias("coreid"), F.col("scientific_name").alias("dwc:scientificName"),
        F.col("genus").alias("dwc:genus"),
        F.concat_ws(", ", F.when(F.col("latitude") != "nan", F.col("latitude")), "longitude").alias("idigbio:geoPoint"))
    media = raw.select(
        "row_idx", F.col("record_id").alias("coreid"), F.col("image_url").alias("ac:accessURI"),
        F.col("image_format").alias("dcterms:format"), F.col("media_id").alias("idigbio:uuid"))
    # A geopoint of one number only cannot be read: its coordinates stay null.
    occurrence = occurrence.withColumn("idigbio:geoPoint", F.when(
        F.col("`idigbio:geoPoint`").rlike("^[0-9.]+, "), F.col("`idigbio:geoPoint`")))
    return archive.import_dwca(occurrence, media, ORDER, ORDER).select(
        "row_idx", "record_id", "media_id", "image_url", "scientific_name", "image_format", "latitude")


@query("A2_manifest_round_trip", """
SELECT row_idx, source, country, image_url, coalesce(nullif(latitude, ''), '<blank>') AS latitude FROM {raw_manifest}""")
def manifest_round_trip(spark, sf):
    raw = view(spark, sf, "raw_manifest").withColumn("_working", F.lit(1))
    path = scratch_path(spark, "manifest")
    manifest.write_manifest(raw, path, "csv")
    back = manifest.read_manifest(spark, path, required=("source", "image_url"))
    return back.select(
        F.col("row_idx").cast("bigint").alias("row_idx"), "source", "country", "image_url",
        F.coalesce(F.nullif("latitude", F.lit("")), F.lit("<blank>")).alias("latitude"))


@query("A2_partitioned_manifest", """
SELECT row_idx, source, download_status, image_url, latitude FROM {raw_manifest}""")
def partitioned_manifest(spark, sf):
    """Written by source and status, read back by partition."""
    path = scratch_path(spark, "partitioned")
    manifest.write_manifest(view(spark, sf, "raw_manifest"), path, partition_by=["source", "download_status"])
    return manifest.read_raw_parquet(spark, path).select("row_idx", "source", "download_status", "image_url", "latitude")


@query("A3_summary_round_trip", "SELECT status, count(*) AS rows FROM {progress_log} GROUP BY status")
def summary_round_trip(spark, sf):
    path = scratch_path(spark, "summary")
    counts = view(spark, sf, "progress_log").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
    manifest.write_summary(counts, path)
    return spark.read.schema("status string, rows bigint").json(path)


@query("A10_vocab_round_trip", """
SELECT p_name AS species, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INT) AS species_id,
  'species_' || (row_number() OVER (ORDER BY p_name) - 1) AS stand_in FROM (SELECT DISTINCT p_name FROM part) t""")
def vocab_round_trip(spark, sf):
    from specimen_spark.operators.keyed import bucketed_rank

    names = view(spark, sf, "part").select(F.col("p_name").alias("species")).distinct()
    ranked = bucketed_rank(names.withColumn("lead", F.substring("species", 1, 3)), [], ["lead"], ["species"], "n")
    path = scratch_path(spark, "vocab")
    vocab.write_vocab(ranked.select("species", (F.col("n") - 1).cast("int").alias("species_id")), path)
    back = vocab.read_vocab_lines(spark, path)
    stand_in = vocab.default_vocab(spark, names.count()).withColumnRenamed("species", "stand_in")
    return back.join(stand_in, "species_id").select("species", "species_id", "stand_in")


_FIRST_URL = """SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY trim(image_url) ORDER BY {order}) AS n
  FROM {src} WHERE trim(image_url) <> '') t WHERE n = 1"""


@query("E1_dedupe_by_url", "SELECT row_idx, image_url, source FROM (" + _FIRST_URL.replace("{order}", "row_idx").replace("{src}", "{raw_manifest}") + ") u")
def dedupe_by_url(spark, sf):
    return dedupe.dedupe_by_url(view(spark, sf, "raw_manifest").select("row_idx", "image_url", "source"), ORDER)


def _merged(spark, sf):
    raw = view(spark, sf, "raw_manifest").select("row_idx", "source", "image_url")
    inputs = {name: raw.where(F.col("source") == name) for name in ("idigbio_dwca", "gbif", "idigbio")}
    return dedupe.merge_manifests(inputs, ORDER)


_INPUT = "CASE source WHEN 'idigbio_dwca' THEN 0 WHEN 'gbif' THEN 1 ELSE 2 END, row_idx"
_MERGED = "merged AS (" + _FIRST_URL.replace("{order}", _INPUT).replace("{src}", "{raw_manifest}") + ")"


@query("E2_merge_manifests", f"WITH {_MERGED} SELECT row_idx, source, image_url FROM merged")
def merge_manifests(spark, sf):
    return _merged(spark, sf)[0].select("row_idx", "source", "image_url")


@query("E2_merge_counts", f"""WITH {_MERGED}
SELECT 'inputs' AS section, source AS key, count(*) AS rows FROM {{raw_manifest}} GROUP BY source
UNION ALL SELECT 'total', 'before_dedupe', count(*) FROM {{raw_manifest}}
UNION ALL SELECT 'total', 'after_dedupe', count(*) FROM merged""")
def merge_counts(spark, sf):
    return _merged(spark, sf)[1]


def _flat_rows(spark, sf):
    raw = view(spark, sf, "raw_manifest")
    c = F.col
    number = lambda n: F.when(~F.isnan(c(n).try_cast("double")), c(n).try_cast("double"))
    return raw.select("row_idx", *pages.manifest_row(
        source=c("source"), record_id=c("record_id"), genus=c("genus"), species=c("species"),
        scientific_name=c("scientific_name"), latitude=number("latitude"), longitude=number("longitude"),
        image_url=c("image_url")))


@query("F2_ingest_summary", "WITH binomial AS (" + INGEST_BINOMIAL + """), flat AS (
  SELECT r.row_idx, source, b.species AS species, b.is_species_level AS level,
    CASE WHEN latitude NOT IN ('', 'nan') THEN CAST(latitude AS DOUBLE) END AS lat, CAST(longitude AS DOUBLE) AS lon
  FROM {raw_manifest} r JOIN binomial b ON r.row_idx = b.row_idx)
SELECT 'totals' AS section, 'rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM flat
UNION ALL SELECT 'totals', 'rows_with_species_level_label', CAST(count(*) AS DOUBLE) FROM flat WHERE level
UNION ALL SELECT 'totals', 'unique_species', CAST(count(DISTINCT species) AS DOUBLE) FROM flat WHERE level
UNION ALL SELECT 'totals', 'latitude_min', min(lat) FROM flat UNION ALL SELECT 'totals', 'latitude_max', max(lat) FROM flat
UNION ALL SELECT 'totals', 'longitude_min', min(lon) FROM flat UNION ALL SELECT 'totals', 'longitude_max', max(lon) FROM flat
UNION ALL SELECT 'by_source', source, CAST(count(*) AS DOUBLE) FROM flat GROUP BY source
UNION ALL (SELECT 'top_species', species, CAST(n AS DOUBLE) FROM (
  SELECT species, count(*) AS n, min(row_idx) AS f FROM flat WHERE level GROUP BY species ORDER BY n DESC, f LIMIT 20) t)""")
def ingest_summary(spark, sf):
    return summaries.ingest_summary(_flat_rows(spark, sf), ORDER)


@query("F16_download_summary", """
SELECT count(*) FILTER (WHERE download_status = 'downloaded') AS downloaded, count(*) FILTER (WHERE download_status = 'exists') AS skipped_existing,
  count(*) FILTER (WHERE download_status NOT IN ('downloaded', 'exists')) AS failed FROM {raw_manifest}""")
def download_summary(spark, sf):
    return summaries.download_summary(view(spark, sf, "raw_manifest"))


@query("G2_top_values", """
SELECT value, n AS rows FROM (
  SELECT trim(regexp_replace(country, '\\s+', ' ', 'g')) || ' ' || event_date AS value, count(*) AS n, min(row_idx) AS f
  FROM {raw_manifest} GROUP BY 1 ORDER BY n DESC, f LIMIT 20) t""")
def top_values(spark, sf):
    raw = view(spark, sf, "raw_manifest")
    return summaries.top_values(
        raw.withColumn("v", F.concat_ws(" ", normalize_text("country"), "event_date")), "v", 20, ORDER)


@query("G6_cap_rows", "SELECT row_idx, source FROM {raw_manifest} ORDER BY row_idx LIMIT 250")
def capped(spark, sf):
    return cap_rows(view(spark, sf, "raw_manifest"), 250, ORDER).select("row_idx", "source")
