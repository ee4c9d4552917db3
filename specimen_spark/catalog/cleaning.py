"""Queries of cleaning, counts per record and species ids."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.snippets import CLEANED, JUDGED, nt
from specimen_spark.catalog.views import view
from specimen_spark.operators import cleaning
from specimen_spark.plans import summaries
from specimen_spark.session import cut_lineage

ORDER = ["row_idx"]
_CLEAN = [
    "row_idx", "source", "record_id", "media_id", "specimen_key", "record_image_count", "family", "genus", "species",
    "species_source", "scientific_name", "latitude", "longitude", "has_coordinates", "us_region", "country",
    "state_province", "event_date", "month", "license", "image_url", "image_format", "download_status", "raw_species",
]


def cleaned(spark, sf, **options):
    return cleaning.clean_manifest(view(spark, sf, "raw_manifest"), ORDER, **options)


def flagship(spark, sf):
    """Raw manifest to cleaned rows to species ids to counts by region and species."""
    clean, _ = cleaned(spark, sf)
    # Aggregated first and stored: ids are found and joined on the few counted rows.
    counts = cut_lineage(clean.groupBy("us_region", "species").agg(
        F.count(F.lit(1)).alias("rows"), F.max("record_image_count").alias("max_record_images")))
    ids = cleaning.species_vocab(counts, rows="rows").drop("rows")
    return counts.join(ids, "species").select("us_region", "species", "species_id", "rows", "max_record_images")


VOCAB = f"""{CLEANED}, vocab AS (
  SELECT species, CAST(row_number() OVER (ORDER BY n DESC, species) - 1 AS INT) AS species_id, n
  FROM (SELECT species, count(*) AS n FROM cleaned GROUP BY species) t)"""

query("M1_region_species_counts", f"""WITH {VOCAB}
SELECT us_region, c.species, species_id, count(*) AS rows, max(record_image_count) AS max_record_images
FROM cleaned c JOIN vocab v ON c.species = v.species GROUP BY ALL""")(flagship)


@query("C1_clean_manifest", f"WITH {CLEANED} SELECT * FROM cleaned")
def clean_manifest(spark, sf):
    return cleaned(spark, sf)[0].select(*_CLEAN)


@query("C1_rejected_rows", f"WITH {JUDGED} SELECT row_idx, image_url, reason AS reject_reason FROM judged WHERE reason IS NOT NULL")
def rejected_rows(spark, sf):
    return cleaned(spark, sf)[1].select("row_idx", "image_url", "reject_reason")


@query("C1_clean_image_only", f"""WITH {JUDGED}
SELECT row_idx, canonical AS species, coalesce(lat, -999.0) AS latitude,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'missing_coordinate' WHEN region = '' THEN 'outside_us_scope' ELSE region END AS us_region
FROM judged WHERE url <> '' AND claim_no = 1 AND lower({nt('family')}) IN ('', 'nymphalidae') AND canonical <> ''""")
def clean_image_only(spark, sf):
    clean, _ = cleaned(spark, sf, allow_missing_coordinates=True, filter_us_scope=False)
    return clean.select("row_idx", "species", F.coalesce("latitude", F.lit(-999.0)).alias("latitude"), "us_region")


@query("F1_reason_counts", f"WITH {JUDGED} SELECT reason, count(*) AS rows FROM judged WHERE reason IS NOT NULL GROUP BY reason")
def reason_counts(spark, sf):
    return summaries.reason_counts(cleaned(spark, sf)[1])


@query("F3_cleaning_summary", f"""WITH {CLEANED}
SELECT 'totals' AS section, 'cleaned_rows' AS key, CAST(count(*) AS DOUBLE) AS value FROM cleaned
UNION ALL SELECT 'totals', 'unique_species', CAST(count(DISTINCT species) AS DOUBLE) FROM cleaned
UNION ALL SELECT 'totals', 'rejected_rows', CAST(count(*) AS DOUBLE) FROM judged WHERE reason IS NOT NULL
UNION ALL SELECT 'rejection_counts', reason, CAST(count(*) AS DOUBLE) FROM judged WHERE reason IS NOT NULL GROUP BY reason
UNION ALL (SELECT 'top_species', species, CAST(n AS DOUBLE) FROM (
  SELECT species, count(*) AS n, min(row_idx) AS f FROM cleaned GROUP BY species ORDER BY n DESC, f LIMIT 25) t)
UNION ALL SELECT 'rows_by_region', us_region, CAST(count(*) AS DOUBLE) FROM cleaned GROUP BY us_region
UNION ALL SELECT 'rows_by_source', source, CAST(count(*) AS DOUBLE) FROM cleaned GROUP BY source""")
def cleaning_summary(spark, sf):
    raw = view(spark, sf, "raw_manifest")
    judged = cleaning.judge_rows(raw, ORDER, names_once=True)
    # The summary needs five columns, and the cascade is aggregated once.
    return summaries.judged_summary(judged.select(
        *ORDER, "source", "reject_reason", F.col("__species_label").alias("species"), F.col("__region").alias("us_region")), ORDER)


@query("F6_record_image_count", f"""
SELECT {nt('source')} AS source, {nt('record_id')} AS record_id, count(*) AS record_image_count FROM {{raw_manifest}}
WHERE {nt('record_id')} <> '' GROUP BY ALL""")
def record_image_count(spark, sf):
    return cleaning.record_image_count(view(spark, sf, "raw_manifest"))


@query("F7_species_ids", f"WITH {VOCAB} SELECT row_idx, c.species, species_id FROM cleaned c JOIN vocab v ON c.species = v.species")
def species_ids(spark, sf):
    clean = cut_lineage(cleaned(spark, sf)[0].select(*ORDER, "species"))
    labelled, _ = cleaning.assign_species_ids(clean)
    return labelled.select("row_idx", "species", "species_id")


@query("F7_species_vocab", f"WITH {VOCAB} SELECT species, species_id FROM vocab")
def species_vocab(spark, sf):
    return cleaning.species_vocab(cleaned(spark, sf)[0]).drop("rows")
