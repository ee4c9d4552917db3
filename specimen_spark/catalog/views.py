"""Manifests derived from the supplied tables.

The same SQL text runs in Spark and in DuckDB; ``{name}`` stands for a table
or for another view. Row keys are arithmetic, so no view needs a global sort.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

_ROW = "(l_orderkey * 8 + l_linenumber) * 2097152 + (l_partkey % 2048) * 1024 + l_suppkey % 1024"

VIEWS = {
    "raw_manifest": f"""
SELECT {_ROW} AS row_idx,
  CASE l_returnflag WHEN 'A' THEN 'gbif' WHEN 'N' THEN 'idigbio' ELSE 'idigbio_dwca' END AS source,
  CASE WHEN l_partkey % 97 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) END AS record_id,
  concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS media_id,
  CASE WHEN l_linenumber = 7 THEN 'Pieridae' WHEN l_linenumber = 6 THEN '' ELSE 'Nymphalidae' END AS family,
  genus, species, raw_species, scientific_name,
  CASE WHEN l_suppkey % 23 = 0 THEN '' WHEN l_suppkey % 29 = 0 THEN 'nan'
       ELSE CAST(CAST(1500 + (l_orderkey * 37 + l_partkey * 11) % 6000 AS DOUBLE) / 100 AS STRING) END AS latitude,
  CAST(CAST(-18000 + (l_orderkey * 53 + l_suppkey * 7) % 12000 AS DOUBLE) / 100 AS STRING) AS longitude,
  CASE l_linenumber % 3 WHEN 0 THEN ' united  states of america ' WHEN 1 THEN 'USA' ELSE 'Mexico' END AS country,
  CASE l_suppkey % 3 WHEN 0 THEN 'new  york' WHEN 1 THEN 'TEXAS' ELSE 'Sonora' END AS state_province,
  CAST(CAST(l_shipdate AS DATE) AS STRING) AS event_date,
  CASE l_partkey % 5 WHEN 0 THEN 'CC0' WHEN 1 THEN 'http://creativecommons.org/licenses/by-nc/4.0/'
       WHEN 2 THEN 'All rights reserved' WHEN 3 THEN 'CC BY-SA 4.0' ELSE '' END AS license,
  CASE WHEN l_partkey % 41 = 0 THEN '' ELSE concat('http://img.example/', CAST(l_orderkey % 5000 AS STRING), '/',
       CAST(l_suppkey % 50 AS STRING), CASE l_linenumber % 4 WHEN 0 THEN '_dorsal.JPG' WHEN 1 THEN '_v.png'
       WHEN 2 THEN '_under-side' ELSE '.tiff?x=1' END) END AS image_url,
  CASE l_linenumber % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png; q=1' WHEN 2 THEN 'image/tiff' ELSE '' END AS image_format,
  CASE l_linenumber % 5 WHEN 0 THEN 'failed' WHEN 1 THEN 'exists' ELSE 'downloaded' END AS download_status
FROM {{lineitem}} l JOIN (SELECT p_partkey,
    CASE WHEN p_partkey % 13 = 0 THEN '' ELSE split_part(p_name, ' ', 1) END AS genus,
    CASE WHEN p_partkey % 11 = 0 THEN 'sp.' WHEN p_partkey % 5 = 0 THEN split_part(p_name, ' ', 2)
         WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END AS species,
    CASE WHEN p_partkey % 17 = 0 THEN split_part(p_name, ' ', 2) ELSE '' END AS raw_species,
    concat(upper(substr(p_name, 1, 1)), substr(CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END, 2),
         ' (Author, 1900)') AS scientific_name FROM {{part}} q) p ON l_partkey = p_partkey""",
    "processed_manifest": f"""
SELECT {_ROW} AS source_row_index,
  CASE l_returnflag WHEN 'A' THEN 'gbif' ELSE 'idigbio' END AS source,
  CASE WHEN l_partkey % 19 = 0 THEN '' ELSE CAST(l_orderkey AS STRING) END AS record_id,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE concat('k:', CAST(l_orderkey AS STRING)) END AS specimen_key,
  concat('http://img.example/', CAST(l_orderkey % 5000 AS STRING), '/', CAST(l_linenumber AS STRING)) AS image_url,
  CASE WHEN l_partkey % 23 = 0 THEN '' ELSE concat('images/', CAST(l_orderkey % 900 AS STRING), '_',
       lpad(CAST(l_suppkey AS STRING), 6, '0'), '.jpg') END AS processed_image_path,
  p_name AS species,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN 'rejected_view' WHEN l_linenumber = 7 THEN 'missing_input' ELSE 'ok' END AS preprocess_status,
  CASE WHEN l_partkey % 10 = 0 THEN 'False' ELSE 'True' END AS keep_for_training,
  CASE WHEN l_partkey % 31 = 0 THEN 'recovered_from_existing_output' WHEN l_partkey % 29 = 0 THEN 'fallback_center_crop'
       ELSE 'heuristic_mask_foreground_component' END AS crop_method,
  CASE WHEN l_linestatus = 'O' AND l_linenumber = 1 THEN CASE l_partkey % 3 WHEN 0 THEN 'fallback_crop' WHEN 1 THEN 'unknown_view' ELSE '' END
       ELSE '' END AS rejection_reason,
  CASE l_suppkey % 3 WHEN 0 THEN 'dorsal' WHEN 1 THEN 'unknown' ELSE '' END AS view_hint,
  CASE l_suppkey % 4 WHEN 0 THEN 'accepted' WHEN 1 THEN 'metadata_dorsal' WHEN 2 THEN 'metadata_ventral' ELSE '' END AS view_status,
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE CAST(l_partkey * 31 % 100 AS DOUBLE) / 100 END AS mask_quality_score,
  CASE WHEN l_partkey % 43 = 0 THEN NULL ELSE CAST(l_partkey * 17 % 100 AS DOUBLE) / 100 END AS symmetry_score,
  CAST(l_partkey * 13 % 100 AS DOUBLE) / 100 AS fill_ratio,
  CAST(l_suppkey * 7 % 60 AS DOUBLE) / 100 AS coverage_ratio,
  CAST(80 + l_partkey * 3 % 300 AS DOUBLE) / 100 AS horizontal_ratio,
  CAST(l_partkey * 29 % 100 AS DOUBLE) / 100 AS wing_balance_ratio,
  CAST(3 + l_partkey % 12 AS INT) AS polygon_vertices,
  CAST(50 + l_partkey * 7 % 50 AS DOUBLE) / 100 AS mask_solidity,
  CAST(l_partkey * 5 % 2000 AS DOUBLE) / 10 AS mask_mean_saturation,
  l_tax > 0.07 AS mask_touches_border,
  CASE l_orderkey % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
FROM {{lineitem}} l JOIN {{part}} p ON l_partkey = p_partkey""",
    "measured": f"""
SELECT {_ROW} AS row_idx,
  CASE l_suppkey % 5 WHEN 0 THEN 'dorsal' WHEN 1 THEN 'ventral' WHEN 2 THEN 'lateral' ELSE 'unknown' END AS view_hint,
  CASE WHEN l_partkey % 29 = 0 THEN 'fallback_center_crop' ELSE 'component' END AS crop_method,
  l_partkey % 17 <> 0 AS input_exists,
  CAST(l_partkey * 31 % 600 AS DOUBLE) / 1000 AS coverage_ratio,
  CAST(80 + l_suppkey * 37 % 470 AS DOUBLE) / 100 AS horizontal_ratio,
  CAST(l_partkey * 13 % 100 AS DOUBLE) / 100 AS fill_ratio,
  CAST(l_orderkey * 17 % 100 AS DOUBLE) / 100 AS symmetry_score,
  CAST(l_orderkey * 29 % 100 AS DOUBLE) / 100 AS wing_balance_ratio,
  CAST(l_partkey * 7 % 2000 AS DOUBLE) / 10 AS mean_saturation,
  CAST(l_suppkey * 11 % 100 AS DOUBLE) / 100 AS low_saturation_fraction,
  CAST(l_orderkey * 3 % 100 AS DOUBLE) / 100 AS centroid_x_ratio,
  CAST(l_partkey * 3 % 100 AS DOUBLE) / 100 AS centroid_y_ratio,
  l_tax > 0.06 AS touches_border,
  CAST(3 + l_partkey % 12 AS INT) AS polygon_vertices,
  CAST(50 + l_partkey * 7 % 50 AS DOUBLE) / 100 AS solidity,
  CAST(l_orderkey % 40 AS INT) AS x0, CAST(l_partkey % 30 AS INT) AS y0,
  CAST(l_orderkey % 40 + 1 + l_suppkey % 90 AS INT) AS x1, CAST(l_partkey % 30 + 1 + l_orderkey % 70 AS INT) AS y1,
  CAST(131 + l_linenumber AS INT) AS width, CAST(100 + l_partkey % 3 AS INT) AS height
FROM {{lineitem}} l""",
    "candidates": f"""
SELECT {_ROW} AS row_idx,
  CAST(l_partkey * 31 % 60 AS DOUBLE) / 100 AS coverage,
  CAST(l_suppkey * 37 % 100 AS DOUBLE) / 100 AS symmetry_score,
  CAST(l_partkey * 13 % 100 - 10 AS DOUBLE) / 100 AS rgb_symmetry,
  CAST(l_orderkey * 17 % 100 AS DOUBLE) / 1000 AS border_touch,
  CAST(l_orderkey * 29 % 100 AS DOUBLE) / 100 AS fill_ratio,
  CAST(l_partkey * 7 % 300 AS DOUBLE) / 100 AS aspect_ratio,
  CAST(l_suppkey * 11 % 100 AS DOUBLE) / 100 AS largest_component_ratio,
  CAST(1 + l_orderkey * 3 % 9 AS DOUBLE) AS component_count,
  CAST(l_partkey * 3 % 40 AS DOUBLE) / 100 AS foreground_luminance,
  CAST(l_suppkey * 3 % 40 AS DOUBLE) / 100 AS foreground_std,
  CAST(l_orderkey * 7 % 70 AS DOUBLE) / 100 AS center_distance
FROM {{lineitem}} l""",
    "strict_manifest": """
SELECT o_orderkey AS strict_idx, CASE o_custkey % 2 WHEN 0 THEN 'gbif' ELSE 'idigbio' END AS source,
  CASE WHEN o_custkey % 7 = 0 THEN '' ELSE CAST(o_orderkey AS STRING) END AS record_id,
  CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('k:', CAST(o_orderkey AS STRING)) END AS specimen_key,
  concat('http://img.example/', CAST(o_orderkey % 5000 AS STRING), '/1') AS image_url,
  CASE o_custkey % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END AS split
FROM {orders} o""",
    "progress_log": """
SELECT event_id, CAST(user_id AS STRING) AS occurrence_key, ts,
  CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'done_existing' WHEN 'purchase' THEN 'skip'
       WHEN 'signup' THEN 'fail_quality' ELSE 'fail_download' END AS status, value
FROM {events} e""",
    "points": """
SELECT c_custkey AS point_id, CAST(1500 + c_custkey * 37 % 6000 AS DOUBLE) / 100 AS lat,
  CAST(-18000 + c_custkey * 53 % 12000 AS DOUBLE) / 100 AS lon FROM {customer} c""",
    "shard_progress": """
SELECT concat('shard_', lpad(CAST(s_suppkey AS STRING), 12, '0')) AS shard,
  CASE WHEN s_nationkey % 9 = 0 THEN 'processing' ELSE 'complete' END AS stage,
  s_nationkey % 11 <> 0 AS processed_csv_exists, s_nationkey % 13 <> 0 AS summary_json_exists FROM {supplier} s""",
    "content": "SELECT doc_id AS image_id, text AS content FROM {documents} d",
    "listing": """
SELECT DISTINCT concat('/data/set/images/', CAST(o_orderkey % 900 AS STRING), '_', lpad(CAST(o_custkey % 100 AS STRING), 6, '0'), '.jpg')
  AS path FROM {orders} o
UNION SELECT DISTINCT concat('/data/images/', CAST(o_orderkey % 900 AS STRING), '_', lpad(CAST(o_custkey % 77 AS STRING), 6, '0'), '.jpg')
  FROM {orders} o2""",
    "outputs": """
SELECT concat('shard_', CAST(l_linenumber AS STRING), '/images/', CASE l_returnflag WHEN 'A' THEN 'gbif' ELSE 'idigbio' END, '_',
  CAST(l_orderkey AS STRING), '_', lpad(CAST(l_orderkey * CASE WHEN l_linenumber = 3 THEN 3 ELSE 1 END AS STRING), 12, '0'), '.jpg') AS path
FROM {lineitem} l""",
    "source_rows": """
SELECT o_orderkey AS source_row_index, CASE o_custkey % 2 WHEN 0 THEN 'gbif' ELSE 'idigbio' END AS source,
  CAST(o_orderkey AS STRING) AS record_id, o_orderpriority AS species,
  CASE WHEN o_custkey % 3 = 0 THEN '' ELSE concat('raw/', CAST(o_orderkey AS STRING), '.jpg') END AS image_path,
  concat('local/', CAST(o_orderkey AS STRING), '.jpg') AS local_image_path,
  CASE o_custkey % 4 WHEN 0 THEN 'dorsal' ELSE '' END AS view_hint
FROM {orders} o""",
}

# One text per engine: long-form class scores.
SPARK_ONLY = {
    "scores": """
SELECT vec_id AS example_id, label AS target, CAST(k AS INT) AS species_id, CAST(v AS DOUBLE) * 10 AS logit
FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS k, v""",
    "pixels": """
SELECT vec_id, k AS pos, CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.5) * 255), 0), 255) AS INT) AS level
FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS k, v""",
}
DUCK_ONLY = {
    "scores": """
SELECT vec_id AS example_id, label AS target, k AS species_id, CAST(embedding[k + 1] AS DOUBLE) * 10 AS logit
FROM {embeddings} e, (SELECT CAST(range AS INT) AS k FROM range(64)) r""",
    "pixels": """
SELECT vec_id, k AS pos, CAST(least(greatest(floor((CAST(embedding[k + 1] AS DOUBLE) + 0.5) * 255), 0), 255) AS INT) AS level
FROM {embeddings} e, (SELECT CAST(range AS INT) AS k FROM range(64)) r""",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{([a-z_]+)\}", text)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Spark DataFrame of a table or view."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = SPARK_ONLY.get(name) or VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _needs(text)})


def sql_with_views(body: str) -> str:
    """DuckDB text: the views that ``{name}`` mentions become CTEs in front of ``body``."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name not in TABLES:
                if name not in ordered:
                    visit(DUCK_ONLY.get(name) or VIEWS[name])
                    ordered.append(name)

    visit(body)
    ordered = list(dict.fromkeys(ordered))
    plain = lambda text: re.sub(r"\{([a-z_]+)\}", r"\1", text)
    ctes = [f"{n} AS ({plain(DUCK_ONLY.get(n) or VIEWS[n]).strip()})" for n in ordered]
    body = plain(body).strip()
    if body.upper().startswith("WITH "):
        ctes.append(body[5:].strip())
        return "WITH " + ",\n".join(ctes)
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body
