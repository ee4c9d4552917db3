"""Queries of splits, partitions, shards and samples."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.snippets import uniform
from specimen_spark.catalog.views import view
from specimen_spark.operators import split
from specimen_spark.plans import summaries

ORDER = ["source_row_index"]
_GROUP = "coalesce(nullif(specimen_key, ''), nullif(record_id, ''), nullif(image_url, ''))"
_GROUPS = f"""counted AS (SELECT {_GROUP} AS g, species, count(*) AS n, min(source_row_index) AS f FROM {{processed_manifest}} GROUP BY ALL),
groups AS (SELECT g AS group_key, species FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, f) AS r FROM counted) t WHERE r = 1)"""


def _sizes(n, val, test):
    """Three SQL columns for the sizes of a split of ``n`` groups."""
    return f"""(SELECT CASE WHEN {n} <= 0 THEN [0, 0, 0] WHEN {n} = 1 THEN [1, 0, 0] WHEN {n} = 2 THEN [1, 1, 0] WHEN {n} = 3 THEN [1, 1, 1]
  ELSE [CAST({n} - greatest(1, round_even({n} * {val}::DOUBLE, 0)) - greatest(1, round_even({n} * {test}::DOUBLE, 0)) AS INT),
        CAST(greatest(1, round_even({n} * {val}::DOUBLE, 0)) AS INT), CAST(greatest(1, round_even({n} * {test}::DOUBLE, 0)) AS INT)] END)"""


_SPLIT = f"""{_GROUPS}, ordered AS (
  SELECT *, row_number() OVER (PARTITION BY species ORDER BY md5('42:' || group_key), group_key) AS r,
    CAST(count(*) OVER (PARTITION BY species) AS INT) AS n FROM groups),
assigned AS (SELECT group_key, CASE WHEN r <= s[1] THEN 'train' WHEN r <= s[1] + s[2] THEN 'val' WHEN r <= s[1] + s[2] + s[3] THEN 'test' ELSE 'train' END AS part
  FROM (SELECT *, {_sizes('n', 0.1, 0.1)} AS s FROM ordered) t),
split_rows AS (SELECT m.* REPLACE (a.part AS split), a.group_key FROM {{processed_manifest}} m JOIN assigned a ON {_GROUP.replace('specimen_key', 'm.specimen_key')} = a.group_key)"""


def _split(spark, sf):
    return split.grouped_split(view(spark, sf, "processed_manifest").drop("split"), ORDER, keep_key=True)


@query("F8_group_species", f"WITH {_GROUPS} SELECT * FROM groups")
def group_species(spark, sf):
    return split.group_species(view(spark, sf, "processed_manifest"), ORDER).drop("rows")


@query("H1_split_sizes", f"""SELECT o_orderkey, s[1] AS train, s[2] AS val, s[3] AS test
FROM (SELECT o_orderkey, {_sizes('n', 0.1, 0.15)} AS s FROM (SELECT o_orderkey, CAST(o_orderkey % 400 AS INT) AS n FROM orders) u) t""")
def split_sizes(spark, sf):
    sizes = view(spark, sf, "orders").select("o_orderkey", split.split_sizes(F.col("o_orderkey") % 400, 0.1, 0.15).alias("s"))
    return sizes.select("o_orderkey", *[F.col(f"s.{p}").cast("int").alias(p) for p in split.SPLITS])


@query("H2_grouped_split", f"WITH {_SPLIT} SELECT source_row_index, split FROM split_rows")
def grouped_split(spark, sf):
    return _split(spark, sf).select("source_row_index", "split")


@query("F4_split_summary", f"""WITH {_SPLIT}
SELECT split, 'totals' AS section, 'rows' AS key, count(*) AS value FROM split_rows GROUP BY split
UNION ALL SELECT split, 'totals', 'groups', count(DISTINCT group_key) FROM split_rows GROUP BY split
UNION ALL SELECT split, 'totals', 'unique_species', count(DISTINCT species) FROM split_rows GROUP BY split
UNION ALL SELECT split, 'top_species', species, n FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, f) AS r FROM (
  SELECT split, species, count(*) AS n, min(source_row_index) AS f FROM split_rows GROUP BY ALL) c) t WHERE r <= 20""")
def split_summary(spark, sf):
    return summaries.split_summary(_split(spark, sf), ORDER, group_key="group_key")


@query("F4_loader_summary", "SELECT split, count(*) AS rows, count(DISTINCT species) AS species FROM {processed_manifest} GROUP BY split")
def loader_summary(spark, sf):
    return summaries.loader_summary(view(spark, sf, "processed_manifest").withColumn("species_id", F.col("species")))


@query("G7_partition_by_weight", """WITH ranked AS (SELECT row_idx, row_number() OVER (ORDER BY md5('42:' || row_idx), row_idx) AS r, count(*) OVER () AS n FROM {raw_manifest}),
sized AS (SELECT *, n * 3.0::DOUBLE / 6 AS a, n * 2.0::DOUBLE / 6 AS b, n * 1.0::DOUBLE / 6 AS c FROM ranked),
based AS (SELECT *, floor(a) AS fa, floor(b) AS fb, floor(c) AS fc, n - floor(a) - floor(b) - floor(c) AS rest FROM sized),
sizes AS (SELECT *, fa + CASE WHEN (a - fa > b - fb)::INT + (a - fa > c - fc)::INT >= 3 - rest THEN 1 ELSE 0 END AS ta,
  fb + CASE WHEN (b - fb >= a - fa)::INT + (b - fb > c - fc)::INT >= 3 - rest THEN 1 ELSE 0 END AS tb FROM based)
SELECT row_idx, CASE WHEN r <= ta THEN 0 WHEN r <= ta + tb THEN 1 ELSE 2 END AS part FROM sizes""")
def partition_by_weight(spark, sf):
    return split.partition_by_weight(view(spark, sf, "raw_manifest"), [3, 2, 1], 42, ["row_idx"]).select("row_idx", "part")


@query("G8_assign_shard", "SELECT row_idx, CAST((row_idx - 1) % 16 AS INT) AS shard FROM {raw_manifest}")
def assign_shard(spark, sf):
    return split.assign_shard(view(spark, sf, "raw_manifest"), 16, row="row_idx").select("row_idx", "shard")


_BUCKETS = """tagged AS (
  SELECT source_row_index, 'random_overall' AS bucket, '42' AS seed FROM {processed_manifest}
  UNION ALL SELECT source_row_index, 'recovered_rows', '43' FROM {processed_manifest} WHERE crop_method = 'recovered_from_existing_output'
  UNION ALL SELECT source_row_index, 'low_quality_rows', '44' FROM {processed_manifest} WHERE mask_quality_score < 0.65
  UNION ALL SELECT source_row_index, 'low_coverage_rows', '45' FROM {processed_manifest} WHERE coverage_ratio < 0.03
  UNION ALL SELECT source_row_index, 'low_symmetry_rows', '46' FROM {processed_manifest} WHERE symmetry_score < 0.80)"""


@query("H3_audit_buckets", f"""WITH {_BUCKETS} SELECT source_row_index, bucket FROM (
  SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5(seed || ':' || source_row_index), source_row_index) AS n FROM tagged) t WHERE n <= 24""")
def audit_buckets(spark, sf):
    return split.audit_buckets(view(spark, sf, "processed_manifest"), 24, 42, ORDER).select("source_row_index", "bucket")


@query("H4_qc_sample", """SELECT source_row_index FROM {processed_manifest} WHERE preprocess_status = 'ok' AND processed_image_path <> ''
ORDER BY md5('42:' || source_row_index), source_row_index LIMIT 50""")
def qc_sample(spark, sf):
    return split.qc_sample(view(spark, sf, "processed_manifest"), 50, 42, ORDER).select("source_row_index")


@query("H5_balanced_sample", f"""WITH members AS (
  SELECT source_row_index, species, row_number() OVER (PARTITION BY species ORDER BY md5('9:member:' || source_row_index), source_row_index) AS pos FROM {{processed_manifest}}),
classes AS (SELECT species, count(*) AS n, row_number() OVER (ORDER BY species) AS c FROM {{processed_manifest}} GROUP BY species),
draws AS (SELECT row_number() OVER (ORDER BY source_row_index) - 1 AS draw FROM {{processed_manifest}}),
placed AS (SELECT draw, floor({uniform("'9:class:' || draw")} * (SELECT count(*) FROM classes)) + 1 AS c, {uniform("'9:row:' || draw")} AS u FROM draws)
SELECT draw, m.source_row_index, m.species FROM placed p JOIN classes k ON p.c = k.c JOIN members m ON m.species = k.species AND m.pos = floor(p.u * k.n) + 1""")
def balanced_sample(spark, sf):
    df = view(spark, sf, "processed_manifest").select("source_row_index", "species")
    return split.balanced_sample(df, "species", ORDER, 9)
