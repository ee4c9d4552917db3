"""Queries of the image jobs. Their pixels are derived from the embeddings table."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.views import view
from specimen_spark.operators import images


def _bytes(values):
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), 2, "0")), ""))


def _levels(c):
    """Embedding values as bytes, the rule of the ``pixels`` view."""
    level = lambda v: F.least(F.greatest(F.floor((v.cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))
    return F.transform(c, lambda v: level(v).cast("bigint"))


def derived_images(spark, sf):
    """4 x 4 images with four channels of the 64 values; every seventh vector stands for a corrupt file."""
    levels = _levels(F.col("embedding"))
    bad = F.col("vec_id") % 7 == 3
    return view(spark, sf, "embeddings").select(
        F.concat(F.lit("img/"), F.col("vec_id").cast("string"), F.lit(".png")).alias("path"), "vec_id",
        F.when(bad, F.lit(-1)).otherwise(F.lit(4)).alias("height"), F.when(bad, F.lit(-1)).otherwise(F.lit(4)).alias("width"),
        F.when(bad, F.lit(-1)).otherwise(F.lit(4)).alias("nChannels"), F.lit(24).alias("mode"), _bytes(levels).alias("data"))


@query("F12_channel_stats", """WITH px AS (SELECT pos % 4 AS c, level / 255.0::DOUBLE AS v, vec_id FROM {pixels} WHERE vec_id % 7 <> 3),
m AS (SELECT c, avg(v) AS mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0.0)) AS std FROM px GROUP BY c)
SELECT (SELECT count(DISTINCT vec_id) FROM px) AS images_used, (SELECT count(*) // 4 FROM px) AS total_pixels,
  round(max(mean) FILTER (WHERE c = 2), 6) AS mean_r, round(max(mean) FILTER (WHERE c = 1), 6) AS mean_g, round(max(mean) FILTER (WHERE c = 0), 6) AS mean_b,
  round(max(std) FILTER (WHERE c = 2), 6) AS std_r, round(max(std) FILTER (WHERE c = 1), 6) AS std_g, round(max(std) FILTER (WHERE c = 0), 6) AS std_b FROM m""")
def channel_stats(spark, sf):
    stats = images.channel_stats(derived_images(spark, sf))
    return stats.select("images_used", "total_pixels", *[F.round(c, 6).alias(c) for c in stats.columns[2:]])


@query("I1_image_profile", """SELECT 'img/' || vec_id || '.png' AS path, vec_id % 7 <> 3 AS decodable, CASE WHEN vec_id % 7 = 3 THEN 0 ELSE 4 END AS width,
  CASE WHEN vec_id % 7 = 3 THEN 0 ELSE 4 END AS height, CASE WHEN vec_id % 7 = 3 THEN '' ELSE 'RGBA' END AS channel_mode, vec_id % 7 <> 3 AS large_enough FROM embeddings""")
def image_profile(spark, sf):
    return images.image_profile(derived_images(spark, sf), min_size=4)


@query("I2_mask_metrics", """WITH every AS (SELECT DISTINCT vec_id FROM {pixels}), on_px AS (
  SELECT vec_id, pos // 8 AS y, pos % 8 AS x FROM {pixels} WHERE level > 140),
box AS (SELECT vec_id, min(x) AS x0, max(x) + 1 AS x1, min(y) AS y0, max(y) + 1 AS y1, count(*) AS area, avg(x) AS cx, avg(y) AS cy FROM on_px GROUP BY vec_id),
halves AS (SELECT p.vec_id, p.y, p.x - x0 < (x1 - x0) // 2 AS is_left, CASE WHEN p.x - x0 < (x1 - x0) // 2 THEN p.x - x0 ELSE x1 - 1 - p.x END AS d
  FROM on_px p JOIN box b ON p.vec_id = b.vec_id WHERE p.x - x0 < (x1 - x0) // 2 OR x1 - 1 - p.x < (x1 - x0) // 2),
cells AS (SELECT vec_id, y, d, count(*) AS n FROM halves GROUP BY ALL),
sym AS (SELECT vec_id, count(*) FILTER (WHERE n = 2) / count(*)::DOUBLE AS s FROM cells GROUP BY vec_id),
bal AS (SELECT vec_id, CAST(count(*) FILTER (WHERE is_left) AS DOUBLE) AS l, CAST(count(*) FILTER (WHERE NOT is_left) AS DOUBLE) AS r FROM halves GROUP BY vec_id)
SELECT 'img/' || e.vec_id || '.png' AS path, b.vec_id IS NOT NULL AS found, CAST(x0 AS INT) AS x0, CAST(y0 AS INT) AS y0, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, coalesce(area, 0) AS area,
  round(coalesce(area / ((x1 - x0) * (y1 - y0))::DOUBLE, 0.0), 6) AS fill_ratio, round(coalesce(area, 0) / 64.0::DOUBLE, 6) AS coverage_ratio, round(coalesce((x1 - x0) / (y1 - y0)::DOUBLE, 0.0), 6) AS horizontal_ratio,
  round(coalesce(s, 0.0), 6) AS symmetry_score, round(coalesce(least(l, r) / greatest(l, r, 1.0), 0.0), 6) AS wing_balance_ratio,
  round(coalesce(cx / 8, 0.5), 6) AS centroid_x_ratio, round(coalesce(cy / 8, 0.5), 6) AS centroid_y_ratio,
  coalesce(x0 <= 2 OR y0 <= 2 OR x1 >= 6 OR y1 >= 6, false) AS touches_border
FROM every e LEFT JOIN box b ON e.vec_id = b.vec_id LEFT JOIN sym ON b.vec_id = sym.vec_id LEFT JOIN bal ON b.vec_id = bal.vec_id""")
def mask_metrics(spark, sf):
    """8 x 8 grey images; the mask is where the level exceeds 140."""
    levels = _levels(F.col("embedding"))
    base = view(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("nChannels"), levels.alias("levels"))
    def table(folder, values):
        return base.select(F.concat(F.lit(folder), "id", F.lit(".png")).alias("path"), "height", "width", "nChannels", _bytes(values).alias("data"))
    on = F.transform("levels", lambda v: F.when(v > 140, F.lit(255)).otherwise(F.lit(0)).cast("bigint"))
    out = images.mask_metrics(table("img/", F.col("levels")), table("mask/", on), "img", "mask")
    ratios = ("fill_ratio", "coverage_ratio", "horizontal_ratio", "symmetry_score", "wing_balance_ratio", "centroid_x_ratio", "centroid_y_ratio")
    return out.select("path", "found", "x0", "y0", "x1", "y1", "area", "touches_border", *[F.round(c, 6).alias(c) for c in ratios])


def _mean_level():
    import numpy as np

    def model(batch):
        return {"mean_level": [float(np.frombuffer(d, dtype=np.uint8).mean()) for d in batch["data"]]}

    return model


@query("I3_cache_features", """SELECT 'img/' || vec_id || '.png' AS path, round(avg(level), 6) AS mean_level FROM {pixels} WHERE vec_id % 7 <> 3 GROUP BY vec_id""")
def cache_features(spark, sf):
    good = derived_images(spark, sf).where("height > 0")
    return images.cache_features(good, _mean_level, "mean_level double").select("path", F.round("mean_level", 6).alias("mean_level"))


@query("F13_audit_images", """WITH i AS (SELECT 'img/' || vec_id || '.png' AS path, vec_id % 7 <> 3 AS ok FROM embeddings), r AS (SELECT 'img/' || (doc_id % 400) || '.png' AS path FROM documents)
SELECT 'totals' AS section, 'corrupt_images' AS key, CAST(count(*) AS DOUBLE) AS value FROM r LEFT JOIN i ON r.path = i.path WHERE NOT coalesce(ok, false)
UNION ALL SELECT 'size', '(4, 4)', CAST(count(*) AS DOUBLE) FROM r JOIN i ON r.path = i.path WHERE ok
UNION ALL SELECT 'mode', 'RGBA', CAST(count(*) AS DOUBLE) FROM r JOIN i ON r.path = i.path WHERE ok""")
def audit_images(spark, sf):
    from specimen_spark.plans.summaries import audit_summary

    rows = view(spark, sf, "documents").select(
        F.concat(F.lit("img/"), (F.col("doc_id") % 400).cast("string"), F.lit(".png")).alias("processed_image_path"))
    summary = audit_summary(rows, images.image_profile(derived_images(spark, sf), 4))
    return summary.where(F.col("section").isin("size", "mode") | (F.col("key") == "corrupt_images"))
