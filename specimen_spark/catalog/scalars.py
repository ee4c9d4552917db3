"""Queries of the column functions."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.snippets import (
    LABELLED, NON_SPECIES, STATES, country, finite, nt, region, state, title, tokens, uniform,
)
from specimen_spark.catalog.views import view
from specimen_spark.functions import geo, media, numbers, quality, species, text


@query("B1_normalize_text", f"SELECT row_idx, {nt('country')} AS country_text, {nt('state_province')} AS state_text FROM {{raw_manifest}}")
def normalize_text(spark, sf):
    return view(spark, sf, "raw_manifest").select(
        "row_idx", text.normalize_text("country").alias("country_text"),
        text.normalize_text("state_province").alias("state_text"))


@query("B2_tokens", f"""
SELECT row_idx, array_to_string(t, '|') AS tokens, coalesce({title('t[1]')}, '') AS title
FROM (SELECT row_idx, {tokens('scientific_name')} AS t FROM {{raw_manifest}}) x""")
def alpha_tokens(spark, sf):
    found = text.tokenize_alpha("scientific_name")
    return view(spark, sf, "raw_manifest").select(
        "row_idx", F.array_join(found, "|").alias("tokens"),
        F.coalesce(text.title_token(F.get(found, F.lit(0))), F.lit("")).alias("title"))


@query("B2_ascii_text", f"""
SELECT doc_id, md5(regexp_replace(strip_accents({nt('text')}), '[^\\x00-\\x7F]', '', 'g')) AS digest FROM documents""")
def ascii_text(spark, sf):
    return view(spark, sf, "documents").select("doc_id", F.md5(text.ascii_text("text")).alias("digest"))


@query("B3_parse_numbers", f"""
SELECT row_idx, {finite('latitude')} AS finite, coalesce(nullif(try_cast(latitude AS DOUBLE), 'nan'::DOUBLE), -1.0) AS defaulted,
  coalesce(isnan(try_cast(latitude AS DOUBLE)), false) AS is_nan,
  coalesce(CASE WHEN regexp_matches(record_id, '^[0-9]+$') THEN CAST(record_id AS BIGINT) END, 7) AS record_number,
  CAST(7 AS BIGINT) AS no_integer
FROM {{raw_manifest}}""")
def parse_numbers(spark, sf):
    value = numbers.parse_float_opt("latitude")
    return view(spark, sf, "raw_manifest").select(
        "row_idx", numbers.parse_float_finite("latitude").alias("finite"),
        F.coalesce(F.when(~F.isnan(value), numbers.parse_float("latitude", -1.0)), F.lit(-1.0)).alias("defaulted"),
        F.coalesce(F.isnan(value), F.lit(False)).alias("is_nan"),
        numbers.parse_int("record_id", 7).alias("record_number"),
        numbers.parse_int("longitude", 7).alias("no_integer"))


@query("B4_parse_month", "SELECT row_idx, regexp_extract(event_date, '([0-9]{4})-([0-9]{2})', 2) AS month FROM {raw_manifest}")
def parse_month(spark, sf):
    return view(spark, sf, "raw_manifest").select("row_idx", text.parse_month("event_date").alias("month"))


@query("B5_normalize_country", f"SELECT row_idx, {country('country')} AS country FROM {{raw_manifest}}")
def normalize_country(spark, sf):
    return view(spark, sf, "raw_manifest").select("row_idx", text.normalize_country("country").alias("country"))


@query("B6_normalize_state", f"SELECT row_idx, {state('state_province')} AS state FROM {{raw_manifest}}")
def normalize_state(spark, sf):
    return view(spark, sf, "raw_manifest").select("row_idx", text.normalize_state("state_province").alias("state"))


@query("B7_canonical_species", f"WITH {LABELLED} SELECT row_idx, canonical AS species, provenance AS species_source FROM labelled")
def canonical_species(spark, sf):
    return view(spark, sf, "raw_manifest").select(
        "row_idx", species.canonical_species("raw_species", "species", "scientific_name", "genus").alias("s")
    ).select("row_idx", "s.species", F.col("s.source").alias("species_source"))


_CLEAN_PART = lambda c: f"regexp_replace({c}, '[^A-Za-z-]', '', 'g')"
_G, _S, _N = nt("genus"), nt("species"), nt("scientific_name")
_COMBINED = f"({_G} || ' ' || {_S})"


def _ingest_case(text_, extra="true"):
    first, second = f"string_split({text_}, ' ')[1]", f"coalesce(string_split({text_}, ' ')[2], '')"
    ok = (f"{_CLEAN_PART(first)} <> '' AND {_CLEAN_PART(second)} <> '' AND lower({_CLEAN_PART(second)}) NOT IN ({NON_SPECIES}) AND {extra}")
    return ok, f"{title(_CLEAN_PART(first))} || ' ' || lower({_CLEAN_PART(second)})"


_C1 = _ingest_case(_S, f"({_G} = '' OR lower({_CLEAN_PART(f'string_split({_S}, chr(32))[1]')}) = lower({_G}))")
_C2 = _ingest_case(_COMBINED)
_SECOND = f"substr(string_split({_N}, ' ')[2], 1, 1)"
_C3 = _ingest_case(_N, f"{_SECOND} = lower({_SECOND}) AND {_SECOND} <> upper({_SECOND})")


INGEST_BINOMIAL = f"""
SELECT row_idx, coalesce(b, {_S}) AS species, b IS NOT NULL AS is_species_level FROM (
  SELECT *, CASE WHEN contains({_S}, ' ') AND {_C1[0]} THEN {_C1[1]}
    WHEN NOT contains({_S}, ' ') AND {_G} <> '' AND {_S} <> '' AND {_C2[0]} THEN {_C2[1]}
    WHEN {_C3[0]} THEN {_C3[1]} END AS b FROM {{raw_manifest}}) t"""


@query("B8_ingest_binomial", INGEST_BINOMIAL)
def ingest_binomial(spark, sf):
    found = species.ingest_binomial("scientific_name", "genus", "species")
    return view(spark, sf, "raw_manifest").select("row_idx", "species", found.alias("b")).select(
        "row_idx", F.coalesce("b", text.normalize_text("species")).alias("species"),
        F.col("b").isNotNull().alias("is_species_level"))


@query("B9_geopoint_text", """
SELECT row_idx, CASE WHEN a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 THEN a
    WHEN a BETWEEN -180 AND 180 AND b BETWEEN -90 AND 90 THEN b END AS lat,
  CASE WHEN a BETWEEN -90 AND 90 AND b BETWEEN -180 AND 180 THEN b
    WHEN a BETWEEN -180 AND 180 AND b BETWEEN -90 AND 90 THEN a END AS lon
FROM (SELECT row_idx, CAST(n[1] AS DOUBLE) AS a, CAST(n[2] AS DOUBLE) AS b FROM (
  SELECT row_idx, regexp_extract_all(longitude || ' / ' || latitude, '-?[0-9]+(?:\\.[0-9]+)?') AS n FROM {raw_manifest}) t) u""")
def geopoint_text(spark, sf):
    joined = F.concat_ws(" / ", "longitude", "latitude")
    return view(spark, sf, "raw_manifest").select("row_idx", geo.parse_geopoint_text(joined).alias("p")).select(
        "row_idx", "p.lat", "p.lon")


@query("B10_first_nonempty", """
SELECT row_idx, coalesce(nullif(raw_species, ''), nullif(species, ''), nullif(genus, '')) AS value FROM {raw_manifest}""")
def first_nonempty(spark, sf):
    return view(spark, sf, "raw_manifest").select(
        "row_idx", text.first_nonempty("raw_species", "species", "genus").alias("value"))


@query("B11_license_allowed", """
SELECT row_idx, contains(l, 'cc0') OR contains(l, 'cc-by') OR contains(l, 'cc by') OR contains(l, 'creativecommons.org/licenses/by')
  OR contains(l, 'creativecommons.org/publicdomain/zero') AS allowed
FROM (SELECT row_idx, lower(trim(license)) AS l FROM {raw_manifest}) t""")
def license_allowed(spark, sf):
    return view(spark, sf, "raw_manifest").select("row_idx", media.license_allowed("license").alias("allowed"))


@query("B12_guess_extension", """
SELECT row_idx,
  CASE WHEN regexp_matches(p, '\\.(jpg|jpeg|png|webp|tif|tiff|bmp|gif)$') THEN regexp_extract(p, '\\.[^.]*$')
       WHEN k = 'image/jpeg' THEN '.jpg' WHEN k = 'image/png' THEN '.png' WHEN k = 'image/tiff' THEN '.tiff' ELSE '.jpg' END AS extension,
  CASE WHEN regexp_matches(p, '\\.(jpg|jpeg|png|webp)$') THEN regexp_extract(p, '\\.[^.]*$') ELSE '.jpg' END AS simple
FROM (SELECT row_idx, lower(split_part(split_part(image_url, '?', 1), '#', 1)) AS p,
  trim(split_part(image_format, ';', 1)) AS k FROM {raw_manifest}) t""")
def guess_extension(spark, sf):
    return view(spark, sf, "raw_manifest").select(
        "row_idx", text.guess_extension("image_url", "image_format").alias("extension"),
        text.guess_extension_simple("image_url").alias("simple"))


@query("B13_stable_names", """
SELECT row_idx,
  '/data/' || source || '/' || trim(source || '_' || record_id || '_' || substr(sha1(image_url), 1, 12), '._') || '.jpg' AS download_path,
  record_id || '_' || substr(md5(image_url), 1, 10) AS stable_name,
  source || '_' || CASE WHEN record_id = '' THEN 'row_' || row_idx ELSE record_id END || '_' || row_idx AS output_name,
  coalesce(nullif(trim(regexp_replace(license, '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'file') AS safe_license
FROM (SELECT * REPLACE (CASE WHEN row_idx < 100000 THEN lpad(CAST(row_idx AS VARCHAR), 6, '0') ELSE CAST(row_idx AS VARCHAR) END AS row_idx),
  row_idx AS row_number FROM {raw_manifest}) t""".replace("SELECT row_idx,\n  '/data/'", "SELECT row_number AS row_idx,\n  '/data/'"))
def stable_names(spark, sf):
    raw = view(spark, sf, "raw_manifest")
    return raw.select(
        "row_idx", text.download_path("/data", "source", "record_id", "image_url", F.lit("")).alias("p"),
        text.stable_name("record_id", "image_url").alias("stable_name"),
        text.output_name("source", "record_id", "row_idx").alias("output_name"),
        text.safe_filename("license").alias("safe_license"),
    ).select("row_idx", F.regexp_replace("p", r"\.[a-z]+$", ".jpg").alias("download_path"), "stable_name",
             "output_name", "safe_license")


@query("B14_regions", f"""
SELECT row_idx, r AS region, CASE WHEN lat IS NULL OR lon IS NULL THEN NULL WHEN r <> '' THEN r
    WHEN {country('country')} = 'United States' AND lower({state('state_province')}) IN ({STATES}) THEN 'us_metadata_but_out_of_bounds'
    ELSE 'non_us_coordinate' END AS scope,
  coalesce(lat BETWEEN 24.5 AND 49.5 AND lon BETWEEN -125.0 AND -66.5, false) AS in_service_box
FROM (SELECT *, {region('lat', 'lon')} AS r FROM (SELECT *, {finite('latitude')} AS lat, {finite('longitude')} AS lon FROM {{raw_manifest}}) s) t""")
def regions(spark, sf):
    raw = view(spark, sf, "raw_manifest").withColumns({
        "lat": numbers.parse_float_finite("latitude"), "lon": numbers.parse_float_finite("longitude")})
    scope = geo.us_scope("lat", "lon", "country", "state_province")["label"]
    return raw.select(
        "row_idx", geo.classify_region("lat", "lon").alias("region"),
        F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), scope).alias("scope"),
        F.coalesce(geo.within_service_bounds("lat", "lon"), F.lit(False)).alias("in_service_box"))


@query("B15_normalize_latlon", f"""
SELECT row_idx, valid, CASE WHEN valid THEN round((la - 18.5) / 54.0, 6) END AS lat_norm, CASE WHEN valid THEN round((lo + 180.0) / 114.0, 6) END AS lon_norm,
  CASE WHEN valid THEN round(la, 6) END AS lat_back, CASE WHEN valid THEN round(lo, 6) END AS lon_back
FROM (SELECT row_idx, lat IS NOT NULL AND lon IS NOT NULL AS valid, least(greatest(lat, 18.5), 72.5) AS la, least(greatest(lon, -180.0), -66.0) AS lo
  FROM (SELECT row_idx, {finite('latitude')} AS lat, {finite('longitude')} AS lon FROM {{raw_manifest}}) r) t""")
def normalize_latlon(spark, sf):
    valid = geo.has_valid_latlon("latitude", "longitude")
    raw = view(spark, sf, "raw_manifest").withColumn("valid", valid)
    number = lambda c: F.when(F.col("valid"), F.col(c).try_cast("double"))
    rows = raw.select("row_idx", "valid", geo.normalize_latlon(number("latitude"), number("longitude")).alias("n"))
    back = geo.denormalize_latlon("n.lat_norm", "n.lon_norm")
    return rows.select(
        "row_idx", "valid", F.round("n.lat_norm", 6).alias("lat_norm"), F.round("n.lon_norm", 6).alias("lon_norm"),
        F.round(back["lat"], 6).alias("lat_back"), F.round(back["lon"], 6).alias("lon_back"))


@query("B16_fourier_features", """
SELECT point_id, CAST(4 * k + j AS INT) AS pos, round(CASE j WHEN 0 THEN sin(f * la) WHEN 1 THEN sin(f * lo) WHEN 2 THEN cos(f * la) ELSE cos(f * lo) END, 6) AS value
FROM (SELECT point_id, k, j, pow(2.0, k) * pi() AS f, (least(greatest(lat, 18.5), 72.5) - 18.5) / 54.0 AS la,
  (least(greatest(lon, -180.0), -66.0) + 180.0) / 114.0 AS lo FROM {points}, range(32) a(k), range(4) b(j)) t""")
def fourier_features(spark, sf):
    points = view(spark, sf, "points").select("point_id", geo.normalize_latlon("lat", "lon").alias("n"))
    return points.select(
        "point_id", F.posexplode(geo.fourier_features("n.lat_norm", "n.lon_norm", 32)).alias("pos", "v")
    ).select("point_id", "pos", F.round("v", 6).alias("value"))


def _family(patterns):
    return " OR ".join(f"regexp_matches(h, '{p}')" for p in patterns)


_DORSAL = _family(["(^|[^a-z])dorsal([^a-z]|$)", "(^|[^a-z])upper[_-]?side([^a-z]|$)", "(^|[^a-z])top([^a-z]|$)", "[_-]d([_-]|$)"])
_VENTRAL = _family(["(^|[^a-z])ventral([^a-z]|$)", "(^|[^a-z])under[_-]?side([^a-z]|$)", "(^|[^a-z])bottom([^a-z]|$)", "[_-]v([_-]|$)"])
_LATERAL = _family(["(^|[^a-z])(lateral|side|profile)([^a-z]|$)"])


@query("B17_view_hint", f"""
SELECT row_idx, CASE WHEN d + v + l <> 1 THEN 'unknown' WHEN d = 1 THEN 'dorsal' WHEN v = 1 THEN 'ventral' ELSE 'lateral' END AS view_hint,
  CASE WHEN d + v + l = 1 THEN 'metadata' WHEN d + v + l > 1 THEN 'metadata_ambiguous' ELSE 'none' END AS view_source
FROM (SELECT row_idx, CAST({_DORSAL} AS INT) AS d, CAST({_VENTRAL} AS INT) AS v, CAST({_LATERAL} AS INT) AS l
  FROM (SELECT row_idx, lower(trim(image_url || ' ' || media_id)) AS h FROM {{raw_manifest}}) t) u""")
def view_hint(spark, sf):
    return view(spark, sf, "raw_manifest").select(
        "row_idx", media.infer_view_hint("image_url", "media_id").alias("v")
    ).select("row_idx", F.col("v.hint").alias("view_hint"), F.col("v.source").alias("view_source"))


@query("B18_is_image_like", """
SELECT row_idx, lower(download_status) IN ('image', 'stillimage') OR starts_with(lower(image_format), 'image/')
  OR lower(image_format) IN ('jpeg', 'jpg', 'png', 'tiff', 'tif', 'webp', 'gif', 'bmp')
  OR regexp_matches(lower(image_url), '\\.(jpg|jpeg|png|webp|tif|tiff|bmp|gif)$') AS is_image
FROM {raw_manifest}""")
def is_image_like(spark, sf):
    return view(spark, sf, "raw_manifest").select(
        "row_idx", media.is_image_like("download_status", "image_format", "image_url").alias("is_image"))


RANK_SCORE = """(coalesce(mask_quality_score, 0.0) + CASE WHEN view_hint = 'dorsal' THEN 0.35 ELSE 0.0 END
  - CASE WHEN view_hint = 'unknown' THEN 0.10 ELSE 0.0 END + 0.20::DOUBLE * (least(mask_mean_saturation, 140.0::DOUBLE) / 140.0)
  + 0.15::DOUBLE * (least(polygon_vertices, 12) / 12.0::DOUBLE) + 0.10::DOUBLE * least(greatest(coverage_ratio, 0.0), 0.35::DOUBLE) / 0.35
  - CASE WHEN fill_ratio >= 0.88 THEN 0.15 ELSE 0.0 END)"""
RECTANGLE = """(view_hint IN ('', 'unknown') AND polygon_vertices > 0 AND polygon_vertices <= 6 AND mask_solidity >= 0.90 AND fill_ratio >= 0.80)"""


@query("B19_rank_score", f"SELECT source_row_index, round({RANK_SCORE}, 6) AS score FROM {{processed_manifest}}")
def rank_score(spark, sf):
    df = view(spark, sf, "processed_manifest")
    return df.select("source_row_index", F.round(quality.rank_score(df), 6).alias("score"))


@query("B20_rectangular_fp", f"SELECT source_row_index, {RECTANGLE} AS is_rectangle FROM {{processed_manifest}}")
def rectangular_fp(spark, sf):
    df = view(spark, sf, "processed_manifest")
    return df.select("source_row_index", quality.is_rectangular_fp(df).alias("is_rectangle"))


@query("B21_keys", """
SELECT source_row_index, source || ':' || record_id AS specimen,
  coalesce(nullif(specimen_key, ''), nullif(record_id, ''), nullif(image_url, '')) AS group_key FROM {processed_manifest}""")
def keys(spark, sf):
    return view(spark, sf, "processed_manifest").select(
        "source_row_index", species.specimen_key("source", "record_id").alias("specimen"),
        species.group_key("specimen_key", "record_id", "image_url").alias("group_key"))


@query("B22_frequency_band", """
SELECT image_url, n AS rows, CASE WHEN n < 10 THEN 'rare' WHEN n < 30 THEN 'tail' WHEN n < 100 THEN 'medium' ELSE 'common' END AS band
FROM (SELECT image_url, count(*) AS n FROM {raw_manifest} GROUP BY image_url) t""")
def frequency_band(spark, sf):
    counts = view(spark, sf, "raw_manifest").groupBy("image_url").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("image_url", "rows", species.frequency_band("rows").alias("band"))


_GAUSS = lambda v, t, s: f"exp(-pow({v} - {t}, 2) / (2.0 * {s} * {s}))"


@query("B23_candidate_quality", f"""
SELECT row_idx, round(CASE WHEN coverage < 0.01 THEN 0.0 ELSE greatest(0.0, least(1.0,
  0.15 * {_GAUSS('coverage', 0.18, 0.11)} + 0.16 * (0.6 * symmetry_score + 0.4 * greatest(rgb_symmetry, 0.0))
  + 0.12 * greatest(0.0, 1.0 - border_touch / 0.08) + 0.10 * {_GAUSS('fill_ratio', 0.48, 0.18)}
  + 0.08 * {_GAUSS('ln(greatest(aspect_ratio, 1e-6))', 'ln(1.25)', 0.55)}
  + 0.12 * greatest(0.0, 1.0 - greatest(component_count - 2, 0) * 0.18) * largest_component_ratio
  + 0.07 * {_GAUSS('center_distance', '0.0', 0.18)}
  + 0.16 * {_GAUSS('foreground_luminance', 0.24, 0.08)} * CASE WHEN foreground_luminance < 0.07 THEN 0.2 WHEN foreground_luminance < 0.10 THEN 0.45 WHEN foreground_luminance < 0.13 THEN 0.72 ELSE 1.0 END
  + 0.06 * {_GAUSS('foreground_std', 0.16, 0.08)})) END, 6) AS quality FROM {{candidates}}""")
def candidate_quality(spark, sf):
    return view(spark, sf, "candidates").select("row_idx", F.round(quality.candidate_quality(), 6).alias("quality"))


@query("B24_mask_quality", """
SELECT row_idx, round((0.45 + least(sqrt(coverage_ratio), 0.75))
  * CASE WHEN coverage_ratio BETWEEN 0.02 AND 0.40 THEN 1.0 WHEN coverage_ratio BETWEEN 0.01 AND 0.55 THEN 0.68 ELSE 0.18 END
  * CASE WHEN horizontal_ratio BETWEEN 1.05 AND 4.2 THEN 1.0 WHEN horizontal_ratio BETWEEN 0.85 AND 5.2 THEN 0.68 ELSE 0.18 END
  * CASE WHEN fill_ratio BETWEEN 0.10 AND 0.86 THEN 1.0 ELSE 0.65 END
  * (0.40 + least(mean_saturation, 150.0) / 150.0) * greatest(0.18, 1.0 - low_saturation_fraction * 0.9)
  * (0.45 + symmetry_score) * (0.35 + least(wing_balance_ratio, 1.0))
  * greatest(0.25, 1.15 - abs(centroid_x_ratio - 0.50) * 1.6) * greatest(0.45, 1.08 - abs(centroid_y_ratio - 0.43) * 1.5)
  * CASE WHEN touches_border THEN 0.72 ELSE 1.0 END
  * CASE WHEN polygon_vertices <= 6 AND solidity >= 0.92 AND fill_ratio >= 0.78 THEN 0.25 ELSE 1.0 END, 6) AS quality
FROM {measured}""")
def mask_quality(spark, sf):
    return view(spark, sf, "measured").select("row_idx", F.round(quality.mask_quality(), 6).alias("quality"))


_READY = """CASE {strict} WHEN view_hint = 'unknown' AND coverage_ratio < 0.08 AND horizontal_ratio < 1.25 THEN 'compact_unknown_view'
  WHEN horizontal_ratio < 1.0 THEN 'not_spread_horizontal' WHEN horizontal_ratio > 5.2 THEN 'too_wide_for_specimen'
  WHEN symmetry_score < (CASE WHEN view_hint = 'dorsal' THEN 0.28 ELSE 0.38 END) THEN 'low_bilateral_symmetry'
  WHEN wing_balance_ratio < (CASE WHEN view_hint = 'dorsal' THEN 0.20 ELSE 0.26 END) THEN 'one_sided_specimen'
  WHEN coverage_ratio < 0.02 THEN 'specimen_too_small'
  WHEN view_hint = 'unknown' AND polygon_vertices <= 6 AND solidity >= 0.92 AND fill_ratio >= 0.78 THEN 'rectangular_non_specimen'
  WHEN mean_saturation < 24.0 THEN 'low_color_saturation' WHEN fill_ratio < 0.08 THEN 'fragmented_mask'
  WHEN touches_border AND low_saturation_fraction > 0.20 THEN 'border_connected_artifact'
  WHEN touches_border AND coverage_ratio > 0.48 THEN 'touches_image_border' ELSE '' END"""
READY = _READY.replace("{strict}", "")
READY_STRICT = _READY.replace("{strict}", "WHEN view_hint IN ('ventral', 'lateral') THEN 'metadata_view_' || view_hint WHEN view_hint = 'unknown' THEN 'unknown_view'")
STATUS = """CASE WHEN {r} <> '' THEN 'rejected_' || {r} WHEN view_hint IN ('dorsal', 'ventral', 'lateral') THEN 'metadata_' || view_hint ELSE 'accepted' END"""


@query("B25_strong_mask", """
SELECT row_idx, coverage_ratio BETWEEN 0.02 AND 0.42 AND horizontal_ratio BETWEEN 1.0 AND 4.8 AND symmetry_score >= 0.42
  AND wing_balance_ratio >= 0.28 AND mean_saturation >= 45.0 AND low_saturation_fraction <= 0.32 AND NOT touches_border AS strong
FROM {measured}""")
def strong_mask(spark, sf):
    return view(spark, sf, "measured").select("row_idx", quality.is_strong_mask().alias("strong"))


@query("B25_readiness", f"""
SELECT row_idx, loose = '' AS keep, loose AS reason, {STATUS.replace('{r}', 'loose')} AS view_status,
  strict = '' AS strict_keep, strict AS strict_reason, {STATUS.replace('{r}', 'strict')} AS strict_view_status
FROM (SELECT *, {READY} AS loose, {READY_STRICT} AS strict FROM {{measured}}) t""")
def readiness(spark, sf):
    judged = view(spark, sf, "measured").select(
        "row_idx", quality.assess_readiness().alias("a"), quality.assess_readiness(True, True).alias("b"))
    return judged.select(
        "row_idx", F.col("a.keep").alias("keep"), F.col("a.reason").alias("reason"),
        F.col("a.view_status").alias("view_status"), F.col("b.keep").alias("strict_keep"),
        F.col("b.reason").alias("strict_reason"), F.col("b.view_status").alias("strict_view_status"))


@query("B26_boxes", """
SELECT row_idx, round((x1 - x0) * (y1 - y0) / CAST(width * height AS DOUBLE), 6) AS area_ratio,
  x0 <= 2 OR y0 <= 2 OR x1 >= width - 2 OR y1 >= height - 2 AS touches,
  CAST(greatest(0, x0 - round_even((x1 - x0) * 0.1::DOUBLE, 0)) AS INT) AS e_left, CAST(greatest(0, y0 - round_even((y1 - y0) * 0.05::DOUBLE, 0)) AS INT) AS e_top,
  CAST(least(width, x1 + round_even((x1 - x0) * 0.1::DOUBLE, 0)) AS INT) AS e_right, CAST(least(height, y1 + round_even((y1 - y0) * 0.1::DOUBLE, 0)) AS INT) AS e_bottom,
  CAST((width - s) // 2 AS INT) AS f_left, CAST((height - s) // 2 AS INT) AS f_top,
  CAST((width - s) // 2 + s AS INT) AS f_right, CAST((height - s) // 2 + s AS INT) AS f_bottom
FROM (SELECT *, CAST(floor(least(width, height) * 0.92::DOUBLE) AS INT) AS s FROM {measured}) t""")
def boxes(spark, sf):
    box = ("x0", "y0", "x1", "y1", "width", "height")
    rows = view(spark, sf, "measured").select(
        "row_idx", F.round(quality.bbox_area_ratio(*box), 6).alias("area_ratio"),
        quality.bbox_touches_border(*box).alias("touches"),
        quality.expand_bbox(*box, 0.1, margin_top=0.05).alias("e"), quality.fallback_bbox("width", "height").alias("f"))
    sides = ("left", "top", "right", "bottom")
    return rows.select("row_idx", "area_ratio", "touches", *[F.col(f"{p}.{s}").alias(f"{p}_{s}") for p in "ef" for s in sides])


@query("B27_source_index", """
SELECT path, CAST(regexp_extract(path, '_([0-9]{6,})\\.jpg$', 1) AS BIGINT) AS source_index FROM {outputs}""")
def source_index(spark, sf):
    return view(spark, sf, "outputs").select("path", text.source_index_from_path("path").alias("source_index"))


@query("B28_jitter", f"""
SELECT point_id, round(least(greatest(lat + ({uniform("'7:lat:' || point_id")} * 2 - 1) * 0.25, 18.5), 72.5), 6) AS lat,
  round(least(greatest(lon + ({uniform("'7:lon:' || point_id")} * 2 - 1) * 0.25, -180.0), -66.0), 6) AS lon FROM {{points}}""")
def jitter(spark, sf):
    return view(spark, sf, "points").select("point_id", geo.jitter_latlon("lat", "lon", 0.25, 7, "point_id").alias("p")).select(
        "point_id", F.round("p.lat", 6).alias("lat"), F.round("p.lon", 6).alias("lon"))
