"""Cleaning: ordered rejection cascade, image counts per record, species ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.fixed_values import DOWNLOADED_STATUSES, TARGET_FAMILY
from specimen_spark.functions.geo import classify_region, scope_rejection
from specimen_spark.functions.numbers import parse_float_finite
from specimen_spark.functions.species import specimen_key, with_species_label
from specimen_spark.functions.text import (
    blank_to_null, normalize_country, normalize_state, normalize_text, parse_month,
)
from specimen_spark.operators.keyed import attach, bucketed_rank, is_small, order_struct, stored
from specimen_spark.schemas import CLEAN_COLUMNS, CLEAN_COPIED, RAW_REQUIRED, optional, validate_required


def record_image_count(df: DataFrame) -> DataFrame:
    """Rows per (source, record) over all input rows; blank records are left out."""
    return (
        df.select(normalize_text("source").alias("source"), blank_to_null("record_id").alias("record_id"))
        .where(F.col("record_id").isNotNull())
        .groupBy("source", "record_id")
        .agg(F.count(F.lit(1)).alias("record_image_count"))
    )


def clean_manifest(
    df: DataFrame, order_cols, *, require_downloaded: bool = False, allow_missing_coordinates: bool = False,
    filter_us_scope: bool = True, existing_paths: DataFrame | None = None, family: str = TARGET_FAMILY,
) -> tuple[DataFrame, DataFrame]:
    """Accepted rows in the clean layout, and input rows with ``reject_reason``.

    The first row of a URL claims it even when that row is rejected for a
    later reason. Accepted rows are judged apart from the rejected ones,
    without most of those.
    """
    options = dict(
        require_downloaded=require_downloaded, allow_missing_coordinates=allow_missing_coordinates,
        filter_us_scope=filter_us_scope, existing_paths=existing_paths, family=family,
    )
    claims = url_claims(df, order_cols)
    rejected = judge_rows(df, order_cols, claims=claims, **options).where(F.col("reject_reason").isNotNull())
    judged = judge_rows(df, order_cols, accepted_only=True, claims=claims, **options)
    return accepted_rows(judged, df, order_cols, family), rejected.select(*df.columns, "reject_reason")


def url_claims(df: DataFrame, order_cols) -> DataFrame:
    """``__url, __claim``: the first order of each URL, stored, since several steps read it."""
    urls = df.select(blank_to_null("image_url").alias("__url"), *order_cols)
    return stored(urls.groupBy("__url").agg(F.min(order_struct(order_cols)).alias("__claim")))


def _claimants(df: DataFrame, claims: DataFrame, order_cols) -> DataFrame:
    """Rows of ``df`` without most of those that do not claim their URL.

    Few claims are broadcast by their orders alone, so rows meet them where they are; rows that share an order with
    the claim of another URL stay. Otherwise the join is on URL and order together, so the rows of a hot URL spread out.
    """
    won = claims.where(F.col("__url").isNotNull())
    orders = won.select(F.col("__claim").alias("__won_by"))
    claimed = order_struct(order_cols).eqNullSafe(F.col("__won_by"))
    if is_small(orders):
        return df.join(F.broadcast(orders), claimed, "left_semi")
    won = won.select(F.col("__url").alias("__won"), F.col("__claim").alias("__won_by"))
    return df.join(won.hint("shuffle_hash"), (blank_to_null("image_url") == F.col("__won")) & claimed, "left_semi")


def _labelled(rows: DataFrame, names: list[Column], once: bool) -> DataFrame:
    """Rows with their species label; with ``once`` each distinct name is read once, if they are few enough to broadcast."""
    if not once:
        return with_species_label(rows, *names)
    parts = [f"__n{i}" for i in range(len(names))]
    distinct = rows.select(*[c.alias(p) for c, p in zip(names, parts)]).distinct()
    labels = stored(with_species_label(distinct, *map(F.col, parts)))
    if not is_small(labels):
        return with_species_label(rows, *names)
    same = [c.eqNullSafe(labels[p]) for c, p in zip(names, parts)]
    return rows.join(F.broadcast(labels), same, "left").drop(*parts)


def judge_rows(
    df: DataFrame, order_cols, *, require_downloaded: bool = False, allow_missing_coordinates: bool = False,
    filter_us_scope: bool = True, existing_paths: DataFrame | None = None, family: str = TARGET_FAMILY,
    accepted_only: bool = False, claims: DataFrame | None = None, names_once: bool = False,
) -> DataFrame:
    """All input rows plus ``reject_reason`` (null = accepted) and the cleaned key columns.

    ``claims`` is ``url_claims`` of the same rows, when it is at hand. ``names_once`` reads each distinct name once, for
    one more scan of the name columns.

    ``accepted_only`` leaves out rejected rows early: by family and place
    before the rows move, by the claim of their URL before names are read.
    """
    validate_required(df, RAW_REQUIRED)
    claims = url_claims(df, order_cols) if claims is None else claims

    if accepted_only:
        lat, lon = parse_float_finite("latitude"), parse_float_finite("longitude")
        placed = lat.isNotNull() & lon.isNotNull()
        passing = F.lower(normalize_text(optional(df, "family"))).isin("", family.lower())
        if not allow_missing_coordinates:
            passing = passing & placed
        if filter_us_scope:
            passing = passing & ~(placed & (classify_region(lat, lon) == ""))
        df = _claimants(df.where(passing), claims, order_cols)

    # Everything that looks at one row only is computed below the join with
    # the claims, so a filter on the final reason cannot repeat it.
    path = F.coalesce(
        F.nullif(normalize_text(optional(df, "image_path")), F.lit("")),
        normalize_text(optional(df, "local_image_path")),
    )
    rows = df.select(
        "*",
        blank_to_null("image_url").alias("__url"),
        parse_float_finite("latitude").alias("__lat"),
        parse_float_finite("longitude").alias("__lon"),
        path.alias("__path"),
        F.lower(normalize_text(optional(df, "family"))).alias("__family"),
        normalize_country(optional(df, "country")).alias("__country"),
        normalize_state(optional(df, "state_province")).alias("__state"),
    )
    names = [optional(df, "raw_species"), optional(df, "species"), F.col("scientific_name"), F.col("genus")]
    rows = _labelled(rows, names, names_once).withColumn("__box", classify_region("__lat", "__lon"))

    located = F.col("__lat").isNotNull() & F.col("__lon").isNotNull()
    outside = F.lit("outside_us_scope")
    if filter_us_scope:
        outside = scope_rejection("__country", "__state")
    region = F.when(~located, F.lit("missing_coordinate")).when(F.col("__box") != "", F.col("__box")).otherwise(outside)
    wanted = family.lower()
    reason = F.when(~F.col("__family").isin("", wanted), F.lit(f"non_{wanted}_family"))
    if not allow_missing_coordinates:
        reason = reason.when(~located, F.lit("missing_coordinate"))
    if filter_us_scope:
        reason = reason.when(located & (F.col("__box") == ""), outside)
    reason = reason.when(F.col("__species_label") == "", F.lit("missing_species_label"))
    if require_downloaded:
        if existing_paths is None:
            raise ValueError("require_downloaded needs existing_paths, a file listing with a column 'path'")
        listing = existing_paths.select(F.col("path").alias("__path")).distinct().withColumn("__exists", F.lit(True))
        rows = attach(rows, listing, ["__path"])
        status = normalize_text(optional(df, "download_status"))
        reason = reason.when(~status.isin(*DOWNLOADED_STATUSES), F.lit("image_not_downloaded"))
        reason = reason.when((F.col("__path") == "") | F.col("__exists").isNull(), F.lit("missing_local_image"))
    rows = rows.select(
        *df.columns, "__url", "__lat", "__lon", "__path", "__species_label", "__species_source", "__genus_hint", "__country", "__state",
        region.alias("__region"),
        reason.alias("__row_reason"),
    )
    return attach(rows, claims, ["__url"]).select(
        *df.columns, "__url", "__lat", "__lon", "__path", "__species_label", "__species_source", "__genus_hint", "__country", "__state", "__region",
        F.when(F.col("__url").isNull(), F.lit("missing_image_url"))
        .when(~order_struct(order_cols).eqNullSafe(F.col("__claim")), F.lit("duplicate_image_url"))
        .otherwise(F.col("__row_reason"))
        .alias("reject_reason"),
    )


def accepted_rows(judged: DataFrame, df: DataFrame, order_cols, family: str = TARGET_FAMILY) -> DataFrame:
    """Clean layout of the accepted rows."""
    kept = judged.where(F.col("reject_reason").isNull())
    kept = kept.withColumn("__source", normalize_text("source")).withColumn("__record", blank_to_null("record_id"))
    counts = record_image_count(df).select(
        F.col("source").alias("__source"), F.col("record_id").alias("__record"), "record_image_count"
    )
    kept = attach(kept, counts, ["__source", "__record"])
    hint = F.col("__genus_hint")
    values = {
        "image_path": F.col("__path"),
        "specimen_key": specimen_key("source", "record_id"),
        "record_image_count": F.coalesce(F.col("record_image_count"), F.lit(1).cast("bigint")),
        "family": F.lit(family),
        "genus": F.when(hint != "", hint).otherwise(F.substring_index("__species_label", " ", 1)),
        "species": F.col("__species_label"),
        "species_source": F.col("__species_source"),
        "latitude": F.col("__lat"),
        "longitude": F.col("__lon"),
        "has_coordinates": F.col("__lat").isNotNull() & F.col("__lon").isNotNull(),
        "us_region": F.col("__region"),
        "country": F.col("__country"),
        "state_province": F.col("__state"),
        "month": parse_month(optional(df, "event_date")),
        "image_url": F.col("__url"),
    }
    copied = {c: normalize_text(optional(df, c)) for c in CLEAN_COPIED}
    order_kept = [c for c in order_cols if c not in CLEAN_COLUMNS]
    return kept.select(*[{**copied, **values}[c].alias(c) for c in CLEAN_COLUMNS], *order_kept)


def species_vocab(df: DataFrame, species: str = "species", rows: str | None = None) -> DataFrame:
    """``species, species_id, rows``: 0-based ids by falling count, then name.

    ``rows`` names a column of row counts when ``df`` is aggregated already.

    Only the aggregated vocabulary is ranked, in slices of equal count and
    equal leading letters.
    """
    total = F.count(F.lit(1)) if rows is None else F.sum(rows)
    # Stored, since ranking reads its input twice.
    counts = stored(df.groupBy(species).agg(total.alias("rows")))
    sliced = counts.withColumn("__fewer", -F.col("rows")).withColumn("__lead", F.substring(species, 1, 3))
    ranked = bucketed_rank(sliced, [], ["__fewer", "__lead"], [species], "__id")
    return ranked.select(species, (F.col("__id") - 1).cast("int").alias("species_id"), "rows")


def assign_species_ids(df: DataFrame, species: str = "species") -> tuple[DataFrame, DataFrame]:
    """Rows with ``species_id`` and the vocabulary they refer to.

    ``df`` is read for both; store or checkpoint it first when it is costly.
    """
    vocab = species_vocab(df, species)
    vocab = vocab.drop("rows")
    return attach(df, vocab, [species], how="inner"), vocab
