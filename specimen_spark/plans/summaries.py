"""Counts and reports over manifests, as small long or one-row frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.fixed_values import FALLBACK_CROP
from specimen_spark.functions.geo import has_valid_latlon
from specimen_spark.functions.numbers import flag_column, parse_int
from specimen_spark.functions.text import blank_to_null, normalize_text
from specimen_spark.operators.keyed import attach, order_struct, stored
from specimen_spark.operators.processed import manifest_group_key
from specimen_spark.operators.split import audit_tags
from specimen_spark.schemas import optional


def _rows() -> Column:
    return F.count(F.lit(1))


def reason_counts(df: DataFrame, reason: str = "reject_reason") -> DataFrame:
    """``reason, rows`` of the rejected rows."""
    return df.where(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason")).agg(_rows().alias("rows"))


def top_values(df: DataFrame, column: str, n: int, order_cols) -> DataFrame:
    """``value, rows`` of the ``n`` most frequent values, first seen first on ties."""
    counts = df.groupBy(F.col(column).alias("value")).agg(
        _rows().alias("rows"), F.min(order_struct(order_cols)).alias("__first"))
    return counts.orderBy(F.desc("rows"), "__first").limit(n).select("value", "rows")


def _top_per_section(counts: DataFrame, section: str, n: int) -> DataFrame:
    order = Window.partitionBy(section).orderBy(F.desc("rows"), "__first")
    return counts.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r", "__first")


def _long(section: str, df: DataFrame, key: str, value: str = "rows") -> DataFrame:
    return df.select(
        F.lit(section).alias("section"), F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("value"))


def _totals(section: str, one_row: DataFrame) -> DataFrame:
    """A one-row aggregate as long rows."""
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in one_row.columns])
    return one_row.select(F.lit(section).alias("section"), F.explode(pairs).alias("p")).select("section", "p.*")


def _stack(frames) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _side(section: str, key: Column, condition: Column | None = None) -> Column:
    """A (section, key) that a row counts for; null where the condition does not hold."""
    pair = F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))
    return pair if condition is None else F.when(condition, pair)


def _one_pass(df: DataFrame, sides, order_cols, top: int, totals, extremes: dict[str, Column] | None = None) -> DataFrame:
    """``section, key, value`` of all sections from one scan and one aggregation of ``df``.

    A row counts for every one of its ``sides``. Section ``top_species`` keeps its ``top`` most frequent keys, first
    seen first on ties, and its keys are counted as total ``unique_species``. ``totals`` are listed with 0 if no row
    counts for them, ``extremes`` (aggregates of all rows, filed under the total ``rows``) with null.
    """
    extremes = extremes or {}
    first = order_struct(order_cols)
    sided = df.select("*", F.explode(F.array(*sides)).alias("__side")).where(F.col("__side").isNotNull())
    counts = sided.groupBy(F.col("__side.section").alias("section"), F.col("__side.key").alias("key")).agg(
        _rows().cast("double").alias("value"), F.min(first).alias("__first"), *[c.alias(n) for n, c in extremes.items()])
    no_first = F.lit(None).cast(counts.schema["__first"].dataType)

    def line(section, key, value, seen=no_first) -> Column:
        return F.struct(section.alias("section"), key.alias("key"), value.cast("double").alias("value"), seen.alias("__first"))

    total, section, key = F.lit("totals"), F.col("section"), F.col("key")
    is_top = section == "top_species"
    lines = counts.select(F.explode(F.array_compact(F.array(
        line(section, key, F.col("value"), F.col("__first")),
        F.when(is_top & key.isNotNull(), line(total, F.lit("unique_species"), F.lit(1))),
        *[F.when((section == "totals") & (key == "rows"), line(total, F.lit(n), F.col(n))) for n in extremes],
    ))).alias("l")).select("l.*")
    listed = [line(total, F.lit(n), F.lit(None if n in extremes else 0)) for n in (*totals, *extremes)]
    always = df.sparkSession.range(1).select(F.explode(F.array(*listed)).alias("l")).select("l.*")
    summed = lines.unionByName(always).groupBy("section", "key").agg(F.sum("value").alias("value"), F.min("__first").alias("__first"))
    # Keys outside the ranked section are alone in their window, so one filter fits all sections.
    order = Window.partitionBy("section", F.when(~is_top, key)).orderBy(F.desc("value"), "__first")
    return summed.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= top).select("section", "key", "value")


def ingest_summary(df: DataFrame, order_cols, top: int = 20) -> DataFrame:
    """``section, key, value``: totals, coordinate ranges, rows by source and top species."""
    df = df.withColumn("__level", F.coalesce(flag_column(df, "is_species_level", ("true",)), F.lit(False)))
    df = df.withColumn("__named", F.col("__level") & (normalize_text("species") != ""))
    sides = [
        _side("totals", F.lit("rows")),
        _side("totals", F.lit("rows_with_species_level_label"), F.col("__level")),
        _side("by_source", F.col("source")),
        _side("top_species", F.col("species"), F.col("__named")),
    ]
    extremes = {f"{c}_{name}": pick(c) for c in ("latitude", "longitude") for name, pick in (("min", F.min), ("max", F.max))}
    return _one_pass(df, sides, order_cols, top, ("rows", "rows_with_species_level_label", "unique_species"), extremes)


def judged_summary(judged: DataFrame, order_cols, top: int = 25) -> DataFrame:
    """``section, key, value``: totals, reasons, top species, rows by region and source.

    ``judged`` holds accepted and rejected rows with ``reject_reason``, ``species``, ``us_region`` and ``source``.
    """
    ok = F.col("reject_reason").isNull()
    sides = [
        _side("totals", F.when(ok, "cleaned_rows").otherwise("rejected_rows")),
        _side("rejection_counts", F.col("reject_reason"), ~ok),
        _side("top_species", F.col("species"), ok),
        _side("rows_by_region", F.col("us_region"), ok),
        _side("rows_by_source", F.col("source"), ok),
    ]
    return _one_pass(judged, sides, order_cols, top, ("cleaned_rows", "rejected_rows", "unique_species"))


def cleaning_summary(clean: DataFrame, rejected: DataFrame, order_cols, top: int = 25) -> DataFrame:
    """``judged_summary`` of clean and rejected rows that are stored apart."""
    accepted = clean.select(F.lit(None).cast("string").alias("reject_reason"), "species", "us_region", "source", *order_cols)
    unnamed = [F.lit(None).cast("string").alias(c) for c in ("species", "us_region", "source")]
    refused = rejected.where(F.col("reject_reason").isNotNull()).select("reject_reason", *unnamed, *order_cols)
    return judged_summary(accepted.unionByName(refused), order_cols, top)


def split_summary(df: DataFrame, order_cols, top: int = 20, group_key: str | None = None) -> DataFrame:
    """``split, section, key, value``: rows, groups, species and top species of each split.

    ``group_key`` names the column of the groups' keys, when it is at hand.
    """
    keyed = df.select(
        "split", *order_cols, (manifest_group_key(df) if group_key is None else F.col(group_key)).alias("__g"),
        normalize_text("species").alias("key"))
    # The rows are aggregated once; all figures come from what is stored of them.
    members = stored(keyed.groupBy("split", "key", "__g").agg(_rows().alias("rows"), F.min(order_struct(order_cols)).alias("__first")))
    counts = members.groupBy("split", "key").agg(F.sum("rows").alias("rows"), F.min("__first").alias("__first"))
    best = _top_per_section(counts, "split", top).select(
        "split", F.lit("top_species").alias("section"), "key", F.col("rows").alias("value"))
    totals = counts.groupBy("split").agg(F.sum("rows").alias("rows"), _rows().alias("unique_species"))
    groups = members.select("split", "__g").distinct().groupBy("split").agg(_rows().alias("groups"))

    def listed(frame: DataFrame) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in frame.columns if c != "split"])
        return frame.select("split", F.lit("totals").alias("section"), F.explode(pairs).alias("p")).select("split", "section", "p.*")

    return listed(totals).unionByName(listed(groups)).unionByName(best)


def loader_summary(df: DataFrame) -> DataFrame:
    """``split, rows, species`` as a training loader reports them."""
    return df.groupBy("split").agg(_rows().alias("rows"), F.countDistinct("species_id").alias("species"))


def preprocess_summary(df: DataFrame) -> DataFrame:
    """``section, key, value``: status totals and rejection reasons."""
    status = F.col("preprocess_status")
    ok = status == "ok"
    background = flag_column(df, "clean_background", ("true",))
    totals = df.agg(
        _rows().alias("total_rows"),
        F.count_if(ok).alias("processed_ok"),
        F.count_if(ok & (optional(df, "crop_method") == FALLBACK_CROP)).alias("fallback_center_crop"),
        F.count_if(status == "missing_input").alias("missing_input"),
        F.count_if(status == "rejected_view").alias("rejected_view"),
        F.count_if(ok & background).cast("boolean").cast("int").alias("clean_background_enabled"),
    )
    reasons = df.where(status == "rejected_view").groupBy(
        F.coalesce(blank_to_null(optional(df, "rejection_reason")), F.lit("unknown")).alias("reason")
    ).agg(_rows().alias("rows"))
    return _stack([_totals("totals", totals), _long("rejection_counts", reasons, "reason")])


def merged_shard_summary(df: DataFrame) -> DataFrame:
    status = F.col("preprocess_status")
    return df.agg(
        _rows().alias("total_rows"), F.count_if(status == "ok").alias("processed_ok"),
        F.count_if(status == "rejected_view").alias("rejected_view"),
        F.count_if(status == "missing_input").alias("missing_input"),
    )


def audit_summary(df: DataFrame, images: DataFrame | None = None, path_col: str = "processed_image_path",
                  top: int = 20) -> DataFrame:
    """``section, key, value``: crop methods, views, sources, buckets, and image facts when given.

    ``images`` is an ``image_profile`` by ``path``; rows without a decodable
    image count as corrupt.
    """
    tags = audit_tags(df)
    totals = df.agg(_rows().alias("rows"), *[F.count_if(tags[t]).alias(t) for t in tags if t != "random_overall"])
    view = F.coalesce(blank_to_null(optional(df, "view_hint")), F.lit("unknown"))
    sides = df.select(F.explode(F.array(
        F.struct(F.lit("crop").alias("section"), normalize_text(optional(df, "crop_method")).alias("key")),
        F.struct(F.lit("view").alias("section"), view.alias("key")),
        F.struct(F.lit("source").alias("section"), normalize_text(optional(df, "source")).alias("key")),
    )).alias("s")).select("s.*")
    counts = sides.groupBy("section", "key").agg(_rows().alias("rows"))
    crops = counts.where(F.col("section") == "crop").orderBy(F.desc("rows"), "key").limit(top)
    frames = [
        _totals("totals", totals),
        _long("crop", crops, "key"),
        counts.where(F.col("section") != "crop").select("section", "key", F.col("rows").cast("double").alias("value")),
    ]
    if images is not None:
        profile = images.withColumnRenamed("path", path_col)
        seen = attach(df.select(path_col), profile, [path_col])
        good = F.coalesce(F.col("decodable"), F.lit(False))
        size = F.format_string("(%d, %d)", F.col("width"), F.col("height"))
        frames += [
            _totals("totals", seen.agg(F.count_if(~good).alias("corrupt_images"))),
            _long("size", seen.where(good).groupBy(size.alias("size")).agg(_rows().alias("rows")), "size"),
            _long("mode", seen.where(good).groupBy("channel_mode").agg(_rows().alias("rows")), "channel_mode"),
        ]
    return _stack(frames)


def curation_summary(curated: DataFrame) -> DataFrame:
    """``split, section, key, value``: kept rows, kept species and rejections per split."""
    ok = F.col("reject_reason").isNull()
    totals = curated.groupBy("split").agg(
        F.count_if(ok).alias("rows"), F.countDistinct(F.when(ok, blank_to_null("species"))).alias("species"))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).alias("value")) for c in ("rows", "species")])
    rejections = curated.where(~ok).groupBy("split", F.col("reject_reason").alias("key")).agg(_rows().alias("value"))
    return totals.select("split", F.lit("totals").alias("section"), F.explode(pairs).alias("p")).select(
        "split", "section", "p.*"
    ).unionByName(rejections.select("split", F.lit("rejections").alias("section"), "key", "value"))


def match_summary(joined: DataFrame) -> DataFrame:
    """``split, outcome, rows`` of a fallback join; split ``all`` holds the totals."""
    counts = joined.groupBy("split", "outcome").agg(_rows().alias("rows"))
    totals = counts.groupBy("outcome").agg(F.sum("rows").alias("rows"))
    return counts.unionByName(totals.select(F.lit("all").alias("split"), "outcome", "rows"))


def assembly_summary(inputs: DataFrame, deduped: DataFrame, filtered: DataFrame, kept: DataFrame) -> DataFrame:
    """``section, key, value`` over the stages of an assembled dataset.

    ``filtered`` is the cascade with ``reject_reason``, ``kept`` the ranked survivors.
    """
    survivors = filtered.where(F.col("reject_reason").isNull())
    before = inputs.agg(_rows().alias("input_rows_before_dedupe"))
    after = filtered.agg(
        _rows().alias("rows_after_dedupe"),
        F.count_if(F.col("reject_reason").isNull() | (F.col("reject_reason") == "rectangular_false_positive"))
        .alias("preprocess_ok_rows"),
    )
    groups = survivors.agg(
        _rows().alias("candidate_rows"), F.countDistinct(manifest_group_key(survivors)).alias("unique_groups"))
    return _stack([
        _totals("totals", before),
        _totals("totals", after),
        _totals("totals", groups),
        _totals("totals", kept.agg(_rows().alias("kept_rows"))),
        _long("rejection_counts", reason_counts(filtered), "reason"),
    ])


def check_shards(progress: DataFrame, expected: int = 0) -> DataFrame:
    """One row per shard with ``complete`` and ``outputs_present``, in name order.

    ``progress`` has ``shard, stage, processed_csv_exists, summary_json_exists``.
    """
    complete = F.lower(F.trim(F.coalesce("stage", F.lit("")))) == "complete"
    present = F.col("processed_csv_exists") & F.col("summary_json_exists")
    report = progress.select("shard", "stage", complete.alias("complete"), present.alias("outputs_present"))
    return report if not expected else report.withColumn("expected_shards", F.lit(expected))


def with_listed_outputs(progress: DataFrame, listing: DataFrame, files=("processed.csv", "summary.json")) -> DataFrame:
    """``shard, stage`` rows with the flags ``check_shards`` reads, from a listing of output files.

    ``listing`` has a column ``path``; a shard's outputs are ``<shard>/<file>``, below any folder.
    """
    name, shard = F.regexp_extract("path", r"([^/]+)$", 1), F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    found = listing.select(shard.alias("shard"), name.alias("file")).where(F.col("file").isin(*files))
    flags = found.groupBy("shard").agg(*[F.max(F.col("file") == f).alias(f"__{i}") for i, f in enumerate(files)])
    joined = progress.select("shard", "stage").join(flags, "shard", "left")
    return joined.select("shard", "stage", *[
        F.coalesce(F.col(f"__{i}"), F.lit(False)).alias(flag) for i, flag in enumerate(("processed_csv_exists", "summary_json_exists"))])


def failing_shards(progress: DataFrame) -> DataFrame:
    """``section, shard``: names of the incomplete shards and of those that lack an output."""
    report = check_shards(progress)
    return report.where(~F.col("complete")).select(F.lit("incomplete").alias("section"), "shard").unionByName(
        report.where(~F.col("outputs_present")).select(F.lit("missing_output").alias("section"), "shard"))


def shard_totals(progress: DataFrame) -> DataFrame:
    report = check_shards(progress)
    return report.agg(
        _rows().alias("shard_count"),
        F.count_if(~F.col("complete")).alias("incomplete_shards"),
        F.count_if(~F.col("outputs_present")).alias("missing_output_shards"),
    ).withColumn("all_complete", F.col("incomplete_shards") == 0).withColumn(
        "all_outputs_present", F.col("missing_output_shards") == 0)


def require_shards(progress: DataFrame, expected: int = 0) -> None:
    """Raise unless all (expected) shards are complete with their outputs; reads one row."""
    row = shard_totals(progress).first()
    if row.shard_count == 0:
        raise RuntimeError("No shard progress found.")
    if expected and row.shard_count != expected:
        raise RuntimeError(f"Expected {expected} shards, found {row.shard_count}.")
    if not (row.all_complete and row.all_outputs_present):
        raise RuntimeError("Shard preprocessing is incomplete; refusing to continue.")


def download_summary(df: DataFrame) -> DataFrame:
    """Downloaded, already existing and other rows."""
    status = normalize_text("download_status")
    return df.agg(
        F.count_if(status == "downloaded").alias("downloaded"),
        F.count_if(status == "exists").alias("skipped_existing"),
        F.count_if(~status.isin("downloaded", "exists")).alias("failed"),
    )


def _preflight_flags(df: DataFrame, vocab: DataFrame, order_cols) -> DataFrame:
    rows = df.select(
        *order_cols,
        F.struct(normalize_text("record_id").alias("record_id"), normalize_text("species_id").alias("species_id"))
        .alias("__v"),
        has_valid_latlon("latitude", "longitude").alias("__located"),
        blank_to_null("species").alias("__species"),
        parse_int("species_id", default=None).alias("__id"),
    )
    names = vocab.select(F.col("species").alias("__species"), F.lit(True).alias("__known_species")).distinct()
    ids = vocab.select(F.col("species_id").cast("bigint").alias("__id"), F.lit(True).alias("__known_id")).distinct()
    return attach(attach(rows, names, ["__species"]), ids, ["__id"])


def preflight_rows(df: DataFrame, vocab: DataFrame, order_cols) -> DataFrame:
    """One row of problem counts; a row of the manifest may count in several."""
    flags = _preflight_flags(df, vocab, list(order_cols))
    return flags.agg(
        _rows().alias("rows_checked"),
        F.count_if(~F.col("__located")).alias("missing_coordinates"),
        F.count_if(F.col("__species").isNull()).alias("missing_species"),
        F.count_if(F.col("__species").isNotNull() & F.col("__known_species").isNull()).alias("unknown_species"),
        F.count_if(F.col("__known_id").isNull()).alias("invalid_species_ids"),
    )


def preflight_examples(df: DataFrame, vocab: DataFrame, order_cols, n: int = 10) -> DataFrame:
    """First ``n`` problems in row order: ``reason, value``."""
    flags = _preflight_flags(df, vocab, list(order_cols))

    def problem(position: int, condition: Column, reason: str, value: Column) -> Column:
        return F.when(condition, F.struct(
            F.lit(position).alias("position"), F.lit(reason).alias("reason"), value.alias("value")))

    problems = F.array_compact(F.array(
        problem(0, ~F.col("__located"), "invalid_coordinates", F.col("__v.record_id")),
        problem(1, F.col("__species").isNull(), "missing_species", F.col("__v.record_id")),
        problem(2, F.col("__species").isNotNull() & F.col("__known_species").isNull(), "unknown_species",
                F.col("__species")),
        problem(3, F.col("__known_id").isNull(), "invalid_species_id", F.col("__v.species_id")),
    ))
    listed = flags.select(*order_cols, F.explode(problems).alias("p"))
    return listed.orderBy(*order_cols, "p.position").limit(n).select(*order_cols, "p.reason", "p.value")


def preflight_paths(resolved: DataFrame, path_col: str = "resolved_path") -> DataFrame:
    """Existing and missing paths of ``resolve_paths`` output."""
    exists = F.col(f"{path_col}_exists")
    return resolved.agg(
        _rows().alias("rows_checked"), F.count_if(exists).alias("existing_paths"),
        F.count_if(~exists).alias("missing_paths"),
    )


def missing_path_examples(resolved: DataFrame, order_cols, path_col: str = "resolved_path", n: int = 10) -> DataFrame:
    missing = resolved.where(~F.col(f"{path_col}_exists")).orderBy(*order_cols).limit(n)
    shown = F.coalesce(F.nullif(F.col(path_col), F.lit("")), F.lit("<missing-path-column>"))
    return missing.select(*order_cols, shown.alias("path"))


def portable_summary(df: DataFrame, files: DataFrame, path_col: str) -> DataFrame:
    """``section, key, value``: unique images, bytes and GiB, rows and species per split."""
    used = df.select(F.col(path_col).alias("path")).distinct()
    sizes = used.join(files.select("path", "length"), "path").agg(
        _rows().alias("unique_images"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_bytes"))
    sizes = sizes.withColumn("total_gib", F.col("total_bytes") / float(1024 ** 3))
    splits = df.groupBy("split").agg(_rows().alias("rows"), F.countDistinct(blank_to_null("species")).alias("species"))
    return _stack([_totals("totals", sizes), _long("rows", splits, "split"), _long("species", splits, "split", "species")])
