"""Deduplication and merging of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.numbers import integer_column
from specimen_spark.functions.text import blank_to_null, normalize_text
from specimen_spark.operators.keyed import attach, order_struct, winning_rows
from specimen_spark.schemas import optional
from specimen_spark.sources.manifest import union_manifests


def dedupe_by_url(df: DataFrame, order_cols) -> DataFrame:
    """First row per normalised URL; rows without URL are dropped."""
    keyed = df.withColumn("__url", blank_to_null("image_url")).where(F.col("__url").isNotNull())
    return winning_rows(keyed, ["__url"], order_cols).select(*df.columns)


def merge_manifests(dfs: dict[str, DataFrame], order_cols) -> tuple[DataFrame, DataFrame]:
    """Deduplicated union in input order, and ``(section, key, rows)`` counts.

    Inputs rank before ``order_cols``: a URL in the first input wins.
    """
    parts = [df.withColumn("__input", F.lit(i)) for i, df in enumerate(dfs.values())]
    merged = union_manifests(parts)
    deduped = dedupe_by_url(merged, ["__input", *order_cols])
    names = F.element_at(F.array(*[F.lit(n) for n in dfs]), F.col("__input") + 1)
    inputs = merged.groupBy("__input").agg(F.count(F.lit(1)).alias("rows"))
    after = deduped.agg(F.count(F.lit(1)).alias("rows"))
    counts = (
        inputs.select(F.lit("inputs").alias("section"), names.alias("key"), "rows")
        .unionByName(inputs.agg(F.sum("rows").alias("rows")).select(
            F.lit("total").alias("section"), F.lit("before_dedupe").alias("key"), "rows"))
        .unionByName(after.select(F.lit("total").alias("section"), F.lit("after_dedupe").alias("key"), "rows"))
    )
    return deduped.drop("__input"), counts


def processed_key(df: DataFrame):
    """Source path, URL, path, processed path, else ``record|media`` (never blank)."""
    parts = [blank_to_null(optional(df, c)) for c in
             ("source_image_path", "image_url", "image_path", "processed_image_path")]
    pair = F.concat(normalize_text(optional(df, "record_id")), F.lit("|"), normalize_text(optional(df, "media_id")))
    return F.coalesce(*parts, pair)


def dedupe_processed(df: DataFrame, order_cols) -> DataFrame:
    """First row per coalesced key."""
    keyed = df.withColumn("__key", processed_key(df))
    return winning_rows(keyed, ["__key"], order_cols).select(*df.columns)


def duplicate_count(df: DataFrame) -> DataFrame:
    """``input_rows, rows_after_dedupe, duplicate_rows_dropped`` of ``dedupe_processed``."""
    per_key = df.select(processed_key(df).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), F.count(F.lit(1)).alias("rows_after_dedupe")
    ).withColumn("duplicate_rows_dropped", F.col("input_rows") - F.col("rows_after_dedupe"))


def merge_shards(dfs, index: str = "source_row_index") -> DataFrame:
    """Union of shard outputs ordered by source row number, blank numbers first as 0."""
    merged = union_manifests(list(dfs))
    return merged.orderBy(F.coalesce(integer_column(merged, index), F.lit(0)))


def content_duplicates(df: DataFrame, content: str, id_col: str, order_cols) -> DataFrame:
    """``first, duplicate, sha1`` for every later row with equal bytes; the smaller id is first among equal orders."""
    hashed = df.select(*dict.fromkeys([id_col, *order_cols]), F.sha1(content).alias("sha1"))
    order_cols = list(dict.fromkeys([*order_cols, id_col]))
    firsts = hashed.groupBy("sha1").agg(
        F.min(order_struct(order_cols)).alias("__first"),
        F.min_by(id_col, order_struct(order_cols)).alias("first"),
        F.count(F.lit(1)).alias("__n"),
    )
    repeated = firsts.where(F.col("__n") > 1).drop("__n")
    joined = attach(hashed, repeated, ["sha1"], how="inner")
    return joined.where(order_struct(order_cols) != F.col("__first")).select(
        "first", F.col(id_col).alias("duplicate"), "sha1"
    )


def duplicate_examples(duplicates: DataFrame, max_examples: int = 20) -> DataFrame:
    """At most ``max_examples`` rows of the duplicate report, in stable order."""
    return duplicates.orderBy("duplicate").limit(max_examples)
