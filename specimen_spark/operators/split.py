"""Leakage-free splits, exact weighted partitions, shards and samples.

Random order is the order of ``md5(seed:key)``: reproducible and independent
of how Spark partitions the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.fixed_values import RECOVERED_CROP
from specimen_spark.functions.geo import hash_uniform
from specimen_spark.functions.numbers import number_column
from specimen_spark.functions.text import as_column, normalize_text
from specimen_spark.operators.keyed import attach, explode_tags, hash_rank, order_struct, sorted_rank, stored
from specimen_spark.operators.processed import manifest_group_key
from specimen_spark.schemas import optional

SPLITS = ("train", "val", "test")


def split_sizes(n, val_fraction: float, test_fraction: float) -> Column:
    """``struct<train, val, test>`` group counts for ``n`` groups of one species.

    Every size is 0 or more and they add up to ``n``. Shares below 0, or above 1 together, are an error; if they
    are 1 together, one group is still left to train on.
    """
    if min(val_fraction, test_fraction) < 0 or val_fraction + test_fraction > 1:
        raise ValueError(f"val and test shares must be 0 or more and at most 1 together, not {val_fraction} and {test_fraction}")
    n = as_column(n).cast("bigint")
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def sizes(train, val, test):
        return F.struct(train.alias("train"), val.alias("val"), test.alias("test"))

    val = F.greatest(one, F.rint(n * F.lit(float(val_fraction))).cast("bigint"))
    test = F.greatest(one, F.rint(n * F.lit(float(test_fraction))).cast("bigint"))
    short = n - val - test <= 0
    overflow = one - (n - val - test)
    cut_test = short & (test >= val) & (test > 1)
    test_2 = F.when(cut_test, test - overflow).otherwise(test)
    val_2 = F.when(short & ~cut_test, F.greatest(one, val - overflow)).otherwise(val)
    train_2 = n - val_2 - test_2
    # Still nothing for training: split what is left beside n - 2 groups.
    train_3 = F.greatest(one, n - 2)
    rest = n - train_3
    val_3 = F.greatest(one, F.floor(rest / 2).cast("bigint"))
    return (
        F.when(n <= 0, sizes(zero, zero, zero))
        .when(n == 1, sizes(one, zero, zero))
        .when(n == 2, sizes(one, one, zero))
        .when(n == 3, sizes(one, one, one))
        .when(train_2 <= 0, sizes(train_3, val_3, rest - val_3))
        .otherwise(sizes(train_2, val_2, test_2))
    )


def with_group_key(df: DataFrame, name: str = "group_key") -> DataFrame:
    """Adds the split group; a row without any usable key is an error."""
    key = manifest_group_key(df)
    return df.withColumn(name, F.when(
        key == "", F.raise_error("Encountered a row without any usable group key.").cast("string")
    ).otherwise(key))


def group_species(df: DataFrame, order_cols) -> DataFrame:
    """``group_key, species, rows``: majority species per group, first seen on ties, then first in name order."""
    rows = with_group_key(df)
    counts = rows.groupBy("group_key", normalize_text("species").alias("species")).agg(
        F.count(F.lit(1)).alias("__n"), F.min(order_struct(order_cols)).alias("__first")
    )
    return counts.groupBy("group_key").agg(
        F.min_by("species", F.struct(-F.col("__n"), F.col("__first"), F.col("species"))).alias("species"),
        F.sum("__n").alias("rows"),
    )


def split_of_groups(groups: DataFrame, seed, val_fraction: float, test_fraction: float) -> DataFrame:
    """``group_key, split`` from ``group_species`` output."""
    ranked = hash_rank(groups, ["species"], ["group_key"], seed, "__rank", "__groups")
    sizes = ranked.withColumn("__s", split_sizes("__groups", val_fraction, test_fraction))
    train, val, test = (F.col(f"__s.{s}") for s in SPLITS)
    rank = F.col("__rank")
    split = (
        F.when(rank <= train, F.lit("train"))
        .when(rank <= train + val, F.lit("val"))
        .when(rank <= train + val + test, F.lit("test"))
        .otherwise(F.lit("train"))
    )
    return sizes.select("group_key", split.alias("split"))


def grouped_split(
    df: DataFrame, order_cols, seed=42, val_fraction: float = 0.1, test_fraction: float = 0.1, keep_key: bool = False
) -> DataFrame:
    """Rows with ``split``: all rows of a group share one, stratified by the group's species.

    ``keep_key`` leaves the group's key in ``group_key``.
    """
    # Stored, since ranking reads its input twice.
    groups = split_of_groups(stored(group_species(df, order_cols)), seed, val_fraction, test_fraction)
    rows = with_group_key(df, "group_key")
    return attach(rows, groups, ["group_key"]).drop(
        *(["group_key"] if "group_key" not in df.columns and not keep_key else []))


def partition_counts(total: Column, weights) -> list[Column]:
    """Largest-remainder counts; equal remainders favour the later output."""
    weight_sum = float(sum(weights))
    raw = [total * F.lit(float(w)) / F.lit(weight_sum) for w in weights]
    base = [F.floor(r).cast("bigint") for r in raw]
    rest = total - reduce(lambda a, b: a + b, base)
    order = F.reverse(F.array_sort(F.array(*[
        F.struct((r - b).alias("fraction"), F.lit(i).alias("output")) for i, (r, b) in enumerate(zip(raw, base))
    ])))
    outputs = F.transform(order, lambda x: x["output"])
    return [b + F.when(F.array_position(outputs, F.lit(i)) <= rest, 1).otherwise(0) for i, b in enumerate(base)]


def partition_by_weight(df: DataFrame, weights, seed, key_cols, name: str = "part") -> DataFrame:
    """Rows with the 0-based output they fall in; output sizes are exact."""
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every weight must be > 0")
    ranked = hash_rank(df, [], key_cols, seed, "__rank", "__total")
    counts = partition_counts(F.col("__total"), weights)
    upper, part = F.lit(0).cast("bigint"), None
    for i, count in enumerate(counts):
        upper = upper + count
        hit = F.col("__rank") <= upper
        part = F.when(hit, F.lit(i)) if part is None else part.when(hit, F.lit(i))
    return ranked.withColumn(name, part).drop("__rank", "__total")


def assign_shard(df: DataFrame, num_shards: int, index: int | None = None, row: str = "source_row_index") -> DataFrame:
    """``(row - 1) mod n`` as ``shard``, or only the rows of one shard."""
    if num_shards < 1:
        raise ValueError("num_shards must be at least 1")
    if index is not None and not 0 <= index < num_shards:
        raise ValueError("index must be in [0, num_shards)")
    rows = df.withColumn("shard", F.pmod(F.col(row) - 1, F.lit(num_shards)).cast("int"))
    return rows if index is None else rows.where(F.col("shard") == index)


def _sample_tagged(tagged: DataFrame, tags: list[str], tag: str, n: int, seed: int, key_cols) -> DataFrame:
    """``n`` rows per tag in md5 order with seed + position of the tag.

    The row-number filter runs per task before the shuffle.
    """
    seeds = F.create_map(*[x for i, t in enumerate(tags) for x in (F.lit(t), F.lit(str(seed + i)))])
    digest = F.md5(F.concat_ws(":", seeds[F.col(tag)], *[F.col(k).cast("string") for k in key_cols]))
    order = Window.partitionBy(tag).orderBy("__digest", *key_cols)
    return (
        tagged.withColumn("__digest", digest)
        .withColumn("__n", F.row_number().over(order))
        .where(F.col("__n") <= n)
        .drop("__n", "__digest")
    )


def audit_tags(df: DataFrame) -> dict[str, Column]:
    """Conditions of the audit buckets; blank quality and coverage count as 1, blank symmetry never is low."""
    quality = F.coalesce(number_column(df, "mask_quality_score"), F.lit(1.0))
    coverage = F.coalesce(number_column(df, "coverage_ratio"), F.lit(1.0))
    symmetry = F.coalesce(number_column(df, "symmetry_score"), F.lit(1.0))
    return {
        "random_overall": F.lit(True),
        "recovered_rows": normalize_text(optional(df, "crop_method")) == RECOVERED_CROP,
        "low_quality_rows": quality < 0.65,
        "low_coverage_rows": coverage < 0.03,
        "low_symmetry_rows": symmetry < 0.80,
    }


def audit_buckets(df: DataFrame, n: int, seed: int, key_cols) -> DataFrame:
    """Up to ``n`` rows per audit bucket; a row may be in several."""
    tags = audit_tags(df)
    return _sample_tagged(explode_tags(df, tags, "bucket"), list(tags), "bucket", n, seed, key_cols)


def qc_sample(df: DataFrame, n: int, seed: int, key_cols) -> DataFrame:
    """``n`` rows with status ok and a processed path."""
    ok = df.where(
        (normalize_text("preprocess_status") == "ok") & (normalize_text("processed_image_path") != "")
    ).withColumn("bucket", F.lit("ok"))
    return _sample_tagged(ok, ["ok"], "bucket", n, seed, key_cols).drop("bucket")


def balanced_sample(df: DataFrame, class_col: str, key_cols, seed, n: int | None = None) -> DataFrame:
    """``n`` draws with replacement, each class equally likely, uniform inside a class; null is a class.

    A draw picks a class and then a position in it; positions are exact ranks,
    so the draws find their rows by an equi-join. ``n`` defaults to the number
    of rows.
    """
    spark = df.sparkSession
    n = df.count() if n is None else n
    rows = df.withColumn("__blank", F.col(class_col).isNull()).withColumn("__name", F.coalesce(F.col(class_col).cast("string"), F.lit("")))
    members = hash_rank(rows, ["__blank", "__name"], key_cols, f"{seed}:member", "__position")
    classes = rows.groupBy("__blank", "__name").agg(F.count(F.lit(1)).alias("__count"))
    classes = sorted_rank(classes, [], ["__blank", "__name"], "__class", "__classes")
    total = classes.agg(F.max("__classes").alias("n")).scalar()
    draws = spark.range(n).select(
        F.col("id").alias("draw"),
        (F.floor(hash_uniform(seed, F.lit("class"), F.col("id")) * total) + 1).alias("__class"),
        hash_uniform(seed, F.lit("row"), F.col("id")).alias("__u"),
    )
    located = attach(draws, classes, ["__class"], how="inner").select(
        "draw", "__blank", "__name", (F.floor(F.col("__u") * F.col("__count")) + 1).cast("bigint").alias("__position")
    )
    return attach(located, members, ["__blank", "__name", "__position"], how="inner").select("draw", *df.columns)
