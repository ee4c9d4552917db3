"""Building blocks that keep keyed work spread out when one key is hot.

* ``first_per_key`` / ``last_per_key`` are plain aggregates, so every map task
  sends at most one row per key.
* ``attach`` joins a one-row-per-key table to a row table so that adaptive
  execution can split the partitions of hot keys.
* ``sorted_rank`` and ``hash_rank`` number rows exactly inside a group without
  sorting the group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.session import cut_lineage, scratch_path

# Hexadecimal digits of a digest that tell slices of a rank apart: 4,096 slices a group.
SLICE_DIGITS = 3
# A lookup with no more bytes of values is broadcast.
BROADCAST_BYTES = 32 << 20
# Groups are dealt to so many buckets; a bucket with no more rows is ranked by a window.
RANK_BUCKETS, WINDOW_ROWS = 1 << 16, 1_000_000


def order_struct(order_cols) -> Column:
    """The order columns as one comparable value; a single column stays itself and hashes faster."""
    columns = [F.col(c) for c in order_cols]
    return columns[0] if len(columns) == 1 else F.struct(*columns)


def first_per_key(df: DataFrame, keys, order_cols, columns=None) -> DataFrame:
    """First row of each key by ``order_cols``."""
    columns = columns or [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*columns), order_struct(order_cols)).alias("__row"))
    return best.select(*keys, "__row.*")


def last_per_key(df: DataFrame, keys, order_cols, columns=None) -> DataFrame:
    """Last row of each key by ``order_cols``."""
    columns = columns or [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), order_struct(order_cols)).alias("__row"))
    return best.select(*keys, "__row.*")


def row_hash(columns) -> Column:
    """Hash of whole rows that tells a null apart from its neighbour's: ``xxhash64`` alone passes nulls over."""
    return F.xxhash64(*[part for c in columns for part in (F.col(c), F.col(c).isNull())])


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut and its size is known."""
    path = scratch_path(df.sparkSession, "keyed")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(lookup: DataFrame) -> bool:
    """Whether the values of a stored lookup are few enough to broadcast."""
    cells = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in lookup.columns]
    size = lookup.agg(F.sum(sum(cells, F.lit(0))).alias("n")).first()["n"] or 0
    return size <= BROADCAST_BYTES


def sized(lookup: DataFrame) -> DataFrame:
    """A stored lookup with the join hint its measured size calls for."""
    return lookup.hint("broadcast" if is_small(lookup) else "shuffle_hash")


def best_orders(df: DataFrame, keys, order_cols, last: bool = False) -> DataFrame:
    """The first (or last) order of each key, as columns ``__k0...`` and ``__o0...``, stored; only these columns of ``df`` are read."""
    names, orders = [f"__k{i}" for i in range(len(keys))], [f"__o{i}" for i in range(len(order_cols))]
    pick = F.max if last else F.min
    narrow = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[F.col(c).alias(o) for c, o in zip(order_cols, orders)])
    if len(orders) > 1:
        # A struct cannot be aggregated by hash, so the last column is settled first, by hash; in a struct null is least.
        *most, least = orders
        settled = F.max(least) if last else F.when(F.count(F.lit(1)) == F.count(least), F.min(least))
        narrow = narrow.groupBy(*names, *most).agg(settled.alias(least))
    best = narrow.groupBy(*names).agg(pick(order_struct(orders)).alias("__best"))
    return stored(best.select(*names, *(
        [F.col("__best").alias(orders[0])] if len(orders) == 1 else [F.col(f"__best.{o}").alias(o) for o in orders])))


def rows_at(df: DataFrame, best: DataFrame, keys, order_cols) -> DataFrame:
    """Rows of ``df`` that have the order of ``best_orders`` of their key; more than one if rows share it."""
    pairs = [*zip(keys, (f"__k{i}" for i in range(len(keys)))), *zip(order_cols, (f"__o{i}" for i in range(len(order_cols))))]
    return df.join(sized(best), [df[c].eqNullSafe(best[n]) for c, n in pairs]).select(*df.columns)


def one_per_key(rows: DataFrame, keys) -> DataFrame:
    """One of the few rows of each key, chosen by a hash of the row."""
    order = Window.partitionBy(*keys).orderBy("__row")
    picked = rows.withColumn("__row", row_hash(rows.columns)).withColumn("__n", F.row_number().over(order))
    return picked.where("__n = 1").select(*rows.columns)


def winning_rows(df: DataFrame, keys, order_cols, last: bool = False) -> DataFrame:
    """Whole rows of ``df`` that come first (or last) of their key; rows without an order come after those with one.

    Late materialisation: only keys and orders are aggregated, by hash, and stored. Rows meet the winners in a hash
    join; if these are few they are broadcast, and only winning rows move. Otherwise the join is on key and order
    together, so the rows of a hot key spread out. Keys whose best order several rows share are settled by a hash of
    the row. ``df`` runs twice and moves whole, so leave out columns that are not wanted. Null keys are a key.
    """
    keys, order_cols = list(keys), list(order_cols)
    return one_per_key(rows_at(df, best_orders(df, keys, order_cols, last), keys, order_cols), keys)


def attach(rows: DataFrame, lookup: DataFrame, keys, how: str = "left") -> DataFrame:
    """Join ``lookup`` (one row per key, usually aggregated) to ``rows`` on ``keys``.

    Spark broadcasts the lookup when its measured size allows it. Otherwise
    both sides are shuffled and adaptive execution splits the partitions of
    hot (or null) keys of ``rows``, copying the few lookup rows to each split.
    It can only do so when both inputs come straight from a shuffle. An
    aggregated lookup is already partitioned by its key and would skip that
    shuffle, so the join also compares a column that is always 0 on both sides.
    """
    keys = list(keys)
    always_zero = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1).cast("bigint"))
    joined = rows.withColumn("__zero", always_zero).join(
        lookup.withColumn("__zero", always_zero), keys + ["__zero"], how
    )
    if how in ("left_semi", "left_anti"):
        return joined.select(*rows.columns)
    return joined.select(*rows.columns, *[c for c in lookup.columns if c not in keys])


def bucketed_rank(
    df: DataFrame, group_cols, bucket_cols, order_cols, rank: str, total: str | None = None
) -> DataFrame:
    """1-based exact rank inside each group; nulls are a group, a slice and a value of their own, and come first.

    ``bucket_cols`` cut the sort order of a group into consecutive slices.
    Rows are ranked inside a slice and shifted by the size of the slices
    before it; only the table of slice sizes is accumulated per group.
    """
    group_cols, bucket_cols = list(group_cols), list(bucket_cols)
    keys = [*group_cols, *bucket_cols]
    slices = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    in_group = Window.partitionBy(*(group_cols or [F.lit(0)]))
    before = in_group.orderBy(*bucket_cols).rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(
        *[F.col(c).alias(f"__of_{c}") for c in keys],
        F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"),
        *([F.sum("__size").over(in_group).alias(total)] if total else []),
    )
    in_slice = Window.partitionBy(*keys).orderBy(*order_cols)
    ranked = df.withColumn("__in_slice", F.row_number().over(in_slice))
    same = [ranked[c].eqNullSafe(offsets[f"__of_{c}"]) for c in keys]
    return (
        ranked.join(offsets, same)
        .withColumn(rank, (F.col("__in_slice") + F.col("__before")).cast("bigint"))
        .drop("__in_slice", "__before", *[f"__of_{c}" for c in keys])
    )


def sorted_rank(
    df: DataFrame, group_cols, order_cols, rank: str, total: str | None = None
) -> DataFrame:
    """1-based exact rank inside each group; nulls are a group and a value of their own, and come first.

    One range exchange sorts the rows by group and order, and then a row's rank follows from its position: the low
    part of ``monotonically_increasing_id`` counts rows inside a partition, and a table of one row per group and
    partition tells where the group begins there and how many of its rows lie in partitions before. Rows that are
    equal in all ``order_cols`` keep the order they come in and may lie in several partitions, so neither a hot group,
    an outlier nor a repeated value fills one. The sorted rows are stored once, since another run might cut them
    elsewhere.
    """
    group_cols = list(group_cols)
    order = [F.col(c) if isinstance(c, str) else c for c in (*group_cols, *order_cols)] + [F.col("__tie")]
    ranged = df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*order)
    placed = ranged.sortWithinPartitions(*order).drop("__tie").withColumn("__at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("__slice", F.shiftright("__at", 33)))
    keys = [*group_cols, "__slice"]
    in_group = Window.partitionBy(*(group_cols or [F.lit(0)]))
    before = in_group.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"), F.min("__at").alias("__start"))
    runs = runs.select(
        *[F.col(c).alias(f"__of_{c}") for c in keys],
        (F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__start") + 1).alias("__shift"),
        *([F.sum("__size").over(in_group).alias(total)] if total else []),
    )
    same = [placed[c].eqNullSafe(runs[f"__of_{c}"]) for c in keys]
    return placed.join(runs, same).select(
        *df.columns, (F.col("__at") + F.col("__shift")).cast("bigint").alias(rank), *([total] if total else []))


def hash_rank(
    df: DataFrame, group_cols, key_cols, seed, rank: str, total: str | None = None
) -> DataFrame:
    """Exact rank in the order of ``md5(seed:key)``.

    Digests are spread evenly, so their first digits cut every group into slices of known order without sampling or
    storing anything: one exchange of the rows, beside counts of the slices. ``df`` runs twice and must give the same
    rows both times.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key_cols]))
    hashed = df.withColumn("__digest", digest).withColumn("__slice", F.substring("__digest", 1, SLICE_DIGITS))
    return bucketed_rank(hashed, group_cols, ["__slice"], ["__digest", *key_cols], rank, total).drop("__digest", "__slice")


def number_rank(
    df: DataFrame, group_cols, number_col: str, tie_cols, rank: str, total: str | None = None
) -> DataFrame:
    """Exact rank in the order of a numeric column: null first, NaN last."""
    return sorted_rank(df, group_cols, [number_col, *tie_cols], rank, total)


def group_rank(df: DataFrame, group_cols, order_cols, rank: str) -> DataFrame:
    """1-based exact rank inside each group, for many groups of which few are large; ``df`` runs up to three times.

    Groups are dealt to buckets by hash and the rows of buckets counted, which moves a number a bucket. Groups in buckets
    with few rows are ranked by a window, with one exchange; only those of larger buckets go through ``sorted_rank``.
    """
    bucket = F.pmod(F.xxhash64(*[F.col(c) for c in group_cols]), F.lit(RANK_BUCKETS))
    large = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WINDOW_ROWS)
    large = [row["b"] for row in large.collect()]  # RANK_BUCKETS numbers at most
    in_group = Window.partitionBy(*group_cols).orderBy(*order_cols)
    ranked = (df.where(~bucket.isin(large)) if large else df).withColumn(rank, F.row_number().over(in_group).cast("bigint"))
    return ranked.unionByName(sorted_rank(df.where(bucket.isin(large)), group_cols, order_cols, rank)) if large else ranked


def with_row_numbers(df: DataFrame, order_col: str, tie_cols=(), name: str = "source_row_index") -> DataFrame:
    """1-based row numbers in the order of a numeric column."""
    return number_rank(df, [], order_col, list(tie_cols), name)


def explode_tags(df: DataFrame, tags: dict[str, Column], tag: str) -> DataFrame:
    """One output row per tag whose condition holds."""
    marks = F.array_compact(F.array(*[F.when(condition, F.lit(name)) for name, condition in tags.items()]))
    return df.withColumn(tag, F.explode(marks))
