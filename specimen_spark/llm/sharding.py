"""Two-pass external shuffle into shards, in DataFrame operations only.

Pass one scatters records uniformly into buckets that fit in a task's memory, by a seeded hash of the record's place
in the input. Pass two shuffles each bucket by itself (``shuffle`` is a Fisher-Yates shuffle inside the JVM). Buckets
one after another make one random order over all records, and shard ``s`` of ``S`` is its ``s``-th part. So shards
differ by one record at most, a task writes its bucket into one shard or two, and equal records spread like others.

What is known of a bucket beside its records is its size; the sizes are joined to the buckets on their partitioning,
so records move once. The input is read three times (its bytes, its rows, its records) and must be the same each
time, as tables in files are; other inputs are to be stored first. The same files, split settings, seed and bucket
size give the same shards, also if executors are lost on the way.

Defined cases: null ids, null or empty texts and repeated rows are records like any other. A text that is larger than
a bucket makes one bucket larger. Empty tables give no records, fewer records than shards leave some shards empty.
Columns of docs called shard or slot are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKET_BYTES = 16 << 20


def scatter(docs: DataFrame, n_buckets: int, seed: int) -> DataFrame:
    """(bucket, key, record): the key is the record's place in the input, whatever the record holds."""
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), record.alias("record"))
    return keyed.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(n_buckets)).cast("int"))


def bucket_starts(scattered: DataFrame) -> DataFrame:
    """(bucket, before, total): records in earlier buckets and in all."""
    sizes = scattered.groupBy("bucket").agg(F.count("*").alias("n"))
    order = Window.partitionBy(F.lit(0)).orderBy("bucket")
    return sizes.select(
        "bucket", (F.sum("n").over(order) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy(F.lit(0))).alias("total"))


def shuffled(docs: DataFrame, n_shards: int, n_buckets: int, seed: int) -> DataFrame:
    """The rows of docs with shard and slot."""
    docs = docs.drop("shard", "slot")
    scattered = scatter(docs, n_buckets, seed)
    # Sorted by place, so that a bucket's shuffle starts from the same order whenever it runs.
    buckets = (
        scattered.repartitionById(n_buckets, "bucket").sortWithinPartitions("bucket", "key")
        .groupBy("bucket").agg(F.collect_list("record").alias("records"))
    )
    starts = bucket_starts(scattered).repartitionById(n_buckets, "bucket").hint("shuffle_hash")
    mixed = buckets.join(starts, "bucket").select("before", "total", F.posexplode(F.shuffle("records", seed)).alias("at", "record"))
    # Shard s begins at place floor(s * total / n_shards).
    place = mixed.select("record", "total", (F.col("before") + F.col("at")).alias("place"))
    shard = F.expr(f"int(((place + 1) * {n_shards} - 1) div total)")
    return place.withColumn("shard", shard).select(
        "record.*", "shard", F.expr(f"place - (shard * total) div {n_shards}").cast("bigint").alias("slot"))


def write_shards(docs: DataFrame, target: str, n_shards: int, seed: int = 0, bucket_bytes: int = BUCKET_BYTES) -> None:
    """The records in shuffled order, with their slot, as Parquet files below ``target/shard=<number>``."""
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8))).first()[0] or 0
    n_buckets = max(1, -(-int(size) // bucket_bytes))
    shuffled(docs, n_shards, n_buckets, seed).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(target)


def read_shards(spark: SparkSession, target: str, schema) -> DataFrame:
    """The written rows; ``schema`` is that of the docs, since without records no file tells it."""
    columns = [f for f in schema.fields if f.name not in ("shard", "slot")]
    fields = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in columns], "slot bigint", "shard int"])
    return spark.read.schema(fields).parquet(target)


def ledger(shards: DataFrame) -> DataFrame:
    """Where each record went: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return shards.select(
        F.col("doc_id").cast("bigint"), (F.octet_length(text) + 8).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
