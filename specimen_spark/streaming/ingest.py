"""Incremental jobs as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from specimen_spark.functions.text import blank_to_null, normalize_text
from specimen_spark.operators.joins import pending
from specimen_spark.streaming.state import StateTable, stored_or_empty


def landing_stream(
    spark: SparkSession, src: str, schema, fmt: str = "parquet", max_files: int | None = None, **options
) -> DataFrame:
    """Stream of the files that appear in a landing folder; each file is taken once."""
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(src)


def stream_ingest(
    stream: DataFrame, dst: str, ledger: str, checkpoint: str, keys=("occurrence_key",), transform=None
) -> StreamingQuery:
    """Append new rows to ``dst`` and their keys to ``ledger``; rows whose key an earlier run took are skipped.

    The rule is the ledger as it stands when the query starts: all rows of a
    key that arrive during one run are taken, however the run is cut into
    batches, and none in later runs. A batch writes below its own number and
    replaces that folder when it is replayed after a failure; a run that is
    started again after a failure counts as a later one.
    """
    keys = list(keys)
    key_schema = ", ".join(f"{k} string" for k in keys) + ", batch bigint"
    known = stored_or_empty(stream.sparkSession, ledger, key_schema).agg(F.max("batch")).first()[0]
    last_known = -1 if known is None else known

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = stored_or_empty(spark, ledger, key_schema).where((F.col("batch") <= last_known) & (F.col("batch") != batch_id))
        fresh = pending(batch, done, keys)
        out = transform(fresh) if transform else fresh
        out.write.mode("overwrite").parquet(f"{dst}/batch={batch_id}")
        named = fresh.select(*[blank_to_null(k).alias(k) for k in keys]).where(F.col(keys[0]).isNotNull())
        named.distinct().write.mode("overwrite").parquet(f"{ledger}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_dedupe(stream: DataFrame, event_time: str | None = None, delay: str | None = None) -> DataFrame:
    """First row per URL across batches.

    The state holds every URL seen. With ``event_time`` and ``delay`` only
    repeats within the delay are removed and the state is bounded.
    """
    rows = stream.withColumn("__url", normalize_text("image_url")).where(F.col("__url") != "")
    if event_time and delay:
        return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["__url"]).drop("__url")
    return rows.dropDuplicates(["__url"]).drop("__url")


def progress_counts(log: DataFrame) -> DataFrame:
    """Running rows per status; batch or stream (output mode ``complete``)."""
    return log.groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


def latest_job_state(events: DataFrame, job: str, time_col: str, tie_col: str, columns=("status",)) -> DataFrame:
    """Last event of each job by time, then tie-break."""
    return events.groupBy(job).agg(
        F.max_by(F.struct(time_col, *columns), F.struct(time_col, tie_col)).alias("__s")
    ).select(job, "__s.*")


def stream_progress_counts(log: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Running rows per status in Spark's state store; every batch adds the counts it changed to the state table."""
    def write(counts: DataFrame, batch_id: int) -> None:
        progress_table(counts.sparkSession, table).write(counts.select("status", "rows"), batch_id)

    return (
        progress_counts(log).writeStream.outputMode("update").foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def progress_table(spark: SparkSession, table: str) -> StateTable:
    """Counts only grow, so the largest of a status is its newest."""
    return StateTable(spark, table, "status string, rows bigint", "status", ["rows"])


def job_table(spark: SparkSession, table: str, schema: str, job: str, time_col: str, tie_col: str) -> StateTable:
    return StateTable(spark, table, schema, job, [time_col, tie_col])


def stream_job_state(
    events: DataFrame, table: str, checkpoint: str, job: str, time_col: str, tie_col: str, columns=("status",)
) -> StreamingQuery:
    """Keep a state table at the latest event of every job after each batch; a batch writes the jobs it saw."""
    names = [job, time_col, tie_col, *columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*names).schema)

    def merge(batch: DataFrame, batch_id: int) -> None:
        job_table(batch.sparkSession, table, schema, job, time_col, tie_col).write(batch.select(*names), batch_id)

    return (
        events.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_job_state(
    spark: SparkSession, table: str, events: DataFrame, job: str, time_col: str, tie_col: str, columns=("status",)
) -> DataFrame:
    """The latest event of every job; ``events`` only gives the types."""
    names = [job, time_col, tie_col, *columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.select(*names).schema)
    return job_table(spark, table, schema, job, time_col, tie_col).current()
