"""Queries of the incremental jobs: streams run to the end of the supplied files."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.views import table, view
from specimen_spark.session import scratch_path
from specimen_spark.streaming import ingest


def _events(spark, sf):
    schema = table(spark, sf, "events").schema
    return ingest.landing_stream(spark, f"{sf}/events.parque[t]", schema)


def _as_log(events):
    status = (
        F.when(F.col("event_type") == "click", "ok").when(F.col("event_type") == "view", "done_existing")
        .when(F.col("event_type") == "purchase", "skip").when(F.col("event_type") == "signup", "fail_quality")
        .otherwise("fail_download"))
    return events.select("event_id", F.col("user_id").cast("string").alias("occurrence_key"), "ts", status.alias("status"), "value",
                         F.concat(F.lit("http://u/"), F.col("user_id").cast("string")).alias("image_url"))


@query("J1_stream_ingest", """SELECT event_id, CAST(user_id AS VARCHAR) AS occurrence_key FROM events
WHERE CAST(user_id AS VARCHAR) NOT IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')""")
def stream_ingest(spark, sf):
    """Rows of the event files whose key is not in the ledger left by an earlier run."""
    base = scratch_path(spark, "ingest")
    done = view(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").cast("string").alias("occurrence_key"))
    done.distinct().write.parquet(f"{base}/ledger/batch=-1")
    ingest.stream_ingest(_as_log(_events(spark, sf)), f"{base}/out", f"{base}/ledger", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("event_id", "occurrence_key")


@query("J2_stream_dedupe", "SELECT DISTINCT 'http://u/' || user_id AS image_url FROM events")
def stream_dedupe(spark, sf):
    base = scratch_path(spark, "dedupe")
    unique = ingest.stream_dedupe(_as_log(_events(spark, sf))).select("image_url")
    writer = unique.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("image_url string").parquet(f"{base}/out")


@query("J3_progress_counts", "SELECT status, count(*) AS rows FROM {progress_log} GROUP BY status")
def progress_counts(spark, sf):
    return ingest.progress_counts(view(spark, sf, "progress_log"))


@query("J3_stream_progress_counts", "SELECT status, count(*) AS rows FROM {progress_log} GROUP BY status")
def stream_progress_counts(spark, sf):
    base = scratch_path(spark, "progress")
    ingest.stream_progress_counts(_as_log(_events(spark, sf)), f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return ingest.progress_table(spark, f"{base}/table").current().select("status", "rows")


@query("J4_latest_job_state", """SELECT occurrence_key, arg_max(status, (ts, event_id)) AS status, epoch_us(max(ts)) AS updated FROM {progress_log} GROUP BY occurrence_key""")
def latest_job_state(spark, sf):
    return ingest.latest_job_state(view(spark, sf, "progress_log"), "occurrence_key", "ts", "event_id").select(
        "occurrence_key", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("updated"))


@query("J4_stream_job_state", """SELECT occurrence_key, arg_max(status, (ts, event_id)) AS status, arg_max(event_id, (ts, event_id)) AS event_id FROM {progress_log} GROUP BY occurrence_key""")
def stream_job_state(spark, sf):
    base = scratch_path(spark, "jobs")
    log = _as_log(_events(spark, sf))
    ingest.stream_job_state(log, f"{base}/table", f"{base}/checkpoint", "occurrence_key", "ts", "event_id").awaitTermination()
    return ingest.current_job_state(spark, f"{base}/table", log, "occurrence_key", "ts", "event_id").select("occurrence_key", "status", "event_id")
