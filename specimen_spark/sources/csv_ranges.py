"""Records of large CSV files whose cells hold line breaks, read by several tasks.

A task that reads a byte range cannot know whether it starts inside a quoted cell. So the ranges are read twice: first
each reports how many quotes it holds, and sums over the ranges before tell with which parity a range starts; only then
are lines put together to records. A line starts a record if the quotes before it are even in number (a doubled quote
counts twice, so it changes nothing). Lines that are a record by themselves, which nearly all are, need no grouping.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from specimen_spark.operators.keyed import attach


def numbered_lines(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, at, value, quotes): lines in the byte ranges that Spark cuts; ``at`` orders those of a range."""
    lines = spark.read.option("lineSep", "\n").text(files)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), "value", quotes.alias("quotes"))


def range_parities(lines: DataFrame) -> DataFrame:
    """(file, block, inside): 1 for ranges that start inside a quoted cell. One row a range is added up."""
    sums = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("inside"))


def records(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, block, at, record): whole records with the place of their first line; blank lines are none."""
    lines = numbered_lines(spark, files)
    lines = attach(lines, range_parities(lines), ["file", "block"], "inner")
    earlier = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("inside") + F.coalesce(F.sum("quotes").over(earlier), F.lit(0))
    marked = lines.withColumn("starts", so_far % 2 == 0).withColumn("closed", (so_far + F.col("quotes")) % 2 == 0)
    whole = marked.where("starts AND closed").select("file", "block", "at", F.col("value").alias("record"))

    # Pieces of longer records: each belongs to the last piece that starts one, in its range or in one before.
    pieces = marked.where("NOT (starts AND closed)").select("file", "block", "at", "value", "starts")
    first = F.when(F.col("starts"), F.struct("block", "at"))
    until = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("first", F.last(first, ignorenulls=True).over(until))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    opened = pieces.groupBy("file", "block").agg(F.max(first).alias("open")).select(
        "file", "block", F.last("open", ignorenulls=True).over(before).alias("open"))
    pieces = attach(pieces, opened, ["file", "block"]).withColumn("first", F.coalesce("first", "open"))
    joined = pieces.groupBy("file", "first").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    long = joined.select("file", "first.block", "first.at", F.array_join(F.expr("transform(lines, x -> x.value)"), "\n").alias("record"))
    return whole.union(long).withColumn("record", F.regexp_replace("record", "\r$", "")).where("record <> ''")


def read_records(spark: SparkSession, files: list[str], columns: list[str], options: dict) -> DataFrame:
    """Rows of CSV files that share a header line, as text columns; the first record of each file is that header."""
    found = records(spark, files)
    heads = found.where("block = 0").groupBy("file").agg(F.min("at").alias("head"))
    body = attach(found, heads, ["file"]).where("NOT (block = 0 AND at = head)")
    schema = ", ".join(f"`{c}` string" for c in columns)
    return body.select(F.from_csv("record", F.lit(schema), options).alias("row")).select("row.*")
