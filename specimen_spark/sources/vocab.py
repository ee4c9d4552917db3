"""Species vocabularies: a JSON map on storage, a two-column table in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vocab(spark: SparkSession, path: str) -> DataFrame:
    """``species, species_id`` from one JSON object of names to ids."""
    text = spark.read.text(path, wholetext=True)
    table = F.from_json("value", "map<string,int>")
    return text.select(F.explode(table).alias("species", "species_id"))


def write_vocab(vocab: DataFrame, path: str) -> None:
    """One JSON object per slice of the vocabulary; a plain table goes through ``write_manifest``."""
    entries = F.map_from_entries(F.array(F.struct("species", "species_id")))
    vocab.select(F.to_json(entries).alias("value")).write.mode("overwrite").text(path)


def read_vocab_lines(spark: SparkSession, path: str) -> DataFrame:
    """Vocabulary written by ``write_vocab``."""
    table = F.from_json("value", "map<string,int>")
    return spark.read.text(path).select(F.explode(table).alias("species", "species_id"))


def default_vocab(spark: SparkSession, n: int) -> DataFrame:
    """Stand-in names ``species_<i>``."""
    ids = spark.range(n).select(F.col("id").cast("int").alias("species_id"))
    return ids.select(F.concat(F.lit("species_"), F.col("species_id").cast("string")).alias("species"), "species_id")
