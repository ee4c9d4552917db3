"""The three end-to-end jobs, each one lazy plan per written result."""

from __future__ import annotations

from pyspark.sql import DataFrame

from specimen_spark.operators.cleaning import assign_species_ids, clean_manifest
from specimen_spark.operators.dedupe import dedupe_processed, merge_manifests
from specimen_spark.operators.joins import fallback_join, matched
from specimen_spark.operators.processed import curate, filter_processed, kept, rank_in_group
from specimen_spark.operators.split import grouped_split
from specimen_spark.operators.training import species_mixture, top_species
from specimen_spark.session import cut_lineage
from specimen_spark.sources.manifest import write_manifest


def raw_to_splits(sources: dict[str, DataFrame], order_cols, out: str, seed=42, **clean_options) -> DataFrame:
    """Merge, clean, label and split raw manifests; stores the clean rows by split, rejects and vocabulary."""
    merged, _ = merge_manifests(sources, order_cols)
    clean, rejected = clean_manifest(cut_lineage(merged), order_cols, **clean_options)
    labelled, vocab = assign_species_ids(cut_lineage(clean))
    split = grouped_split(labelled, order_cols, seed)
    write_manifest(rejected, f"{out}/rejected")
    write_manifest(vocab, f"{out}/species")
    write_manifest(split, f"{out}/clean", partition_by="split")
    return split.sparkSession.read.parquet(f"{out}/clean")


def assemble_images(processed: DataFrame, order_cols, k: int = 1, seed=42, **thresholds) -> DataFrame:
    """Deduplicate, filter, rank and split processed images."""
    survivors = kept(filter_processed(dedupe_processed(processed, order_cols), **thresholds))
    ranked = rank_in_group(survivors, k, order_cols).drop("group_key")
    return grouped_split(cut_lineage(ranked), order_cols, seed)


def coordinate_dataset(strict: DataFrame, processed: DataFrame, order_cols, id_cols, **thresholds) -> DataFrame:
    """Strict rows joined to their measurements and curated."""
    return kept(curate(matched(fallback_join(strict, processed, order_cols, id_cols)), **thresholds))


def species_report(scores: DataFrame, vocab: DataFrame, k: int, temperature: float = 1.0, top_k: int = 0) -> DataFrame:
    """Best ``k`` species of each scored coordinate."""
    return top_species(species_mixture(scores, temperature, top_k), vocab, k)
