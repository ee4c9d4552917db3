"""Registry of all queries over the supplied tables."""

from specimen_spark.catalog import cleaning, images, ingest, processed, scalars, split, streams, training  # noqa: F401
from specimen_spark.catalog.cleaning import flagship
from specimen_spark.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]
