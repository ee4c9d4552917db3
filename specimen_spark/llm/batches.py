"""Small helpers for work on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BLOCK_BYTES = 24 << 20


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of a DDL string."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(schema))


def map_columns(df: DataFrame, fn: Callable[..., dict], schema: str, state: Callable[[], tuple] = tuple) -> DataFrame:
    """``fn(*columns as lists, *state())`` for each batch; it returns the output columns by name.

    ``state`` is called once per task, so that ``fn`` can keep bounded caches between batches.
    """
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = state()
        for batch in batches:
            if batch.num_rows:
                columns = fn(*[c.to_pylist() for c in batch.columns], *held)
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)


def block_count(df: DataFrame, text: str, block_bytes: int = BLOCK_BYTES) -> int:
    """How many blocks of about ``block_bytes`` the texts fill; one number reaches the driver."""
    size = df.agg(F.sum(F.octet_length(text)).alias("n")).first()["n"]
    return max(1, -(-int(size or 0) // block_bytes))


def block_of(n_blocks: int, *columns: str) -> Column:
    """Block of a row, spread evenly whatever the values of other columns."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(n_blocks)).cast("int")
