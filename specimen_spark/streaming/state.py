"""State tables kept as change files over a base, so that what a batch writes follows the batch.

``table/changes/version=<batch>`` holds what a batch changed, ``table/base/version=<batch>`` the state up to a batch.
The state is the newest base with all later changes. When the changes since a base have as many rows as the base, they
are merged into a new one, so a row is copied a constant number of times however many batches there are. The files
that the base before needs stay until the next merge, for readers that began earlier; older ones go. A batch that is
replayed writes the same folders again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stored_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """Stored table, or an empty one before the first write; any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class StateTable:
    """The newest row of each key by ``order``; ``schema`` is the DDL of key, order and other columns."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str]):
        self.spark, self.path, self.schema, self.key, self.order = spark, path.rstrip("/"), schema, key, list(order)

    def newest(self, rows: DataFrame) -> DataFrame:
        others = [c for c in rows.columns if c != self.key]
        best = rows.groupBy(self.key).agg(F.max_by(F.struct(*others), F.struct(*self.order)).alias("__row"))
        return best.select(self.key, "__row.*")

    def part(self, name: str) -> DataFrame:
        return stored_or_empty(self.spark, f"{self.path}/{name}", f"{self.schema}, version bigint")

    def base_version(self) -> int:
        version = self.part("base").agg(F.max("version")).first()[0]
        return -1 if version is None else version

    def since(self, base: int, until: int | None = None) -> DataFrame:
        changes = self.part("changes").where(F.col("version") > base)
        return changes if until is None else changes.where(F.col("version") <= until)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Add a batch's rows; merges when the changes have grown to the size of the base."""
        self.newest(rows).write.mode("overwrite").parquet(f"{self.path}/changes/version={batch_id}")
        base = self.base_version()
        if base >= batch_id:  # a replay of a batch that was merged already
            return
        kept = self.part("base").where(F.col("version") == base)
        changes = self.since(base, batch_id)
        if changes.count() >= max(1, kept.count()):
            merged = self.newest(kept.union(changes).drop("version"))
            merged.write.mode("overwrite").parquet(f"{self.path}/base/version={batch_id}")
            self.drop("base", base - 1)
            self.drop("changes", base)

    def drop(self, name: str, until: int) -> None:
        """Delete the folders of versions up to ``until``; a driver call each, few between two merges."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(folder) if fs.exists(folder) else ():
            found = status.getPath().getName()
            if found.startswith("version=") and int(found.removeprefix("version=")) <= until:
                fs.delete(status.getPath(), True)

    def current(self) -> DataFrame:
        """The newest row of every key."""
        base = self.base_version()
        return self.newest(self.part("base").where(F.col("version") == base).union(self.since(base)).drop("version"))
