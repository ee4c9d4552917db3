"""Manifests and summaries on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specimen_spark.schemas import RAW_SCHEMA, validate_required
from specimen_spark.sources.csv_ranges import read_records


def manifest_files(spark: SparkSession, paths) -> list[str]:
    """The files that paths, folders and globs name, each once, in the order of the paths."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found: dict[str, None] = {}

    def add(fs, status) -> None:
        path = status.getPath()
        if status.isDirectory():
            for inner in sorted(fs.listStatus(path), key=lambda s: s.getPath().getName()):
                if not inner.getPath().getName().startswith(("_", ".")):
                    add(fs, inner)
        else:
            found[path.toString()] = None

    for text in [paths] if isinstance(paths, str) else paths:
        path = jvm.org.apache.hadoop.fs.Path(text)
        fs = path.getFileSystem(conf)
        matches = fs.globStatus(path)
        if not matches:
            raise FileNotFoundError(text)
        for status in matches:
            add(fs, status)
    return list(found)


def _header(spark: SparkSession, file: str) -> str:
    """First line of a file."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8")).readLine() or ""
    finally:
        stream.close()


def read_manifest(
    spark: SparkSession, paths, required=(), max_rows: int | None = None, columns=None, order_cols=(),
    multi_line: bool = True, mode: str = "PERMISSIVE", split: bool = False,
) -> DataFrame:
    """CSV manifests as text columns; quotes, embedded newlines and globs are understood.

    A file is read once, however often it is named; files are grouped by
    header line and the groups joined by column name. Blank and absent cells
    come back as ''. ``max_rows`` takes the first rows by ``order_cols``.
    Large files are split between tasks without ``multi_line``, or with
    ``split``, which finds record borders by the parity of quotes (cells that
    hold a quote have to be quoted, lines end with a line feed). ``mode`` says
    what becomes of malformed rows (``FAILFAST`` raises).
    """
    if max_rows is not None and not order_cols:
        raise ValueError("max_rows needs order_cols")
    by_header: dict[str, list[str]] = {}
    for file in manifest_files(spark, paths):
        by_header.setdefault(_header(spark, file), []).append(file)
    options = {"quote": '"', "escape": '"', "nullValue": "\u0000", "emptyValue": "", "mode": mode}
    reader = spark.read.options(header=True, multiLine=multi_line, **options)
    groups = [(reader.csv(files), files) for files in by_header.values()]
    df = union_manifests([read_records(spark, files, whole.columns, options) if split else whole for whole, files in groups])
    df = df.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in df.columns])
    validate_required(df, required)
    if columns:
        df = df.select(*columns)
    return df.orderBy(*order_cols).limit(max_rows) if max_rows is not None else df


def read_raw_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Raw manifest kept as Parquet, with absent columns filled by null."""
    df = spark.read.parquet(path)
    missing = [f for f in RAW_SCHEMA.fields if f.name not in df.columns]
    return df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])


def public_columns(df: DataFrame) -> list[str]:
    """Columns without the leading underscore of working columns."""
    return [c for c in df.columns if not c.startswith("_")]


def write_manifest(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None, mode: str = "overwrite") -> None:
    """Store a manifest; several inputs are united by column name beforehand.

    With ``partition_by`` rows are gathered by those columns before the write, so a value has few files and not one a
    task; adaptive execution splits the values that fill more than ``spark.sql.adaptive.advisoryPartitionSizeInBytes``
    and joins small ones. Values that share a shuffle partition with such a hot value are split with it. Null is a value.
    """
    out = df.select(*public_columns(df))
    if fmt == "csv":
        text = [
            F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map"))
            else F.initcap(F.col(c).cast("string")).alias(c) if kind == "boolean" else F.col(c)
            for c, kind in out.dtypes
        ]
        out = out.select(*text)
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or ())
    if parts:
        out = out.hint("rebalance", *[F.col(c) for c in parts])
    writer = out.write.mode(mode)
    if parts:
        writer = writer.partitionBy(*parts)
    if fmt == "csv":
        writer.options(
            header=True, quote=chr(34), escape=chr(34), emptyValue="", ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        ).csv(path)
    else:
        writer.format(fmt).save(path)


def union_manifests(dfs) -> DataFrame:
    """Union by name over the ordered union of all columns."""
    merged = dfs[0]
    for other in dfs[1:]:
        merged = merged.unionByName(other, allowMissingColumns=True)
    return merged


def write_summary(df: DataFrame, path: str) -> None:
    """Store a summary frame as JSON lines."""
    df.write.mode("overwrite").json(path)
