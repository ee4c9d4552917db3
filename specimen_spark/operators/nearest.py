"""Exact nearest record by planar degree distance, without comparing all pairs.

Records collapse to distinct sites, sites to a hierarchy of cells with tight
bounding boxes. Every query point keeps, level by level, only the cells that
can still hold its nearest site: those whose smallest possible distance is not
above the largest possible distance of the best cell. Both bounds are computed
with the same floating-point steps as the distance itself, so pruning is exact
including ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.fixed_values import NEAREST_FALLBACK_SPECIES, NEAREST_FALLBACK_URL
from specimen_spark.functions.geo import finite_pair
from specimen_spark.functions.numbers import number_column
from specimen_spark.functions.text import let
from specimen_spark.operators.keyed import attach, first_per_key, order_struct, stored
from specimen_spark.session import cut_lineage

# Cells per degree as powers of two, coarse to fine (16 degrees ... 1/4096 degree).
LEVELS = (-4, 0, 4, 8, 12)
_STEP = 4


def _cell(value: Column, low: float, high: float) -> Column:
    """Finest cell number; far-away values share the border cells."""
    inside = F.greatest(F.lit(low), F.least(F.lit(high), value))
    return F.floor(inside * F.lit(float(2 ** LEVELS[-1]))).cast("bigint")


def _bounds(cell: Column) -> tuple[Column, Column]:
    """Smallest and largest possible distance of the point (__lat, __lon) to a cell's box."""

    def axis(point, low, high):
        near = F.greatest(low - point, point - high, F.lit(0.0))
        far = F.greatest(F.abs(point - low), F.abs(high - point))
        return near, far

    near_y, far_y = axis(F.col("__lat"), cell["y_min"], cell["y_max"])
    near_x, far_x = axis(F.col("__lon"), cell["x_min"], cell["x_max"])
    return F.sqrt(near_y * near_y + near_x * near_x), F.sqrt(far_y * far_y + far_x * far_x)


def _prune(cells: Column) -> Column:
    """Cells of an array that may hold the nearest site, with their bounds."""

    def measure(c: Column) -> Column:
        near, far = _bounds(c)
        return F.struct(c["cy"].alias("cy"), c["cx"].alias("cx"), near.alias("near"), far.alias("far"))

    def keep(p: Column) -> Column:
        return F.filter(p["cells"], lambda c: c["near"] <= p["limit"])

    return let(F.transform(cells, measure), lambda all_: let(
        F.struct(all_.alias("cells"), F.array_min(F.transform(all_, lambda c: c["far"])).alias("limit")), keep))


def _cell_tables(sites: DataFrame) -> list[DataFrame]:
    """Per level the children of each cell; every array has at most 256 entries. Each level is stored and made from the one below."""
    box = [F.min("y_min").alias("y_min"), F.max("y_max").alias("y_max"),
           F.min("x_min").alias("x_min"), F.max("x_max").alias("x_max")]
    level = sites.select(
        "cy", "cx", F.col("__lat").alias("y_min"), F.col("__lat").alias("y_max"),
        F.col("__lon").alias("x_min"), F.col("__lon").alias("x_max"),
    ).groupBy("cy", "cx").agg(*box)
    tables = []
    for _ in LEVELS[1:]:
        parent = level.withColumn("py", F.shiftright("cy", _STEP)).withColumn("px", F.shiftright("cx", _STEP))
        children = F.collect_list(F.struct("cy", "cx", "y_min", "y_max", "x_min", "x_max")).alias("children")
        level_up = stored(parent.groupBy("py", "px").agg(*box, children))
        tables.append(level_up.select("py", "px", "children"))
        level = level_up.select(F.col("py").alias("cy"), F.col("px").alias("cx"), "y_min", "y_max", "x_min", "x_max")
    # The coarsest level has at most 12 x 24 cells: one bounded array.
    top = level.agg(F.collect_list(F.struct("cy", "cx", "y_min", "y_max", "x_min", "x_max")).alias("cells"))
    return [top, *reversed(tables)]


def nearest_record(
    points: DataFrame, records: DataFrame, order_cols, *, lat: str = "lat", lon: str = "lon",
    record_lat: str = "latitude", record_lon: str = "longitude", values=("species", "image_url"),
    fallback=(NEAREST_FALLBACK_SPECIES, NEAREST_FALLBACK_URL),
) -> DataFrame:
    """Points with ``distance`` and the ``values`` of their nearest record.

    The first record wins among equal distances; records without finite
    coordinates are skipped. A point with no record, or whose nearest record
    has a blank last value (the URL), gets ``fallback``.
    """
    values = list(values)
    located = records.select(
        number_column(records, record_lat).alias("__lat"), number_column(records, record_lon).alias("__lon"),
        *values, *[F.col(c) for c in order_cols if c not in values],
    ).where(finite_pair("__lat", "__lon"))
    sites = first_per_key(located, ["__lat", "__lon"], order_cols).withColumns({
        "cy": _cell(F.col("__lat"), -90.0, 90.0), "cx": _cell(F.col("__lon"), -180.0, 180.0)})
    sites = cut_lineage(sites)
    top, *tables = _cell_tables(sites)

    asked = points.select(F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon"))
    # Points are few bytes and much work, so they are spread by a fixed number of tasks, which is not reduced by their size.
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = asked.where(finite_pair("__lat", "__lon")).distinct().repartition(tasks)
    asked = asked.withColumn("cells", top.scalar())
    live = asked.select("__lat", "__lon", F.explode(_prune(F.col("cells"))).alias("c")).select(
        "__lat", "__lon", "c.cy", "c.cx")
    per_point = Window.partitionBy("__lat", "__lon")
    for i, table in enumerate(tables):
        keyed = live.select("__lat", "__lon", F.col("cy").alias("py"), F.col("cx").alias("px"))
        if i == 0:
            # At most 288 rows with 256 children each.
            opened = keyed.join(F.broadcast(table), ["py", "px"])
        else:
            opened = attach(keyed, table, ["py", "px"], how="inner")
        nearby = opened.select("__lat", "__lon", F.explode(_prune(F.col("children"))).alias("c"))
        best = nearby.select("__lat", "__lon", "c.*").withColumn("__best", F.min("far").over(per_point))
        live = best.where(F.col("near") <= F.col("__best")).select("__lat", "__lon", "cy", "cx")

    places = sites.select(
        "cy", "cx", F.col("__lat").alias("__y"), F.col("__lon").alias("__x"),
        F.struct(*values).alias("__value"), order_struct(order_cols).alias("__order"),
    )
    pairs = attach(live, places, ["cy", "cx"], how="inner")
    dy, dx = F.col("__lat") - F.col("__y"), F.col("__lon") - F.col("__x")
    found = pairs.withColumn("__distance", F.sqrt(dy * dy + dx * dx)).where(
        F.col("__distance") < F.lit(float("inf"))
    ).groupBy("__lat", "__lon").agg(
        F.min("__distance").alias("distance"),
        F.min_by("__value", F.struct("__distance", "__order")).alias("__value"),
    )
    keyed_points = points.select("*", F.col(lat).cast("double").alias("__lat"), F.col(lon).cast("double").alias("__lon"))
    joined = attach(keyed_points, found, ["__lat", "__lon"])
    unusable = F.coalesce(F.col(f"__value.{values[-1]}"), F.lit("")) == ""
    return joined.select(
        *points.columns, "distance",
        *[F.when(unusable, F.lit(spare)).otherwise(F.col(f"__value.{v}")).alias(v)
          for v, spare in zip(values, fallback)],
    )
