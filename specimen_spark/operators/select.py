"""Vector similarity and greedy diverse selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.text import as_column
from specimen_spark.operators.keyed import attach


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalize(c) -> Column:
    """Vector divided by its length; lengths below 1e-12 count as 1e-12."""
    vector = as_column(c)
    length = F.greatest(F.sqrt(_dot(vector, vector)), F.lit(1e-12))
    return F.transform(vector, lambda x: x.cast("double") / length)


def cosine(a, b) -> Column:
    a, b = as_column(a), as_column(b)
    return _dot(a, b) / (
        F.greatest(F.sqrt(_dot(a, a)), F.lit(1e-12)) * F.greatest(F.sqrt(_dot(b, b)), F.lit(1e-12))
    )


def diverse_select(
    df: DataFrame, request_col: str, candidate_col: str, k: int, diversity_weight: float = 0.35,
    min_quality: float = 0.0, min_luminance: float = 0.0, quality: str = "quality_score",
    luminance: str = "foreground_luminance", embedding: str = "embedding",
) -> DataFrame:
    """``request, pick, candidate``: ``k`` greedy picks per request.

    A pick maximises quality minus ``diversity_weight`` times the largest
    cosine to the picks so far minus a penalty for dark images. Candidates
    above both thresholds are preferred when there are at least ``k`` of them.

    Each round is one aggregate over all requests at once. What a round knows
    of the earlier ones is one small row per request, so no request is ever
    gathered in one task.
    """
    dark = F.greatest(F.lit(min_luminance) - F.col(luminance), F.lit(0.0))
    penalty = dark * 0.08 / F.lit(max(min_luminance, 1.0e-6))
    pool = df.select(
        F.col(request_col).alias("__r"), F.col(candidate_col).alias("__c"), F.col(quality).alias("__q"),
        (F.col(quality) - penalty).alias("__value"), l2_normalize(embedding).alias("__v"),
        ((F.col(quality) >= min_quality) & (F.col(luminance) >= min_luminance)).alias("__ok"),
    )
    state = pool.groupBy("__r").agg(
        F.sum(F.col("__ok").cast("int")).alias("__good")
    )
    state = state.select(
        "__r", (F.col("__good") >= k).alias("__strict"),
        F.array().cast("array<struct<c:string,v:array<double>>>").alias("__picks"),
    )
    for _ in range(k):
        open_ = attach(pool, state, ["__r"], how="inner")
        unseen = ~F.exists("__picks", lambda p: p["c"] == F.col("__c").cast("string"))
        closest = F.array_max(F.transform("__picks", lambda p: _dot(p["v"], F.col("__v"))))
        objective = F.col("__value") - F.coalesce(F.lit(diversity_weight) * closest, F.lit(0.0))
        usable = unseen & (F.col("__ok") | ~F.col("__strict"))
        # Equal objectives: higher quality first, then the smaller candidate id.
        chosen = open_.groupBy("__r").agg(
            F.first("__strict").alias("__strict"),
            F.first("__picks").alias("__picks"),
            F.max_by(
                F.when(usable, F.struct(F.col("__c").cast("string").alias("c"), F.col("__v").alias("v"))),
                F.when(usable, F.struct(objective.alias("o"), F.col("__q"), -F.col("__c"))),
            ).alias("__new"),
        )
        state = chosen.select(
            "__r", "__strict",
            F.when(F.col("__new").isNull(), F.col("__picks"))
            .otherwise(F.array_append("__picks", F.col("__new"))).alias("__picks"),
        )
    kind = dict(df.dtypes)[candidate_col]
    return state.select(F.col("__r").alias(request_col), F.posexplode("__picks").alias("__i", "__p")).select(
        request_col, (F.col("__i") + 1).alias("pick"), F.col("__p.c").cast(kind).alias(candidate_col)
    )
