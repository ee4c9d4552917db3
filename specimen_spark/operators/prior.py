"""Location-to-species prior as a Spark ML model."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.functions.geo import fourier_features, normalize_latlon
from specimen_spark.operators.keyed import attach
from specimen_spark.operators.training import class_counts, class_weights


def location_features(df: DataFrame, n_freq: int = 4, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Rows with the ``features`` vector of their scaled coordinates."""
    point = normalize_latlon(F.col(lat), F.col(lon))
    scaled = df.withColumn("__p", point)
    return scaled.withColumn(
        "features", array_to_vector(F.concat(
            F.array(F.col("__p.lat_norm"), F.col("__p.lon_norm")),
            fourier_features("__p.lat_norm", "__p.lon_norm", n_freq),
        ))
    ).drop("__p")


def fit_prior(
    train: DataFrame, vocab: DataFrame, n_freq: int = 4, strategy: str = "effective_num",
    max_iter: int = 30, reg: float = 1e-4,
):
    """Multinomial logistic regression on location features with class weights."""
    weights = class_weights(class_counts(train, vocab), strategy)
    lookup = weights.select("species_id", F.col("weight").alias("__weight"))
    rows = attach(train, lookup, ["species_id"], how="inner")
    featured = location_features(rows, n_freq).select("features", F.col("species_id").cast("double").alias("label"),
                                                      "__weight")
    learner = LogisticRegression(
        featuresCol="features", labelCol="label", weightCol="__weight", family="multinomial", maxIter=max_iter,
        regParam=reg,
    )
    return learner.fit(featured)


def score_prior(model, df: DataFrame, id_cols, n_freq: int = 4, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Long form ``ids, species_id, logit, probability``."""
    scored = model.transform(location_features(df, n_freq, lat, lon))
    pairs = F.arrays_zip(vector_to_array("rawPrediction").alias("logit"), vector_to_array("probability").alias("probability"))
    return scored.select(*id_cols, F.posexplode(pairs).alias("species_id", "s")).select(
        *id_cols, "species_id", F.col("s.logit").alias("logit"), F.col("s.probability").alias("probability")
    )
