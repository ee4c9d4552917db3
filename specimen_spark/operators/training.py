"""Class counts, weights, class scores and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.fixed_values import FREQUENCY_BANDS
from specimen_spark.functions.species import frequency_band
from specimen_spark.functions.text import as_column


def class_counts(df: DataFrame, vocab: DataFrame, class_col: str = "species_id") -> DataFrame:
    """``species_id, class_count`` for the whole vocabulary, zeros kept."""
    counts = df.groupBy(F.col(class_col).alias("species_id")).agg(F.count(F.lit(1)).alias("n"))
    return vocab.join(counts, "species_id", "left").select(
        *vocab.columns, F.coalesce("n", F.lit(0).cast("bigint")).alias("class_count")
    )


def class_balance(df: DataFrame, class_col: str = "species_id") -> DataFrame:
    """Rows, classes, smallest and largest class."""
    counts = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.coalesce(F.sum("n"), zero).alias("rows"), F.count(F.lit(1)).alias("species"),
        F.coalesce(F.min("n"), zero).alias("class_count_min"), F.coalesce(F.max("n"), zero).alias("class_count_max"),
    )


def _raw_weight(count: Column, strategy: str, beta: float) -> Column:
    n = F.greatest(count.cast("double"), F.lit(1.0))
    kind = strategy.strip().lower()
    if kind in ("", "none", "off"):
        return F.lit(1.0)
    if kind == "inverse_freq":
        return F.lit(1.0) / n
    if kind == "sqrt_inv":
        return F.lit(1.0) / F.sqrt(n)
    if kind == "effective_num":
        return F.lit(1.0 - beta) / (F.lit(1.0) - F.pow(F.lit(beta), n))
    raise ValueError(f"Unsupported class weighting strategy: {strategy}")


def class_weights(counts: DataFrame, strategy: str = "effective_num", beta: float = 0.9999) -> DataFrame:
    """Counts with ``weight``; the mean weight is 1."""
    weighted = counts.withColumn("__w", _raw_weight(F.col("class_count"), strategy, beta))
    mean = weighted.agg(F.avg("__w").alias("m")).scalar()
    return weighted.withColumn("weight", F.col("__w") / mean).drop("__w")


def active_strategy(strategy, epoch, drw_start_epoch: int = 0) -> Column:
    """Weighting in force at an epoch: none before the deferred start."""
    strategy, epoch = F.lit(strategy) if isinstance(strategy, str) else strategy, as_column(epoch)
    off = F.lower(F.trim(strategy)).isin("", "none", "off")
    return F.when(off | (F.lit(drw_start_epoch > 0) & (epoch < drw_start_epoch)), F.lit("none")).otherwise(strategy)


def ldam_margins(counts: DataFrame, max_margin: float = 0.5) -> DataFrame:
    """Counts with ``margin``: count to the power -1/4, the largest scaled to ``max_margin``."""
    raw = F.pow(F.greatest(F.col("class_count").cast("double"), F.lit(1.0)), F.lit(-0.25))
    largest = counts.agg(F.max(raw).alias("m")).scalar()
    return counts.withColumn("margin", raw * (F.lit(max_margin) / largest))


def _score_order(example: str) -> Window:
    return Window.partitionBy(example).orderBy(F.desc("logit"), "species_id")


def species_mixture(
    scores: DataFrame, temperature: float = 1.0, top_k: int = 0, example: str = "example_id"
) -> DataFrame:
    """Softmax per example over its ``top_k`` best classes (0 = all); others get probability 0."""
    scaled = scores.withColumn("__z", F.col("logit") / F.lit(max(float(temperature), 1.0e-4)))
    ranked = scaled.withColumn("__rank", F.row_number().over(_score_order(example)))
    every = Window.partitionBy(example)
    shifted = F.exp(F.col("__z") - F.max("__z").over(every))
    inside = F.lit(True) if top_k <= 0 else F.col("__rank") <= top_k
    weighted = ranked.withColumn("__e", F.when(inside, shifted).otherwise(F.lit(0.0)))
    return weighted.withColumn("probability", F.col("__e") / F.sum("__e").over(every)).drop("__z", "__rank", "__e")


def top_species(
    probabilities: DataFrame, vocab: DataFrame, k: int, example: str = "example_id"
) -> DataFrame:
    """``example, rank, species_id, species, probability`` of the best ``k`` classes."""
    order = Window.partitionBy(example).orderBy(F.desc("probability"), "species_id")
    best = probabilities.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(vocab.select("species_id", "species"), "species_id", "left")
    return named.select(
        example, "rank", "species_id", F.coalesce("species", F.col("species_id").cast("string")).alias("species"),
        "probability",
    )


def example_results(
    scores: DataFrame, class_table: DataFrame | None = None, scale: float = 1.0, example: str = "example_id"
) -> DataFrame:
    """Per example: target, prediction, rank of the target, loss and loss weight.

    ``class_table`` brings ``margin`` and ``weight`` per class; without it the
    loss is plain cross entropy.
    """
    rows = scores
    if class_table is None:
        rows = rows.withColumn("margin", F.lit(0.0)).withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(class_table.select("species_id", "margin", "weight"), "species_id", "left")
    own = F.col("species_id") == F.col("target")
    rows = rows.select(
        example, "target", "species_id", "logit",
        (F.lit(scale) * (F.col("logit") - F.when(own, F.col("margin")).otherwise(F.lit(0.0)))).alias("__z"),
        F.when(own, F.col("weight")).alias("__w"),
        own.alias("__own"),
    )
    every = Window.partitionBy(example)
    rows = rows.withColumn("__rank", F.row_number().over(_score_order(example))).withColumn(
        "__max", F.max("__z").over(every)
    )
    return rows.groupBy(example).agg(
        F.first("target").alias("target"),
        F.max(F.when(F.col("__rank") == 1, F.col("species_id"))).alias("prediction"),
        F.max(F.when(F.col("__own"), F.col("__rank"))).alias("target_rank"),
        (F.max("__max") + F.log(F.sum(F.exp(F.col("__z") - F.col("__max"))))
         - F.max(F.when(F.col("__own"), F.col("__z")))).alias("loss"),
        F.max("__w").alias("weight"),
    )


def evaluate(
    scores: DataFrame, class_table: DataFrame | None = None, scale: float = 1.0, example: str = "example_id"
) -> DataFrame:
    """One row: weighted mean loss, top-1, top-5 and macro-F1."""
    results = example_results(scores, class_table, scale, example)
    overall = results.agg(
        (F.sum(F.col("loss") * F.col("weight")) / F.sum("weight")).alias("loss"),
        F.avg((F.col("target_rank") <= 1).cast("double")).alias("top1"),
        F.avg((F.col("target_rank") <= 5).cast("double")).alias("top5"),
    )
    hit = (F.col("target") == F.col("prediction")).cast("int")
    sides = results.select(F.explode(F.array(
        F.struct(F.col("target").alias("label"), F.lit(1).alias("true"), F.lit(0).alias("said"), hit.alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).alias("true"), F.lit(1).alias("said"),
                 F.lit(0).alias("hit")),
    )).alias("s")).select("s.*")
    per_label = sides.groupBy("label").agg(F.sum("true").alias("t"), F.sum("said").alias("p"), F.sum("hit").alias("h"))
    f1 = per_label.agg(F.avg(F.lit(2.0) * F.col("h") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    return overall.select("*", f1.scalar().alias("macro_f1"))


def per_species_metrics(preds: DataFrame, train_counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Recall, evaluation rows, training rows and band of each evaluated class."""
    recall = preds.groupBy(F.col("target").alias("species_id")).agg(
        F.count(F.lit(1)).alias("eval_rows"),
        F.avg((F.col("target") == F.col("prediction")).cast("double")).alias("recall"),
    )
    joined = recall.join(train_counts.select("species_id", "class_count"), "species_id", "left").join(
        vocab.select("species_id", "species"), "species_id", "left"
    )
    rows = F.coalesce("class_count", F.lit(0).cast("bigint"))
    return joined.select(
        F.coalesce("species", F.col("species_id").cast("string")).alias("species"), "species_id", "eval_rows",
        "recall", rows.alias("train_rows"), frequency_band(rows).alias("frequency_band"),
    )


def band_summary(per_species: DataFrame) -> DataFrame:
    """Species, rows and mean recall of all four bands."""
    spark = per_species.sparkSession
    bands = spark.range(1).select(F.explode(F.array(*[F.lit(b) for b, _ in FREQUENCY_BANDS])).alias("frequency_band"))
    found = per_species.groupBy("frequency_band").agg(
        F.count(F.lit(1)).alias("species"), F.sum("eval_rows").alias("rows"), F.avg("recall").alias("mean_recall")
    )
    zero = F.lit(0).cast("bigint")
    return bands.join(found, "frequency_band", "left").select(
        "frequency_band", F.coalesce("species", zero).alias("species"), F.coalesce("rows", zero).alias("rows"),
        F.coalesce("mean_recall", F.lit(0.0)).alias("mean_recall"),
    )


def best_epoch(
    log: DataFrame, run_cols, metric: str, epoch: str = "epoch", mode: str = "max", ties: str = "earliest"
) -> DataFrame:
    """Best epoch of each run; ``ties`` decides between equal values."""
    value = F.col(metric) if mode == "max" else -F.col(metric)
    when = -F.col(epoch) if ties == "earliest" else F.col(epoch)
    usable = log.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    return usable.groupBy(*run_cols).agg(
        F.max_by(F.struct(F.col(epoch).alias("best_epoch"), F.col(metric).alias("best_value")),
                 F.struct(value.alias("v"), when.alias("e"))).alias("__b")
    ).select(*run_cols, "__b.best_epoch", "__b.best_value")
