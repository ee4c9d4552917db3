"""Queries of class weights, scores, evaluation and vectors."""

from pyspark.sql import functions as F

from specimen_spark.catalog.registry import query
from specimen_spark.catalog.views import view
from specimen_spark.operators import joins, select, training
from specimen_spark.plans import summaries


def _vocab(spark, sf):
    """Names of the score classes, from the scores themselves."""
    ids = view(spark, sf, "scores").select("species_id").distinct()
    return ids.withColumn("species", F.concat(F.lit("name_"), F.col("species_id").cast("string")))


def _targets(spark, sf):
    return view(spark, sf, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("label").alias("species_id"))


def _counts(spark, sf):
    return training.class_counts(_targets(spark, sf), _vocab(spark, sf))


_COUNTS = """vocab AS (SELECT DISTINCT species_id, 'name_' || species_id AS species FROM {scores}),
counts AS (SELECT v.species_id, species, count(e.vec_id) AS class_count FROM vocab v LEFT JOIN embeddings e ON e.label = v.species_id GROUP BY ALL)"""


@query("F9_class_counts", f"WITH {_COUNTS} SELECT species_id, species, class_count FROM counts")
def class_counts(spark, sf):
    return _counts(spark, sf)


@query("F9_class_balance", """SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS species, min(n) AS class_count_min, max(n) AS class_count_max
FROM (SELECT p_name, count(*) AS n FROM part GROUP BY p_name) t""")
def class_balance(spark, sf):
    return training.class_balance(view(spark, sf, "part"), "p_name")


_WEIGHTS = f"""{_COUNTS}, raw AS (SELECT *, 1.0 / greatest(class_count, 1) AS w1, 1.0 / sqrt(greatest(class_count, 1)) AS w2,
  (1.0::DOUBLE - 0.9999::DOUBLE) / (1.0::DOUBLE - pow(0.9999::DOUBLE, greatest(class_count, 1))) AS w3, pow(greatest(class_count, 1), -0.25::DOUBLE) AS m FROM counts),
weights AS (SELECT *, w1 / (SELECT avg(w1) FROM raw) AS inverse_freq, w2 / (SELECT avg(w2) FROM raw) AS sqrt_inv,
  w3 / (SELECT avg(w3) FROM raw) AS effective_num, m * (0.5::DOUBLE / (SELECT max(m) FROM raw)) AS margin FROM raw)"""


@query("F10_class_weights", f"""WITH {_WEIGHTS} SELECT species_id, 1.0::DOUBLE AS none, round(inverse_freq, 6) AS inverse_freq, round(sqrt_inv, 6) AS sqrt_inv,
  round(effective_num, 6) AS effective_num FROM weights""")
def class_weights(spark, sf):
    out = _counts(spark, sf)
    for strategy in ("none", "inverse_freq", "sqrt_inv", "effective_num"):
        out = training.class_weights(out, strategy).withColumn(strategy, F.round("weight", 6)).drop("weight")
    return out.select("species_id", "none", "inverse_freq", "sqrt_inv", "effective_num")


@query("F10_active_strategy", "SELECT event_id, CASE WHEN event_id < 500 THEN 'none' ELSE 'sqrt_inv' END AS strategy FROM events")
def active_strategy(spark, sf):
    return view(spark, sf, "events").select(
        "event_id", training.active_strategy("sqrt_inv", "event_id", 500).alias("strategy"))


@query("F11_ldam_margins", f"WITH {_WEIGHTS} SELECT species_id, round(margin, 6) AS margin FROM weights")
def ldam_margins(spark, sf):
    return training.ldam_margins(_counts(spark, sf)).select("species_id", F.round("margin", 6).alias("margin"))


_EXAMPLES = f"""{_WEIGHTS}, z AS (
  SELECT s.*, 30.0::DOUBLE * (logit - CASE WHEN s.species_id = target THEN margin ELSE 0.0 END) AS z, effective_num AS w,
    row_number() OVER (PARTITION BY example_id ORDER BY logit DESC, s.species_id) AS r
  FROM {{scores}} s JOIN weights k ON s.species_id = k.species_id),
top AS (SELECT example_id, max(z) AS m FROM z GROUP BY example_id),
examples AS (
  SELECT z.example_id, any_value(target) AS target, max(CASE WHEN r = 1 THEN species_id END) AS prediction,
    max(CASE WHEN species_id = target THEN r END) AS target_rank, max(CASE WHEN species_id = target THEN w END) AS w,
    any_value(m) + ln(sum(exp(z - m))) - max(CASE WHEN species_id = target THEN z END) AS loss
  FROM z JOIN top ON z.example_id = top.example_id GROUP BY z.example_id)"""


def _table(spark, sf):
    return training.ldam_margins(training.class_weights(_counts(spark, sf)))


@query("F17_evaluate", f"""WITH {_EXAMPLES}, sides AS (
  SELECT target AS label, 1 AS t, 0 AS p, CAST(target = prediction AS INT) AS h FROM examples UNION ALL SELECT prediction, 0, 1, 0 FROM examples),
labels AS (SELECT label, sum(t) AS t, sum(p) AS p, sum(h) AS h FROM sides GROUP BY label)
SELECT round(sum(loss * w) / sum(w), 6) AS loss, round(avg(CAST(target_rank <= 1 AS DOUBLE)), 6) AS top1,
  round(avg(CAST(target_rank <= 5 AS DOUBLE)), 6) AS top5, round((SELECT avg(2.0::DOUBLE * h / (t + p)) FROM labels), 6) AS macro_f1 FROM examples""")
def evaluate(spark, sf):
    result = training.evaluate(view(spark, sf, "scores"), _table(spark, sf), scale=30.0)
    return result.select(*[F.round(c, 6).alias(c) for c in result.columns])


_PER_SPECIES = f"""{_EXAMPLES}, per_species AS (
  SELECT e.target AS species_id, any_value(c.species) AS species, count(*) AS eval_rows, avg(CAST(target = prediction AS DOUBLE)) AS recall, any_value(c.class_count) AS train_rows
  FROM examples e JOIN counts c ON e.target = c.species_id GROUP BY e.target),
banded AS (SELECT *, CASE WHEN train_rows < 10 THEN 'rare' WHEN train_rows < 30 THEN 'tail' WHEN train_rows < 100 THEN 'medium' ELSE 'common' END AS frequency_band FROM per_species)"""


def _per_species(spark, sf):
    preds = training.example_results(view(spark, sf, "scores"), _table(spark, sf), 30.0)
    return training.per_species_metrics(preds, _counts(spark, sf), _vocab(spark, sf))


@query("F18_per_species_metrics", f"WITH {_PER_SPECIES} SELECT species, species_id, eval_rows, round(recall, 6) AS recall, train_rows, frequency_band FROM banded")
def per_species_metrics(spark, sf):
    return _per_species(spark, sf).withColumn("recall", F.round("recall", 6))


@query("F19_band_summary", f"""WITH {_PER_SPECIES}
SELECT b AS frequency_band, count(species) AS species, CAST(coalesce(sum(eval_rows), 0) AS BIGINT) AS rows, round(coalesce(avg(recall), 0.0), 6) AS mean_recall
FROM (SELECT unnest(['rare', 'tail', 'medium', 'common']) AS b) t LEFT JOIN banded ON b = frequency_band GROUP BY b""")
def band_summary(spark, sf):
    return training.band_summary(_per_species(spark, sf)).withColumn("mean_recall", F.round("mean_recall", 6))


_LABELS = """labels_in AS (
  SELECT source_row_index AS i, record_id, CASE WHEN source_row_index % 11 = 0 THEN '' ELSE species END AS species,
    CASE source_row_index % 7 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE CAST(source_row_index % 9 AS VARCHAR) END AS species_id,
    CASE WHEN source_row_index % 5 = 0 THEN 'nan' ELSE '40.5' END AS latitude FROM {processed_manifest}),
names AS (SELECT species, CAST(row_number() OVER (ORDER BY species) - 1 AS INT) AS species_id FROM (SELECT DISTINCT o_orderpriority AS species FROM orders
  UNION SELECT DISTINCT p_name FROM part WHERE p_partkey % 2 = 0) t),
flags AS (SELECT l.*, latitude = 'nan' AS bad_point, species = '' AS no_species, species <> '' AND species NOT IN (SELECT species FROM names) AS unknown,
  species_id IN ('', 'x') OR coalesce(try_cast(species_id AS INT), -1) NOT IN (SELECT species_id FROM names) AS bad_id FROM labels_in l)"""


def _labels(spark, sf):
    i = F.col("source_row_index")
    df = view(spark, sf, "processed_manifest").select(
        i, "record_id", F.when(i % 11 == 0, F.lit("")).otherwise(F.col("species")).alias("species"),
        F.when(i % 7 == 0, F.lit("")).when(i % 7 == 1, F.lit("x")).otherwise((i % 9).cast("string")).alias("species_id"),
        F.when(i % 5 == 0, F.lit("nan")).otherwise(F.lit("40.5")).alias("latitude"), F.lit("-100").alias("longitude"))
    names = view(spark, sf, "orders").select(F.col("o_orderpriority").alias("species")).union(
        view(spark, sf, "part").where("p_partkey % 2 = 0").select("p_name")).distinct()
    from specimen_spark.operators.keyed import bucketed_rank

    ranked = bucketed_rank(names.withColumn("lead", F.substring("species", 1, 3)), [], ["lead"], ["species"], "n")
    return df, ranked.select("species", (F.col("n") - 1).cast("int").alias("species_id"))


@query("D7_check_against_vocab", f"WITH {_LABELS} SELECT i AS source_row_index, unknown AS species_unknown, bad_id AS id_unknown FROM flags")
def check_against_vocab(spark, sf):
    df, vocab = _labels(spark, sf)
    return joins.check_against_vocab(df, vocab).select("source_row_index", "species_unknown", "id_unknown")


@query("F20_preflight_rows", f"""WITH {_LABELS} SELECT count(*) AS rows_checked, count(*) FILTER (WHERE bad_point) AS missing_coordinates,
  count(*) FILTER (WHERE no_species) AS missing_species, count(*) FILTER (WHERE unknown) AS unknown_species, count(*) FILTER (WHERE bad_id) AS invalid_species_ids FROM flags""")
def preflight_rows(spark, sf):
    df, vocab = _labels(spark, sf)
    return summaries.preflight_rows(df, vocab, ["source_row_index"])


@query("F20_preflight_examples", f"""WITH {_LABELS}, problems AS (
  SELECT i, 0 AS p, 'invalid_coordinates' AS reason, record_id AS value FROM flags WHERE bad_point UNION ALL SELECT i, 1, 'missing_species', record_id FROM flags WHERE no_species
  UNION ALL SELECT i, 2, 'unknown_species', species FROM flags WHERE unknown UNION ALL SELECT i, 3, 'invalid_species_id', species_id FROM flags WHERE bad_id)
SELECT i AS source_row_index, reason, value FROM problems ORDER BY i, p LIMIT 10""")
def preflight_examples(spark, sf):
    df, vocab = _labels(spark, sf)
    return summaries.preflight_examples(df, vocab, ["source_row_index"])


@query("F22_best_epoch", """SELECT occurrence_key, arg_max(event_id, (value, -event_id)) AS max_earliest, arg_min(event_id, (value, event_id)) AS min_earliest,
  arg_min(event_id, (value, -event_id)) AS min_latest, round(max(value), 6) AS best_value FROM {progress_log} GROUP BY occurrence_key""")
def best_epoch(spark, sf):
    log = view(spark, sf, "progress_log")
    parts = [
        training.best_epoch(log, ["occurrence_key"], "value", "event_id", mode, ties).select(
            "occurrence_key", F.col("best_epoch").alias(f"{mode}_{ties}"), F.round("best_value", 6).alias(f"v_{mode}_{ties}"))
        for mode, ties in (("max", "earliest"), ("min", "earliest"), ("min", "latest"))
    ]
    joined = parts[0].join(parts[1], "occurrence_key").join(parts[2], "occurrence_key")
    return joined.select("occurrence_key", "max_earliest", "min_earliest", "min_latest", F.col("v_max_earliest").alias("best_value"))


_MIX = """mixed AS (SELECT example_id, species_id, CASE WHEN r <= 4 THEN exp(logit / 0.7::DOUBLE - m) ELSE 0.0 END AS e FROM (
  SELECT *, row_number() OVER (PARTITION BY example_id ORDER BY logit DESC, species_id) AS r, max(logit / 0.7::DOUBLE) OVER (PARTITION BY example_id) AS m FROM {scores}) t),
probs AS (SELECT example_id, species_id, e / sum(e) OVER (PARTITION BY example_id) AS probability FROM mixed)"""


@query("G3_species_mixture", f"WITH {_MIX} SELECT example_id, species_id, round(probability, 6) AS probability FROM probs")
def species_mixture(spark, sf):
    mixed = training.species_mixture(view(spark, sf, "scores"), 0.7, 4)
    return mixed.select("example_id", "species_id", F.round("probability", 6).alias("probability"))


@query("G4_top_species", f"""WITH {_MIX} SELECT example_id, rank, species_id, CASE WHEN species_id = 3 THEN '3' ELSE 'name_' || species_id END AS species, round(probability, 6) AS probability
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY example_id ORDER BY probability DESC, species_id) AS INT) AS rank FROM probs) t WHERE rank <= 3""")
def top_species(spark, sf):
    mixed = training.species_mixture(view(spark, sf, "scores"), 0.7, 4)
    best = training.top_species(mixed, _vocab(spark, sf).where("species_id <> 3"), 3)
    return best.withColumn("probability", F.round("probability", 6))


@query("H7_l2_normalize", """WITH e AS (SELECT vec_id, k AS pos, CAST(embedding[k + 1] AS DOUBLE) AS v FROM embeddings, (SELECT CAST(range AS INT) AS k FROM range(64)) r)
SELECT vec_id, pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value FROM e""")
def l2_normalize(spark, sf):
    rows = view(spark, sf, "embeddings").select("vec_id", F.posexplode(select.l2_normalize("embedding")).alias("pos", "v"))
    return rows.select("vec_id", "pos", F.round("v", 6).alias("value"))


@query("H7_cosine", """SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf):
    a = view(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = view(spark, sf, "embeddings").select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(select.cosine("x", "y"), 6).alias("cosine"))


@query("H6_diverse_select")
def diverse_select(spark, sf):
    """Three diverse picks per class; checked against a direct loop in the tests."""
    pool = view(spark, sf, "embeddings").select(
        F.col("label").alias("request"), "vec_id", "embedding",
        ((F.col("vec_id") * 37 % 100) / 100.0).alias("quality_score"), ((F.col("vec_id") * 13 % 40) / 100.0).alias("foreground_luminance"))
    return select.diverse_select(pool, "request", "vec_id", 3, 0.35, 0.5, 0.1)


@query("K1_location_prior")
def location_prior(spark, sf):
    """Fit the prior on cleaned rows of the whole manifest and report its evaluation."""
    from specimen_spark.catalog.cleaning import ORDER, cleaned
    from specimen_spark.operators.cleaning import assign_species_ids
    from specimen_spark.operators.prior import fit_prior, score_prior
    from specimen_spark.session import cut_lineage

    clean = cut_lineage(cleaned(spark, sf)[0].select(*ORDER, "species", "latitude", "longitude"))
    labelled, vocab = assign_species_ids(clean)
    model = fit_prior(labelled, vocab, n_freq=3, max_iter=8)
    scores = score_prior(model, labelled.withColumn("target", F.col("species_id")).drop("species_id"), [*ORDER, "target"], 3)
    return training.evaluate(scores, example="row_idx")
