"""End-to-end jobs, the fallback join, one-pass summaries, clustered writes and the location prior on small fixtures."""

import json
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from specimen_spark.operators import images, joins, keyed, prior, processed, training
from specimen_spark.plans import summaries, workflows
from specimen_spark.sources import manifest, vocab
from specimen_spark.streaming import ingest

STRICT = "sid int, specimen_key string, source string, record_id string, image_url string, image_path string"
DONE = "n int, specimen_key string, source string, record_id string, image_url string, processed_image_path string, " \
       "processed_image_absolute_path string, preprocess_status string, keep_for_training string, fill_ratio double"


def squeeze(text):
    return " ".join((text or "").split())


def plain_keys(specimen, source, record, url):
    found = [("specimen_key", squeeze(specimen), ""), ("record_id", squeeze(source), squeeze(record)), ("image_url", squeeze(url), "")]
    return [k for k in found if k[1]]


def test_fallback_join_matches_a_plain_loop(spark):
    """Blank and null keys, a hot key, equal measurements under many keys, later rows that fail a check."""
    rng = random.Random(5)
    pick = lambda *values: rng.choice(values)
    done = [(n, pick(None, "", "hot", f"k{n % 40}"), pick("gbif", " idigbio ", None), pick("", f"r{n % 25}"), pick(None, f"u{n % 30}", "hot"),
             pick(None, "", f"p{n % 7}"), pick("", f"/a/p{n % 7}", None), pick("ok", "ok", "rejected_view"), pick("True", "yes", "False", None),
             pick(None, 0.5, float(n % 3))) for n in range(400)]
    strict = [(i, pick(None, "hot", f"k{i % 60}"), pick("gbif", "idigbio", None), pick("", f"r{i % 50}"), pick(None, f"u{i % 60}"), f"i{i}") for i in range(300)]
    lookup = {}
    for row in done:
        for key in plain_keys(*row[1:5]):
            lookup[key] = row
    want = {}
    for i, *cells, _ in strict:
        hit = next((k for k in plain_keys(*cells) if k in lookup), None)
        if hit is None:
            want[i] = ("missing_processed_match", None, None)
            continue
        row = lookup[hit]
        outcome = ("missing_processed_image_path" if not squeeze(row[6]) else "processed_keep_false" if row[8] not in ("True", "yes")
                   else "processed_preprocess_not_ok" if row[7] != "ok" else "matched_rows")
        want[i] = (outcome, hit[0], row[9])
    got = joins.fallback_join(spark.createDataFrame(strict, STRICT), spark.createDataFrame(done, DONE), ["n"], ["sid"])
    assert {r.sid: (r.outcome, r.match_key, r.fill_ratio) for r in got.collect()} == want and got.count() == len(strict)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan


def test_fallback_join_of_ties_nulls_and_empty_tables(spark):
    strict = spark.createDataFrame([(1, "a", "", "", "", ""), (2, "b", "", "", "", "")], STRICT)
    # Equal orders with values in different columns, a null order, and a row repeated throughout.
    rows = [(1, "a", "", "", "", "x", None, "ok", "True", 1.0), (1, "a", "", "", "", None, "x", "ok", "True", 1.0),
            (None, "b", "", "", "", "q", "/q", "ok", "True", 3.0), (None, "b", "", "", "", "q", "/q", "ok", "True", 3.0)]
    done = spark.createDataFrame(rows, DONE)
    got = joins.fallback_join(strict, done, ["n"], ["sid"]).orderBy("sid").collect()
    assert [(r.sid, r.fill_ratio) for r in got] == [(1, 1.0), (2, 3.0)] and got[1].outcome == "matched_rows"
    assert got[0].processed_image_path == "x"
    empty = joins.fallback_join(strict, done.where("false"), ["n"], ["sid"])
    assert [r.outcome for r in empty.collect()] == ["missing_processed_match"] * 2
    assert joins.fallback_join(strict.where("false"), done, ["n"], ["sid"]).count() == 0


def test_fallback_join_with_every_row_of_a_shared_row_number(spark):
    """As the reference SQL joins: all rows with the number that won count, also those under other keys."""
    strict = spark.createDataFrame([(1, "a", "", "", "", ""), (2, "b", "", "", "", ""), (3, "c", "", "", "", "")], STRICT)
    rows = [(4, "a", "", "", "", "x", "/x", "ok", "True", 1.0), (5, "a", "", "", "", "y", "/y", "ok", "True", 2.0),
            (5, "z", "", "", "", "", "", "ok", "True", 3.0), (6, "b", "", "", "", "q", "/q", "ok", "False", 4.0)]
    got = joins.fallback_join(strict, spark.createDataFrame(rows, DONE), ["n"], ["sid"], every_last=True).collect()
    assert sorted((r.sid, r.outcome, r.fill_ratio or 0.0) for r in got) == [
        (1, "matched_rows", 2.0), (1, "missing_processed_image_path", 3.0), (2, "processed_keep_false", 4.0),
        (3, "missing_processed_match", 0.0)]


def test_rows_that_differ_in_the_place_of_a_null_leave_one_winner(spark):
    rows = [("k", 1, None, "x"), ("k", 1, "x", None), ("k", 1, "x", "x")]
    assert keyed.winning_rows(spark.createDataFrame(rows, "k string, o int, a string, b string"), ["k"], ["o"]).count() == 1


def judged_rows(spark, rows):
    return spark.createDataFrame(rows, "i int, reject_reason string, species string, us_region string, source string")


def test_one_pass_summary_equals_counting_apart(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, None, None, "bad", "worse"]), rng.choice(["a a", "b b", "c c", "d d", None]), rng.choice(["west", None]),
             rng.choice(["gbif", "idigbio"])) for i in range(500)]
    good = [r for r in rows if r[1] is None]
    species = Counter(r[2] for r in good)
    first = {s: min(r[0] for r in good if r[2] == s) for s in species}
    top = sorted(species, key=lambda s: (-species[s], first[s]))[:2]
    want = {("totals", "cleaned_rows"): len(good), ("totals", "rejected_rows"): len(rows) - len(good),
            ("totals", "unique_species"): len([s for s in species if s is not None])}
    want |= {("rejection_counts", k): n for k, n in Counter(r[1] for r in rows if r[1]).items()}
    want |= {("top_species", s): species[s] for s in top}
    want |= {("rows_by_region", k): n for k, n in Counter(r[3] for r in good).items()}
    want |= {("rows_by_source", k): n for k, n in Counter(r[4] for r in good).items()}
    df = judged_rows(spark, rows)
    got = summaries.judged_summary(df, ["i"], 2)
    assert {(r.section, r.key): r.value for r in got.collect()} == want
    apart = summaries.cleaning_summary(df.where("reject_reason IS NULL"), df.where("reject_reason IS NOT NULL"), ["i"], 2)
    assert {(r.section, r.key): r.value for r in apart.collect()} == want
    none = {(r.section, r.key): r.value for r in summaries.judged_summary(df.where("false"), ["i"]).collect()}
    assert none == {("totals", k): 0.0 for k in ("cleaned_rows", "rejected_rows", "unique_species")}


def test_ingest_summary_of_no_rows_and_null_coordinates(spark):
    kind = "i int, source string, species string, is_species_level boolean, latitude double, longitude double"
    df = spark.createDataFrame([(1, "a", "x y", True, 3.0, None), (2, None, "", True, -1.0, None), (3, "a", "x y", None, None, None)], kind)
    got = {(r.section, r.key): r.value for r in summaries.ingest_summary(df, ["i"]).collect()}
    assert got == {("totals", "rows"): 3, ("totals", "rows_with_species_level_label"): 2, ("totals", "unique_species"): 1,
                   ("totals", "latitude_min"): -1, ("totals", "latitude_max"): 3, ("totals", "longitude_min"): None,
                   ("totals", "longitude_max"): None, ("by_source", "a"): 2, ("by_source", None): 1, ("top_species", "x y"): 1}
    none = {r.key: r.value for r in summaries.ingest_summary(df.where("false"), ["i"]).collect()}
    assert none == {"rows": 0, "rows_with_species_level_label": 0, "unique_species": 0, **{f"{c}itude_{m}": None for c in ("lat", "long") for m in ("min", "max")}}


def test_partitioned_writes_are_clustered_and_hot_values_split(spark, tmp_path):
    rows = spark.range(0, 60_000, 1, 12).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.concat(F.lit("v"), F.col("id") % 5)).alias("split"),
        F.sha2(F.col("id").cast("string"), 256).alias("text"))
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "256k", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        manifest.write_manifest(rows, f"{tmp_path}/m", partition_by="split")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = {p.name: len(list(p.glob("*.parquet"))) for p in (tmp_path / "m").iterdir() if p.is_dir()}
    assert files["split=hot"] > 1 and all(files[f"split=v{i}"] <= 2 for i in range(5)), files
    back = spark.read.parquet(f"{tmp_path}/m")
    assert back.count() == 60_000 and back.where("split IS NULL").count() == 20_000


def raw(spark, n, source):
    rows = [(i, source, f"{source}{i % (n // 2)}", f"m{i}", "Limenitis", f"Limenitis {('archippus', 'arthemis', 'lorquini')[i % 3]}", str(30 + i % 15),
             str(-120 + i % 40), f"http://x/{i % (n - 3)}.jpg", "Nymphalidae") for i in range(n)]
    return spark.createDataFrame(rows, "i int, source string, record_id string, media_id string, genus string, scientific_name string, latitude string, "
                                 "longitude string, image_url string, family string")


def test_raw_manifests_to_splits(spark, tmp_path):
    out = workflows.raw_to_splits({"a": raw(spark, 60, "gbif"), "b": raw(spark, 40, "idigbio")}, ["i"], f"{tmp_path}/out")
    rows = out.collect()
    assert len({r.image_url for r in rows}) == len(rows) > 0
    assert len(rows) + spark.read.parquet(f"{tmp_path}/out/rejected").count() == len({f"http://x/{i % 57}.jpg" for i in range(60)})
    groups = {}
    for r in rows:
        groups.setdefault(r.specimen_key, set()).add(r.split)
    assert all(len(s) == 1 for s in groups.values()) and {r.split for r in rows} == {"train", "val", "test"}
    names = {r.species: r.species_id for r in spark.read.parquet(f"{tmp_path}/out/species").collect()}
    assert sorted(names.values()) == list(range(len(names))) and all(names[r.species] == r.species_id for r in rows)


def test_processed_images_to_dataset(spark):
    rows = [(i, "gbif", f"r{i % 30}", f"gbif:r{i % 30}", f"http://x/{i % 50}", f"p/{i}.jpg", "Limenitis archippus", "ok" if i % 4 else "rejected_view",
             "True", "heuristic_mask_foreground_component", "dorsal", "accepted", 0.9, 0.9, 0.6, 0.2, 1.2, 0.95 if i % 3 else 0.5) for i in range(120)]
    done = spark.createDataFrame(rows, "source_row_index bigint, source string, record_id string, specimen_key string, image_url string, processed_image_path string, "
                                 "species string, preprocess_status string, keep_for_training string, crop_method string, view_hint string, view_status string, "
                                 "mask_quality_score double, symmetry_score double, fill_ratio double, coverage_ratio double, horizontal_ratio double, "
                                 "wing_balance_ratio double").withColumn("processed_image_absolute_path", F.concat(F.lit("/abs/"), "processed_image_path"))
    out = workflows.assemble_images(done, ["source_row_index"], k=1)
    got = out.collect()
    assert got and len({r.specimen_key for r in got}) == len(got) and all(r.preprocess_status == "ok" for r in got)
    assert all(r.source_row_index < 50 for r in got)  # the first row of a URL stays
    strict = done.select(F.col("source_row_index").alias("sid"), "specimen_key", "source", "record_id", "image_url", F.lit("").alias("image_path"),
                         "species", F.lit(40.0).alias("latitude"), F.lit(-100.0).alias("longitude"), F.lit("train").alias("split"))
    joined = joins.matched(joins.fallback_join(strict, done, ["source_row_index"], ["sid"]))
    kept = workflows.coordinate_dataset(strict, done, ["source_row_index"], ["sid"])
    assert 0 < kept.count() <= joined.count() < strict.count()


def test_species_report(spark):
    scores = spark.createDataFrame(
        [(1, 0, 1.0), (1, 1, 3.0), (1, 2, 2.0), (2, 0, 5.0), (2, 1, 0.0), (2, 2, 0.0)], "example_id int, species_id int, logit double")
    names = spark.createDataFrame([("s0", 0), ("s1", 1)], "species string, species_id int")
    got = workflows.species_report(scores, names, 2, temperature=0.5).orderBy("example_id", "rank").collect()
    assert [(r.example_id, r.rank, r.species) for r in got] == [(1, 1, "s1"), (1, 2, "2"), (2, 1, "s0"), (2, 2, "s1")]
    assert math.isclose(got[0].probability, 1 / (1 + math.exp(-2) + math.exp(-4)))


def test_location_prior_beats_the_class_prior_and_a_plain_fit_agrees(spark):
    rng = np.random.default_rng(4)
    lat = np.concatenate([rng.normal(30, 2, 150), rng.normal(45, 2, 90), rng.normal(38, 2, 60)])
    lon = np.concatenate([rng.normal(-110, 3, 150), rng.normal(-75, 3, 90), rng.normal(-95, 3, 60)])
    y = np.repeat([0, 1, 2], [150, 90, 60])
    df = spark.createDataFrame([(i, float(a), float(o), int(s)) for i, (a, o, s) in enumerate(zip(lat, lon, y))], "i int, latitude double, longitude double, species_id int")
    names = spark.createDataFrame([(f"s{i}", i) for i in range(3)], "species string, species_id int")
    model = prior.fit_prior(df, names, n_freq=2, max_iter=200, reg=0.01)
    rows = prior.score_prior(model, df.withColumn("target", F.col("species_id")).drop("species_id"), ["i", "target"], 2).collect()
    probs = np.zeros((len(y), 3))
    for r in rows:
        probs[r.i, r.species_id] = r.probability
    assert len(rows) == 3 * len(y) and np.allclose(probs.sum(axis=1), 1)
    share = np.bincount(y) / len(y)
    loss = -np.log(probs[np.arange(len(y)), y]).mean()
    assert loss < 0.5 * -(share * np.log(share)).sum() and (probs.argmax(axis=1) == y).mean() > 0.95
    # The same objective by plain gradient descent: weighted mean loss with the penalty on standardised features.
    x = np.array([r.features.toArray() for r in prior.location_features(df, 2).orderBy("i").collect()])
    weight = {r.species_id: r.weight for r in training.class_weights(training.class_counts(df, names), "effective_num").collect()}
    w = np.array([weight[s] for s in y])
    w = w / w.sum()
    spread = np.sqrt(np.average((x - np.average(x, axis=0, weights=w)) ** 2, axis=0, weights=w) * len(y) / (len(y) - 1))
    z = x / np.where(spread > 0, spread, 1)
    z = z - np.average(z, axis=0, weights=w)
    b, c = np.zeros((3, z.shape[1])), np.zeros(3)
    for _ in range(20_000):
        e = np.exp(z @ b.T + c)
        p = e / e.sum(axis=1, keepdims=True)
        d = (p - np.eye(3)[y]) * w[:, None]
        b, c = b - 0.3 * (d.T @ z + 0.01 * b), c - 0.3 * d.sum(axis=0)
    assert np.abs(p - probs).max() < 0.02, np.abs(p - probs).max()


def test_bounded_stream_dedupe_keeps_late_repeats_and_survives_restarts(spark, tmp_path):
    """A repeat within the delay goes, also after a restart; state older than the watermark is evicted."""
    src, base = f"{tmp_path}/in", str(tmp_path)

    def run(rows):
        spark.createDataFrame(rows, "image_url string, at string").select("image_url", F.to_timestamp("at").alias("at")).coalesce(1).write.mode("append").parquet(src)
        stream = ingest.landing_stream(spark, src, "image_url string, at timestamp", max_files=1)
        unique = ingest.stream_dedupe(stream, "at", "1 hour")
        query = unique.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp").trigger(availableNow=True).start()
        query.awaitTermination()
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return sorted(r.image_url for r in spark.read.schema("image_url string").parquet(f"{base}/out").collect()), state

    got, _ = run([("u1", "2024-01-01 00:00:00"), ("u1", "2024-01-01 00:10:00"), ("u2", "2024-01-01 00:20:00"), ("", "2024-01-01 00:20:00")])
    assert got == ["u1", "u2"]
    got, _ = run([("u1", "2024-01-01 00:30:00"), ("u3", "2024-01-01 05:00:00")])
    assert got == ["u1", "u2", "u3"]
    got, state = run([("u2", "2024-01-01 05:10:00"), ("u4", "2024-01-01 00:00:00")])
    assert "u4" not in got, "rows behind the watermark are late"
    assert got.count("u2") == 2 and state <= 2, "the repeat came after its state was evicted"


def test_cache_vocab_and_path_reports(spark, tmp_path):
    source = spark.range(3)
    cache = spark.createDataFrame([(0, [1.0], "x"), (1, None, "x"), (2, [2.0], "x")], "id int, f array<double>, g string")
    row = images.check_cache(source, cache, ["f", "g"]).first()
    assert (row.source_rows, row.cached_rows, row.incomplete_rows, row.complete) == (3, 3, 1, False)
    assert images.check_cache(source, cache.where("f IS NOT NULL").union(cache.where("id = 0")), ["f"]).first().complete
    (tmp_path / "v.json").write_text(json.dumps({"a b": 0, "ü": 1}), encoding="utf-8")
    assert {r.species: r.species_id for r in vocab.read_vocab(spark, f"{tmp_path}/v.json").collect()} == {"a b": 0, "ü": 1}
    resolved = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate([("/a", True), ("/b", False), ("", False), (None, False)])], "i int, resolved_path string, resolved_path_exists boolean")
    shown = summaries.missing_path_examples(resolved, ["i"], n=2).collect()
    assert [(r.i, r.path) for r in shown] == [(1, "/b"), (2, "<missing-path-column>")]
    named = spark.createDataFrame([("/abs/x.jpg", "x.jpg", 1)], "processed_image_path string, name string, kept int")
    out = processed.materialized_manifest(named, "name", "/data/set/").first()
    assert (out.processed_image_path, out.processed_image_absolute_path, out.original_processed_image_path, out.kept) == (
        "images/x.jpg", "/data/set/images/x.jpg", "/abs/x.jpg", 1)
