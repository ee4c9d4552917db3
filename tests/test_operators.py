"""Operators on small fixtures: semantics, skew, brute force."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from specimen_spark.operators import cleaning, dedupe, images, joins, keyed, processed, select, split
from specimen_spark.operators.nearest import nearest_record
from specimen_spark.plans import summaries
from specimen_spark.sources import images as image_files
from specimen_spark.sources import manifest
from specimen_spark.streaming import ingest

RAW = "i int, source string, record_id string, genus string, scientific_name string, latitude string, longitude string, image_url string, family string"


def raw_rows(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_url_is_claimed_by_a_row_rejected_later(spark):
    df = raw_rows(spark, [
        (1, "a", "r", "Limenitis", "Limenitis archippus", "40", "-100", "u1", "Pieridae"),
        (2, "a", "r", "Limenitis", "Limenitis archippus", "40", "-100", " u1 ", ""),
        (3, "a", "", "Limenitis", "Limenitis archippus", "40", "-100", "u2", ""),
        (4, "a", "r", "Limenitis", "Limenitis archippus", "40", "-100", "u3", "nymphalidae"),
    ])
    clean, rejected = cleaning.clean_manifest(df, ["i"])
    assert {r.i: r.reject_reason for r in rejected.collect()} == {1: "non_nymphalidae_family", 2: "duplicate_image_url"}
    assert {r.i: r.record_image_count for r in clean.collect()} == {3: 1, 4: 3}


def test_missing_local_image(spark):
    df = raw_rows(spark, [(i, "a", "r", "Aus", "Aus bus", "40", "-100", f"u{i}", "") for i in range(3)]).withColumn(
        "download_status", F.lit("exists")).withColumn("local_image_path", F.concat(F.lit("/x/"), F.col("i").cast("string")))
    listing = spark.createDataFrame([("/x/1",)], "path string")
    clean, rejected = cleaning.clean_manifest(df, ["i"], require_downloaded=True, existing_paths=listing)
    assert [r.i for r in clean.collect()] == [1]
    assert {r.reject_reason for r in rejected.collect()} == {"missing_local_image"}


def test_nan_passes_every_threshold(spark):
    names = ["mask_quality_score", "symmetry_score", "fill_ratio", "coverage_ratio", "horizontal_ratio", "wing_balance_ratio"]
    df = spark.createDataFrame([["nan"] * 6, [""] + ["0.2"] * 5], names)
    assert sorted(r.reject_reason or "" for r in processed.curate(df).collect()) == ["", "mask_quality_score"]


def test_ok_status_without_keep_is_counted_as_ok_reason(spark):
    df = spark.createDataFrame([("ok", "False")], "preprocess_status string, keep_for_training string")
    assert processed.filter_processed(df).first().reject_reason == "preprocess:ok"


def test_keyless_rows_share_one_key(spark):
    df = spark.createDataFrame([(1, "", ""), (2, "", ""), (3, "r", "m")], "i int, record_id string, media_id string")
    assert sorted(r.i for r in dedupe.dedupe_processed(df, ["i"]).collect()) == [1, 3]


def test_group_ties_keep_input_order(spark):
    df = spark.createDataFrame([(i, "k", 0.5) for i in range(5)], "source_row_index int, specimen_key string, mask_quality_score double")
    best = processed.rank_in_group(df, 2, ["source_row_index"]).orderBy("group_rank").collect()
    assert [(r.source_row_index, r.group_size) for r in best] == [(0, 5), (1, 5)]


def test_destination_names_skip_taken_numbers(spark):
    rows = [(1, "a/x.jpg"), (2, "b/x.jpg"), (3, "c/x_001.jpg"), (4, "d/x.jpg"), (5, "a/x.jpg"), (6, "e/y.png")]
    df = spark.createDataFrame(rows, "i int, path string")
    got = {r.path: r.name for r in processed.destination_names(df, "path", "i").collect()}
    assert got["a/x.jpg"] == "x.jpg" and got["c/x_001.jpg"] == "x_001.jpg" and got["e/y.png"] == "y.png"
    assert {got["b/x.jpg"], got["d/x.jpg"]} == {"x_002.jpg", "x_003.jpg"}


def plain_names(paths):
    """Names given one path after another, as the naming says: a base name, else its first number that no name has."""
    bases = {p.rsplit("/", 1)[-1] for p in paths}
    used, names = {}, {}
    for path in dict.fromkeys(paths):
        base = path.rsplit("/", 1)[-1]
        stem, dot, end = base.rpartition(".")
        name, n = base, 0
        while name in used or (n and name in bases):
            n += 1
            name = f"{stem}_{n:03d}{dot}{end}"
        used[name], names[path] = path, name
    return names


def test_destination_names_match_plain_naming(spark):
    """Look-alikes with other spellings of a number do not block it; blocked runs, gaps and numbers of four digits."""
    tails = ["a.jpg", "a_001.jpg", "a_0001.jpg", "a_002.jpg", "a_000.jpg", "a_1000.jpg", "a_01.jpg", "a_999.jpg", "a_004.png", "a_001_001.jpg", "b.jpg", "b_003.jpg"]
    rng = random.Random(7)
    paths = [f"{rng.randrange(400)}/{rng.choice(tails)}" for _ in range(1500)] + [f"{k}/a.jpg" for k in range(1100)]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    assert {r.path: r.name for r in processed.destination_names(df, "path", "i").collect()} == plain_names(paths)
    few = ["x/a.jpg", "y/a.jpg", "z/a_0001.jpg"]
    df = spark.createDataFrame(list(enumerate(few)), "i int, path string")
    assert {r.path: r.name for r in processed.destination_names(df, "path", "i").collect()}["y/a.jpg"] == "a_001.jpg"


def test_many_blocked_numbers_of_one_name(spark):
    """A base name with 100,000 paths and as many blocked numbers: every second number is taken."""
    n = 100_000
    wanted = spark.range(n).select(F.col("id").alias("i"), F.concat(F.col("id").cast("string"), F.lit("/a.jpg")).alias("path"))
    number = (F.col("id") * 2 + 2).cast("string")
    blocks = spark.range(n).select((F.col("id") + n).alias("i"), F.concat(
        F.lit("q/a_"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")), F.lit(".jpg")).alias("path"))
    names = processed.destination_names(wanted.union(blocks), "path", "i")
    later = names.where("path LIKE '%/a.jpg' AND path <> '0/a.jpg'").select(
        F.split("path", "/")[0].cast("int").alias("j"), F.regexp_extract("name", r"_(\d+)\.", 1).cast("int").alias("number"))
    odd = later.agg(F.count("*").alias("n"), F.count_distinct("number").alias("d"), F.sum((F.col("number") != 2 * F.col("j") - 1).cast("int")).alias("wrong")).first()
    assert (odd.n, odd.d, odd.wrong) == (n - 1, n - 1, 0)
    assert names.agg(F.count_distinct("name")).first()[0] == 2 * n


def test_ranks_are_exact_in_a_hot_group(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"))
    for ranked in (keyed.number_rank(df, ["g"], "id", [], "r", "n"), keyed.hash_rank(df, ["g"], ["id"], 1, "r", "n")):
        check = ranked.groupBy("g").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.countDistinct("r").alias("d"), F.max("n").alias("n"))
        assert all(r.lo == 1 and r.hi == r.d == r.n for r in check.collect())


def test_hot_key_is_split_by_the_join(spark):
    """With a third of the rows on one key, adaptive execution splits that key's partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 60000, 1, 8).select("id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.col("id").cast("string")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        lookup = rows.groupBy("k").agg(F.min("id").alias("first"))
        joined = keyed.attach(rows, lookup, ["k"])
        assert joined.where("first is null").count() == 0
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_nearest_matches_brute_force(spark):
    rng = random.Random(5)
    # A third of the records share one spot; others are spread or far away.
    records = [(i, 40.0, -100.0) if i % 3 == 0 else (i, rng.uniform(10, 80), rng.uniform(-180, 180)) for i in range(600)]
    records += [(600, float("nan"), 0.0), (601, 89.0, 179.0)]
    points = [(i, rng.uniform(-95, 95), rng.uniform(-200, 200)) for i in range(20)] + [(20, 40.0, -100.0)]
    r = spark.createDataFrame([(i, a, b, f"s{i}", f"u{i}") for i, a, b in records], "i int, latitude double, longitude double, species string, image_url string")
    p = spark.createDataFrame(points, "p int, lat double, lon double")
    got = {x.p: x.image_url for x in nearest_record(p, r, ["i"]).collect()}
    for n, lat, lon in points:
        want = min((x for x in records if x[1] == x[1]), key=lambda x: (((lat - x[1]) ** 2 + (lon - x[2]) ** 2) ** 0.5, x[0]))
        assert got[n] == f"u{want[0]}"


def test_masks_pair_by_path_and_size(spark):
    def table(rows):
        return spark.createDataFrame([(p, h, 2, 1, bytearray(b"\1" * 2 * h)) for p, h in rows], "path string, height int, width int, nChannels int, data binary")

    pictures, masks = table([("i/a/x.png", 2), ("i/b/x.png", 3), ("i/c.png", 2)]), table([("m/a/x.tif", 2), ("m/b/x.tif", 2)])
    got = {r.path: (r.found, r.reason) for r in images.mask_metrics(pictures, masks, "i", "m").collect()}
    assert got == {"i/a/x.png": (True, None), "i/b/x.png": (False, "size_mismatch"), "i/c.png": (False, "missing_mask")}


def test_every_diverse_pick_beats_what_is_left(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({
        "request": np.repeat([0, 1, 2], 6), "c": np.tile(np.arange(6), 3), "quality_score": rng.random(18) * np.repeat([1, 1, 0.3], 6),
        "foreground_luminance": rng.random(18) * 0.3, "angle": rng.random(18)})
    frame["embedding"] = [[a, 1 - a] for a in frame.pop("angle")]
    picks = select.diverse_select(spark.createDataFrame(frame), "request", "c", 3, 0.5, 0.35, 0.1).toPandas()
    for request, pool in frame.groupby("request"):
        chosen = picks[picks.request == request].sort_values("pick").c.tolist()
        assert len(set(chosen)) == 3
        pool = pool.set_index("c")
        good = pool[(pool.quality_score >= 0.35) & (pool.foreground_luminance >= 0.1)]
        pool = good if len(good) >= 3 else pool
        vectors = np.stack(pool.embedding)
        units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        cosines = pd.DataFrame(units @ units.T, pool.index, pool.index)
        plain = pool.quality_score - 0.8 * (0.1 - pool.foreground_luminance).clip(lower=0)
        for n, pick in enumerate(chosen):
            worth = plain - (0.5 * cosines[chosen[:n]].max(axis=1) if n else 0)
            assert worth[pick] >= worth.drop(chosen[:n]).max() - 1e-12


def test_ranks_keep_every_row(spark):
    """Null groups, null and NaN values: as many rows come out as went in, nulls first, NaN last."""
    nan = float("nan")
    rows = [(1, "a", 1.0), (2, "a", None), (3, "a", nan), (4, None, 2.0), (5, None, None), (6, "b", 1e300), (7, "b", -1e300), (8, "a", 1.0)]
    df = spark.createDataFrame(rows, "i int, g string, x double")
    got = {r.i: (r.r, r.n) for r in keyed.number_rank(df, ["g"], "x", ["i"], "r", "n").collect()}
    assert got == {2: (1, 4), 1: (2, 4), 8: (3, 4), 3: (4, 4), 5: (1, 2), 4: (2, 2), 7: (1, 2), 6: (2, 2)}
    assert keyed.hash_rank(df, ["g"], ["x"], 1, "r").count() == 8
    assert keyed.with_row_numbers(df, "x", ["i"]).select("source_row_index").distinct().count() == 8
    assert keyed.number_rank(df.where("false"), ["g"], "x", ["i"], "r").count() == 0


def test_no_slice_of_a_rank_is_large(spark):
    """An outlier, a hot group and a repeated value: sorted partitions follow the rows, not the values."""
    df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(F.lit(99)).alias("g"), F.when(
        F.col("id") == 5, F.lit(1e18)).when(F.col("id") % 2 == 0, F.lit(3.0)).otherwise(F.col("id").cast("double")).alias("x"))
    stored = []
    original, partitions = keyed.cut_lineage, spark.conf.get("spark.sql.shuffle.partitions")

    def measured(placed):
        stored.append(original(placed))
        return stored[-1]

    keyed.cut_lineage = measured
    spark.conf.set("spark.sql.shuffle.partitions", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranked = keyed.sorted_rank(df, ["g"], ["x"], "r", "n")
    finally:
        keyed.cut_lineage = original
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in stored[0].groupBy("__slice").count().collect()]
    assert len(stored) == 1 and sum(sizes) == 60_000 and max(sizes) <= 0.03 * 60_000
    exact = ranked.groupBy("g").agg((F.count_distinct("r") == F.count("*")).alias("one"), (F.max("r") == F.count("*")).alias("all"), (F.max("n") == F.count("*")).alias("n"))
    assert exact.where("NOT (one AND all AND n)").count() == 0
    above = ranked.alias("a").join(ranked.alias("b"), F.expr("a.g = b.g AND a.r + 1 = b.r AND a.x > b.x"))
    assert above.count() == 0


def test_hash_rank_moves_rows_once_and_stores_nothing(spark):
    df = spark.range(30_000).select("id", F.when(F.col("id") % 3 > 0, F.lit("hot")).alias("g"))
    ranked = keyed.hash_rank(df, ["g"], ["id"], 7, "r", "n")
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and len([x for x in plan.splitlines() if "Exchange hashpartitioning(g" in x and "__slice" in x]) <= 2
    rows = ranked.collect()
    for g in ("hot", None):
        own = sorted((hashlib.md5(f"7:{r.id}".encode()).hexdigest(), r.r, r.n) for r in rows if r.g == g)
        assert [r for _, r, _ in own] == list(range(1, len(own) + 1)) and {n for _, _, n in own} == {len(own)}


def test_balanced_sample_keeps_the_null_class(spark):
    df = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(20)], "i int, k string")
    drawn = split.balanced_sample(df, "k", ["i"], 3, 60)
    assert drawn.count() == 60 and {r.k for r in drawn.collect()} == {"a", None}


def test_names_of_blank_and_repeated_indexes_differ(spark):
    rows = [(1, "a/x.jpg", "1"), (2, "b/x.jpg", None), (3, "c/x.jpg", ""), (4, "d/x.jpg", "7"), (5, "e/x.jpg", "7"), (6, "f/x.jpg", "7"), (None, "g/y.jpg", "9"), (8, " ", "8")]
    df = spark.createDataFrame(rows, "i int, path string, idx string")
    got = {r.path: r.destination_name for r in processed.destination_names_simple(df, "path", "i", "idx").collect()}
    assert got == {"a/x.jpg": "x.jpg", "b/x.jpg": "x_dup.jpg", "c/x.jpg": "x_dup_2.jpg", "d/x.jpg": "x_7.jpg", "e/x.jpg": "x_7_2.jpg", "f/x.jpg": "x_7_3.jpg",
                   "g/y.jpg": "y.jpg", " ": None}


def test_path_without_an_order_keeps_its_name(spark):
    df = spark.createDataFrame([(None, "a/x.jpg"), (2, "b/x.jpg")], "i int, path string")
    assert {r.path: r.name for r in processed.destination_names(df, "path", "i").collect()} == {"a/x.jpg": "x.jpg", "b/x.jpg": "x_001.jpg"}


def test_equal_orders_leave_one_first_row(spark):
    df = spark.createDataFrame([(1, 5, "t"), (2, 5, "t"), (3, 6, "u")], "id int, o int, content string")
    assert [tuple(r)[:2] for r in dedupe.content_duplicates(df, "content", "id", ["o"]).collect()] == [(1, 2)]


def test_manifests_of_unlike_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("source,record_id,image_url\ns1,r1,u1\n")
    (tmp_path / "b.csv").write_text("image_url,source,record_id\nu2,s2,r2\n")
    (tmp_path / "c.csv").write_text('source,extra\ns3,"two\nlines"\n')
    df = manifest.read_manifest(spark, [f"{tmp_path}/*.csv", f"{tmp_path}/a.csv", str(tmp_path)])
    assert sorted(tuple(r[c] for c in ("source", "record_id", "image_url", "extra")) for r in df.collect()) == [
        ("s1", "r1", "u1", ""), ("s2", "r2", "u2", ""), ("s3", "", "", "two\nlines")]
    first = manifest.read_manifest(spark, f"{tmp_path}/*.csv", max_rows=1, order_cols=["source"]).collect()
    assert [r.source for r in first] == ["s1"]
    with pytest.raises(ValueError):
        manifest.read_manifest(spark, f"{tmp_path}/*.csv", max_rows=1)
    with pytest.raises(FileNotFoundError):
        manifest.read_manifest(spark, f"{tmp_path}/none*.csv")


@pytest.mark.parametrize("max_files", [1, 2, None])
def test_ingest_does_not_depend_on_batches(spark, tmp_path, max_files):
    schema = "occurrence_key string, image_url string"

    def land(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")

    def run(name):
        src = f"{tmp_path}/*" if name == "all" else f"{tmp_path}/{name}"
        ingest.stream_ingest(ingest.landing_stream(spark, src, schema, max_files=max_files), f"{tmp_path}_out", f"{tmp_path}_ledger", f"{tmp_path}_cp").awaitTermination()
        return sorted(r.image_url for r in spark.read.parquet(f"{tmp_path}_out").collect())

    for i in range(3):
        land([("k1", f"u{i}"), (f"other{i}", f"v{i}"), (None, f"w{i}")], "in")
    assert run("in") == ["u0", "u1", "u2", "v0", "v1", "v2", "w0", "w1", "w2"]
    land([("k1", "late"), ("new", "n")], "in")
    assert run("in") == ["n", "u0", "u1", "u2", "v0", "v1", "v2", "w0", "w1", "w2"]


def test_no_group_is_in_two_splits(spark):
    df = spark.range(3000).select(F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.lit("gbif:")).otherwise(
        (F.col("id") % 400).cast("string")).alias("specimen_key"), (F.col("id") % 9).cast("string").alias("species"))
    out = split.grouped_split(df, ["i"])
    assert out.count() == 3000
    assert out.groupBy("specimen_key").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.select("split").distinct().count() == 3


def test_balanced_sample_has_equal_classes(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") < 10, "rare").otherwise("common").alias("c"))
    got = {r.c: r["count"] for r in split.balanced_sample(df, "c", ["id"], 4, 1000).groupBy("c").count().collect()}
    assert sum(got.values()) == 1000 and abs(got["rare"] - 500) < 80


def test_shard_gate(spark):
    df = spark.createDataFrame([("s1", "complete", True, True), ("s2", "processing", True, False)],
                               "shard string, stage string, processed_csv_exists boolean, summary_json_exists boolean")
    with pytest.raises(RuntimeError):
        summaries.require_shards(df)
    summaries.require_shards(df.where("shard = 's1'"), 1)


def test_ledger_key_choice(spark):
    df = spark.createDataFrame([("1", "u1"), ("1", "u2"), ("", "u3")], "occurrence_key string, image_url string")
    done = spark.createDataFrame([("1", "u1")], "occurrence_key string, image_url string")
    assert [r.image_url for r in joins.pending(df, done).collect()] == ["u3"]
    both = joins.pending(df, done, ("occurrence_key", "image_url")).collect()
    assert sorted(r.image_url for r in both) == ["u2", "u3"]


def png(width, height, pixel):
    lines = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_files(spark, tmp_path):
    (tmp_path / "i").mkdir()
    (tmp_path / "m").mkdir()
    (tmp_path / "i" / "a.png").write_bytes(png(8, 4, lambda x, y: (255, 0, 51)))
    (tmp_path / "i" / "bad.png").write_bytes(b"no image")
    (tmp_path / "m" / "a.png").write_bytes(png(8, 4, lambda x, y: (255 if 2 <= x < 6 and y else 0,) * 3))
    pictures = image_files.read_images(spark, str(tmp_path / "i"))
    stats = images.channel_stats(pictures).first()
    assert (stats.images_used, stats.total_pixels, stats.mean_r, stats.mean_g) == (1, 32, 1.0, 0.0)
    assert abs(stats.mean_b - 0.2) < 1e-9
    assert sorted(r.decodable for r in images.image_profile(pictures, 4).collect()) == [False, True]
    mask = images.mask_metrics(pictures, image_files.read_images(spark, str(tmp_path / "m")), str(tmp_path / "i"), str(tmp_path / "m")).where("found").first()
    assert (mask.x0, mask.y0, mask.x1, mask.y1, mask.area) == (2, 1, 6, 4, 12)
    assert (mask.symmetry_score, mask.wing_balance_ratio, mask.mean_saturation) == (1.0, 1.0, 255.0)
    files = image_files.list_files(spark, str(tmp_path / "i"), "*.png")
    assert files.count() == 2


def test_manifest_csv(spark, tmp_path):
    path = tmp_path / "m.csv"
    path.write_text('source,note\na,"line one\nline ""two"""\nb,\n', encoding="utf-8")
    rows = manifest.read_manifest(spark, [str(path), str(path)], required=("source",)).orderBy("source").collect()
    assert [tuple(r) for r in rows] == [("a", 'line one\nline "two"'), ("b", "")]
    with pytest.raises(ValueError):
        manifest.read_manifest(spark, str(path), required=("absent",))


def test_stream_restart_adds_nothing(spark, tmp_path):
    landing, base = str(tmp_path / "in"), str(tmp_path)
    rows = spark.range(40).select(F.col("id").cast("string").alias("occurrence_key"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("image_url"))
    rows.where("occurrence_key < '2'").write.mode("append").parquet(landing)

    def run():
        stream = ingest.landing_stream(spark, landing, rows.schema)
        ingest.stream_ingest(stream, f"{base}/out", f"{base}/ledger", f"{base}/cp").awaitTermination()
        return spark.read.parquet(f"{base}/out").count()

    first = run()
    assert run() == first
    rows.write.mode("append").parquet(landing)
    assert run() == 40 and run() == 40


def test_winning_rows(spark):
    """First and last rows of keys: null keys and orders, ties, rows equal throughout, composite orders; no wide sort."""
    rows = [("a", 2, 1, "x"), ("a", 1, 5, "y"), ("a", 1, 3, "z"), ("b", 1, 1, "u"), ("b", 1, 1, "u"), ("c", None, 1, "p"), ("c", 7, 1, "q"),
            ("d", None, None, "r"), (None, 4, 1, "n"), (None, 3, 1, "m"), ("e", 1, 1, "s"), ("e", 1, 1, "t")]
    df = spark.createDataFrame(rows, "k string, o int, p int, v string")
    first = sorted((r.k or "", r.v) for r in keyed.winning_rows(df, ["k"], ["o", "p"]).where("k <> 'e' AND k <> 'c' OR k IS NULL").collect())
    assert first == [("", "m"), ("a", "z"), ("b", "u"), ("d", "r")]
    single = keyed.winning_rows(df, ["k"], ["o"]).collect()
    assert len(single) == 6 and {r.k: r.v for r in single if r.k in ("c", "d", None)} == {"c": "q", "d": "r", None: "m"}
    assert {r.v for r in single if r.k == "a"} <= {"y", "z"} and {r.v for r in single if r.k == "e"} <= {"s", "t"}
    last = {r.k: r.v for r in keyed.winning_rows(df, ["k"], ["o"], last=True).collect()}
    assert {k: last[k] for k in ("a", "c", None)} == {"a": "x", "c": "q", None: "n"}
    assert keyed.winning_rows(df.where("false"), ["k"], ["o"]).count() == 0
    hot = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("o"))
    assert keyed.winning_rows(hot, ["k"], ["o"]).where("k = 'hot'").collect()[0].o == 0 and keyed.winning_rows(hot, ["k"], ["o"]).count() == 20_001
    plan = keyed.winning_rows(hot, ["k"], ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan.split("Union")[0]


def test_large_csv_with_line_breaks_is_read_by_several_tasks(spark, tmp_path):
    """Range ends inside quoted cells, doubled quotes, blank lines and CRLF: the same rows as Spark's own reader."""
    rng = random.Random(12)
    cells = ["plain", "", 'a "quoted" word', "two\nlines", "\n\n", 'ends with "', "comma, cell", "x" * 90, "é\nü"]

    def quoted(x):
        return '"' + x.replace('"', '""') + '"' if x == "" or set(x) & set('",\n') else x

    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        lines = ["id,first,second"] + [f"{name}{i},{quoted(rng.choice(cells))},{quoted(rng.choice(cells))}" for i in range(400)]
        lines.insert(50, "")
        with open(tmp_path / name, "w", newline="", encoding="utf-8") as f:
            f.write(end.join(lines) + end)
    with open(tmp_path / "c.csv", "w", newline="") as f:  # one cell over many ranges, and no line end at the end
        f.write('id,first,second\nlong,"' + "line\n" * 2_000 + '",y\nlast,x,z')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(tuple, manifest.read_manifest(spark, str(tmp_path)).collect()))
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        df = manifest.read_manifest(spark, str(tmp_path), split=True)
        assert sorted(map(tuple, df.collect())) == want and len(want) == 802
        from specimen_spark.sources.csv_ranges import numbered_lines, range_parities
        parities = range_parities(numbered_lines(spark, [f"{tmp_path}/c.csv"])).collect()
        assert len(parities) > 8 and {r.inside for r in parities} == {0, 1}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_state_table_writes_follow_the_batches(spark, tmp_path):
    from specimen_spark.streaming.state import StateTable

    path, rng, want, written = str(tmp_path / "state"), random.Random(3), {}, 0
    table = StateTable(spark, path, "job string, at bigint, tie bigint, status string", "job", ["at", "tie"])
    assert table.current().count() == 0
    for batch in range(6):
        rows = [(f"j{rng.randrange(300)}", rng.randrange(50), batch * 1000 + i, f"s{i}") for i in range(200 if batch == 0 else 20)]
        df = spark.createDataFrame(rows, "job string, at bigint, tie bigint, status string")
        for _ in range(2 if batch in (0, 3) else 1):  # two batches are replayed
            table.write(df, batch)
        for job, at, tie, status in rows:
            want[job] = max(want.get(job, (-1, -1, "")), (at, tie, status))
        assert {r.job: (r.at, r.tie, r.status) for r in table.current().collect()} == want
    names = {p.parent.name + "/" + p.name for p in (tmp_path / "state").glob("*/version=*")}
    assert "base/version=0" in names and "base/version=1" not in names  # small batches did not copy the state
    table.write(spark.createDataFrame([(f"k{i}", 1, i, "new") for i in range(400)], table.schema), 6)
    table.write(spark.createDataFrame([(f"m{i}", 1, i, "new") for i in range(900)], table.schema), 7)
    names = {p.parent.name + "/" + p.name for p in (tmp_path / "state").glob("*/version=*")}
    assert names == {"base/version=6", "base/version=7", "changes/version=7"}, "older files go"
    assert table.current().count() == len(want) + 1300


def test_progress_counts_of_a_stream_survive_restarts(spark, tmp_path):
    src, base = str(tmp_path / "in"), str(tmp_path)
    seen = []
    for part in range(3):
        rows = [(["ok", "skip", "fail"][(part + i) % (2 + part % 2)],) for i in range(10 + part)]
        seen += rows
        spark.createDataFrame(rows, "status string").coalesce(1).write.mode("append").parquet(src)
        log = ingest.landing_stream(spark, src, "status string", max_files=1)
        ingest.stream_progress_counts(log, f"{base}/table", f"{base}/cp").awaitTermination()
        want = {s: sum(r == (s,) for r in seen) for s, in set(seen)}
        assert {r.status: r.rows for r in ingest.progress_table(spark, f"{base}/table").current().collect()} == want


def test_generated_methods_are_bounded_and_white_space_needs_no_lambda(spark):
    from specimen_spark.catalog import QUERIES
    from specimen_spark.functions.text import normalize_text

    QUERIES["C2_preprocess_ok"](spark, "/root/testdata/sf0.001")
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
    texts = [None, "", " a  b ", "a\tb", "a \t b", "　x  y\n", "a b", "\x1c"]
    cells = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    squeezed = cells.select("i", normalize_text("t").alias("t"))
    assert [r.t for r in squeezed.orderBy("i").collect()] == [" ".join((t or "").split()) for t in texts]
    assert "lambda" not in squeezed._jdf.queryExecution().executedPlan().toString()


def test_accepted_rows_are_judged_without_those_that_fail_by_place_or_claim(spark):
    names = ["i", "source", "record_id", "image_url", "species", "scientific_name", "genus", "latitude", "longitude", "family"]
    rows = [(1, "gbif", "r1", "u1", "Danaus plexippus", "", "Danaus", "40", "-100", ""),
            (2, "gbif", "r1", "u1", "Danaus plexippus", "", "Danaus", "40", "-100", ""),   # claimed by 1
            (None, "gbif", "r1", "u1", "Danaus plexippus", "", "Danaus", "40", "-100", ""),   # without an order: after 1
            (3, "gbif", "r2", "u2", "Danaus plexippus", "", "Danaus", "nan", "-100", ""),   # claims, though without a place
            (4, "gbif", "r2", "u2", "Danaus plexippus", "", "Danaus", "40", "-100", ""),
            (5, "gbif", "r3", "u3", "Danaus plexippus", "", "Danaus", "40", "-100", "Pieridae"),
            (6, "gbif", "r4", "u4", "Danaus plexippus", "", "Danaus", "-40", "100", "")]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names))
    clean, rejected = cleaning.clean_manifest(df, ["i"])
    assert [r.i for r in clean.collect()] == [1] and rejected.count() == 6
    judged = cleaning.judge_rows(df, ["i"], accepted_only=True)
    assert judged.count() == 1
