"""Plans that keep big inputs cheap: how often a source is scanned, and what moves."""

import random

from pyspark.sql import functions as F

from specimen_spark.catalog import QUERIES
from specimen_spark.functions.media import has_image_suffix
from specimen_spark.functions.text import blank_to_null, file_name, is_not_blank, normalize_text
from specimen_spark.operators import cleaning, dedupe, joins, keyed, processed, split
from specimen_spark.plans import summaries
from specimen_spark.sources import archive, pages


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole paths of scanned files
    return df._jdf.queryExecution().executedPlan().toString()


def table(df, path):
    df.write.mode("overwrite").parquet(str(path))
    return df.sparkSession.read.parquet(str(path))


def test_few_winners_are_broadcast(spark, tmp_path):
    """Many rows, few keys: the rows are scanned once more and do not move to meet the winners."""
    rows = table(spark.range(3000).select(F.col("id").alias("o"), (F.col("id") % 7).cast("string").alias("k"), F.lit("x" * 50).alias("v")), tmp_path / "a")
    won = keyed.winning_rows(rows, ["k"], ["o"])
    assert "BroadcastHashJoin" in plan_of(won) and "ShuffledHashJoin" not in plan_of(won)
    assert plan_of(won).count("/a]") == 1
    assert {(r.k, r.o) for r in won.collect()} == {(str(i), i) for i in range(7)}


def test_many_winners_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 10)
    rows = spark.range(500).select(F.col("id").alias("o"), (F.col("id") % 100).cast("string").alias("k"))
    won = keyed.winning_rows(rows, ["k"], ["o"], last=True)
    assert "ShuffledHashJoin" in plan_of(won) and {(r.k, r.o) for r in won.collect()} == {(str(i % 100), i) for i in range(400, 500)}


def test_null_orders_of_several_columns(spark):
    """In a composite order null is least, as in a sort."""
    rows = spark.createDataFrame([("a", 1, None, "n"), ("a", 1, 2, "m"), ("a", 2, 0, "z"), ("b", None, 5, "p"), ("b", 1, 1, "q")], "k string, o int, p int, v string")
    assert {r.k: r.v for r in keyed.winning_rows(rows, ["k"], ["o", "p"]).collect()} == {"a": "n", "b": "p"}
    assert {r.k: r.v for r in keyed.winning_rows(rows, ["k"], ["o", "p"], last=True).collect()} == {"a": "z", "b": "q"}


def test_merge_does_not_sort_its_rows(spark, tmp_path):
    rows = table(spark.range(100).select(F.col("id").alias("row_idx"), F.concat(F.lit("u"), F.col("id") % 9).alias("image_url")), tmp_path / "m")
    merged, counts = dedupe.merge_manifests({"first": rows.where("row_idx % 2 = 0"), "second": rows.where("row_idx % 2 = 1")}, ["row_idx"])
    assert "SortAggregate" not in plan_of(merged)
    assert {r.row_idx for r in merged.collect()} == {0, 2, 4, 6, 8, 10, 12, 14, 16}
    assert {r.key: r["rows"] for r in counts.collect()} == {"first": 50, "second": 50, "before_dedupe": 100, "after_dedupe": 9}


def test_archive_reads_whole_only_what_wins(spark, tmp_path):
    """The first row of a URL counts among rows with an occurrence; media are not scanned again when the result is read."""
    occurrence = table(spark.createDataFrame([("c1", 1, "old"), ("c1", 2, "new"), ("c2", 3, "two")], "coreid string, o int, `dwc:scientificName` string"), tmp_path / "occurrence")
    media = table(spark.createDataFrame(
        [("none", 1, "http://a/1.jpg"), ("c2", 1, "http://a/1.jpg"), ("c1", 2, "http://a/1.jpg"), ("c1", 3, "http://a/2.jpg"), ("none", 4, "http://a/3.jpg"), ("c1", 5, "")],
        "coreid string, m int, `ac:accessURI` string"), tmp_path / "media")
    rows = archive.import_dwca(occurrence, media, ["o"], ["m"])
    assert plan_of(rows).count("/media]") == 0 and plan_of(rows).count("/occurrence]") == 1
    assert {(r.m, r.record_id, r.image_url, r.scientific_name) for r in rows.collect()} == {
        (1, "c2", "http://a/1.jpg", "two"), (3, "c1", "http://a/2.jpg", "new")}


def test_ranked_queries_scan_their_table_before_they_are_read(spark):
    """G1 and the assembly summary store the deduplicated rows, and read those."""
    from specimen_spark.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    assert plan_of(QUERIES["G1_rank_in_group"](spark, sf)).count("lineitem.parquet]") == 0
    assert plan_of(QUERIES["F14_assembly_summary"](spark, sf)).count("lineitem.parquet]") == 1


def test_names_do_not_carry_other_columns(spark):
    """G9 ranks two columns and scans its table once, before the result is read; G10 scans it once more to write rows."""
    from specimen_spark.catalog import QUERIES

    sf = "/root/testdata/sf0.001"
    assert plan_of(QUERIES["G9_simple_names"](spark, sf)).count("lineitem.parquet]") == 0
    assert plan_of(QUERIES["G10_portable_manifest"](spark, sf)).count("lineitem.parquet]") == 1


def test_rows_that_share_an_index_are_numbered_apart(spark):
    """Repeated and missing indices go on with _2, _3; a row with an index of its own does not."""
    rows = [("a/x.jpg", 1, "1"), ("b/x.jpg", 2, "7"), ("c/x.jpg", 3, "7"), ("d/x.jpg", 4, "8"), ("e/x.jpg", 5, None), ("f/x.jpg", 6, None), ("g/y.jpg", 7, "7"), (None, 8, "7")]
    df = spark.createDataFrame(rows, "path string, o int, i string")
    named = {r.o: r.destination_name for r in processed.destination_names_simple(df, "path", "o", "i").collect()}
    assert named == {1: "x.jpg", 2: "x_7.jpg", 3: "x_7_2.jpg", 4: "x_8.jpg", 5: "x_dup.jpg", 6: "x_dup_2.jpg", 7: "y.jpg", 8: None}


def test_points_are_spread_over_tasks(spark):
    """Points that fill one small partition are still pruned by several tasks, and their cells are made once a level."""
    from specimen_spark.operators.nearest import nearest_record

    records = spark.range(400).select(F.col("id").alias("o"), (F.col("id") % 20).cast("double").alias("latitude"), (F.col("id") * 7 % 90).cast("double").alias("longitude"), F.lit("s").alias("species"), F.lit("u").alias("image_url"))
    points = spark.range(50).select((F.col("id") * 3 % 25).cast("double").alias("lat"), (F.col("id") * 11 % 80).cast("double").alias("lon"))
    found = nearest_record(points, records, ["o"])
    plan = plan_of(found)
    assert "REPARTITION_BY_NUM" in plan and plan.count("partial_collect_list") <= 1
    sites = {(r.latitude, r.longitude) for r in records.collect()}
    for r in found.collect():
        assert r.distance == min(((r.lat - y) ** 2 + (r.lon - x) ** 2) ** 0.5 for y, x in sites)


def raw_rows(spark, tmp_path, n=400):
    """Raw rows of few URLs and names; every third is out of place."""
    i = F.col("id")
    return table(spark.range(n).select(
        i.alias("o"), F.lit("gbif").alias("source"), (i % 9).cast("string").alias("record_id"),
        F.concat(F.lit("u"), (i % 20).cast("string")).alias("image_url"), F.lit("Danaus plexippus").alias("species"),
        F.lit("").alias("scientific_name"), F.when(i % 2 == 0, "Danaus").otherwise("Vanessa").alias("genus"),
        F.when(i % 3 == 0, "-40").otherwise("40").alias("latitude"), F.lit("-100").alias("longitude")), tmp_path / "raw")


def test_rows_meet_few_claims_where_they_are(spark, tmp_path, monkeypatch):
    rows = raw_rows(spark, tmp_path)
    judged = cleaning.judge_rows(rows, ["o"], accepted_only=True).where("reject_reason IS NULL")
    assert "ShuffledHashJoin" not in plan_of(judged) and plan_of(judged).count("/raw]") == 1
    accepted = [r.o for r in judged.orderBy("o").collect()]
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 10)
    many = cleaning.judge_rows(rows, ["o"], accepted_only=True).where("reject_reason IS NULL")
    assert "ShuffledHashJoin" in plan_of(many) and [r.o for r in many.orderBy("o").collect()] == accepted
    assert accepted == [o for o in range(20) if o % 3 and o % 2 == 0]


def test_shared_orders_do_not_claim_another_url(spark):
    names = ["i", "source", "record_id", "image_url", "species", "scientific_name", "genus", "latitude", "longitude", "family"]
    tail = ("Danaus plexippus", "", "Danaus", "40", "-100", "")
    rows = [(1, "gbif", "r", "u1", *tail), (2, "gbif", "r", "u1", *tail), (2, "gbif", "r", "u2", *tail)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n == 'i' else 'string'}" for n in names))
    clean, _ = cleaning.clean_manifest(df, ["i"])
    assert sorted((r.i, r.image_url) for r in clean.collect()) == [(1, "u1"), (2, "u2")]


def test_distinct_names_are_read_once_and_alike(spark, tmp_path, monkeypatch):
    rows = raw_rows(spark, tmp_path)
    columns = ["o", "__species_label", "__species_source", "__genus_hint", "reject_reason"]
    plain = cleaning.judge_rows(rows, ["o"]).select(*columns)
    once = cleaning.judge_rows(rows, ["o"], names_once=True).select(*columns)
    assert "regexp_extract_all" in plan_of(plain) and "regexp_extract_all" not in plan_of(once)
    assert sorted(plain.collect()) == sorted(once.collect())
    monkeypatch.setattr(keyed, "BROADCAST_BYTES", 1)
    assert "regexp_extract_all" in plan_of(cleaning.judge_rows(rows, ["o"], names_once=True).select(*columns))


def test_vocabulary_is_ranked_from_stored_counts(spark, tmp_path):
    plan = plan_of(cleaning.species_vocab(raw_rows(spark, tmp_path)))
    assert "/raw]" not in plan


def test_white_space_of_any_kind_is_squeezed(spark):
    rng = random.Random(3)
    white = [*" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0      　"]
    texts = ["".join(rng.choice([*white, " ", " ", "a", "$1", "\\", "é", "\x01", "\U0001f98b", "​"]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts.append("long word " * 20_000 + "\t")
    cells = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.t for r in cells.select("i", normalize_text("t").alias("t")).orderBy("i").collect()] == [" ".join(t.split()) for t in texts]


def test_image_endings_need_their_dot(spark):
    texts = {"jpg": False, "a.JPG": True, "a.jpg ": True, "a.jpg?x": False, "x/jpg": False, ".gif": True, "a.b.tiff": True, "": False, "a.": False}
    cells = spark.createDataFrame([(t,) for t in texts], "t string")
    found = cells.select("t", has_image_suffix("t").alias("image"))
    assert {r.t: r.image for r in found.collect()} == texts and "RLIKE" not in plan_of(found).upper()


def test_paths_without_climbing_need_no_lambda(spark):
    rng = random.Random(5)
    texts = ["", "/", "//", ".", "./", "/.", "a\n", "/a\n/", "a/.\n"] + [
        "".join(rng.choice(["/", "/", ".", "a", "..", "/../", "b.c", "\n"]) for _ in range(rng.randrange(9))) for _ in range(2000)]

    def plain(text):
        parts = []
        for part in text.split("/"):
            if part == "..":
                parts = parts[:-1]
            elif part not in ("", "."):
                parts.append(part)
        return ("/" if text.startswith("/") else "") + "/".join(parts)

    cells = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.p for r in cells.select("i", joins.normal_path("t").alias("p")).orderBy("i").collect()] == [plain(t) for t in texts]


def test_paths_below_roots_are_normalised_once_a_root(spark, tmp_path):
    rows = table(spark.range(40).select(F.col("id").alias("o"), F.concat(F.lit("a//"), F.col("id").cast("string")).alias("p"),
                                        F.lit("/abs/./x").alias("q")), tmp_path / "rows")
    listing = spark.createDataFrame([("/data/set/a/1",), ("/data/a/2",), ("/abs/./x",)], "path string")
    found = joins.resolve_paths(rows, listing, ("p", "q"), ["o"], "/data/set")
    got = {r.o: (r.resolved_path, r.resolved_path_exists) for r in found.collect()}
    assert got[1] == ("/data/set/a/1", True) and got[2] == ("/data/a/2", True) and got[3] == ("/abs/./x", True)
    # Each squeezed value is computed once below the join and once in front of the fallback's.
    assert plan_of(found).split("== ")[0].count("regexp_replace(coalesce(") <= 4


def test_split_summary_scans_its_rows_once(spark, tmp_path):
    i = F.col("id")
    rows = table(spark.range(90).select(
        i.alias("o"), F.when(i % 10 == 0, None).otherwise((i % 3).cast("string")).alias("split"), (i % 17).cast("string").alias("specimen_key"),
        F.when(i % 7 == 0, None).otherwise((i % 5).cast("string")).alias("species")), tmp_path / "rows")
    got = summaries.split_summary(rows, ["o"])
    assert "/rows]" not in plan_of(got) and "Expand" not in plan_of(got)
    data = rows.collect()
    want = set()
    for part in {r.split for r in data}:
        mine = [r for r in data if r.split == part]
        names = [r.species or "" for r in mine]
        want |= {(part, "totals", "rows", len(mine)), (part, "totals", "groups", len({r.specimen_key for r in mine})),
                 (part, "totals", "unique_species", len(set(names)))} | {(part, "top_species", n, names.count(n)) for n in names}
    assert {tuple(r) for r in got.collect()} == want


def test_groups_are_found_before_they_are_ranked(spark, tmp_path):
    rows = table(spark.range(60).select(F.col("id").alias("o"), (F.col("id") % 11).cast("string").alias("specimen_key"), F.lit("a").alias("species")), tmp_path / "rows")
    parted = split.grouped_split(rows, ["o"], keep_key=True)
    assert plan_of(parted).count("/rows]") == 1 and "group_key" in parted.columns
    assert "group_key" not in split.grouped_split(rows, ["o"]).columns


def test_pages_made_from_columns_are_made_once(spark):
    """A filter by the size of an array that is about to be exploded would make the array twice."""
    for name in ("A4_flatten_occurrences", "A5_flatten_simple", "A6_flatten_records", "A7_flatten_media"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "size(array(" not in plan, name


def test_empty_and_null_arrays_of_pages(spark):
    """No row for an array that is empty or null, a row for an element that is null."""
    rows = [(1, ["a", None]), (2, []), (3, None), (4, ["b"])]
    found = pages.each_element(spark.createDataFrame(rows, "p int, items array<string>"), "items", "i", ["p"])
    assert sorted(map(tuple, found.collect()), key=str) == [(1, "a"), (1, None), (4, "b")]


def test_small_groups_are_ranked_without_a_range_sort(spark, monkeypatch, tmp_path):
    """Groups in large buckets go through the range sort, all others through a window; nulls are a group and a value."""
    df = table(spark.range(4000).select(
        "id", F.when(F.col("id") % 2 == 0, F.lit("hot")).when(F.col("id") % 5 > 0, F.concat(F.lit("g"), (F.col("id") % 300).cast("string"))).alias("g"),
        F.when(F.col("id") % 1000 > 0, -F.col("id")).alias("o")), tmp_path / "ranks")
    plain, sorted_rows, sort = keyed.group_rank(df, ["g"], ["o", "id"], "r"), [], keyed.sorted_rank
    monkeypatch.setattr(keyed, "WINDOW_ROWS", 500)
    monkeypatch.setattr(keyed, "sorted_rank", lambda rows, *rest: sorted_rows.append(rows.count()) or sort(rows, *rest))
    split_up = keyed.group_rank(df, ["g"], ["o", "id"], "r")
    assert 2000 <= sorted_rows[0] < 4000
    groups = {}
    for r in df.collect():
        groups.setdefault(r.g, []).append((r.o is not None, r.o, r.id))
    want = {key[2]: n for keys in groups.values() for n, key in enumerate(sorted(keys), 1)}
    assert {r.id: r.r for r in plain.collect()} == want == {r.id: r.r for r in split_up.collect()}


def test_names_without_look_alikes_are_not_sorted_again(spark, monkeypatch):
    counted = []
    for name in ("sorted_rank", "number_rank"):
        rank = getattr(processed, name)
        monkeypatch.setattr(processed, name, lambda rows, *rest, rank=rank: counted.append(rows.count()) or rank(rows, *rest))
    rows = [(i, f"{i % 40}/x{i % 7}.jpg") for i in range(300)] + [(300, "0/b_001.jpg"), (301, "1/b.jpg"), (302, "2/c_000456.jpg"), (303, "3/c.jpg"), (304, "4/c.jpg")]
    names = {r.path: r.name for r in processed.destination_names(spark.createDataFrame(rows, "i int, path string"), "path", "i").collect()}
    assert counted == [0, 0] and len(set(names.values())) == len(names) == len({p for _, p in rows})
    assert names["3/c.jpg"] == "c.jpg" and names["4/c.jpg"] == "c_001.jpg" and names["7/x0.jpg"] == "x0_001.jpg"


def test_names_of_large_buckets(spark, monkeypatch):
    from test_operators import plain_names

    monkeypatch.setattr(keyed, "WINDOW_ROWS", 20)
    rng = random.Random(3)
    paths = [f"{rng.randrange(90)}/{rng.choice(['a.jpg', 'a_002.jpg', 'a_003.jpg', 'b.tif', 'c.png', 'c_001.png', f'd{rng.randrange(50)}.jpg'])}" for _ in range(700)]
    df = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    assert {r.path: r.name for r in processed.destination_names(df, "path", "i").collect()} == plain_names(paths)


def test_blank_tests_agree(spark):
    texts = [None, "", " ", "\t\n", " 　", "\x1c\x85", " a", "​", "x\n", "\n/", "a/b", "\U0001f600", "  .", "a/b\n", "b/\n", "/", "a//c.jpg"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select(is_not_blank("t").alias("a"), blank_to_null("t").isNotNull().alias("b"),
                       file_name("t").alias("f"), F.regexp_extract("t", r"([^/]*)$", 1).alias("g")).collect():
        assert r.a == r.b and r.f == r.g
