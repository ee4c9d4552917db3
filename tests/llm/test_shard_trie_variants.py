"""Sharding, conversation trie and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from specimen_spark.llm import sharding, trie, variants
from specimen_spark.llm.queries import QUERIES, TRIE_SQL, VARIANTS_SQL
from specimen_spark.session import scratch_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# -- sharding -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def records(spark):
    rows = [(i, f"text {i} " * (i % 7)) for i in range(700)] + [(None, None)] * 300 + [(5, "same")] * 200 + [(6, ""), (7, "é" * 50_000)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("mine")).withColumn("bucket", F.lit(9)).withColumn("key", F.lit(1))
    path = scratch_path(spark, "records")
    frame.repartition(6).write.parquet(path)
    return spark.read.parquet(path)


def test_shards_hold_every_record_once_and_differ_by_one(spark, records):
    target = scratch_path(spark, "shards")
    sharding.write_shards(records, target, 24, seed=3, bucket_bytes=4_000)
    back = sharding.read_shards(spark, target, records.schema)
    assert {"bucket", "key"} <= set(back.columns)
    rows = [r.asDict() for r in sharding.ledger(back).collect()]
    wanted = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in records.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == wanted
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert sorted(slots) == list(range(24))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_shuffle_scatters_by_seed_and_mixes_each_bucket(spark):
    path = scratch_path(spark, "plain")
    spark.range(0, 4_000, 1, 5).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")).write.parquet(path)
    docs = spark.read.parquet(path)
    buckets = {r["record"]["doc_id"]: r["bucket"] for r in sharding.scatter(docs, 8, 11).collect()}
    assert len(set(buckets.values())) == 8 and max(Counter(buckets.values()).values()) < 4_000 / 8 * 1.3
    order = [r["doc_id"] for r in sharding.shuffled(docs, 3, 8, 11).orderBy("shard", "slot").collect()]
    assert sorted(order) == list(range(4_000))
    # One bucket after another, each in an order of its own that is neither sorted nor that of another seed.
    runs = [buckets[i] for i in order]
    assert runs == sorted(runs)
    for b in range(8):
        own = [i for i in order if buckets[i] == b]
        rising = sum(x < y for x, y in zip(own, own[1:])) / len(own)
        assert 0.35 < rising < 0.65
        assert abs(sum(own[:len(own) // 2]) / (len(own) // 2) - 2_000) < 400
    again = [r["doc_id"] for r in sharding.shuffled(docs, 3, 8, 11).orderBy("shard", "slot").collect()]
    other = [r["doc_id"] for r in sharding.shuffled(docs, 3, 8, 12).orderBy("shard", "slot").collect()]
    assert again == order and other != order


def test_shards_of_few_records_and_of_none(spark, records):
    for n in (0, 3):
        docs = spark.read.parquet(records.inputFiles()[0]).limit(n)
        path, target = scratch_path(spark, "few"), scratch_path(spark, "few-shards")
        docs.write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path)
        sharding.write_shards(docs, target, 24)
        assert sharding.read_shards(spark, target, docs.schema).count() == n


def test_sharding_plan_has_no_python_and_moves_records_once(spark, records):
    plan = sharding.shuffled(records, 24, 9, 1)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert len(re.findall(r"Exchange shufflepartitionid", plan)) == 2 and "ShuffledHashJoin" in plan


def test_query_over_whole_table(spark):
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    rows = QUERIES["op13_sharding"](spark, SF).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip(table["doc_id"], table["text"])}


# -- conversation trie --------------------------------------------------------------------------------------------


def brute_trie(rows):
    """Nodes by plain prefixes of rebuilt conversations (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - c % 20, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = sum(saved[q] for q in children[p]) + (len(members[p]) - 1) * (len(WORD.findall(p[-1][1])) if p else 0)
    return sorted([(
        min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(m) if len(built[c]) == len(p)).encode()).hexdigest()) for p, m in members.items()], key=str)


def conversations(seed, n=160):
    rng, rows = random.Random(seed), []
    for c in range(n):
        if rng.random() < 0.9:  # else absent, also as an opening
            for t in range(rng.choice([1, 1, 2, 3, 4, 6])):
                rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, ""]), rng.choice(["x  y", "z", "", None]) if t else "hi you there"))
    long = [(500 + k, t, "user", f"turn {t}") for k in range(5) for t in range(60 + k)]
    hot = [(2_000 + k, t, "user", "same words") for k in range(300) for t in range(3)]
    return rows + long + hot + [(None, 1, "user", "lost"), (900, 1, "user", "twice"), (900, 1, "user", "twice")]


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("partition_bytes", [8 << 20, 2_000, 300])
def test_trie_matches_plain_prefixes(spark, partition_bytes):
    rows = conversations(5)
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("depth", F.lit("mine")).withColumn("key", F.lit(1))
    found = trie.trie(trie.rebuild(frame), partition_bytes).select(*COLUMNS)
    assert rows_of(found) == brute_trie(rows)


def test_trie_sql_matches_plain_prefixes():
    rows = conversations(6)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(TRIE_SQL).fetchall(), key=str) == brute_trie(rows)


def test_forest_of_partitions_adds_up():
    """Nodes of one forest, and of its paths cut anywhere: partial sums of shared nodes add up to the same."""
    rng = random.Random(2)
    step = {x: hashlib.md5(x.encode()).digest() + bytes([0, 0, 0, 1 + i]) for i, x in enumerate("abc")}
    paths = sorted({b"".join(step[rng.choice("abc")] for _ in range(rng.randrange(7))) for _ in range(90)})
    n = [rng.randrange(1, 5) for _ in paths]
    alone = [rng.randrange(2) for _ in paths]
    ids = list(range(len(paths)))

    def summed(cuts):
        out = defaultdict(lambda: [10 ** 9, 0, 0, 0, 0])
        for low, high in zip([0, *cuts], [*cuts, len(paths)]):
            before = trie.common_depth(paths[low - 1], paths[low]) if low else -1
            after = trie.common_depth(paths[high - 1], paths[high]) if high < len(paths) else -1
            forest = trie.Forest(paths[low:high], n[low:high], ids[low:high], alone[low:high], [None] * (high - low), before, after)
            for first, _, depth, total, least, children, leaves, saved, _, _ in forest.build():
                node = out[paths[low + first][:trie.STEP * depth]]
                node[0] = min(node[0], least)
                for k, x in enumerate((total, children, leaves, saved), 1):
                    node[k] += x
        return dict(out)

    whole = summed([])
    assert len(whole) == len({p[:trie.STEP * d] for p in paths for d in range(len(p) // trie.STEP + 1)})
    for _ in range(30):
        assert summed(sorted(rng.sample(range(1, len(paths)), rng.randrange(1, 8)))) == whole


def test_trie_of_nothing_and_of_one(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).count() == 0
    one = [(20, None, None, None)]
    assert rows_of(trie.conversation_trie(spark.createDataFrame(one, schema)).select(*COLUMNS)) == brute_trie(one)


# -- spelling variants --------------------------------------------------------------------------------------------


def brute_variants(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= 5}
    letters = {x for w in n for x in w}
    near = {}
    for w in n:
        edits = {w[:k] + w[k + 1:] for k in range(len(w))}
        edits |= {w[:k] + x + w[k + gone:] for k in range(len(w) + 1) for x in letters for gone in (0, 1)}
        near[w] = [v for v in edits if v != w and v in n]
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n[form[w]] if form[w] else None, root))
    return sorted(out, key=str)


VARIANTS = ["word", "n", "n_near", "form", "form_n", "root"]


def misspelled(seed):
    """Words with chains of ever rarer variants, many of one stem, and long ones."""
    rng = random.Random(seed)
    letters, rows = "abcdeéü÷", []

    def edit(w):
        k, x = rng.randrange(len(w) + 1), rng.choice(letters)
        return rng.choice([w[:k] + x + w[k:], w[:k] + w[k + 1:], w[:k] + x + w[k + 1:]])

    bag = []
    for _ in range(25):
        w = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 12)))
        bag += [w] * 800
        for _ in range(8):
            v = edit(w)
            bag += [v] * rng.choice([5, 30, 150]) + [edit(v)] * rng.choice([4, 5, 25])
    stems = ["station" + a + b + end for a in letters for b in letters for end in ("ing", "er", "")]
    bag += [s.upper() if rng.random() < 0.2 else s for s in stems for _ in range(rng.choice([5, 6, 40]))]
    bag += ["z" * 3_000] * 6 + ["z" * 3_001] * 31 + ["aaaaaa", "aaaaaaa", "aaaaaaaa"] * 9
    rng.shuffle(bag)
    for i in range(0, len(bag), 40):
        rows.append((None if rng.random() < 0.05 else i, rng.choice([" ", "\n", "1", "-"]).join(bag[i:i + 40])))
    return rows + [(1, None), (2, ""), (3, " \n"), rows[0], rows[0]]


@pytest.fixture(scope="module")
def spelled():
    rows = misspelled(8)
    return rows, brute_variants(rows)


def test_variants_match_brute_force(spark, spelled):
    rows, expected = spelled
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("word", F.lit("mine")).withColumn("n", F.lit(3))
    found = variants.spelling_variants(docs).select(*VARIANTS)
    assert rows_of(found) == expected
    assert any(r[5] not in (r[0], r[3]) for r in expected), "a chain of two forms is there"


def test_large_buckets_lose_no_link(spark, spelled):
    """Cut again and again, buckets give the links that whole ones give, each once."""
    rows, expected = spelled
    words = spark.createDataFrame([r[:2] for r in expected], "word string, n bigint")
    whole = rows_of(variants.links(words, bucket_pairs=10 ** 9))
    for limit in (0, 3, 40):
        assert rows_of(variants.links(words, bucket_pairs=limit)) == whole
    assert len(set(whole)) == len(whole) and 2 * len(whole) == sum(r[2] for r in expected)


def test_variants_sql_matches_brute_force(spelled):
    rows, expected = spelled
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    names = [c[0] for c in con.execute(VARIANTS_SQL).description]
    found = con.execute(VARIANTS_SQL).fetchall()
    assert sorted([tuple(r[names.index(c)] for c in VARIANTS) for r in found], key=str) == expected


def test_variants_of_nothing(spark):
    assert variants.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
