"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute_force import brute_components, brute_removed
from specimen_spark.llm import ann, bpe, langid, lm, minhash, packing, quality, shingles, suffix, urls, warc
from specimen_spark.llm.components import components
from specimen_spark.llm.queries import QUALITY_SQL, QUERIES, URL_RULES, URL_SQL, WARC_SQL, vocabulary

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Null ids and texts, empty and blank texts, one word, repeated rows, equal texts, a very long text, odd characters.
ODD = [
    (None, "no id but some words here", "en"), (1, None, "en"), (2, "", None), (3, " \n\t ", "fr"), (4, "one", "en"),
    (5, "one two", "en"), (6, "one two", "de"), (7, "a b c " * 30_000, "en"), (8, "x" * 200_000, None), (8, "x" * 200_000, None),
    (9, "é ü 漢字 😀     #$% <|endoftext|> Á ΑΣ", "fr"), (10, "12 34 !!", "en"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in ODD]
    # An extra column, and ones named like results.
    return spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("block", F.lit(2))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts():
    table = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return dict(zip(table["doc_id"], table["text"]))


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# -- components -------------------------------------------------------------------------------------------------


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (None, 3)]
    parent = list(range(500))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: root(i) for i in range(500) if root(i) != i}


# -- quality ----------------------------------------------------------------------------------------------------


def duck(**tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame.toPandas() if hasattr(frame, "toPandas") else frame)
    return con


def test_ledger_of_odd_texts(odd, empty):
    rows = quality.ledger(odd).where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    got = by_id(rows, "n_words", "word_chars", "n_repeat_words")
    assert got[1] == got[2] == got[3] == (0, 0, 0)
    assert got[7] == (90_000, 90_000, 90_000) and got[8] == (1, 200_000, 0)
    assert quality.ledger(odd).count() == len(ODD) and quality.ledger(empty).count() == 0


def test_ledger_matches_sql_on_odd_texts(spark, odd):
    docs = odd.where("doc_id IS NOT NULL AND length(text) < 1000")
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    mine = sorted(quality.ledger(docs).select(*names).collect())
    con = duck(documents=docs.select("doc_id", "text"))
    assert [tuple(r) for r in mine] == sorted(con.execute(f"SELECT {', '.join(names)} FROM ({QUALITY_SQL})").fetchall())


def test_policies_and_ablations(spark):
    marked = spark.createDataFrame([(0,), (1,), (2,), (3,), (4,), (256,)], "fail_bits bigint")
    rejected = [r[0] for r in marked.select(quality.rejected_by("base")).collect()]
    assert rejected == [False, True, True, True, False, False]
    got = {r["rule"]: (r["n_failing"], r["n_only_this"], r["n_rejected"]) for r in quality.ablations(marked, "base").collect()}
    assert got == {"too_few_words": (2, 1, 3), "repeated_words": (2, 1, 3)}


@pytest.mark.parametrize("policy", quality.POLICIES)
def test_ablations_over_the_table_match_sql(spark, policy):
    got = quality.ablations(QUERIES["op9_quality_rules"](spark, SF), policy).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    con.execute(f"CREATE TABLE marked AS SELECT fail_bits & {quality.mask(policy)} AS bits FROM ({QUALITY_SQL})")
    assert sorted(r["rule"] for r in got) == sorted(quality.POLICIES[policy])
    for r in got:
        bit = 1 << quality.RULES.index(r["rule"])
        want = con.execute(f"SELECT count(*) FILTER (bits & {bit} <> 0), count(*) FILTER (bits = {bit}), count(*) FILTER (bits <> 0) FROM marked").fetchone()
        assert (r["n_failing"], r["n_only_this"], r["n_rejected"]) == want


def test_bits_stored_with_documents_decide_every_policy(odd):
    stored = quality.with_bits(odd.withColumn("fail_bits", F.lit("mine")))
    for policy in quality.POLICIES:
        kept = stored.where(~quality.rejected_by(policy)).select(*odd.columns)
        assert sorted(map(str, kept.collect())) == sorted(map(str, quality.filter_documents(odd, policy).collect()))


def test_filter_keeps_clean_documents(spark, texts):
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    good = [i for i, q, t in zip(labels["doc_id"], labels["quality"], labels["toxic"]) if q == 1 and len(texts[i].split()) >= 50]
    bad = [i for i, q in zip(labels["doc_id"], labels["quality"]) if q == 0]
    kept = by_id(QUERIES["op9_quality_rules"](spark, SF), "kept")
    assert all(kept[i][0] for i in good)
    assert sum(not kept[i][0] for i in bad) >= 0.9 * len(bad)


# -- language ---------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    lang = dict(zip(*(pq.read_table("/root/testdata/sf0.01/documents.parquet")[c].to_pylist() for c in ("doc_id", "lang"))))
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_odd_texts(odd, empty):
    model = langid.learn(odd)
    rows = langid.predict(odd, model).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id for r in rows if r.lang_pred == "und"} >= {1, 2, 3, 10}
    assert langid.predict(empty, langid.learn(empty)).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, langid.learn(empty)).collect()} == {"und"}
    assert langid.filter_documents(odd, model, 0.5).columns == odd.columns


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    sizes = np.array([7, 4, 1])
    scores = rng.normal(size=(12, 3)).astype(np.float32)
    starts = np.cumsum(sizes) - sizes
    got = langid.viterbi(scores, starts, sizes, 0.7)
    for start, size in zip(starts, sizes):
        def value(path):
            return sum(scores[start + i, l] for i, l in enumerate(path)) - 0.7 * sum(a != b for a, b in zip(path, path[1:]))
        best = max((value(p) for p in np.ndindex(*[3] * size)))
        assert value(got[start:start + size]) == pytest.approx(best, abs=1e-4)


def test_mixed_text_is_labelled_by_spans():
    model = langid.Model(["a", "b"], np.stack([np.where(np.arange(langid.BUCKETS + 13) % 2, 9, 1), np.where(np.arange(langid.BUCKETS + 13) % 2, 1, 9)]))
    lang, score, words, spans = langid.Labeller(model, 3.0).label([["word"] * 10])[0]
    assert words == 10 and spans == 1 and score == 1.0


# -- near duplicates --------------------------------------------------------------------------------------------


def test_near_duplicates_match_brute_force(spark, texts):
    got = by_id(QUERIES["op1_minhash_near_dedup"](spark, SF), "n_shingles", "component_id", "kept")
    assert got == brute_components(texts, 3, 85, 100)


@pytest.mark.parametrize("star_bytes", [16 << 20, 0])
def test_strays_of_a_star_are_linked(spark, monkeypatch, star_bytes):
    """Versions drift away from the first one, so that links exist that the first one has no part in."""
    monkeypatch.setattr(minhash, "STAR_BYTES", star_bytes)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(220)]
    texts = {}
    n = 60 if star_bytes else 9  # every round of an unbounded star is a set of jobs
    for i in range(n):
        own = list(words)
        for _ in range(rng.randrange(0, 9)):
            own[rng.randrange(220)] = f"x{rng.randrange(40)}"
        texts[i] = " ".join(own)
    drift = list(words)
    for i in range(60, 75 if star_bytes else 66):
        for _ in range(2):
            drift[rng.randrange(220)] = f"d{i}"
        texts[i] = " ".join(drift)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = by_id(minhash.near_duplicates(docs, 3, 85, 100), "n_shingles", "component_id", "kept")
    assert got == brute_components(texts, 3, 85, 100)
    assert len({v[1] for v in got.values()}) < len(got)


def test_near_duplicates_of_odd_texts(odd, empty):
    got = by_id(minhash.near_duplicates(odd).where("doc_id IS NOT NULL"), "n_shingles", "component_id", "kept")
    assert got[1] == (0, 1, True) and got[6] == (1, 5, False) and got[5] == (1, 5, True)
    assert minhash.near_duplicates(odd).count() == len(ODD) and minhash.near_duplicates(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    pool = shingles.mix(rng.integers(0, 1 << 62, 3000).astype(np.uint64))
    for shared in (100, 400):
        a, b = np.unique(pool[:600]), np.unique(np.concatenate([pool[:shared], pool[600:1200 - shared]]))
        signs = shingles.signatures([a, b, a[:3]], 120)
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(np.mean(signs[0] == signs[1]) - true) < 0.15
        assert np.isfinite(signs).all()


# -- repeated passages ------------------------------------------------------------------------------------------


def test_removal_matches_brute_force(spark, texts):
    rows = [(i, t or "") for i, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = suffix.remove_repeats(docs, block_bytes=60_000)  # several blocks
    want = brute_removed(rows)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.collect()) == want
    got = QUERIES["op6_suffix_array_dedup"](spark, SF).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == [(*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want]


@pytest.mark.parametrize("size, letters", [(60, 1), (400, 2), (3000, 2), (3000, 200)])
def test_pointers_tell_suffixes_apart_as_their_bytes_do(size, letters):
    rng = np.random.default_rng(size + letters)
    data = rng.integers(0, letters, size, dtype=np.uint8)
    data[-size // 3:] = data[:-(-size // 3)]  # a long repeat
    span = np.arange(size) // 100  # owners are those of a whole span, and strings end inside it
    low = rng.integers(0, 9, size)[span].astype(np.int32)
    high = low + (rng.random(size) < 0.2)[span].astype(np.int32)
    string = np.flatnonzero((rng.random(size) < 0.8) & (np.arange(size) % 100 <= 50) & (np.arange(size) <= size - suffix.LENGTH))
    least = suffix.refine(suffix.words_of(data), string, low, high)
    first = {}
    for s in string.tolist():
        key = data[s:s + suffix.LENGTH].tobytes()
        first[key] = min(first.get(key, 99), low[s])
    assert least.tolist() == [first[data[s:s + suffix.LENGTH].tobytes()] for s in string.tolist()]


@pytest.mark.parametrize("hot_spans", [2, 20])
def test_hot_anchors_lose_nothing(spark, hot_spans):
    """A phrase in many surroundings, some of them shared."""
    rng = random.Random(5)
    phrase = "".join(rng.choice("abcde ") for _ in range(60))
    sides = ["".join(rng.choice("abcde ") for _ in range(40)) for _ in range(60)]
    rows = [(i, rng.choice(sides) + phrase[rng.randrange(9):rng.randrange(35, 60)] + rng.choice(sides)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = suffix.remove_repeats(docs, block_bytes=9000, hot_spans=hot_spans)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.collect()) == brute_removed(rows)


def test_anchors_are_hot_by_their_surroundings():
    rng = random.Random(6)
    phrase, side = "the same words that many have in common, as they are", lambda: "".join(rng.choice("abcde ") for _ in range(60))
    one = side()
    copies = suffix.Block(pa.table({"doc_id": list(range(90)), "text": [one + phrase + one] * 90}))
    mixed = suffix.Block(pa.table({"doc_id": list(range(90)), "text": [side() + phrase + side() for _ in range(90)]}))
    for block, some in ((copies, False), (mixed, True)):
        h, _, first, count = block.runs()
        assert bool(len(suffix.hot_anchors(block.words, h, first, count, 64))) == some


def test_repeated_rows_and_ids_are_spread_over_blocks(spark):
    rng = random.Random(3)
    line = "".join(rng.choice("abcd ") for _ in range(400))
    rows = [(7, line)] * 300 + [(i, line[i:i + 120] + str(i) * 40) for i in range(8, 60)] + [(None, line)] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = suffix.remove_repeats(docs, block_bytes=9000).collect()
    assert all(r.n_removed == 0 for r in cut if r.doc_id in (7, None)) and len(cut) == len(rows)
    want = {w[0]: w[2] for w in brute_removed([(7, line), *rows[300:352]])}
    assert {r.doc_id: r.n_removed for r in cut if r.doc_id is not None} == want


def test_removal_of_made_up_repeats(spark):
    rng = random.Random(8)
    line = "".join(rng.choice("abcdé ") for _ in range(300))
    rows = [(i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(120))) + line[rng.randrange(100):][:rng.randrange(40, 200)]
             + rng.choice("xyz") * rng.randrange(80)) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    cut = suffix.remove_repeats(docs, block_bytes=2000)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.collect()) == brute_removed(rows)


def test_removal_from_odd_texts(odd, empty):
    cut = suffix.remove_repeats(odd, as_text=True)
    assert cut.count() == len(ODD)
    got = by_id(cut.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), "n_bytes", "n_removed")
    assert got[1] == (0, 0) and got[8] == (200_000, 0) and got[7] == (180_000, 0)
    assert suffix.remove_repeats(empty).count() == 0


# -- packing ----------------------------------------------------------------------------------------------------


def check_packing(rows, capacity=1024):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= capacity
    total = sum(r.length for r in rows)
    return by_doc, len(by_sequence), -(-total // capacity)


def test_packing_round_trip(spark, texts):
    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = QUERIES["op8_best_fit_packing"](spark, SF).collect()
    by_doc, used, least = check_packing(rows)
    assert used <= least * 1.02 + 1
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces = sorted(by_doc[i])
        assert [p[1] for p in pieces] == [0, *np.cumsum([p[2] for p in pieces])[:-1]] and sum(p[2] for p in pieces) == len(ids)
        assert len(pieces) == -(-len(ids) // 1024) and all(p[2] == 1024 for p in pieces[1:])
    crc = {(r.doc_id, r.piece): r.ids_crc32 for r in rows}
    some = next(i for i in texts if len(by_doc[i]) > 1)
    ids = np.array([*tokenizer.encode(texts[some], add_special_tokens=False).ids, 2], "<u4")
    for piece, start, length in by_doc[some]:
        assert crc[some, piece] == zlib.crc32(ids[start:start + length].tobytes())


def test_packing_of_odd_texts(odd, empty):
    placed = packing.pack(odd, vocabulary("byte_bpe_50k.json"))
    check_packing(placed.collect())
    assert placed.where("start = 0").count() == len(ODD)
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).count() == 0
    joined = packing.sequences(placed).collect()
    assert sum(len(r.ids) for r in joined) == 4 * sum(r.length for r in placed.collect())


def test_byte_encoder_matches_the_tokenizer():
    path = vocabulary("byte_bpe_50k.json")
    tokenizer, encode = Tokenizer.from_file(path), packing.ByteEncoder(path)
    odd = [t for _, t, _ in ODD if t and len(t) < 1000] + [
        "a  b", "a \nb", "a\n\nb c", " a", "a ", "I'll don't 's", "x y z\x1c q", "a \x85 b", "\x00a b", "a\tb c\rd", "1 22 333 a1b2 ,. !?"]
    for text in odd:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


# -- BPE --------------------------------------------------------------------------------------------------------


def test_trie_encoder_matches_the_tokenizer(spark, texts):
    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = by_id(QUERIES["op10_bpe_tokenizer"](spark, SF), "n_tokens", "ids_sha256", "decoded_sha256")
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert got[i] == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_trie_encoder_of_odd_texts(odd, empty):
    path = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(4)
    encoder = bpe.WordEncoder(path)
    made = ["".join(rng.choice("abeinorst'é漢1 .<|>") for _ in range(rng.randrange(60))) for _ in range(400)]
    odd_texts = [t for _, t, _ in ODD if t] + ["<|endoftext|", "<|startoftext|><|endoftext|>x", "áb ́", "\x1ca\x85b"] + made
    for text, (ids, decoded) in zip(odd_texts, encoder.encode_group(odd_texts)):
        true = tokenizer.encode(text, add_special_tokens=False).ids
        assert ids.decode() == " ".join(map(str, true)) and decoded.decode() == tokenizer.decode(true, skip_special_tokens=False)
    encoded = bpe.encode(odd.where("length(text) < 1000 OR text IS NULL"), path)
    assert bpe.decode(encoded, path).count() == encoded.count()
    assert bpe.digests(odd, path).count() == len(ODD) and bpe.digests(empty, path).count() == 0


# -- archives ---------------------------------------------------------------------------------------------------


def pages(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/", "same"), (3, None, None), (4, "http://c d/é", ""), (5, "x", "é" * 100_000),
            (None, "http://n/", "same"), (6, "http://e/", "only"), (6, "http://f/", "only"), (7, "http://g/", "a\r\n\r\nb\r\n")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))


def test_archives_round_trip(spark, tmp_path):
    found = {}
    for run in ("one", "two"):
        target = str(tmp_path / run)
        manifest = warc.write_archives(pages(spark), target, shard_bytes=50_000, roll_bytes=500)
        records = warc.read_archives(spark, target).collect()
        found[run] = sorted((r["name"], r["sha1"], r["records"]) for r in manifest.collect())
        kinds = sorted(((r.page_id or 0), r.record_type, r.refers_to, r.payload_bytes) for r in records)
        assert kinds == [(0, "revisit", 2, 4), (1, "revisit", 2, 4), (2, "response", None, 4), (3, "revisit", 4, 0), (4, "response", None, 0),
                         (5, "response", None, 200_000), (6, "response", None, 4), (6, "response", None, 4), (7, "response", None, 8)]
        payloads = {r.page_id: bytes(r.payload) for r in records if r.record_type == "response"}
        assert payloads[5] == ("é" * 100_000).encode() and payloads[7] == b"a\r\n\r\nb\r\n"
        assert not (tmp_path / run / "_tmp").exists()
    assert found["one"] == found["two"] and len(found["one"]) > 2  # deterministic, rolled


def test_archives_of_no_pages(spark, tmp_path):
    none = pages(spark).where("false")
    assert warc.write_archives(none, str(tmp_path / "w")).count() == 0
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_archive_sql_agrees_on_odd_pages(spark, tmp_path):
    rows = pages(spark).where("page_id IS NOT NULL")
    warc.write_archives(rows, str(tmp_path / "w"))
    mine = warc.read_archives(spark, str(tmp_path / "w"), with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", [(r.page_id, r.html) for r in rows.collect()])
    assert sorted(map(str, map(tuple, mine.collect()))) == sorted(map(str, con.execute(WARC_SQL).fetchall()))


# -- nearest neighbours -----------------------------------------------------------------------------------------


def test_neighbours_recall_and_order(spark):
    table = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    x, ids = np.array(table["embedding"], np.float64), np.array(table["vec_id"])
    rows = QUERIES["op5_nearest_neighbours"](spark, SF).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = 0
    assert set(got) == {i for i in ids.tolist() if i % 20 == 0}
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        inner = x @ x[np.flatnonzero(ids == q)[0]]
        inner[ids == q] = -np.inf
        true = ids[np.lexsort((ids, -inner))[:20]]
        hits += len(set(true) & {f[1] for f in found})
        for _, v, score in found:
            assert score == pytest.approx(inner[np.flatnonzero(ids == v)[0]], abs=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_neighbours_of_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [None, 1.0]), (6, [float("nan"), 1.0]),
            (7, [float("inf"), 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [-1.0, 5.0])]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in ann.search(vectors).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 9, -1.0), (20, 1, 9, 10.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert ann.search(vectors.where("false")).count() == 0


def test_neighbours_of_repeated_queries(spark):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.standard_normal((300, 8)))]
    rows += [rows[20]] + [rows[40]] * 2 + [rows[60]] * 150 + [(80, rng.standard_normal(8).tolist())]
    vectors = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in ann.search(vectors, target=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == set(range(0, 300, 20))
    recall = 0
    for q, found in got.items():
        asks = np.array(min(v for i, v in rows if i == q))
        scores = sorted((-float(np.dot(v, asks)), i) for i, v in rows if i != q)
        assert [n for n, _ in found] == list(range(1, 21)) and q not in {i for _, i in found}
        if q in (20, 40, 80):  # repeats of 60 are neighbours of their own to other queries
            assert len({i for _, i in found} - {60}) + sum(i == 60 for _, i in found) == 20
        recall += len({i for _, i in scores[:20]} & {i for _, i in found}) / len({i for _, i in scores[:20]})
    assert recall >= 0.9 * len(got)


# -- url filters ------------------------------------------------------------------------------------------------


def test_url_filter_matches_sql(spark):
    link = '<LINK href="{}" rel="canonical">'
    rows = [
        (1, "http://Example.COM/en/x", None), (2, "http://www.example.com/en/x?y=1", ""), (3, "https://a.net/es/1", None),
        (4, "http://alias.org/1", link.format("https://a.net/es/1#top")), (5, "http://alias.org/2", link.format("/1")),
        (6, "http://both.org/", link.format("http://www.example.com/en/x?y=1") + '<meta http-equiv="refresh" content="0; url=https://a.net/es/1">'),
        (7, None, link.format("https://a.net/es/1")), (8, "no scheme", None), (9, "http://net", None), (10, "http://x.net/fr/#a", None),
        (11, "http://alone.org/", None), (12, "http://alias.org/1", None), (None, "http://alias.org/2", None), (13, "http://notcom.org/en/", None),
    ]
    pages_df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("rule", F.lit("mine")).withColumn("host", F.lit(1))
    mine = urls.judge_urls(pages_df, urls.rule_table(spark, URL_RULES))
    verdicts = {r.page_id: (r.rule, r.verdict) for r in mine.collect()}
    assert verdicts[1] == ("example.com/en/", "block") and verdicts[2] == ("www.example.com/en/", "allow")
    assert verdicts[4] == (None, "allow")  # connected with an allowed page through 6
    assert verdicts[11] == (None, "allow") and verdicts[8] == (None, "allow")
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    order = sorted(mine.columns)
    theirs = con.execute(f"SELECT {', '.join(order)} FROM ({URL_SQL})").fetchall()
    assert sorted(map(str, map(tuple, mine.select(*order).collect()))) == sorted(map(str, theirs))
    alone = urls.judge_urls(pages_df.where("page_id <> 6"), urls.rule_table(spark, URL_RULES))
    blocked = {r.page_id for r in alone.collect() if r.verdict == "block"}
    assert blocked == {1, 3, 4, 5, 10, 12}
    given = spark.createDataFrame([("http://alone.org/", "https://a.net/es/1")], "src string, dst string")
    assert urls.judge_urls(pages_df, urls.rule_table(spark, URL_RULES), given).where("page_id = 11").first().verdict == "allow"
    assert urls.judge_urls(pages_df.where("false"), urls.rule_table(spark, URL_RULES)).count() == 0


def test_link_targets_are_resolved(spark):
    page = "http://h.org/dir/page1?q=1#f"
    cases = {
        "//www.net/es/x": "http://www.net/es/x", "page2.html": "http://h.org/dir/page2.html", "/go?next=https://a.net/es/1": "http://h.org/go?next=https://a.net/es/1",
        "?p=2": "http://h.org/dir/page1?p=2", "../x/./y": "http://h.org/x/y", "../../..": "http://h.org/", "./": "http://h.org/dir/",
        "HTTPS://a.net/es/../fr/1": "HTTPS://a.net/fr/1", "go?to=http://a.net/../b": "http://h.org/dir/go?to=http://a.net/../b", "mailto:a@b.net": None,
    }
    html = "".join(f'<link href="{t}" rel="canonical">' for t in cases)
    html = "<link rel=canonical><meta http-equiv=refresh content=5>" + html + "<link rel='alternate canonical' href='http://second.org/'>"
    html += '<link rel="canonical-not" href="http://no.org/"><link rel=stylesheet href="http://no.org/2">'
    html += "<meta content='0; url=/r1' http-equiv=refresh><meta http-equiv='Refresh' content='1; URL=http://r.org/2'>"
    pages = spark.createDataFrame([(page, html), ("http://bare.org", "<link rel=canonical href=x>")], "url string, html string")
    got = {(r.src, r.dst) for r in urls.link_edges(pages).collect()}
    want = {(page, d) for d in cases.values() if d} | {(page, d) for d in ("http://second.org/", "http://h.org/r1", "http://r.org/2")}
    assert got == want | {("http://bare.org", "http://bare.org/x")}


def test_url_verdicts_follow_resolved_links(spark):
    rows = [(1, "http://a.org/1", '<link rel="canonical" href="//www.net/es/x">'), (2, "http://b.org/dir/page1", "<link rel=canonical href=page2.html>"),
            (3, "http://b.org/dir/page2.html", "<meta http-equiv=refresh content='0; url=http://a.net/fr/1'>"),
            (4, "http://c.org/1", "<link rel=canonical href='/go?next=https://a.net/es/1'>"), (5, "http://b.org/page2.html", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    verdicts = {r.page_id: r.verdict for r in urls.judge_urls(pages, urls.rule_table(spark, URL_RULES)).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow"}


def test_url_filter_runs_no_python(spark):
    plan = QUERIES["op7_url_filters"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# -- language model ---------------------------------------------------------------------------------------------


def test_scores_match_the_base_and_beat_it(spark):
    sf = "/root/testdata/sf0.01"
    table = pq.read_table(f"{sf}/documents.parquet").to_pydict()
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in zip(table["doc_id"], table["text"])}
    held = {i for i in tokens if zlib.crc32(str(i).encode()) % 10 == 0}
    counts = Counter(w for i, ws in tokens.items() if i not in held for w in ws)
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op3_lm_scores"](spark, sf).collect()
    assert len(rows) == len(tokens)
    for r in rows:
        ws = tokens[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(w in counts for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel=1e-9)
        assert -1e9 < r.score < 0 and r.bits_per_byte > 0
    mine, base = (sum(getattr(r, c) for r in rows if r.held_out) for c in ("score", "base_score"))
    assert mine > base


def small_mixer(words, n, rounds=20):
    table = np.zeros(2 << 18, np.float32)
    lm.add_bits(table, 18, words, np.array(n))
    mixer = lm.Mixer(*lm.packed(table.reshape(2, -1)))
    for _ in range(rounds):
        mixer.learn(words, np.array(n), np.zeros(lm.Mixer.GATES))
    return mixer


def test_bit_probabilities_add_up():
    mixer = small_mixer([b"abc", b"abd", b"b"], [3, 1, 7])
    total = 0
    for a in range(256):
        data = lm.Bytes([bytes([a])])
        total += math.prod(float(p if bit[0] else 1 - p) for bit, slots in data.bits(18) for p in mixer.predict(*mixer.inputs(slots))[1])
    assert total == pytest.approx(1, abs=1e-9)


def test_context_counts_are_those_of_all_running_text():
    """Words counted with their number of occurrences give what counting every occurrence gives."""
    text = b"aba abc aba b aba abc".split()
    once, every = np.zeros(2 << 18, np.float32), np.zeros(2 << 18, np.float32)
    counts = Counter(text)
    lm.add_bits(once, 18, list(counts), np.array(list(counts.values())))
    lm.add_bits(every, 18, text, np.ones(len(text)))
    assert np.array_equal(once, every) and every.sum() == sum(len(w) + 1 for w in text) * 8 * lm.CONTEXTS
    assert lm.COUNTS[lm.packed(np.arange(33))].tolist() == list(range(33))
    large = np.array([40.0, 1e3, 1e6, 1e9])
    assert np.all(np.abs(lm.COUNTS[lm.packed(large)] / large - 1) < 0.09)


def plain_spelling(mixer, word, own=0):
    """log10 of a word's probability, bit by bit and context by context, ``own`` counts taken out."""
    mask, total, data = (1 << 64) - 1, 0.0, lm.spelling(word)
    for place, byte in enumerate(data):
        before = [data[place - back] + 1 if place >= back else 0 for back in range(1, 6)]
        contexts = [((sum(x << 9 * i for i, x in enumerate(before[:back])) + (back << 50)) * int(lm.K)) & mask for back in (5, 3, 2, 1)]
        for k in range(7, -1, -1):
            node, bit = (((1 << (7 - k)) | (byte >> (k + 1))) * int(lm.K2)) & mask, (byte >> k) & 1
            slots = [(((c ^ node) * int(lm.K)) & mask) >> (64 - mixer.slot_bits) for c in contexts]
            zeros, ones = [[max(float(lm.COUNTS[t[s]]) - own * (bit == b), 0.0) for s in slots] for b, t in enumerate((mixer.zeros, mixer.ones))]
            seen = [z + o for z, o in zip(zeros, ones)]
            steps = [min(math.ceil(math.log2(s + 1)), 7) for s in seen]
            three = min(steps[1], 5)
            x = sum(w * math.log((o + 0.2) / (z + 0.2)) for w, z, o in zip(mixer.weights[steps[0] * 6 + three], zeros, ones))
            x = min(max(x, -11.9), 11.9)
            at = (min(max(x, -8), 7.999) + 8) * 2
            low, share = int(at), at - int(at)
            p = (1 / (1 + math.exp(-x)) + mixer.refined[three][low] * (1 - share) + mixer.refined[three][low + 1] * share) / 2
            p = min(max(p, 1e-6), 1 - 1e-6)
            total += math.log10(p if bit else 1 - p)
    return total


def test_scores_match_plain_python(spark):
    """score, token by token, from the weights the jobs learn: spelling, training share, history, gates."""
    rng = random.Random(9)
    bag = ["the", "cat", "sat", "été", "dog", "then", "cats"]
    rows = [(i, " ".join(rng.choice(bag) if rng.random() < 0.8 else "".join(rng.choice("abcé") for _ in range(5)) for _ in range(rng.randrange(30)))) for i in range(60)]
    rows += [(None, "the null id"), (3, rows[3][1]), (61, None), (62, "The THE the")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).cache()
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 10 == 0
    column = langid.fold("doc_id", 10) == 0
    words = lm.vocabulary(docs.where(~F.coalesce(column, F.lit(True)))).cache()
    counts = Counter(w for i, t in rows if not held(i) for w in [*lm.tokens_of(t), lm.END])
    assert {bytes(r.word): r.n for r in words.collect()} == counts
    n, (mixer, spelled) = sum(counts.values()), lm.learn_mixer(words, len(counts))
    by_key = {lm.key_of(w) - (1 << 64) * (lm.key_of(w) >> 63): w for w in counts}
    known = {by_key[r.key]: r.spelled for r in spelled.collect()}
    assert known.keys() == counts.keys()
    # One task learned, from the words in the order of their hashes, a few at a time: here step by step.
    ordered = [bytes(r.word) for r in words.orderBy(F.xxhash64("word", F.lit(7))).collect()]
    start = lm.Mixer(mixer.zeros, mixer.ones)
    for low in range(0, len(ordered), lm.Mixer.TOGETHER):
        some = ordered[low:low + lm.Mixer.TOGETHER]
        if not low:
            for w in some:  # the weights change after each bit of all of them, so only roughly the same
                assert known[w] == pytest.approx(plain_spelling(start, w, 1 + math.log2(counts[w])), rel=0.05)
        start.learn(some, lm.evidence(np.array([counts[w] for w in some])), np.zeros(lm.Mixer.GATES))
    assert np.allclose(start.weights, mixer.weights) and np.allclose(start.refined, mixer.refined)
    column_docs = docs.withColumn("held_out", F.coalesce(column, F.lit(True)))
    blocks = lm.numbered_blocks(column_docs, spelled, spark.sparkContext.broadcast(mixer), lm.BLOCK_BYTES)
    weights = lm.learn_blend(blocks, n).weights
    assert np.allclose(weights.sum(axis=1), 1)
    expected = []
    for i, text in rows:
        tokens, total, seen, follows, after, foreseen = [*lm.tokens_of(text), lm.END], 0.0, Counter(), Counter(), Counter(), False
        for place, w in enumerate(tokens):
            previous = tokens[place - 1] if place else None
            step = 1 + min(math.ceil(math.log2(after[previous] + 1)), 3) if place else 0
            experts = [counts[w] / n, 10 ** (known[w] if w in known else plain_spelling(mixer, w)), seen[w] / max(place, 1), follows[previous, w] / max(after[previous], 1)]
            total += math.log10(sum(a * b for a, b in zip(weights[step * 2 + foreseen], experts)))
            foreseen = follows[previous, w] > 0
            seen[w] += 1
            follows[previous, w] += 1
            after[previous] += 1
        expected.append((-1 if i is None else i, total))
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in lm.score(docs, column).collect())
    for (i, mine), (j, other) in zip(found, sorted(expected)):
        assert i == j and mine == pytest.approx(other, rel=1e-5)


def test_history_counts_what_came_before():
    history = lm.History(np.array([5, 6, 5, 6, 0, 5, 0]), np.array([5, 2]))
    assert history.share.tolist() == pytest.approx([0, 0, 0.5, 1 / 3, 0, 0, 0])
    assert history.following.tolist() == pytest.approx([0, 0, 0, 1, 0, 0, 0])


def test_scores_of_odd_texts(odd, empty):
    rows = lm.score(odd, langid.fold("doc_id", 10) == 0).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == sorted((i or 0, len(WORD.findall(t or "")) + 1) for i, t, _ in ODD)
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    assert len({r.score for r in rows if r.doc_id == 8}) == 1 and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert lm.score(empty, F.lit(False)).count() == 0
    assert all(r.n_known == 0 and math.isfinite(r.score) for r in lm.score(odd.where("doc_id < 6"), F.lit(True)).collect())


def test_one_id_for_all_rows_is_spread_over_blocks(spark):
    docs = spark.range(4_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit("some words " * 200).alias("text"))
    sizes = [r["count"] for r in lm.deal(docs, 500_000).groupBy("block").count().collect()]
    assert len(sizes) == 18 and max(sizes) < 2 * min(sizes)


def test_expected_counts_weigh_the_experts_once(monkeypatch):
    import numpy as np

    from specimen_spark.llm import lm

    rng = np.random.default_rng(4)
    blend, experts, gate = lm.Blend(rng.random((10, 4))), rng.random((4, 50)), rng.integers(0, 10, 50)
    part = blend.weights[gate].T * experts / blend.probability(experts, gate)
    want = np.stack([np.bincount(gate, p, 10) for p in part], axis=1)
    monkeypatch.setattr(lm.Blend, "probability", None)
    assert (blend.mass(experts, gate) == want).all()


def test_rounds_of_learning_are_those_of_mass(monkeypatch):
    """Tokens are sorted by gate once, and ``mass`` is not asked again for every round."""
    rng = np.random.default_rng(5)
    blend, experts, gate, before = lm.Blend(rng.random((10, 4))), rng.random((4, 900)), rng.integers(0, 9, 900), rng.random((10, 4))
    experts[:, :20] = 0
    want = blend
    for _ in range(lm.Blend.ROUNDS):
        mass = want.mass(experts, gate)
        want = lm.Blend(before + mass)
    monkeypatch.setattr(lm.Blend, "mass", None)
    found, own = blend.learned(experts, gate, before)
    assert np.allclose(found.weights, want.weights, rtol=1e-12) and np.allclose(own, mass, rtol=1e-12)


def test_history_sorts_twice(monkeypatch):
    """Words and pairs are sorted; what came before a token is known from the words. Gates and shares as counted one by one."""
    rng, sorts, argsort = np.random.default_rng(6), [], np.argsort
    sizes = np.array([1, 40, 3, 0, 200, 1])
    tokens = rng.integers(0, 6, sizes.sum())
    monkeypatch.setattr(np, "argsort", lambda *args, **kw: sorts.append(1) or argsort(*args, **kw))
    history = lm.History(tokens, sizes)
    assert len(sorts) == 2
    at = 0
    for size in sizes:
        seen, after, follows, foreseen = Counter(), Counter(), Counter(), False
        for place in range(size):
            word, previous = tokens[at], tokens[at - 1] if place else None
            step = 1 + min(math.ceil(math.log2(after[previous] + 1)), 3) if place else 0
            assert history.gate[at] == step * 2 + foreseen and history.share[at] == seen[word] / max(place, 1)
            assert history.following[at] == follows[previous, word] / max(after[previous], 1)
            foreseen = follows[previous, word] > 0
            seen[word] += 1
            after[previous] += 1
            follows[previous, word] += 1
            at += 1
    assert not len(lm.History(tokens[:0], sizes[:0]).gate)


def test_mixer_looks_once_for_both_counts():
    mixer = small_mixer([b"abc", b"abd", b"b"], [3, 1, 7])
    assert len(mixer.pairs) == 1 << 18 and mixer.zeros.dtype == mixer.ones.dtype == np.uint8
    fresh = mixer.untrained()
    assert fresh.pairs is mixer.pairs and (fresh.weights == 0.4).all() and not (mixer.weights == 0.4).all()
