"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, grouping.

1. Documents with equal shingle sets form a class, represented by the smallest id.
2. Signatures of representatives are banded. The smallest member of a bucket is its centre; only (centre, member)
   pairs are made, never all pairs of a bucket.
3. Pairs are verified on the full sets.
4. Members that are not similar to their centre ("strays") may still be similar to another member of its star. Let
   D be what a member has and the centre has not, R what it lacks. Two members ``c`` and ``x`` of which ``c`` is a
   stray can only be similar if they share enough of their differences (D with D, R with R). The number needed
   follows from the sizes, so the two share an element among the first few of their differences in any common
   order. A star whose sets are bounded is decided in one task, by union-find over the members that share an element
   of their prefixes. For a larger one the prefixes are the buckets of the next round, which no longer hold the
   centre; so rounds end, and no pair of a bucket is left undecided.
5. Components of the verified links; a document's component is the smallest id in it.

Defined cases: texts that are null or have no word have no shingles, link with nothing and are kept. Rows that repeat an id are expected to have the
same text. A null id is a document of its own: it is kept and links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema
from specimen_spark.llm.components import components
from specimen_spark.llm.shingles import WordHashes, band_keys, batches_of_sets, shingle_set, signatures
from specimen_spark.operators.keyed import attach
from specimen_spark.session import cut_lineage

BANDS, ROWS = 24, 5
STAR_BYTES = 16 << 20
SIGNED = "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>"
VERIFIED = "a bigint, b bigint, linked boolean, prefix array<bigint>"


def sign(docs: DataFrame, width: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, size and key of the shingle set, band keys of every whole text."""
    out = arrow_schema(SIGNED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for start, sets in batches_of_sets(batch["text"].to_pylist(), width, hashes):
                filled = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(filled, bands * rows), bands).view(np.int64).tolist() if filled else [])
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[start:start + len(sets)], out[0].type),
                    pa.array(list(map(len, sets)), out[1].type),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], out[2].type),
                    pa.array([next(keys) if len(s) else [] for s in sets], out[3].type),
                ], schema=out)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, SIGNED)


def set_table(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(doc_id, set_key, elements) of the documents in ``ids`` (doc_id, set_key); sets as 64-bit numbers."""
    schema = "doc_id bigint, set_key binary, elements binary"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, wanted, texts = (c.to_pylist() for c in batch.columns)
            rows, size = [], 0
            for doc_id, key, text in zip(ids, wanted, texts):
                data = shingle_set(text, width, hashes).tobytes()
                if xxhash.xxh3_128_digest(data) == key:
                    rows.append((doc_id, key, data))
                    size += len(data)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    texts = docs.select(F.col("doc_id").cast("bigint"), "text")
    return texts.join(ids, "doc_id").select("doc_id", "set_key", "text").mapInArrow(run, schema).dropDuplicates(["doc_id", "set_key"])


def compare(centre: np.ndarray, member: np.ndarray, num: int, den: int) -> tuple[bool, np.ndarray]:
    """Whether ``den * intersection >= num * union``, and the prefix of the member's differences from the centre."""
    place = np.searchsorted(centre, member)
    place[place == len(centre)] = 0
    shared = centre[place] == member
    inter = int(shared.sum())
    linked = den * inter >= num * (len(centre) + len(member) - inter)
    only = member[~shared]
    missing = np.ones(len(centre), bool)
    missing[place[shared]] = False
    lacking = centre[missing]
    d, r, both = len(only), len(lacking), num + den
    if linked:
        take = d + r - (num * d + den * r) // both
    else:
        need = -(-(num * (len(centre) + d) - den * (len(centre) - r)) // both)
        take = d + r - max(1, need) + 1
    return linked, np.concatenate([only, lacking])[:max(0, take)].view(np.int64)


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) with whether they are similar and the prefix of b's differences from a."""
    out = arrow_schema(VERIFIED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            a, b, left, right = batch.columns
            for i in range(batch.num_rows):
                linked, prefix = compare(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), num, den)
                rows.append((a[i].as_py(), b[i].as_py(), linked, prefix))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    elements = sets.select("doc_id", "elements")
    members = attach(pairs, elements.select(F.col("doc_id").alias("b"), F.col("elements").alias("right")), ["b"], "inner")
    both = attach(members, elements.select(F.col("doc_id").alias("a"), F.col("elements").alias("left")), ["a"], "inner")
    return both.select("a", "b", "left", "right").mapInArrow(run, VERIFIED)


def decide(num: int, den: int):
    """Links between the members of one star: a member and those it shares a prefix element with, unless connected."""
    out = arrow_schema("a bigint, b bigint")

    def run(table: pa.Table) -> pa.Table:
        ids, linked = table["b"].to_pylist(), table["linked"].to_pylist()
        prefixes = [p.values.to_numpy() for p in table["prefix"]]
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["elements"]]
        parent = list(range(len(ids)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        first = next((i for i, x in enumerate(linked) if x), 0)
        for i in (i for i, x in enumerate(linked) if x):
            parent[i] = first
        member = np.repeat(np.arange(len(ids)), list(map(len, prefixes)))
        elements = np.concatenate(prefixes)
        order = np.argsort(elements, kind="stable")
        elements, member = elements[order], member[order]
        found = []
        for c in (i for i, x in enumerate(linked) if not x):
            low, high = (np.searchsorted(elements, prefixes[c], side) for side in ("left", "right"))
            others = np.unique(np.concatenate([member[a:b] for a, b in zip(low, high)])) if len(low) else ()
            for x in others:
                small, large = sorted((len(sets[c]), len(sets[x])))
                if den * small >= num * large and root(c) != root(x):
                    inter = len(np.intersect1d(sets[c], sets[x], assume_unique=True))
                    if den * inter >= num * (small + large - inter):
                        found.append((min(ids[c], ids[x]), max(ids[c], ids[x])))
                        parent[root(c)] = root(x)
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found)], schema=out) if found else out.empty_table()

    return run


def stars(buckets: DataFrame) -> DataFrame:
    """Distinct (smallest member, other member) of rows (key..., doc_id)."""
    keys = [c for c in buckets.columns if c != "doc_id"]
    centres = buckets.groupBy(*keys).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("last")).where("a < last").drop("last")
    return attach(buckets, centres, keys, "inner").where("a < doc_id").select("a", F.col("doc_id").alias("b")).distinct()


def links(representatives: DataFrame, docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Verified links (a, b) that connect what candidate buckets connect; see the module's text."""
    spark = docs.sparkSession
    banded = representatives.select("doc_id", F.explode("bands").alias("key"))
    pairs = cut_lineage(stars(banded.select("key", "doc_id")))
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = cut_lineage(set_table(docs, representatives.join(ids, "doc_id").select("doc_id", "set_key"), width))
    sizes = sets.select(F.col("doc_id").alias("b"), F.octet_length("elements").alias("bytes"))
    found = spark.createDataFrame([], "a bigint, b bigint")
    while not pairs.isEmpty():
        verified = cut_lineage(verify(pairs, sets, num, den))
        found = found.union(verified.where("linked").select("a", "b"))
        measured = attach(verified.select("a", "b", "linked"), sizes, ["b"], "inner")
        star = measured.groupBy("a").agg(F.count("*").alias("n"), F.min("linked").alias("all"), F.sum("bytes").alias("bytes"))
        star = cut_lineage(star.where("n > 1 AND NOT all").select("a", "bytes"))
        open_stars = attach(verified, star, ["a"], "inner")
        bounded = open_stars.where(F.col("bytes") <= STAR_BYTES).drop("bytes")
        with_sets = attach(bounded, sets.select(F.col("doc_id").alias("b"), "elements"), ["b"], "inner")
        found = found.union(cut_lineage(with_sets.groupBy("a").applyInArrow(decide(num, den), "a bigint, b bigint")))
        rows = open_stars.where(F.col("bytes") > STAR_BYTES).select("a", F.explode("prefix").alias("element"), F.col("b").alias("doc_id"), "linked")
        # A bucket without a stray connects nothing new.
        strays = rows.groupBy("a", "element").agg(F.min("linked").alias("all"), F.count("*").alias("n")).where("n > 1 AND NOT all").select("a", "element")
        buckets = attach(rows, strays, ["a", "element"], "inner").select("a", "element", "doc_id")
        pairs = cut_lineage(stars(buckets.withColumnRenamed("a", "centre")))
    return found


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the smallest id of each component); similar is num/den or more.

    Lower-cased A-Z, words between ASCII white space, shingles of ``width`` words.
    """
    signed = cut_lineage(sign(docs, width))
    known = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = cut_lineage(known.groupBy("set_key").agg(F.min("doc_id").alias("representative")))
    representatives = known.join(classes, ["set_key"]).where("doc_id = representative").select("doc_id", "set_key", "bands")
    linked = links(representatives, docs, width, num, den)
    reached = components(linked).withColumnRenamed("node", "representative")
    classed = attach(known.select("doc_id", "set_key", "n_shingles"), classes, ["set_key"], "inner")
    labelled = attach(classed, reached, ["representative"])
    labelled = labelled.select("doc_id", "n_shingles", F.coalesce("component", "representative").alias("component_id"))
    empty = signed.where("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return labelled.union(empty).select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
