"""Spelling variants: words one edit apart, found by asymmetric q-chunks.

Of two words that are one insertion, deletion or replacement apart, the shorter one (of equal ones, either) is cut
into two disjoint chunks, of which the edit leaves one as it is. The other word contributes positional grams of the
chunks' lengths. A preserved chunk stands at its own place in the other word, or one place later behind an inserted
code point; so of all positional grams only those within that shift can match, and only those are sent. Words meet in
a join on (length, place, chunk), and each pair is verified.

A chunk that many words share would make a bucket of too many pairs. What its words do not share is the other
chunk, so such a bucket is cut again by the same rule: the other chunk is halved, and one of the halves is preserved
too. This goes on, round by round, for the large buckets only; a bucket whose words agree on all but one code point is
bounded by the alphabet, since its pairs are links. Every pair has one path through these cuts (the front half if it
is preserved, else the back half), so each link is found once and none is lost.

Defined cases: null texts have no words; a null id counts as an empty one where runs are altered; repeated rows count
again. Very long runs are words like any other. Empty tables give no rows. Other columns of docs are not looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema
from specimen_spark.operators.keyed import attach
from specimen_spark.session import cut_lineage

LEAST_LENGTH, LEAST_COUNT, DOMINANCE = 6, 5, 5
TYPO_RATE = 199
RUN = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LENGTH)
COUNTER_BYTES = 32 << 20
LONG_TEXT = 1 << 20
BUCKET_PAIRS = 4096


def runs_of(text: str) -> Counter:
    """Distinct runs of letters with their counts; shorter ones cannot become words."""
    return Counter(RUN.findall(text) if len(text) < LONG_TEXT else (m[0] for m in RUN.finditer(text)))


def altered(run: bytes, h: int) -> bytes:
    """The run without one code point if its hash says so."""
    if h % TYPO_RATE:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1:]).encode()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): runs of letters of all whole texts, lower-cased in A-Z and altered by hash, that occur often enough."""
    schema = "word binary, n bigint"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = Counter(), 0

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(counts), out[0].type), pa.array(list(counts.values()), out[1].type)], schema=out)

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                start = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for found, n in runs_of(text or "").items():
                    found = found.encode().lower()  # bytes: A-Z only
                    h = zlib.crc32(found, start)
                    if h % TYPO_RATE == 0:
                        found = altered(found, h)
                        if len(found.decode()) < LEAST_LENGTH:
                            continue
                    if found not in counts:
                        held += len(found) + 120
                    counts[found] += n
                if held > COUNTER_BYTES:
                    yield rows()
                    counts.clear()
                    held = 0
        if counts:
            yield rows()

    counted = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_COUNT}").withColumn("word", F.col("word").cast("string"))


# -- buckets: words that agree before place low and from place high on; grams are one code point longer (shift 1) ----

PLACED = ("word", "n", "size", "shift", "low", "high")


def whole_words(words: DataFrame) -> DataFrame:
    """Every word as chunk word of its own length, and as gram word for chunk words one shorter."""
    size = F.length("word")
    roles = F.array(F.struct(size.alias("size"), F.lit(0).alias("shift")), F.struct((size - 1).alias("size"), F.lit(1).alias("shift")))
    return words.select("word", "n", F.explode(roles).alias("role")).select(
        "word", "n", "role.*", F.lit(0).alias("low"), F.col("role.size").alias("high")).where(f"size >= {LEAST_LENGTH}")


def front(word: str, place: Column | str) -> Column:
    return F.substring(word, F.lit(1), F.col(place) if isinstance(place, str) else place)


def halves(placed: DataFrame) -> DataFrame:
    """Each bucket's words in the two buckets where the front or the back half is preserved, with the join key."""
    middle = F.expr("(low + high) div 2").cast("int")
    cuts = F.array(F.struct(middle.alias("low"), F.col("high")), F.struct(F.col("low"), middle.alias("high")))
    cut = placed.select("word", "n", "size", "shift", F.explode(cuts).alias("cut")).select("word", "n", "size", "shift", "cut.*")
    back = F.expr("substring(word, high + shift + 1)")
    return cut.withColumn("key", F.xxhash64("size", "low", "high", front("word", "low"), back))


def links_of(buckets: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): words one edit apart in a bucket, each pair in the one bucket on its path."""
    a = buckets.where("shift = 0").select("key", *[F.col(c).alias(f"a_{c}") for c in PLACED])
    b = buckets.select("key", *[F.col(c).alias(f"b_{c}") for c in PLACED])
    pair = (
        "a_size = b_size AND a_low = b_low AND a_high = b_high AND (b_shift = 1 OR a_word < b_word)"
        # On its path: the halves cut off behind were not preserved in front as well.
        " AND (a_high = a_size OR substring(a_word, 1, a_high) <> substring(b_word, 1, b_high))"
        # Verified: the bucket holds what its key says, and the words are one edit apart.
        " AND substring(a_word, 1, a_low) = substring(b_word, 1, b_low)"
        " AND substring(a_word, a_high + 1) = substring(b_word, b_high + b_shift + 1)"
        " AND levenshtein(a_word, b_word, 1) = 1"
    )
    found = a.withColumnRenamed("key", "a_key").join(b, F.expr("a_key = key AND " + pair))
    return found.select(F.col("a_word").alias("a"), F.col("a_n"), F.col("b_word").alias("b"), F.col("b_n"))


def links(words: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """(a, a_n, b, b_n) of all words (word, n) one edit apart, each pair once; rounds as the logarithm of the length."""
    found, placed = None, whole_words(words)
    while True:
        keyed = cut_lineage(halves(placed))
        chunks, grams = F.sum(1 - F.col("shift")), F.sum("shift")
        sizes = keyed.groupBy("key").agg(
            (chunks * (chunks - 1) / 2 + chunks * grams).alias("pairs"), F.max(F.col("high") - F.col("low")).alias("open")
        ).where("pairs > 0")
        buckets = attach(keyed, sizes.select("key", F.expr(f"pairs > {bucket_pairs} AND open > 1").alias("large")), ["key"], "inner")
        own = links_of(buckets.where("NOT large"))
        found = own if found is None else found.union(own)
        placed = cut_lineage(buckets.where("large").select(*PLACED))
        if placed.isEmpty():
            return found


# -- forms ------------------------------------------------------------------------------------------------------------


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words (word, form): forms followed to the last, each round twice as far.

    A form has several times its word's count, so chains are short and have no circle.
    """
    known = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        further = attach(known, known.select(F.col("word").alias("root"), F.col("root").alias("next")), ["root"])
        followed = cut_lineage(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = followed.select("word", "root")
        if followed.where("moved").isEmpty():
            return known


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n and root of all words of docs (doc_id, text)."""
    words = cut_lineage(vocabulary(docs))
    found = links(words)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    near = found.select(F.explode(sides).alias("side")).select("side.*").groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    judged = attach(words, near, ["word"])
    dominant = -F.col("best.less") >= DOMINANCE * F.col("n")
    formed = cut_lineage(judged.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(dominant, F.col("best.near")).alias("form"), F.when(dominant, -F.col("best.less")).alias("form_n")))
    ended = attach(formed, roots(formed.where("form IS NOT NULL")), ["word"])
    return ended.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
