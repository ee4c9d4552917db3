"""Rule bitmask ledger: every rule is evaluated once, policies are masks over the stored failure bits.

The ledger holds the measurements and one bit per failed rule. A policy is a version name with the set of
rules that reject; applying it or finding out what each rule contributes needs no second look at the texts.

Defined cases: a null or empty text has no words, all measurements are 0 and ``too_few_words`` fails. Rows
with null or repeated ids each get a row of their own. Words are runs of bytes other than ASCII white space.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from specimen_spark.llm.batches import map_columns

# Fixed order: a rule's place is its bit. New rules are appended, never inserted.
RULES = (
    "too_few_words", "repeated_words", "too_many_symbols", "duplicate_lines", "odd_word_length",
    "shouting", "few_letters", "exclamations", "too_many_words",
)
# Versions stay as they are once they have been used.
POLICIES = {
    "base": ("too_few_words", "repeated_words"),
    "v1": ("too_few_words", "repeated_words", "too_many_symbols", "duplicate_lines", "odd_word_length", "shouting",
           "few_letters", "exclamations"),
    "v2": RULES,
}
LEDGER = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "n_lines bigint, n_upper_words bigint, n_letter_words bigint, n_exclamations bigint, fail_bits bigint"
)
MEASURES = [c.split()[0] for c in LEDGER.split(", ")][1:-1]
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
LOWER, UPPER = bytes(range(ord("a"), ord("z") + 1)), bytes(range(ord("A"), ord("Z") + 1))
NO_LETTER, NO_LOWER, NO_UPPER = (bytes(set(range(256)) - set(kept)) for kept in (LOWER + UPPER + SPACES, LOWER + SPACES, UPPER))


def mask(policy: str) -> int:
    return sum(1 << RULES.index(rule) for rule in POLICIES[policy])


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside windows that are found twice or more, the first find included."""
    grams = list(zip(*[words[i:] for i in range(window)]))
    if len(set(grams)) == len(grams):
        return 0
    seen, covered, end = Counter(grams), 0, 0
    for start, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += start + window - max(start, end)
            end = start + window
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()
    joined = b"".join(words)
    lines = [line for line in data.split(b"\n") if line and not line.isspace()]
    return (
        len(words), len(joined.decode()), len(joined) - len(joined.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), *upper_and_letter_words(data, words), joined.count(b"!"),
    )


def upper_and_letter_words(data: bytes, words: list[bytes]) -> tuple[int, int]:
    """Words of two characters or more in capitals, and words with a letter.

    Of ASCII words all but some letters is cut out at once, and the words that are left are counted; those with a
    letter but no small one are capitals. Other words are looked at one by one.
    """
    odd = [] if data.isascii() else [w.decode() for w in words if not w.isascii()]
    plain = b" ".join([w for w in words if w.isascii()]) if odd else data
    n_letter = len(plain.translate(None, NO_LETTER).split())
    n_upper = n_letter - len(plain.translate(None, NO_LOWER).split())
    n_upper -= len(b"".join([w for w in words if len(w) == 1]).translate(None, NO_UPPER))
    return n_upper + sum(w.isupper() for w in odd if len(w) > 1), n_letter + sum(map(has_letter, odd))


def has_letter(word: bytes | str) -> bool:
    if word.isalpha():
        return True
    return any(c.isalpha() for c in (word if isinstance(word, str) else word.decode()))


def fail_bits(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_letter, n_marks) -> int:
    failed = (
        n_words < 50,
        100 * n_repeat_words > 50 * n_words,
        10 * n_symbols > 3 * n_words,
        100 * n_dup_lines > 30 * n_lines,
        not 2 * n_words <= word_chars <= 15 * n_words,
        2 * n_upper > n_words,
        2 * n_letter < n_words,
        2 * n_marks > n_words,
        n_words > 100_000,
    )
    return sum(1 << bit for bit, fails in enumerate(failed) if fails)


def ledger(docs: DataFrame) -> DataFrame:
    """One row per document: measurements and failure bits."""
    names = [c.split()[0] for c in LEDGER.split(", ")]

    def rows(ids, texts):
        measured = [(i, *m, fail_bits(*m)) for i, m in zip(ids, map(measure, texts))]
        return dict(zip(names, zip(*measured)))

    return map_columns(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, LEDGER)


def with_bits(docs: DataFrame, name: str = "fail_bits") -> DataFrame:
    """The rows of docs (text and any others) with their failure bits; a column of that name is replaced."""
    docs = docs.drop(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = pa.array([fail_bits(*measure(t)) for t in batch["text"].to_pylist()], pa.int64())
            yield batch.append_column(name, bits)

    return docs.mapInArrow(run, StructType([*docs.schema, StructField(name, LongType())]))


def filter_documents(docs: DataFrame, policy: str) -> DataFrame:
    """The rows of docs (text and any others) that the policy keeps."""
    return with_bits(docs, "__fail_bits").where(~rejected_by(policy, "__fail_bits")).select(*docs.columns)


def rejected_by(policy: str, bits: Column | str = "fail_bits") -> Column:
    bits = F.col(bits) if isinstance(bits, str) else bits
    return bits.bitwiseAND(F.lit(mask(policy)).cast("bigint")) != 0


def ablations(marked: DataFrame, policy: str) -> DataFrame:
    """Per rule of the policy: documents failing it, and documents only it rejects.

    Documents are first counted per bit pattern, so at most 2 ** len(RULES) rows leave a task.
    """
    used = F.lit(mask(policy)).cast("bigint")
    patterns = marked.select(F.col("fail_bits").bitwiseAND(used).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rule = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("bigint").alias("bit")) for r in POLICIES[policy]
    ])).alias("r")
    each = patterns.select("bits", "n", rule).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failing"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )
