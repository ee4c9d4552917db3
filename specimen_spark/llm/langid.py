"""Language identification of mixed-language text.

Scripts narrow the candidates of a word to the languages that use its script. A word's score for a language is the
sum of log-probabilities of its hashed letter n-grams. A Viterbi pass over the words, with a penalty for every
change of language, labels spans; the document gets the language with the most letters.

The model is learned from a bounded sample of labelled documents: about ``docs_per_language`` documents of each
language, chosen by hash, whole texts. It is a table of ``BUCKETS`` values per language, so its size does not grow
with the corpus; it goes to the driver and to the tasks.

Defined cases: a null text or one without a letter is ``und`` with score 0; words without a letter fit all languages
alike. Ties go to the language that sorts first. With no labelled documents everything is ``und``. Rows with null or
repeated ids each get a row of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema

BUCKETS = 1 << 16
ORDERS = (1, 2, 3, 4)
GROUP_WORDS = 500_000
CACHED_WORDS = 300_000
WORDS_AT_ONCE = 20_000
PREDICTED = "doc_id bigint, lang_pred string, score double, n_words bigint, n_spans bigint"
# First and last code point of the ranges of each script.
SCRIPTS = (
    ("latin", ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("cyrillic", ((0x400, 0x52F),)),
    ("armenian", ((0x530, 0x58F),)),
    ("hebrew", ((0x590, 0x5FF),)),
    ("arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("devanagari", ((0x900, 0x97F),)),
    ("thai", ((0xE00, 0xE7F),)),
    ("georgian", ((0x10A0, 0x10FF),)),
    ("hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("kana", ((0x3040, 0x30FF),)),
    ("han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF))),
)
OTHER = len(SCRIPTS)


@cache
def script_table() -> np.ndarray:
    scripts = np.full(1 << 16, OTHER, np.uint8)
    for number, (_, ranges) in enumerate(SCRIPTS):
        for first, last in ranges:
            scripts[first:last + 1] = number
    return scripts


@cache
def letter_table() -> np.ndarray:
    """Whether each code point is a letter. Small letters have as many letters as what they stand for."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Numbering(dict):
    """Numbers words in the order they are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class WordFeatures:
    """Hashed n-grams of distinct words, computed for many words at once."""

    def __init__(self, words: list[str]):
        lowered = [f" {w.lower()} " for w in words]
        codes = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).astype(np.uint64)
        self.sizes = np.fromiter(map(len, lowered), np.int64, len(lowered))
        word = np.repeat(np.arange(len(words)), self.sizes)
        starts = np.cumsum(self.sizes) - self.sizes
        left = (starts + self.sizes)[word] - np.arange(len(codes))  # characters to the end of the word
        grams, owners, rolling = [], [], np.zeros(len(codes), np.uint64)
        self.n_single = len(codes)  # the first grams are single characters, which say little
        for order in ORDERS:
            shifted = np.zeros_like(codes)
            n = max(0, len(codes) - order + 1)
            shifted[:n] = codes[order - 1:order - 1 + n]
            rolling = (rolling * np.uint64(0x100000001B3)) ^ (shifted + np.uint64(order))
            inside = left >= order
            mixed = (rolling[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
            grams.append(mixed.astype(np.int64))
            owners.append(word[inside])
        self.grams, self.owners = np.concatenate(grams), np.concatenate(owners)
        table = script_table()
        scripts = table[np.minimum(codes, 0xFFFF).astype(np.int64)]
        self.scripts = np.zeros((len(words), OTHER + 1), bool)
        self.scripts[word, scripts] = True
        self.letters = np.bincount(word, letter_table()[codes.astype(np.int64)], len(words)).astype(np.int64)


def count_grams(rows: Iterator[tuple[str, str]]) -> dict[str, np.ndarray]:
    """Per language: counts of the buckets, then of the scripts of letters' words."""
    counts: dict[str, np.ndarray] = {}
    for lang, text in rows:
        words, n = np.unique(np.array(text.split() or [""], dtype=object).astype(str), return_counts=True)
        features = WordFeatures(words.tolist())
        own = counts.setdefault(lang, np.zeros(BUCKETS + OTHER + 1))
        own[:BUCKETS] += np.bincount(features.grams, weights=n[features.owners], minlength=BUCKETS)
        own[BUCKETS:] += (features.scripts * (n * (features.letters > 0))[:, None]).sum(axis=0)
    return counts


class Model:
    """Log-probabilities (bucket x language) and the scripts each language uses."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        grams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        self.scores = np.log((grams + 0.1) / (grams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).T.astype(np.float32).copy()
        used = scripts[:, :OTHER] / np.maximum(scripts[:, :OTHER].sum(axis=1, keepdims=True), 1)
        self.uses = used >= 0.02

    def word_scores(self, words: list[str], features: WordFeatures | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores (word x language, the best one 0) and letters of each word."""
        features, n = features or WordFeatures(words), len(words)
        scores = np.stack([np.bincount(features.owners, weights=self.scores[features.grams, k], minlength=n)
                           for k in range(len(self.languages))], axis=1)
        scores[features.letters == 0] = 0
        fits = features.scripts[:, :OTHER].astype(np.int32) @ self.uses.T.astype(np.int32) > 0
        scores[~fits & fits.any(axis=1)[:, None]] -= 1000.0
        return (scores - scores.max(axis=1, keepdims=True)).astype(np.float32), features.letters


    def fitting(self, features: WordFeatures) -> np.ndarray:
        """Whether each word (x language) has a script of the language and n-grams likelier in it than by chance."""
        owners, grams = features.owners[features.n_single:], features.grams[features.n_single:]
        n = len(features.letters)
        chance = np.bincount(owners, minlength=n) * -np.log(BUCKETS)
        evidence = np.stack([np.bincount(owners, weights=self.scores[grams, k], minlength=n) for k in range(len(self.languages))], axis=1)
        known_scripts = features.scripts[:, :OTHER]
        # A word without a script of the table is told by its n-grams only.
        script = (known_scripts.astype(np.int32) @ self.uses.T.astype(np.int32) > 0) | ~known_scripts.any(axis=1)[:, None]
        return script & (evidence >= chance[:, None])


def viterbi(scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word; documents (longest first) advance word by word together."""
    n_words, n_langs = scores.shape
    kept = np.zeros((n_words, n_langs), bool)  # whether the best path to (word, language) stays in the language
    best_before = np.zeros(n_words, np.int16)
    running = scores[starts].copy()
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes[0]) + 1), side="right")
    for step in range(1, int(sizes[0])):
        n = active[step]
        at, before = starts[:n] + step, running[:n]
        top = before.argmax(axis=1)
        switch = before[np.arange(n), top] - penalty
        stay = before >= switch[:, None]
        kept[at], best_before[at] = stay, top
        running[:n] = np.where(stay, before, switch[:, None]) + scores[at]
    labels = np.zeros(n_words, np.int16)
    now = running.argmax(axis=1).astype(np.int16)
    labels[starts + sizes - 1] = now
    for step in range(int(sizes[0]) - 1, 0, -1):
        n = active[step]
        at, own = starts[:n] + step, labels[starts[:n] + step]
        labels[at - 1] = np.where(kept[at, own], own, best_before[at])
    return labels


def best_paths(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of every word, as ``viterbi`` over whole documents finds it.

    Scores are 0 for a word's best language. A word for which all other languages are worse by more than two penalties
    is in its best language whatever surrounds it, so only what lies between such words is searched, short pieces of
    all documents together; a piece holds the clear word before it and the one behind it.
    """
    clear = (scores >= -2 * penalty - 0.01).sum(axis=1) == 1
    labels = scores.argmax(axis=1).astype(np.int16)
    opens, closes = (np.zeros(len(scores), bool) for _ in range(2))
    opens[np.cumsum(sizes) - sizes] = closes[np.cumsum(sizes) - 1] = True
    first = np.flatnonzero(~clear & (opens | np.append(True, clear[:-1])))
    last = np.flatnonzero(~clear & (closes | np.append(clear[1:], True)))
    first, last = first - ~opens[first], last + ~closes[last]
    order = np.argsort(first - last, kind="stable")
    if len(order):
        first, length = first[order], (last - first + 1)[order]
        starts = np.cumsum(length) - length
        at = np.arange(length.sum()) + np.repeat(first - starts, length)
        labels[at] = viterbi(scores[at], starts, length, penalty)
    return labels


class Labeller:
    """Labels texts with a model; keeps scores of words it has seen."""

    def __init__(self, model: Model, penalty: float, judges: bool = False):
        self.model, self.penalty, self.judges = model, penalty, judges
        self.reset()

    def reset(self) -> None:
        self.index = Numbering()
        self.scores = np.zeros((0, len(self.model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.fits = np.zeros((0, len(self.model.languages)), bool)

    def lookup(self, words: list[str]) -> np.ndarray:
        known = len(self.index)
        numbers = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        new, found = list(islice(self.index, known, None)), []
        for low in range(0, len(new), WORDS_AT_ONCE):  # a word takes some 500 bytes meanwhile
            some = new[low:low + WORDS_AT_ONCE]
            features = WordFeatures(some)
            found.append((*self.model.word_scores(some, features), *[self.model.fitting(features)] * self.judges))
        if found:
            scores, letters, *fits = zip(*found)
            self.scores, self.letters = np.concatenate([self.scores, *scores]), np.concatenate([self.letters, *letters])
            if self.judges:
                self.fits = np.concatenate([self.fits, *fits[0]])
        return numbers

    def spans(self, split: list[list[str]]) -> tuple | None:
        """Documents with words, longest first: numbers, sizes, and of every word its document, number and language."""
        if len(self.index) > CACHED_WORDS:
            self.reset()
        order = sorted((i for i, words in enumerate(split) if words), key=lambda i: -len(split[i]))
        if not order or not self.model.languages:
            return None
        sizes = np.array([len(split[i]) for i in order])
        ids = self.lookup([w for i in order for w in split[i]])
        labels = best_paths(self.scores[ids], sizes, self.penalty)
        return order, sizes, np.repeat(np.arange(len(order)), sizes), ids, labels

    def fitting_share(self, split: list[list[str]]) -> list[float]:
        """Share of the letters of each list of words that fit the language of their span; 0 without letters."""
        out = [0.0] * len(split)
        if (found := self.spans(split)) is None:
            return out
        order, _, owner, ids, labels = found
        letters = self.letters[ids]
        total, fit = (np.bincount(owner, weights=w, minlength=len(order)) for w in (letters, letters * self.fits[ids, labels]))
        for row, i in enumerate(order):
            out[i] = float(fit[row] / total[row]) if total[row] else 0.0
        return out

    def label(self, split: list[list[str]]) -> list[tuple]:
        """(language, score, words, spans) of each list of words."""
        out: list[tuple] = [("und", 0.0, len(words), 0) for words in split]
        if (found := self.spans(split)) is None:
            return out
        order, sizes, owner, ids, labels = found
        n_langs = len(self.model.languages)
        share = np.bincount(owner * n_langs + labels, weights=self.letters[ids], minlength=len(order) * n_langs).reshape(-1, n_langs)
        changes = np.append(False, (labels[1:] != labels[:-1]) & (owner[1:] == owner[:-1]))
        spans = np.bincount(owner, weights=changes, minlength=len(order)).astype(int) + 1
        for row, i in enumerate(order):
            total = share[row].sum()
            if total:
                top = int(share[row].argmax())
                out[i] = (self.model.languages[top], float(share[row, top] / total), int(sizes[row]), int(spans[row]))
        return out


def learn(docs: DataFrame, docs_per_language: int = 2000) -> Model:
    """Learn from docs (doc_id, text, lang); two light passes, the counts of the sample meet at the driver."""
    labelled = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((0, BUCKETS + OTHER + 1)))
    step = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(max(1, n // docs_per_language)))])
    chosen = labelled.where(F.pmod(F.xxhash64("doc_id", "text"), step[F.col("lang")]) == 0)
    schema = "lang string, counts binary"
    out = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(b["lang"].to_pylist(), b["text"].to_pylist()))
        counts = count_grams(rows)
        if counts:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), out[0].type), pa.array([c.astype("<i4").tobytes() for c in counts.values()], out[1].type)], schema=out)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, counts in zip(b["lang"].to_pylist(), b["counts"].to_pylist()):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(counts, "<i4").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), out[0].type), pa.array([s.astype("<i4").tobytes() for s in sums.values()], out[1].type)], schema=out)

    partial = chosen.select("lang", "text").mapInArrow(count, schema)
    summed = partial.repartition(len(sizes), "lang").mapInArrow(add, schema).collect()
    table = {r["lang"]: np.frombuffer(r["counts"], "<i4").astype(float) for r in summed}
    languages = sorted(table)
    return Model(languages, np.stack([table[lang] for lang in languages]) if languages else np.zeros((0, BUCKETS + OTHER + 1)))


def predict(docs: DataFrame, model: Model, penalty: float = 6.0) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language), n_words, n_spans of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers per language
    out = arrow_schema(PREDICTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty)

        def labelled(ids, split):
            rows = [(i, *row) for i, row in zip(ids, labeller.label(split))]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

        for batch in batches:
            ids, split, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids.append(doc_id)
                split.append((text or "").split())
                size += len(split[-1])
                if size >= GROUP_WORDS:
                    yield labelled(ids, split)
                    ids, split, size = [], [], 0
            if ids:
                yield labelled(ids, split)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PREDICTED)


def filter_documents(docs: DataFrame, model: Model, least_share: float, penalty: float = 6.0) -> DataFrame:
    """The rows of docs (text and any others) of whose letters at least ``least_share`` fit the language of their span.

    Letters do not fit if their word is in a script that the language does not use, or its n-grams are less likely in
    the language than by chance. How many languages a text has does not matter. A model without languages says
    nothing about a text, so all rows stay.
    """
    if not model.languages:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, penalty, judges=True)

        def judged(split: list[list[str]]) -> list[bool]:
            return [share > 0 and share >= least_share for share in labeller.fitting_share(split)]

        for batch in batches:
            keep, split, size = [], [], 0
            for text in batch["text"].to_pylist():
                split.append((text or "").split())
                size += len(split[-1])
                if size >= GROUP_WORDS:
                    keep += judged(split)
                    split, size = [], 0
            keep += judged(split)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(folds)), F.lit(0))
