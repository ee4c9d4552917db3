"""Row work of the first pipeline stages: the same results with less done word by word."""

import random

import numpy as np
import pytest

from specimen_spark.llm import langid, quality


def test_words_in_capitals_and_with_letters(monkeypatch):
    """As counted one by one; ASCII words are not looked at one by one."""
    parts = ["A", "BB", "b", "Bc", "1", "12", "A1", "!a", "É", "ÉÀ", "Éa", "aÉ", "日本", "Ⅳ", "ǅA", "x Y", "\x1cA", "--", "ß"]
    rng = random.Random(3)
    texts = ["", *parts, *("".join(rng.choice(parts) + rng.choice([" ", "\n", "\t\x0b", "\x0c"]) for _ in range(30)) for _ in range(200))]
    shown = [[w.decode() for w in t.encode().split()] for t in texts]
    want = [(sum(w.isupper() for w in ws if len(w) > 1), sum(any(map(str.isalpha, w)) for w in ws)) for ws in shown]
    assert [quality.measure(t)[6:8] for t in texts] == want
    monkeypatch.setattr(quality, "has_letter", None)
    assert quality.measure("Some PLAIN words - A B 12")[6:8] == (1, 5)


@pytest.mark.parametrize("penalty", [0.5, 6.0])
def test_only_words_between_clear_ones_are_searched(monkeypatch, penalty):
    rng = np.random.default_rng(7)
    sizes = np.sort(np.append(rng.integers(1, 60, 150), [1, 1, 900]))[::-1].copy()
    scores = -rng.gamma(0.5, 8, (sizes.sum(), 3)).astype(np.float32)
    scores -= scores.max(axis=1, keepdims=True)
    scores[rng.random(len(scores)) < 0.1] = 0
    want = langid.viterbi(scores, np.cumsum(sizes) - sizes, sizes, penalty)
    longest, viterbi = [], langid.viterbi
    monkeypatch.setattr(langid, "viterbi", lambda s, starts, n, p: longest.append(int(n[0])) or viterbi(s, starts, n, p))
    assert np.array_equal(langid.best_paths(scores, sizes, penalty), want)
    assert len(longest) == 1 and longest[0] < 450
    clear = np.where(np.eye(3, dtype=bool)[rng.integers(0, 3, 50)], 0, -1000).astype(np.float32)
    assert np.array_equal(langid.best_paths(clear, np.array([30, 20]), penalty), clear.argmax(axis=1)) and len(longest) == 1


def test_letters_of_words_are_those_of_their_characters():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    words = ["".join(map(chr, points[low:low + 50])) for low in range(0, len(points), 50)]
    assert langid.WordFeatures(words).letters.tolist() == [sum(map(str.isalpha, w)) for w in words]


def test_features_of_many_new_words_are_made_in_parts(monkeypatch):
    rows = [("en", "the cat sat on the mat " * 5), ("fr", "le chat est sur la table " * 5)]
    counts = langid.count_grams(iter(rows))
    model = langid.Model(sorted(counts), np.stack([counts[k] for k in sorted(counts)]))
    split = [[f"w{i} le the chat{i % 7}" for i in range(100)][k:] + ["the", "cat"] for k in range(3)]
    whole = [getattr(langid.Labeller(model, 6.0, judges=True), kind)(split) for kind in ("label", "fitting_share")]
    seen, real = [], langid.WordFeatures
    monkeypatch.setattr(langid, "WORDS_AT_ONCE", 9)
    monkeypatch.setattr(langid, "WordFeatures", lambda words: seen.append(len(words)) or real(words))
    assert [getattr(langid.Labeller(model, 6.0, judges=True), kind)(split) for kind in ("label", "fitting_share")] == whole
    assert max(seen) <= 9
