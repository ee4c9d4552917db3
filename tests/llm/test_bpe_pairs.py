"""Pairs of tokens: what the merges that formed them tell, against running all merges."""

import random

import pytest

from specimen_spark.llm import bpe
from specimen_spark.llm.queries import vocabulary


@pytest.fixture(scope="module")
def encoder():
    return bpe.WordEncoder(vocabulary("word_bpe_49k.json"))


def merged(encoder, symbols):
    """What the merges make of symbols, lowest rank first, leftmost first."""
    symbols = list(symbols)
    while len(symbols) > 1:
        rank, at = min((encoder.ranks.get(a * encoder.base + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
        if rank == 1 << 60:
            break
        symbols[at:at + 2] = [encoder.ids[encoder.by_id[symbols[at]] + encoder.by_id[symbols[at + 1]]]]
    return symbols


def characters(encoder, token):
    text = encoder.by_id[token]
    inner = text.removesuffix(encoder.end)
    return [encoder.ids[s] for s in [*inner[:-1], inner[-1] + text[len(inner):]]]


def test_tokens_are_those_their_text_is_encoded_as(encoder):
    alive = set(encoder.inner.values()) | set(encoder.final.values())
    for token in random.Random(1).sample(sorted(t for t in encoder.ids.values() if encoder.by_id[t] != encoder.end), 6_000):
        assert (merged(encoder, characters(encoder, token)) == [token]) == (token in alive)


def test_pairs_are_decided_as_the_merges_do(encoder):
    rng = random.Random(2)
    inner, every = sorted(encoder.inner.values()), sorted([*encoder.inner.values(), *encoder.final.values()])
    known = [(a, b) for a, b in (divmod(p, encoder.base) for p in rng.sample(sorted(encoder.ranks), 3_000)) if a in set(inner)]
    pairs = [(rng.choice(inner), rng.choice(every)) for _ in range(6_000)] + known + [(t, t) for t in rng.sample(inner, 1_500)]
    decided = 0
    for a, b in pairs:
        crossed = merged(encoder, characters(encoder, a) + characters(encoder, b)) != [a, b]
        assert encoder.crossed(a, b) == crossed
        decided += crossed
    assert 0 < decided < len(pairs)
