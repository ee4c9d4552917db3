"""Word shingle sets and SuperMinHash signatures of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

CACHED_WORDS = 500_000
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hash of each word, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: str | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingles of A-Z lower-cased words; fewer words than ``width`` make one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(width, len(w))
    n = len(w) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * M1 + w[i:i + n])
    return np.unique(out)


def signatures(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """SuperMinHash of each non-empty set (set x slot).

    Every element deals its ranks 0, 1, 2, ... to the slots in an order of its own; a slot keeps the smallest
    rank plus fraction. In round ``j`` all elements deal rank ``j``: a set whose slots are all taken is done, since
    later ranks are larger.
    """
    sizes = np.array([len(s) for s in sets])
    result = np.full((len(sets), slots), np.inf)
    flat = result.reshape(-1)
    elements, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order: np.ndarray | None = None
    with np.errstate(over="ignore"):
        for rank in range(slots):
            draw = mix(elements + np.uint64(rank + 1) * M1)
            fraction = (draw >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            pick = rank + (mix(draw) % np.uint64(slots - rank)).astype(np.int64)
            if order is None:
                slot = pick
            else:
                rows = np.arange(len(elements))
                slot = order[rows, pick].astype(np.int64)
                order[rows, pick] = order[:, rank]
            np.minimum.at(flat, owner * slots + slot, rank + fraction)
            open_sets = np.isinf(result).any(axis=1)
            if not open_sets.any():
                break
            going = open_sets[owner]
            if order is None:  # only sets that go on need the order of their elements
                order = np.tile(np.arange(slots, dtype=np.uint16), (int(going.sum()), 1))
                order[np.arange(len(order)), pick[going]] = 0
            else:
                order = order[going]
            elements, owner = elements[going], owner[going]
    return result


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """64-bit key of each band of each signature (set x band); keys of different bands do not meet."""
    rows = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, -1)
    keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * M1, (len(rows), 1))
    with np.errstate(over="ignore"):
        for i in range(rows.shape[2]):
            keys = mix(keys * M1 + rows[:, :, i])
    return keys


def batches_of_sets(texts: list[str | None], width: int, hashes: WordHashes, most: int = 200_000) -> Iterator[tuple[int, list[np.ndarray]]]:
    """First index and sets of runs of texts with about ``most`` shingles."""
    start, sets, size = 0, [], 0
    for i, text in enumerate(texts):
        sets.append(shingle_set(text, width, hashes))
        size += len(sets[-1])
        if size >= most:
            yield start, sets
            start, sets, size = i + 1, [], 0
    if sets:
        yield start, sets
