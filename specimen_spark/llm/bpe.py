"""Byte-pair encoding by a walk over a trie of distinct words, and decoding.

The encoding of a prefix is determined by its last token: token ``t`` ends the encoding of a prefix exactly if it
and the last token of the prefix before ``t`` are what the merges make of the two together. So a depth-first walk
over the trie of the distinct words of a group of texts keeps one last token per node, each shared prefix is
encoded once, and a word's tokens are read back from its leaf. (The last byte of a word is a symbol of its own,
so it is a leaf below the trie of inner bytes.)

Works for tokenizer files whose model is BPE with an end-of-word suffix and which drop white space between words:
the text is normalized, split by the file's pattern and spelled in the file's byte alphabet.

Defined cases: null and empty texts have no ids and decode to the empty string. Special tokens that are spelled out
in a text become their ids. Rows with null or repeated ids each get a row of their own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema, map_columns

GROUP_BYTES = 8 << 20
CACHED_WORDS = 400_000
TAIL = 4
DIGESTS = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class WordEncoder:
    """Encodes texts with the vocabulary and merges of a tokenizer file. Tokens are known by their ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.alphabet = byte_alphabet()
        self.normalize = Tokenizer.from_file(path).normalizer.normalize_str
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.by_id = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.base = max(self.by_id) + 1
        self.learn_merges(model["merges"])
        self.written = {i: (b"%d" % i, t.encode()) for i, t in self.by_id.items()}
        self.fits: dict[int, bool] = {}
        self.young: dict[str, tuple[bytes, bytes]] = {s: self.written[i] for s, i in self.special.items()}
        self.old: dict[str, tuple[bytes, bytes]] = {}

    # -- merges -----------------------------------------------------------------------------------------------

    def learn_merges(self, merges) -> None:
        """Rank of each pair, and of each token the merge that forms it, which its recorded pair tells unless it has several."""
        ids, base = self.ids, self.base
        self.ranks: dict[int, int] = {}
        self.formed, self.left, self.right = [-1] * base, [-1] * base, [-1] * base
        several = set()
        for rank, (first, second) in enumerate(merges):
            a, b, token = ids[first], ids[second], ids[first + second]
            self.ranks[a * base + b] = rank
            if self.formed[token] >= 0:
                several.add(token)
            else:
                self.formed[token], self.left[token], self.right[token] = rank, a, b
        for token in several:
            self.formed[token], self.left[token], self.right[token] = self.last_merge(token)
        # Only tokens that their own text is encoded as ever occur; merges put parts before wholes.
        self.inner: dict[str, int] = {}
        self.final: dict[str, int] = {}
        alive = set()
        for token in sorted(ids.values(), key=self.formed.__getitem__):
            a, b, rank = self.left[token], self.right[token], self.formed[token]
            if rank >= 0 and not (a in alive and b in alive and not self.crossed(a, b, rank)):
                continue
            alive.add(token)
            text = self.by_id[token]
            if text.endswith(self.end) and text != self.end:
                self.final[text.removesuffix(self.end)] = token
            else:
                self.inner[text] = token
        # How long the tokens are that end in given characters; where none does, only shorter ones can.
        self.inner_tails, self.final_tails = {}, {}
        for found, tails in ((self.inner, self.inner_tails), (self.final, self.final_tails)):
            for text in found:
                if len(text) >= TAIL:
                    tails[text[-TAIL:]] = max(len(text), tails.get(text[-TAIL:], 0))
        self.size = [0] * base
        for found in (self.inner, self.final):
            for text, token in found.items():
                self.size[token] = len(text)

    def last_merge(self, token: int) -> tuple[int, int, int]:
        """Rank and parts of the merge that forms a token out of its characters; -1 if none does."""
        text = self.by_id[token]
        inner = text.removesuffix(self.end)
        symbols = [self.ids[s] for s in [*inner[:-1], inner[-1] + text[len(inner):]]]
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(a * self.base + b, 1 << 60), i) for i, (a, b) in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            if len(symbols) == 2:
                return rank, symbols[0], symbols[1]
            symbols[at:at + 2] = [self.ids[self.by_id[symbols[at]] + self.by_id[symbols[at + 1]]]]
        return 1 << 60, -1, -1

    def crossed(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether a merge of rank below ``limit`` joins the end of token ``a`` to the start of ``b`` behind it.

        The merges that formed the two are taken back, the latest first. What then meets at the border met there at
        that time, and was merged if its rank came before that of the merge just taken back. Of equal ranks the merge
        further left comes first.
        """
        ranks, formed, base = self.ranks, self.formed, self.base
        while True:
            rank = ranks.get(a * base + b)
            if rank is not None and rank < limit:
                return True
            if formed[a] > formed[b]:
                limit, a = formed[a], self.right[a]
            elif formed[b] >= 0:
                limit, b = formed[b] + 1, self.left[b]
            else:
                return False

    def last_token(self, word: str, depth: int, last: list[int], tokens: dict[str, int], tails: dict[str, int]) -> int:
        """The token that ends the encoding of the first ``depth`` characters, given those of all shorter prefixes."""
        fits, base = self.fits, self.base
        low = depth - tails.get(word[depth - TAIL:depth], TAIL - 1) if depth >= TAIL else 0
        for start in range(low if low > 0 else 0, depth):
            token = tokens.get(word[start:depth])
            if token is None:
                continue
            if not start:
                return token
            pair = last[start] * base + token
            known = fits.get(pair)
            if known is None:
                if len(fits) >= 1_000_000:
                    fits.clear()
                known = fits[pair] = not self.crossed(last[start], token)
            if known:
                return token
        raise ValueError(f"no token ends {word[:depth]!r}")

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each distinct word (in the byte alphabet) with its tokens, by a depth-first walk in sorted order."""
        last, previous, size = [-1], "", self.size
        for word in sorted(words):
            inner = len(word) - 1
            shared, most = 0, min(inner, len(last) - 1)
            while shared < most and word[shared] == previous[shared]:
                shared += 1
            del last[shared + 1:]
            for depth in range(shared + 1, inner + 1):
                last.append(self.last_token(word, depth, last, self.inner, self.inner_tails))
            previous = word
            tokens = [self.last_token(word, inner + 1, last, self.final, self.final_tails)]
            depth = inner + 1 - size[tokens[0]]
            while depth:
                tokens.append(last[depth])
                depth -= size[last[depth]]
            yield word, tokens[::-1]

    # -- texts ------------------------------------------------------------------------------------------------

    def spelled(self, piece: bytes) -> list[str]:
        """The words of a piece between white space; a special token stands for itself."""
        text = piece.decode()
        if text.isascii() and text.isprintable() and "<|" not in text:  # printable ASCII is spelled as itself
            return [text.lower()] if text.isalpha() else self.words.findall(text.lower())
        parts = self.parts.split(text) if "<|" in text else [text]
        words = []
        for part in parts:
            if part in self.special:
                words.append(part)
            elif part:
                for word in self.words.findall(self.normalize(part)):
                    words.append("".join([self.alphabet[b] for b in word.encode()]))
        return words

    def learn(self, words: set[str]) -> dict[str, tuple[bytes, bytes]]:
        """The words' ids and tokens as text; words of earlier groups are remembered in two generations."""
        young, old, new = self.young, self.old, []
        for word in words:
            if word not in young:
                if word in old:
                    young[word] = old[word]
                else:
                    new.append(word)
        for word, tokens in self.encode_words(new):
            written = [self.written[t] for t in tokens]
            young[word] = b" ".join([w[0] for w in written]), b" ".join([w[1] for w in written])
        if len(young) > CACHED_WORDS:
            self.old = young
            self.young = {s: young[s] for s in self.special}
        return young

    def decode(self, ids: Iterable[int]) -> str:
        """As the file says: it has no decoder, so tokens are joined by spaces."""
        return " ".join([self.by_id[i] for i in ids])

    def encode_group(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids in decimal and the decoded text of each text."""
        split = [(t or "").encode().split() for t in texts]
        pieces = {p: self.spelled(p) for p in set().union(*split)}
        known = self.learn({w for words in pieces.values() for w in words})
        ids, tokens = {}, {}
        for piece, words in pieces.items():
            if len(words) == 1:
                ids[piece], tokens[piece] = known[words[0]]
            else:
                ids[piece] = b" ".join([known[w][0] for w in words])
                tokens[piece] = b" ".join([known[w][1] for w in words])
        for found in split:
            yield (b" ".join(filter(None, map(ids.__getitem__, found))),
                   b" ".join(filter(None, map(tokens.__getitem__, found))))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process; its caches are bounded."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def groups(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about GROUP_BYTES; a longer text is a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        length = len(text or "")
        if size and size + length > GROUP_BYTES:
            yield start, i
            start, size = i, 0
        size += length
    yield start, len(texts)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens of every whole text."""
    schema = "doc_id bigint, ids array<int>, n_tokens bigint"

    def rows(doc_ids, texts):
        ids = [[int(x) for x in i.split()] for a, b in groups(texts) for i, _ in encoder(path).encode_group(texts[a:b])]
        return {"doc_id": doc_ids, "ids": ids, "n_tokens": list(map(len, ids))}

    return map_columns(docs.select(F.col("doc_id").cast("bigint"), "text"), rows, schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    def rows(doc_ids, ids):
        return {"doc_id": doc_ids, "text": [encoder(path).decode(i or ()) for i in ids]}

    return map_columns(encoded.select("doc_id", "ids"), rows, "doc_id bigint, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """The ids and the decoded text of each document as SHA-256, taken in the task so that neither leaves it."""
    out = arrow_schema(DIGESTS)

    def run(batches):
        for batch in batches:
            doc_ids, texts = (c.to_pylist() for c in batch.columns)
            rows = []
            for a, b in groups(texts):
                for doc_id, (ids, decoded) in zip(doc_ids[a:b], encoder(path).encode_group(texts[a:b])):
                    rows.append((doc_id, ids.count(b" ") + 1 if ids else 0, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, DIGESTS)
