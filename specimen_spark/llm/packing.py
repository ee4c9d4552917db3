"""Sum-of-squares packing of tokenized documents into sequences of a fixed length.

Documents become ids and an end id; only documents longer than a sequence are cut, so that all their pieces but
the first are full. Pieces are then placed longest first: among the open sequences that still have room, a piece
goes where the sum over all residual gaps of (number of open sequences with that gap) squared becomes smallest; a
sequence is opened only if none has room. Whole corpora are packed in groups of at most about ``group_pieces``
pieces, spread by hash, each of which ends with a handful of sequences that are not full.

Defined cases: a null text is an empty one, which is a piece of the end id alone. Rows with null or repeated ids are
documents of their own; those with one id and one text are packed in one group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema
from specimen_spark.session import cut_lineage

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint"
CACHED_CHUNKS = 400_000
GROUP_PIECES = 100_000
# Space or line feed next to other white space, or at an end: such texts are not cut at their spaces.
UNEVEN = re.compile(r"\s\s|^\s|\s\Z|\x00")


class ByteEncoder:
    """Ids of texts as little-endian unsigned 32-bit numbers, equal to those of the tokenizer file.

    A single space or line feed between other characters always ends a word of the file's pattern, so texts are
    looked up in parts between them; only parts that are new are encoded. Texts with white space side by side are
    encoded whole, and texts that spell out a special token go through the tokenizer itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec["added_tokens"]]
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        other = iter(range(0x100, 0x200))
        byte = {chr(b) if b in set(plain) else chr(next(other)): b for b in range(256)}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        import public_tokenizers

        self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.plain.encode_ordinary(text), dtype="<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if UNEVEN.search(text):
            return self.ids(text)
        # A part that starts with \0 follows a line feed, any other but the first follows a space.
        first, *parts = text.replace("\n", " \0").split(" ")
        known = self.known
        try:
            return b"".join([self.ids(first), *map(known.__getitem__, parts)])
        except KeyError:
            pass
        if len(known) > CACHED_CHUNKS:
            known.clear()
        for part in {p for p in parts if p not in known}:
            known[part] = self.ids("\n" + part[1:] if part[:1] == "\0" else " " + part)
        return b"".join([self.ids(first), *map(known.__getitem__, parts)])


_ENCODERS: dict[str, ByteEncoder] = {}


def encoder(path: str) -> ByteEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ByteEncoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first piece may be shorter than the others."""
    first = n % capacity or capacity
    if n <= capacity:
        first = n
    yield 0, first
    for start in range(first, n, capacity):
        yield start, capacity


def tokenize(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Pieces of every whole text; ``ids`` (little-endian unsigned 32-bit) only if asked for."""
    schema = f"{PIECES}, ids binary" if with_ids else PIECES
    out, end = arrow_schema(schema), np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*[c.to_pylist() for c in batch.columns]):
                ids = encoder(path)(text or "") + end
                for piece, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start:4 * (start + length)]
                    rows.append((doc_id, piece, start, length, zlib.crc32(own), own)[:len(out)])
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)


def sum_of_squares(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each piece, taken in the given order."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    counts = np.zeros(capacity + 1, np.int64)
    sequences, offsets, opened = [], [], 0
    for length in lengths:
        gaps = counts[length:]
        fits = np.flatnonzero(gaps)
        if fits.size:
            # Moving one sequence from gap g to gap g - length changes the sum by 2 (after - before) + 2;
            # a sequence that becomes full leaves the count.
            change = 2 * (counts[fits] - gaps[fits]) + 2
            if fits[0] == 0:
                change[0] = 1 - 2 * gaps[0]
            rest = int(fits[change.argmin()])
            gap = rest + length
            sequence = open_by_gap[gap].pop()
            counts[gap] -= 1
        else:
            sequence, gap, opened = opened, capacity, opened + 1
            rest = capacity - length
        if rest:
            open_by_gap[rest].append(sequence)
            counts[rest] += 1
        sequences.append(sequence)
        offsets.append(capacity - gap)
    return sequences, offsets


def place(pieces: DataFrame, capacity: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces (with a ``length``); ``pieces`` should be stored, it is read twice.

    Full pieces need no search. The others are packed by groups; their number follows from the count of pieces.
    """
    n_groups = max(1, -(-pieces.where(F.col("length") < capacity).count() // group_pieces))
    keyed = pieces.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_groups)).cast("int"))
    names = pieces.columns

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sequences, offsets = sum_of_squares(frame["length"].tolist(), capacity)
        group = int(frame["__group"].iloc[0])
        return frame[names].assign(sequence_id=np.array(sequences, np.int64) * n_groups + group, offset=np.array(offsets, np.int64))

    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id bigint, offset bigint"
    packed = keyed.where(F.col("length") < capacity).groupBy("__group").applyInPandas(pack, schema)
    full = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return packed.union(full)


def pack(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """All pieces of all documents with their place; see ``tokenize`` and ``place``."""
    return place(cut_lineage(tokenize(docs, path, capacity, end_id, with_ids)), capacity)


def sequences(placed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from placed pieces with ``ids``; a sequence has at most ``capacity`` pieces."""
    part = F.struct("offset", F.hex("ids").alias("ids"))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(part)), lambda p: p["ids"]))
    return placed.groupBy("sequence_id").agg(F.unhex(joined).alias("ids"))
