"""Removal of long strings that an earlier document has too, by bucket-pointer refinement of suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Most strings
of a corpus are unique and need no sorting. So candidates are chosen by content first: of the q-grams inside a
string, the one with the smallest hash (the leftmost, if tied) is its anchor, and equal strings have equal anchors.

1. Rows are dealt to blocks by their place in the input. A block sends the hashes of its anchors' q-grams, packed, to
   hash buckets, and learns which of them other blocks have too.
2. The strings of anchors that several documents have are compared by ``refine``: suffixes start in buckets of equal
   8 bytes, and a bucket is sorted by the bucket pointers of the suffixes 8, 16 and 18 bytes later. Pointers are
   replaced after each pass and the next one reads them, so depth grows from 8 to 16, 32 and 50 bytes. Buckets of one
   suffix or one owner are final. No hash decides here: first buckets are the bytes themselves. First inside each
   block: of equal strings only those of the smallest document go on, the others are found already. So however many
   copies a string has, a block sends it once. Then over all blocks, by bucket of the anchor's hash. An anchor that
   has many different surroundings in some block is hot: its strings go one by one, by the hash of all their bytes, so
   only equal ones meet, at most one a block and document.
3. Found strings return to their block, and their bytes are cut out of the texts.

The texts are shuffled once; all three passes of a block read that shuffle. Block numbers must come out the same if a
lost task is run again, as they do over files.

Defined cases: a null text is empty; an empty or short text stays as it is. Documents without an id stay and remove
nothing. Rows with the same id do not remove from each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from specimen_spark.llm.batches import arrow_schema

LENGTH, Q = 50, 24
SPAN = LENGTH - Q + 1  # q-grams in a string, so at most so many strings have one anchor
STEPS = (8, 16, LENGTH - 32)  # offsets whose pointers take the depth from 8 bytes to 16, 32 and LENGTH
BLOCK_BYTES = 4 << 20
MAX_TASKS = 10_000  # beyond so many blocks, a task takes several one after another
CHUNK = 1 << 18
HASH_BYTES = 6
HOT_SPANS = 64  # different surroundings in one block that make an anchor hot
K = np.uint64(0x9E3779B97F4A7C15)
LOW = np.uint64(0xFFFFFFFF)
GRAMS = "bucket int, block int, hashes binary, hot binary"
SHARED = "block int, bucket int, bits binary, hot binary"
STRINGS = "bucket int, block int, found binary, runs binary, bytes binary"
FOUND = "block int, found binary"
RUN = np.dtype([("doc_id", "<i8"), ("doc", "<i4"), ("first", "<i4"), ("strings", "u1")])
HIT = np.dtype([("doc", "<i4"), ("first", "<i4"), ("mask", "<u4")])


def scramble(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * K
    return h ^ (h >> np.uint64(29))


def words_of(buffer: np.ndarray) -> np.ndarray:
    """The 8 bytes at every position as one number; a view."""
    return np.ndarray((max(0, len(buffer) - 7),), "<u8", buffer.data if len(buffer) > 7 else b"\0" * 8, strides=(1,))


def gram_hashes(words: np.ndarray, at) -> np.ndarray:
    """Hashes of the q-grams at positions (or a slice of them)."""
    h = None
    for i in range(0, Q, 8):
        word = words[at.start + i:at.stop + i] if isinstance(at, slice) else words[at + i]
        h = scramble(np.zeros(len(word), np.uint64) if h is None else h, word)
    return h


class Block:
    """The texts of a block, sorted by id, in one buffer."""

    def __init__(self, table: pa.Table):
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")])  # nulls last
        self.table = table.take(order)
        texts = [(t or "").encode() for t in self.table["text"].to_pylist()]
        self.known = pc.is_valid(self.table["doc_id"]).to_numpy()
        self.ids = pc.fill_null(self.table["doc_id"], 0).to_numpy()
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.words = words_of(self.buffer)

    def runs(self) -> tuple[np.ndarray, ...]:
        """Hash, document, first string and number of strings of each anchor, over strings inside a document."""
        parts, total = [], len(self.buffer) - LENGTH + 1
        for low in range(0, total, CHUNK):
            high = min(total, low + CHUNK)
            h = gram_hashes(self.words, slice(low, high + SPAN - 1))
            key = (h & ~LOW) | np.arange(len(h), dtype=np.uint64)
            width = 1
            while 2 * width <= SPAN:
                key = np.minimum(key[:-width], key[width:])
                width *= 2
            key = np.minimum(key[:len(key) - (SPAN - width)], key[SPAN - width:])
            place = (key & LOW).astype(np.int64)
            string = np.arange(low, high)
            ended = self.ends[np.searchsorted(self.ends, low, side="right"):np.searchsorted(self.ends, high, side="left")]
            doc = np.searchsorted(self.ends, low, side="right") + np.cumsum(np.bincount(ended - low, minlength=high - low))
            inside = np.flatnonzero((string + LENGTH <= self.ends[doc]) & self.known[doc])
            if not len(inside):
                continue
            place, string, doc = place[inside], string[inside], doc[inside]
            new = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (string[1:] != string[:-1] + 1)))
            count = np.diff(np.append(new, len(place)))
            parts.append((h[place[new]], doc[new], string[new], count))
        if not parts:
            return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
        return tuple(np.concatenate(p) for p in zip(*parts))


def bucket_slices(hashes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted distinct truncated hashes of each bucket."""
    short = np.sort(hashes >> np.uint64(64 - 8 * HASH_BYTES))
    short = short[np.append(True, short[1:] != short[:-1])] if len(short) else short
    bucket = bucket_numbers(short, n_buckets)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(bucket[part[0]]), short[part]


def bucket_numbers(short: np.ndarray, n_buckets: int) -> np.ndarray:
    return (((short * K) >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)


def pack_hashes(short: np.ndarray) -> bytes:
    return short.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :HASH_BYTES].tobytes()


def unpack_hashes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, HASH_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :HASH_BYTES] = raw
    return wide.view("<u8").ravel()


def spread(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Run and start of every string of the runs."""
    run = np.repeat(np.arange(len(first)), count)
    return run, first[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)


def refine(words: np.ndarray, string: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Smallest owner of an equal string, for the strings that start at rising positions of a buffer.

    ``low`` and ``high`` are the smallest and largest owner of every position. ``pointer`` holds the bucket of a
    suffix as the place where its bucket begins in the order of suffixes. A suffix that is final keeps its pointer:
    whatever it would still be told from is in no bucket with it, or has the same owner.
    """
    needed = [np.zeros(len(words), bool)]  # positions by the depth their pointers must reach, deepest first
    needed[0][string] = True
    for step in STEPS[::-1]:
        wider = needed[-1].copy()
        wider[step:] |= needed[-1][:-step]
        needed.append(wider)
    least = low[string]
    pointer = np.zeros(len(words), np.uint32)
    going = np.flatnonzero(needed.pop())
    key, base = words[going], np.zeros(len(going), np.uint32)
    for step in (*STEPS, None):
        order = np.argsort(key)
        going, key, base = going[order], key[order], base[order]
        new = np.append(True, key[1:] != key[:-1])[:len(key)]
        heads = np.flatnonzero(new)
        if not len(heads):
            break
        sizes = np.diff(np.append(heads, len(key)))
        least_of, most_of = np.minimum.reduceat(low[going], heads), np.maximum.reduceat(high[going], heads)
        if step is None:
            least[np.searchsorted(string, going)] = np.repeat(least_of, sizes)
            break
        parent = np.flatnonzero(np.append(True, base[1:] != base[:-1]))
        inside = heads - parent[np.searchsorted(parent, heads, side="right") - 1]
        pointer[going] = np.repeat(base[heads] + inside.astype(np.uint32), sizes)
        going = going[np.repeat((sizes > 1) & (least_of < most_of), sizes)]
        going = going[needed.pop()[going]]
        base = pointer[going]
        key = base.astype(np.uint64) << np.uint64(32) | pointer[going + step]
    return least


def hits(run: np.ndarray, string: np.ndarray, removed: np.ndarray, doc: np.ndarray, first: np.ndarray, absolute: np.ndarray) -> np.ndarray:
    """One HIT per run with removed strings; ``absolute`` is where the run starts in the numbering of ``string``."""
    masks = np.zeros(len(doc), np.uint32)
    np.bitwise_or.at(masks, run[removed], np.uint32(1) << (string - absolute[run])[removed].astype(np.uint32))
    some = np.flatnonzero(masks)
    out = np.zeros(len(some), HIT)
    out["doc"], out["first"], out["mask"] = doc[some], first[some], masks[some]
    return out


def string_hashes(words: np.ndarray, string: np.ndarray) -> np.ndarray:
    return scramble(scramble(gram_hashes(words, string), gram_hashes(words, string + Q)), words[string + LENGTH - 8])


def hot_anchors(words: np.ndarray, short: np.ndarray, first: np.ndarray, count: np.ndarray, hot_spans: int) -> np.ndarray:
    """Sorted hashes of the anchors with at least ``hot_spans`` spans that differ at an end."""
    order = np.argsort(short)
    heads = np.flatnonzero(np.append(True, short[order][1:] != short[order][:-1])[:len(order)])
    sizes = np.diff(np.append(heads, len(order)))
    often = order[np.repeat(sizes >= hot_spans, sizes)]
    ends = scramble(words[first[often]] * K, words[first[often] + count[often] + LENGTH - 9])
    sides = np.unique(np.stack([short[often], ends], axis=1), axis=0)[:, 0]
    hashes, spans = np.unique(sides, return_counts=True)
    return hashes[spans >= hot_spans]


def send_grams(n_buckets: int, hot_spans: int):
    out = arrow_schema(GRAMS)

    def run(table: pa.Table) -> pa.Table:
        number, block = table["block"][0].as_py(), Block(table)
        h, _, first, count = block.runs()
        hot = hot_anchors(block.words, h >> np.uint64(64 - 8 * HASH_BYTES), first, count, hot_spans)
        rows = [(b, number, pack_hashes(s), np.packbits(np.isin(s, hot)).tobytes()) for b, s in bucket_slices(h, n_buckets)]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out) if rows else out.empty_table()

    return run


def bits_of(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def mark_shared(table: pa.Table) -> pa.Table:
    """Bits of the hashes that more than one block has, and of those that are hot in some block."""
    blobs = [unpack_hashes(x.as_py()) for x in table["hashes"]]
    everything, inverse, counts = np.unique(np.concatenate(blobs), return_inverse=True, return_counts=True)
    hot = np.zeros(len(everything), bool)
    hot[inverse[np.concatenate([bits_of(x.as_py(), len(blob)) for x, blob in zip(table["hot"], blobs)])]] = True
    edges = np.cumsum([0, *map(len, blobs)]).tolist()
    bits = [[np.packbits(flags[inverse[a:b]]).tobytes() for a, b in zip(edges, edges[1:])] for flags in (counts > 1, hot)]
    out = pa.schema([("block", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary()), ("hot", pa.binary())])
    return pa.table([table["block"], table["bucket"], *[pa.array(b, pa.binary()) for b in bits]], schema=out)


def send_strings(n_buckets: int):
    out = arrow_schema(STRINGS)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        block = Block(table)
        h, doc, first, count = block.runs()
        if not len(h):
            return out.empty_table()
        short = h >> np.uint64(64 - 8 * HASH_BYTES)
        answered = dict(zip(answers["bucket"].to_pylist(), zip(answers["bits"].to_pylist(), answers["hot"].to_pylist())))
        slices = [(s, *[bits_of(x, len(s)) for x in answered[b]]) for b, s in bucket_slices(h, n_buckets)]
        abroad = np.isin(short, np.concatenate([s[shared] for s, shared, _ in slices]))
        hot = np.isin(short, np.concatenate([s[marked] for s, _, marked in slices]))
        order = np.argsort(short)
        heads = np.flatnonzero(np.append(True, short[order][1:] != short[order][:-1]))
        sizes = np.diff(np.append(heads, len(order)))
        several = np.zeros(len(h), bool)
        several[order] = np.repeat(np.minimum.reduceat(doc[order], heads) < np.maximum.reduceat(doc[order], heads), sizes)
        chosen = np.flatnonzero(abroad | several)
        doc, first, count, abroad, hot, short = (x[chosen] for x in (doc, first, count, abroad, hot, short))
        run_of, string = spread(first, count)
        twice = several[chosen][run_of]
        removed = np.zeros(len(string), bool)
        if twice.any():
            rank = np.repeat(np.cumsum(np.append(0, block.ids[1:] != block.ids[:-1])), block.sizes).astype(np.int32)
            wanted = np.zeros(len(block.buffer), bool)
            wanted[string[twice]] = True
            starts = np.flatnonzero(wanted)
            wanted[starts] = rank[starts] > refine(block.words, starts, rank, rank)
            removed = wanted[string]
        found = hits(run_of, string, removed, doc, first - block.starts[doc], first)
        found_bucket = bucket_numbers(short, n_buckets)[np.unique(run_of[removed])]
        left = np.zeros(len(doc), bool)
        left[run_of[~removed]] = True
        sent = np.flatnonzero(left & abroad & ~hot)
        alone = np.flatnonzero(~removed & (abroad & hot)[run_of])
        bucket = np.concatenate([bucket_numbers(short[sent], n_buckets), bucket_numbers(string_hashes(block.words, string[alone]), n_buckets)])
        sent = np.concatenate([sent, run_of[alone]])
        begin = np.concatenate([first[sent[:len(sent) - len(alone)]], string[alone]])
        strings = np.concatenate([count[sent[:len(sent) - len(alone)]], np.ones(len(alone), np.int64)])
        runs = np.zeros(len(sent), RUN)
        runs["doc_id"], runs["doc"] = block.ids[doc[sent]], doc[sent]
        runs["first"], runs["strings"] = begin - block.starts[doc[sent]], strings
        number, rows = table["block"][0].as_py(), []
        view = memoryview(block.buffer)
        order, found_order = np.argsort(bucket, kind="stable"), np.argsort(found_bucket, kind="stable")
        begin, strings, runs, found = begin[order], strings[order], runs[order], found[found_order]
        used = np.unique(np.concatenate([bucket, found_bucket]))
        cuts = [np.searchsorted(x[o], used, side=side).tolist() for x, o in ((bucket, order), (found_bucket, found_order)) for side in ("left", "right")]
        lows, highs = begin.tolist(), (begin + strings).tolist()
        for b, low, high, found_low, found_high in zip(used.tolist(), *cuts):
            spans = [view[f:t + LENGTH - 1] for f, t in zip(lows[low:high], highs[low:high])]
            rows.append((b, number, found[found_low:found_high].tobytes(), runs[low:high].tobytes(), b"".join(spans)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out) if rows else out.empty_table()

    return run


def distinct_spans(data: bytes, first: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The number of each span among the distinct ones, and those."""
    numbers: dict[bytes, int] = {}
    which = [numbers.setdefault(data[f:f + n], len(numbers)) for f, n in zip(first.tolist(), lengths.tolist())]
    return np.array(which, np.int64), list(numbers)


def find_strings(table: pa.Table) -> pa.Table:
    """Refinement over the strings of all blocks in a bucket; passes on what the blocks found themselves.

    Runs with the same bytes are one run with several owners, so copies are sorted once.
    """
    blocks = table["block"].to_pylist()
    runs = [np.frombuffer(x.as_py(), RUN) for x in table["runs"]]
    origin = np.repeat(np.arange(len(blocks)), [len(r) for r in runs])
    every = np.concatenate(runs)
    found = [x.as_py() for x in table["found"]]
    if len(every):
        count = every["strings"].astype(np.int64)
        lengths = count + LENGTH - 1
        which, spans = distinct_spans(b"".join(x.as_py() for x in table["bytes"]), np.cumsum(lengths) - lengths, lengths)
        owner = np.unique(every["doc_id"], return_inverse=True)[1].astype(np.int32)
        order = np.argsort(which, kind="stable")
        heads = np.searchsorted(which[order], np.arange(len(spans)))
        low, high = np.minimum.reduceat(owner[order], heads), np.maximum.reduceat(owner[order], heads)
        sizes = np.fromiter(map(len, spans), np.int64, len(spans))
        words = words_of(np.frombuffer(b"".join(spans), np.uint8))
        start = np.cumsum(sizes) - sizes
        string = spread(start, sizes - LENGTH + 1)[1]
        least = np.zeros(len(words), np.int32)
        least[string] = refine(words, string, np.repeat(low, sizes), np.repeat(high, sizes))
        # Every string of every run, numbered by where it starts among the distinct spans.
        run_of, string = spread(start[which], count)
        removed = owner[run_of] > least[string]
        masks = hits(run_of, string, removed, np.arange(len(every)), np.zeros(len(every), np.int64), start[which])
        at = masks["doc"].astype(np.int64)
        masks["first"] = every["first"][at]
        masks["doc"] = every["doc"][at]
        edges = np.searchsorted(origin[at], np.arange(len(blocks) + 1)).tolist()
        found = [x + masks[a:b].tobytes() for x, a, b in zip(found, edges, edges[1:])]
    some = [i for i, x in enumerate(found) if x]
    return pa.table([pa.array([blocks[i] for i in some], pa.int32()), pa.array([found[i] for i in some], pa.binary())],
                    schema=pa.schema([("block", pa.int32()), ("found", pa.binary())]))


def cut_texts(out: pa.Schema, columns: list[str], as_text: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return out.empty_table()
        block = Block(table)
        found = np.frombuffer(b"".join(answers["found"].to_pylist()), HIT)
        starts = np.zeros(len(block.buffer) + 1, np.int8)
        first = block.starts[found["doc"]] + found["first"]
        for bit in range(SPAN):
            starts[first[(found["mask"] >> np.uint32(bit)) & np.uint32(1) > 0] + bit] = 1
        change = starts.astype(np.int32)
        change[LENGTH:] -= starts[:-LENGTH] if len(starts) > LENGTH else 0
        gone = np.cumsum(change) > 0
        edges = np.flatnonzero(gone[1:] != gone[:-1]) + 1  # a document's last byte may touch the next one's first
        edges = np.concatenate([[0], edges, [len(gone)]])
        rows = []
        data = block.buffer
        for low, high in zip(block.starts.tolist(), block.ends.tolist()):
            inner = edges[np.searchsorted(edges, low, side="right"):np.searchsorted(edges, high, side="left")].tolist()
            cuts = [low, *inner, high]
            spans = [(a - low, b - a) for a, b in zip(cuts, cuts[1:]) if b > a and gone[a]]
            kept = b"".join(data[a:b].tobytes() for a, b in zip(cuts, cuts[1:]) if b > a and not gone[a])
            if as_text:
                kept = kept.decode(errors="ignore")
            rows.append((kept, high - low, sum(n for _, n in spans), len(spans), [{"start": s, "length": n} for s, n in spans]))
        extra = [pa.array(c, out.field(len(columns) + i).type) for i, c in enumerate(zip(*rows))]
        return pa.Table.from_arrays([*[block.table[c].cast(out.field(i).type) for i, c in enumerate(columns)], *extra], schema=out)

    return run


def remove_repeats(docs: DataFrame, block_bytes: int = BLOCK_BYTES, as_text: bool = False, hot_spans: int = HOT_SPANS) -> DataFrame:
    """The rows of docs (doc_id, text and any others) with kept, n_bytes, n_removed, n_spans and spans.

    ``kept`` holds bytes, or text without the characters that were cut through. Columns of those names in ``docs``
    are replaced.
    """
    added = f"kept {'string' if as_text else 'binary'}, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start: bigint, length: bigint>>"
    taken = {*StructType.fromDDL(added).names, "block"}
    docs = docs.select(*[c for c in docs.columns if c not in taken]).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    columns = docs.columns
    size = int(docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)
    cores = docs.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-size // block_bytes), min(cores, size >> 20))
    place = F.xxhash64(F.monotonically_increasing_id())  # not the id or the text: either may be that of many rows
    dealt = docs.withColumn("block", F.pmod(place, F.lit(n_blocks)).cast("int"))

    def spread_by(df: DataFrame, column: str):
        """Groups by the number in a column, one a task, so that a task stays as small when the corpus grows."""
        return (df.repartitionById(n_blocks, column) if n_blocks <= MAX_TASKS else df.repartition(MAX_TASKS, column)).groupBy(column)

    by_block = spread_by(dealt, "block")
    grams = by_block.applyInArrow(send_grams(n_blocks, hot_spans), GRAMS)
    shared = spread_by(grams, "bucket").applyInArrow(mark_shared, SHARED)
    strings = by_block.cogroup(spread_by(shared, "block")).applyInArrow(send_strings(n_blocks), STRINGS)
    found = spread_by(strings, "bucket").applyInArrow(find_strings, FOUND)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", " + added
    return by_block.cogroup(spread_by(found, "block")).applyInArrow(cut_texts(arrow_schema(schema), columns, as_text), schema)
