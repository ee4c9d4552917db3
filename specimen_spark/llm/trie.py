"""Trie of conversation prefixes from sorted neighbours, by union-find over their common depths.

Every conversation is a path of turns. Sorted paths that share a prefix are neighbours, so the depth to which each path
agrees with the one before holds the whole trie: edges between neighbours are taken in descending depth, union-find
merges the components they join, and every merge makes a node where branches meet. Steps:

1. Turns are numbered by exact ranks and keyed by digest. A turn whose key no other conversation has at that depth
   ends what is shared; from there on a conversation is alone, and those nodes follow from its turns row by row. So
   only shared prefixes become paths, and a long conversation of its own never meets in a task.
2. Equal paths become one row with the number and least id of their conversations.
3. Distinct paths are range-sorted into partitions of bounded bytes. Each partition makes its forest by union-find.
   Nodes that the neighbouring partition has too, which are prefixes of the paths at its two ends, are contracted to
   partial sums: counts, leaves and savings add up, and the first partition that holds a node counts it as a child.
   A sum for each such node merges the forests across boundaries.
4. Ids of conversations that end at a node are joined for ranges of ids, and the ranges run through the digest one
   after another, so that no task holds all of them.

Defined cases: turns are ordered by turn (null first), then role, then text; null roles and texts are empty. Rows
without a conv_id belong to no conversation. Repeated rows are turns of their own. Empty tables give no node; a
conversation without turns left is a member of the root only. Other columns are not looked at. Turns are told apart
by 128-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema
from specimen_spark.operators.keyed import attach, sorted_rank
from specimen_spark.session import cut_lineage

SHARED_TURNS, GROUP_IDS = 4, 20
STEP = 20  # bytes of a turn in a path: 16 of the digest, 4 of the word count
PARTITION_BYTES = 8 << 20
ID_RANGE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


# -- conversations ----------------------------------------------------------------------------------------------------


def rebuild(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, role, text) of every conversation with its shared opening, and a row of depth 0 for each.

    Conversation c opens with the first h turns of conversation c - c % 20, then come its own turns after its first h;
    h is crc32 of its decimal id modulo 4.
    """
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = sorted_rank(turns, ["conv_id"], ["turn", "role", "text"], "place").drop("turn")
    opening = turns.where(f"conv_id % {GROUP_IDS} = 0 AND place < {SHARED_TURNS}").withColumnRenamed("conv_id", "head")
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED_TURNS))
    ids = turns.select("conv_id").distinct().select("conv_id", F.expr(f"conv_id - conv_id % {GROUP_IDS}").alias("head"), taken.alias("taken"))
    opened = ids.join(opening.groupBy("head").agg(F.max("place").alias("there")), "head", "left").select(
        "conv_id", "head", "taken", F.least("taken", F.coalesce("there", F.lit(0))).alias("opened"))
    opened = cut_lineage(opened)
    first = opened.join(opening, "head").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "role", "text")
    own = attach(turns, opened.select("conv_id", "taken", "opened"), ["conv_id"], "inner").where("place > taken").select(
        "conv_id", (F.col("place") - F.col("taken") + F.col("opened")).alias("depth"), "role", "text")
    nothing = F.lit(None).cast("string")
    starts = opened.select("conv_id", F.lit(0).cast("bigint").alias("depth"), nothing.alias("role"), nothing.alias("text"))
    return starts.union(first).union(own)


def keyed_turns(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, depth, step): a turn as the bytes of a path."""
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))
    counted = F.unhex(F.lpad(F.hex(words.cast("bigint")), 8, "0"))
    start = F.col("conv_id").cast("string").cast("binary")  # of one conversation only
    return rebuilt.select("conv_id", "depth", F.when(F.col("depth") > 0, F.concat(digest, counted)).otherwise(start).alias("step"))


# -- one partition's forest -------------------------------------------------------------------------------------------

NODES = ("key string, parent_key string, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
         "n_leaves bigint, saved_tokens bigint, ends string, shared boolean")


def common_depth(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common."""
    low, high = 0, min(len(a), len(b)) // STEP
    while low < high:
        middle = (low + high + 1) // 2
        if a[:STEP * middle] == b[:STEP * middle]:
            low = middle
        else:
            high = middle - 1
    return low


def node_key(path: bytes, depth: int) -> str:
    return hashlib.md5(path[:STEP * depth]).hexdigest()


class Forest:
    """Nodes of sorted distinct paths, some of which reach into the partitions before and after.

    ``before`` and ``after`` are the depths to which the first and last path agree with the neighbouring partitions'
    paths, -1 where there is none.
    """

    def __init__(self, paths: list[bytes], n: list[int], least: list[int], alone: list[int], ends: list[str | None], before: int, after: int):
        self.paths, self.n, self.least, self.alone, self.ends = paths, n, least, alone, ends
        self.before, self.after = before, after
        self.depths = [len(p) // STEP for p in paths]
        self.edges = [common_depth(a, b) for a, b in zip(paths, paths[1:])]
        self.nodes: list[list] = []

    def words(self, i: int, depth: int) -> int:
        return int.from_bytes(self.paths[i][STEP * depth - 4:STEP * depth], "big") if depth else 0

    def build(self) -> list[list]:
        """[first path, last path, depth, n, least, children, leaves, saved, ends, parent node] of every node."""
        k = len(self.paths)
        self.parent = list(range(k))
        # A component is known by its first path: last path, depth of its top, sums, and the nodes right below its top.
        self.last, self.top = list(range(k)), list(self.depths)
        self.children, self.saved, self.below = list(self.alone), [0] * k, [[] for _ in range(k)]
        self.total, self.first_id = list(self.n), list(self.least)
        following = [*self.edges, self.after]
        self.leaves = [a or int(f < d) for a, f, d in zip(self.alone, following, self.depths)]
        self.end = list(self.ends)
        for edge in sorted(range(k - 1), key=lambda e: -self.edges[e]):
            self.merge(self.find(edge), self.find(edge + 1), self.edges[edge])
        root = self.find(0)
        self.raise_to(root, 0)
        self.close(root)
        return self.nodes

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def merge(self, a: int, b: int, depth: int) -> None:
        """Two neighbouring components meet in a node at this depth, which a path's end or an earlier merge may have made."""
        self.raise_to(a, depth)
        self.raise_to(b, depth)
        self.parent[b], self.last[a] = a, self.last[b]
        self.total[a] += self.total[b]
        self.first_id[a] = min(self.first_id[a], self.first_id[b])
        self.children[a] += self.children[b]
        self.leaves[a] += self.leaves[b]
        self.saved[a] += self.saved[b]
        self.below[a] += self.below[b]
        self.below[b] = []
        self.end[a] = self.end[a] or self.end[b]

    def counted_here(self, c: int, depth: int) -> bool:
        """Whether no partition before has the node."""
        return c > 0 or depth > self.before

    def close(self, c: int) -> int:
        """Put down the top of a component; its saving is known now."""
        depth, words = self.top[c], self.words(c, self.top[c])
        self.saved[c] += self.total[c] * words - words * self.counted_here(c, depth)
        self.nodes.append([c, self.last[c], depth, self.total[c], self.first_id[c], self.children[c], self.leaves[c], self.saved[c], self.end[c], -1])
        for child in self.below[c]:
            self.nodes[child][-1] = len(self.nodes) - 1
        return len(self.nodes) - 1

    def raise_to(self, c: int, depth: int) -> None:
        """Walk a component's top up to a depth; the nodes passed on the way have one child each."""
        while self.top[c] > depth:
            node, passed = self.close(c), self.top[c]
            self.top[c], self.below[c], self.end[c] = passed - 1, [node], None
            self.children[c] = int(self.counted_here(c, passed))

    def rows(self) -> Iterator[tuple]:
        """NODES; shared ones are partial sums and known by key, and so are the nodes below which others hang."""
        final = len(self.paths) - 1

        def shared(first: int, last: int, depth: int) -> bool:
            return first == 0 and depth <= self.before or last == final and depth <= self.after

        nodes = self.build()
        for first, last, depth, n, least, children, leaves, saved, end, parent in nodes:
            own = shared(first, last, depth)
            hangs = self.alone[first] > 0 and self.depths[first] == depth
            key = node_key(self.paths[first], depth) if own or hangs else None
            parent_key = parent_id = None
            if parent >= 0:
                above = nodes[parent]
                if own or shared(above[0], above[1], above[2]):
                    parent_key = node_key(self.paths[first], depth - 1)
                else:
                    parent_id = above[4]
            yield key, parent_key, least, depth, parent_id, n, children, leaves, saved, end, own


def forest_rows():
    """The function that makes a partition's NODES."""
    out = arrow_schema(NODES)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("path")
        made = Forest(*[table[c].to_pylist() for c in ("path", "n", "least", "alone", "ends")], table["before"][0].as_py(), table["after"][0].as_py())
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*made.rows()), out)], schema=out)

    return run


# -- the whole trie ---------------------------------------------------------------------------------------------------


def end_digests(ended: DataFrame) -> DataFrame:
    """(path_key, ends): SHA-256 of the ascending ids of the conversations (path_key, conv_id) that end at a path."""
    ranges = ended.groupBy("path_key", F.expr(f"conv_id div {ID_RANGE} - int(conv_id < 0)").alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    schema = "path_key string, ends string"
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for path_key, ids in zip(batch["path_key"].to_pylist(), batch["ids"].to_pylist()):
                if path_key != key:
                    if key is not None:
                        done.append((key, digest.hexdigest()))
                    key, digest = path_key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([digest.hexdigest()])], schema=out)

    return ranges.repartition("path_key").sortWithinPartitions("path_key", "range").select("path_key", "ids").mapInArrow(run, schema)


def shared_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, turns, path, path_key, alone): what each conversation shares, and from which depth it is alone."""
    common = turns.where("depth > 0").groupBy("depth", "step").agg(F.count("*").alias("n")).where("n > 1").select("depth", "step", F.lit(True).alias("common"))
    marked = attach(turns, common, ["depth", "step"])
    steps = marked.groupBy("conv_id").agg(
        F.max("depth").alias("turns"), F.min(F.expr("if(depth > 0 AND common IS NULL, depth, null)")).alias("alone"),
        F.collect_list(F.expr("if(common, struct(depth, step), null)")).alias("steps"))
    steps = steps.withColumn("steps", F.sort_array(F.expr("filter(steps, x -> alone IS NULL OR x.depth < alone)")))
    # Concatenated as text, since arrays of bytes cannot be joined.
    path = F.unhex(F.array_join(F.expr("transform(steps, x -> hex(x.step))"), ""))
    pathed = steps.select("conv_id", "turns", "alone", path.alias("path"))
    return pathed.withColumn("path_key", F.md5("path"))


def trie(rebuilt: DataFrame, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The nodes of conversations (conv_id, depth from 1, role, text; one row of depth 0 each)."""
    turns = cut_lineage(keyed_turns(rebuilt))
    convs = cut_lineage(shared_paths(turns))
    ended = end_digests(convs.where("alone IS NULL").select("path_key", "conv_id"))
    paths = convs.groupBy("path").agg(
        F.count("*").alias("n"), F.min("conv_id").alias("least"), F.count("alone").alias("alone")).withColumn("path_key", F.md5("path"))
    paths = attach(paths, ended, ["path_key"]).drop("path_key")
    size = convs.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
    parts = max(1, -(-int(size) // partition_bytes))
    ranged = cut_lineage(paths.repartitionByRange(parts, "path").withColumn("part", F.spark_partition_id()))
    # The ends of each partition, beside those of its neighbours: one row a partition.
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    bounds = ranged.groupBy("part").agg(F.min("path").alias("low"), F.max("path").alias("high")).select(
        "part", "low", "high", F.lag("high").over(order).alias("left"), F.lead("low").over(order).alias("right"))
    depth = F.udf(lambda a, b: -1 if a is None or b is None else common_depth(a, b), "int")
    bounds = bounds.select("part", depth("left", "low").alias("before"), depth("high", "right").alias("after"))
    nodes = cut_lineage(attach(ranged, bounds, ["part"], "inner").groupBy("part").applyInArrow(forest_rows(), NODES))

    merged = nodes.where("shared").groupBy("key").agg(
        F.max("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        F.lit(None).cast("bigint").alias("parent_conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("ends").alias("ends"))
    merged = cut_lineage(merged)
    inner = nodes.where("NOT shared").drop("shared").unionByName(merged)
    # Alone: one node a turn, below the end of the shared path or the turn before.
    alone = attach(turns.drop("step"), convs.where("alone IS NOT NULL").select("conv_id", "alone", "turns", "path_key"), ["conv_id"], "inner").where("depth >= alone")
    is_first, is_last = F.col("depth") == F.col("alone"), F.col("depth") == F.col("turns")
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    tails = alone.select(
        F.lit(None).cast("string").alias("key"), F.when(is_first, F.col("path_key")).alias("parent_key"), "conv_id", F.col("depth").cast("bigint").alias("depth"),
        F.when(~is_first, F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"), F.when(is_last, none).otherwise(one).alias("n_children"),
        one.alias("n_leaves"), none.alias("saved_tokens"), F.when(is_last, F.sha2(F.col("conv_id").cast("string"), 256)).alias("ends"))
    every = inner.unionByName(tails)
    named = inner.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    hung = attach(every.where("parent_key IS NOT NULL"), named, ["parent_key"])
    whole = every.where("parent_key IS NULL").withColumn("above", F.col("parent_conv_id")).union(hung)
    return whole.select(
        "conv_id", "depth", F.col("above").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The trie of all rebuilt conversations of (conv_id, turn, role, text)."""
    return trie(cut_lineage(rebuild(conversations)))
