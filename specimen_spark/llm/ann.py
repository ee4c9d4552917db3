"""Nearest neighbours by largest inner product: inverted lists scanned dimension by dimension.

Vectors get one more coordinate that makes them equally long, so the largest inner product is the smallest distance,
and are rotated at random, so that any first coordinates are a fair sample of all. Every vector goes into the list
of its nearest centroid; a query looks at its nearest lists. Inside a list, distances grow column block by column
block; after each block a hypothesis test compares the distance so far, scaled up to all dimensions, with the
k-th best distance known and drops candidates that are too far with high confidence. What is left at the end is
scored exactly, in double precision on the original vectors.

The centroids are fitted on a bounded sample (``sample_rows``), and so is the number of lists a query looks at: the
smallest one that holds ``target`` of the true neighbours of sampled queries inside the sample. Every row is indexed.
Lists that are hot are split by hash on both sides, vectors and queries.

Defined cases: vectors that are null, zero, or hold a null or non-finite component, rows without an id, and vectors
that are not as long as most take no part. An id asks once: of the rows that share a query id, the vector that sorts
first asks. All of them are the query's own and never its neighbours, nor do they count among the rows it looks at.
Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from specimen_spark.llm.batches import arrow_schema
from specimen_spark.session import cut_lineage

BLOCK = 16
FOUND = "query_id bigint, vec_id bigint, score double"


@dataclass
class Index:
    """What tasks need: bounded by lists x dimensions."""

    centroids: np.ndarray
    rotation: np.ndarray
    length: float
    probes: int


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").cast("bigint"), v.alias("v"))
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).where(F.exists("v", lambda x: x != 0))
    usual = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").limit(1).select("n")
    return rows.join(F.broadcast(usual), F.size("v") == F.col("n")).drop("n")  # one number


def extend(x: np.ndarray, length: float) -> np.ndarray:
    """One more coordinate, so that all vectors have the same length."""
    rest = np.sqrt(np.maximum(length ** 2 - (x ** 2).sum(axis=1), 0))
    return np.hstack([x, rest[:, None]])


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Centroids of each row, nearest first."""
    return np.argsort((centroids ** 2).sum(axis=1) - 2 * x @ centroids.T, axis=1, kind="stable")


def fit(rows: DataFrame, k: int, sample_rows: int, target: float, seed: int) -> Index:
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = rows.agg(F.count("*").alias("n"), F.max(norm).alias("m")).first()
    n = size["n"]
    step = max(1, n // sample_rows)
    taken = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(step)) == 0).orderBy("vec_id").select("vec_id", "v").collect()
    if not taken:
        taken = rows.orderBy("vec_id").limit(sample_rows).select("vec_id", "v").collect()
    ids, sample = np.array([r["vec_id"] for r in taken]), np.array([r["v"] for r in taken])
    rng = np.random.default_rng(seed)
    x = extend(sample, length := float(np.sqrt(size["m"])))
    rotation, _ = np.linalg.qr(rng.standard_normal((x.shape[1], x.shape[1])))
    n_lists = int(min(len(x), 4096, max(1, round(n ** 0.5 / 4))))
    centroids = x[rng.choice(len(x), n_lists, replace=False)].copy()
    for _ in range(10):
        own = nearest(x, centroids)[:, 0]
        counts = np.bincount(own, minlength=n_lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    own = nearest(x, centroids)[:, 0]
    asked = rng.choice(len(x), min(256, len(x)), replace=False)
    queries = np.hstack([sample[asked], np.zeros((len(asked), 1))])
    inner = queries @ x.T
    inner[ids[asked][:, None] == ids] = -np.inf
    true = np.argsort(-inner, axis=1)[:, :min(k, max(1, len(x) - 1))]
    order = nearest(queries, centroids)
    place = np.argsort(order, axis=1)
    needed = np.sort(np.take_along_axis(place, own[true], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return Index(centroids, rotation, length, probes)


def scan(queries: np.ndarray, vectors: np.ndarray, k: int, own: np.ndarray, confidence: float = 2.1) -> list[np.ndarray]:
    """Candidates left for each query (rotated, as are the vectors); blocks of columns, then tests.

    ``own`` has the first row that is the query's own and the one after the last; they set no bound.
    """
    dims = vectors.shape[1]
    columns = [np.ascontiguousarray(vectors[:, a:a + BLOCK]) for a in range(0, dims, BLOCK)]
    left = []
    for q, (low, high) in zip(queries, own):
        alive = np.concatenate([np.arange(low), np.arange(high, len(vectors))])
        first = ((vectors[alive[:4 * k]] - q) ** 2).sum(axis=1)
        bound = np.partition(first, k - 1)[k - 1] * (1 + 1e-5) if len(first) >= k else np.inf
        partial, done = np.zeros(len(alive)), 0
        for column in columns:
            width = column.shape[1]
            partial = partial + ((column[alive] - q[done:done + width]) ** 2).sum(axis=1)
            done += width
            scaled = partial * (dims / done)
            slack = 1.0 if done == dims else (1 + confidence / np.sqrt(done)) ** 2
            near = scaled <= bound * slack
            alive, partial = alive[near], partial[near]
        if len(alive) > k:  # ties of the last place stay
            alive = alive[partial <= np.partition(partial, k - 1)[k - 1] * (1 + 1e-5)]
        left.append(alive)
    return left


def search(vectors: DataFrame, k: int = 20, query_step: int = 20, sample_rows: int = 8192, target: float = 0.98,
           list_rows: int = 20_000, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row whose id is divisible by ``query_step``."""
    rows = cut_lineage(usable(vectors))
    result_schema = "query_id bigint, rank int, vec_id bigint, score double"
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], result_schema)
    index = fit(rows, k, sample_rows, target, seed)
    shared = rows.sparkSession.sparkContext.broadcast(index)
    spark, placed = rows.sparkSession, "list int, vec_id bigint, v array<double>"
    placed_arrow = arrow_schema(placed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = extend(np.array(batch["v"].to_pylist()), shared.value.length) if batch.num_rows else None
            if x is not None:
                own = nearest(x, shared.value.centroids)[:, 0].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(own), batch["vec_id"], batch["v"].cast(placed_arrow.field(2).type)], schema=placed_arrow)

    indexed = cut_lineage(rows.mapInArrow(assign, placed))
    sizes = {r["list"]: r["n"] for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # one per list
    list_sizes = np.array([sizes.get(i, 0) for i in range(len(index.centroids))])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.array(batch["v"].to_pylist())
            order = nearest(np.hstack([v, np.zeros((len(v), 1))]), shared.value.centroids)
            seen = np.cumsum(list_sizes[order], axis=1)
            wanted = 4 * k + batch["own"].to_numpy()  # a query goes on to further lists until it has seen that many rows
            take = np.maximum(shared.value.probes, (seen < wanted[:, None]).sum(axis=1) + 1)
            take = np.minimum(take, order.shape[1])
            for start in range(0, len(v), 256):
                own = np.concatenate([order[i, :take[i]] for i in range(start, min(start + 256, len(v)))]).astype(np.int32)
                who = np.repeat(np.arange(start, min(start + 256, len(v))), take[start:start + 256])
                part = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array(own), part["vec_id"], part["v"].cast(placed_arrow.field(2).type)], schema=placed_arrow)

    asking = indexed.where(F.col("vec_id") % query_step == 0).groupBy("vec_id")
    queries = cut_lineage(asking.agg(F.min("v").alias("v"), F.count("*").alias("own")))
    probing = cut_lineage(queries.repartition(max(1, -(-queries.count() // 2000)), "vec_id").mapInArrow(probe, placed))
    asked = {r["list"]: r["n"] for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = spark.createDataFrame(
        [(i, -(-sizes[i] // list_rows), -(-asked[i] // list_rows)) for i in sizes if i in asked], "list int, nv int, nq int")

    def dealt(df: DataFrame, own: str, other: str, own_name: str, other_name: str) -> DataFrame:
        with_parts = df.join(F.broadcast(parts), "list")  # one row per list
        return with_parts.select("list", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int").alias(own_name),
                                 F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name))

    found_arrow = arrow_schema(FOUND)

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_arrow.empty_table()
        left = left.sort_by("vec_id")
        ids, v = left["vec_id"].to_numpy(), np.array(left["v"].to_pylist())
        query_ids, q = right["vec_id"].to_numpy(), np.array(right["v"].to_pylist())
        rotation = shared.value.rotation
        turned = (extend(v, shared.value.length) @ rotation).astype(np.float32)
        asked_turned = (np.hstack([q, np.zeros((len(q), 1))]) @ rotation).astype(np.float32)
        out = []
        own = np.stack([np.searchsorted(ids, query_ids, side) for side in ("left", "right")], axis=1)
        for i, alive in enumerate(scan(asked_turned, turned, k, own)):
            scores = (v[alive] * q[i]).sum(axis=1)
            best = np.lexsort((ids[alive], -scores))[:k]
            out.append((np.full(len(best), query_ids[i]), ids[alive][best], scores[best]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], schema=found_arrow)

    found = dealt(indexed, "nv", "nq", "pv", "pq").groupBy("list", "pv", "pq").cogroup(
        dealt(probing, "nq", "nv", "pq", "pv").groupBy("list", "pv", "pq")).applyInArrow(match, FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
