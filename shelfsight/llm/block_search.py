"""Exact top-k search by inner product with block-at-a-time pruning.

Vectors become integers, and each dimension is a term. Documents are numbered so that similar ones are
neighbours (by nearest pivot, then by closeness to it), and ranges of BLOCK_ROWS numbers are blocks. A block
row is a forward index: its ids, its vectors, and the greatest and least value of every term. For a query, the
sum over the terms of what the block can give at most bounds the score of every document in it. Blocks are
taken in the order of that bound and scored through their forward index until the bounds fall below the k-th
best score. A bound equal to it still counts, so ties by id are exact.

Queries start with a floor: the k-th best score among the rows that stood beside them while blocks were cut.
Queries in chunks meet blocks in shards, one pair in a task at a time, both of bounded size; each pair sends at
most k rows a query at or above its floor. The pivots are a bounded sample (PIVOTS rows) and decide the order
only, never a result. Every row is indexed.

Defined results: a vector that is null, or holds a null, NaN or infinite component, takes no part, and neither
does a null id; vectors of different lengths are padded with zeros; an empty vector scores 0; components beyond
2**62 after scaling are cut to that, and a score beyond 64 bits to their range; rows equal in id and vector count
once; an id with several vectors is searched once for each of them, and a query never finds rows of its own id;
equal scores go by ascending id; fewer than k others are all returned; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import written
from .words import lean, runs

BLOCK_ROWS = 64
BUFFER_ROWS = 2048  # rows a task holds while it cuts blocks; a query's floor comes from its buffer
PIVOTS = 256
CHUNK_BYTES = 2 << 20  # integers of the queries in one chunk; their bounds on a shard are some 30 MB
SHARD_BYTES = 32 << 20  # integers of the blocks in one shard
LIMIT = 2 ** 62
EXACT = 2.0 ** 53  # inner products up to here are exact in doubles
LEAST = np.iinfo(np.int64).min
BLOCK_SCHEMA = "buffer bigint, place int, ids array<bigint>, rows array<bigint>, most array<bigint>, " \
               "least array<bigint>, asked array<int>, floors array<bigint>"
FIELDS = [f.split()[0] for f in BLOCK_SCHEMA.split(", ")]


def integers(vectors: pa.ListArray, scale: float, dims: int) -> np.ndarray:
    """floor(scale * x) of each component, padded to ``dims``."""
    sizes = np.diff(vectors.offsets.to_numpy())
    x = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(sizes), dims), np.int64)
    out[np.arange(dims) < sizes[:, None]] = np.clip(x, -float(LIMIT), float(LIMIT)).astype(np.int64)
    return out


def arithmetic(greatest: float, dims: int) -> type:
    """Doubles while all inner products are exact in them, else Python's integers."""
    return np.float64 if greatest * greatest * max(dims, 1) < EXACT else object


def usable(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v): rows that take part, components as doubles."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    known = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return (df.select(F.col(id).cast("bigint").alias("id"), v.alias("v"))
            .where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(known))


def flat(table: pa.Table, column: str) -> np.ndarray:
    """All elements of a list column."""
    return table.column(column).combine_chunks().flatten().to_numpy()


class Blocks:
    """The forward indexes of one shard."""

    def __init__(self, table: pa.Table, dims: int, number: type):
        sizes = np.diff(table.column("ids").combine_chunks().offsets.to_numpy())
        self.ids = flat(table, "ids")
        self.rows = flat(table, "rows").reshape(len(self.ids), dims).astype(number)
        self.most, self.least = (flat(table, c).reshape(len(sizes), dims).astype(number) for c in ("most", "least"))
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Queries by blocks: the sum over terms of the most that a document of the block can add."""
        return np.maximum(queries, 0) @ self.most.T + np.minimum(queries, 0) @ self.least.T

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's ``k`` best rows that reach its floor."""
        bounds = self.bounds(queries)
        order = np.argsort(-bounds, axis=1, kind="stable")
        floors = floors.astype(queries.dtype)
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, queries.dtype)]
        done, width = 0, 1
        active = np.arange(len(queries))
        while len(active) and done < bounds.shape[1]:
            turn = order[active, done:done + width]
            alive = np.take_along_axis(bounds[active], turn, 1) >= floors[active, None]
            found = [best]
            for block in np.unique(turn[alive]):
                asking = active[(alive & (turn == block)).any(axis=1)]
                span = slice(self.starts[block], self.ends[block])
                scores = queries[asking] @ self.rows[span].T
                fit = (scores >= floors[asking, None]) & (self.ids[span] != own[asking, None])
                q, row = np.nonzero(fit)
                found.append([asking[q], self.ids[span][row], scores[q, row]])
            best = self._best(*(np.concatenate(x) for x in zip(*found)), k)
            last = np.searchsorted(best[0], np.arange(len(queries)), side="right")
            full = last - np.searchsorted(best[0], np.arange(len(queries))) >= k
            floors[full] = np.maximum(floors[full], best[2][last[full] - 1])
            done, width = done + width, width * 2
            active = active[alive[:, -1]]  # bounds fall along the order: once one is below the floor, so are the rest
        return tuple(best)

    @staticmethod
    def _best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> list[np.ndarray]:
        order = np.lexsort((ids, -scores, query))
        query, ids, scores = query[order], ids[order], scores[order]
        keep = np.arange(len(query)) - np.searchsorted(query, query) < k
        return [query[keep], ids[keep], scores[keep]]


def cut(ids: np.ndarray, rows: np.ndarray, every: int, k: int, number: type) -> list[dict]:
    """One buffer of ordered rows as blocks, with the floors of the queries among them."""
    asked = np.flatnonzero(ids % every == 0)
    floors = np.full(len(asked), LEAST)
    scores = rows[asked].astype(number) @ rows.T.astype(number)
    for place, row in enumerate(asked):
        others = scores[place][ids != ids[row]]
        if len(others) >= k:
            floors[place] = min(max(int(np.partition(others, len(others) - k)[len(others) - k]), LEAST), -LEAST - 1)
    out = []
    for start in range(0, len(ids), BLOCK_ROWS):
        part = rows[start:start + BLOCK_ROWS]
        here = (asked >= start) & (asked < start + BLOCK_ROWS)
        out.append({"ids": ids[start:start + BLOCK_ROWS], "rows": part.ravel(), "most": part.max(axis=0),
                    "least": part.min(axis=0), "asked": (asked[here] - start).astype(np.int32), "floors": floors[here]})
    return out


def blocks(df: DataFrame, every: int, k: int, scale: float, id: str = "vec_id", vector: str = "embedding"
           ) -> tuple[DataFrame, int, int, type]:
    """The written block table, dimensions, rows and arithmetic."""
    spark = df.sparkSession
    rows = usable(df, id, vector)
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("v")), F.lit(0)).alias("dims"),
                     F.coalesce(F.max(F.array_max(F.transform("v", F.abs))), F.lit(0.0)).alias("top")).first()
    n, dims = stats["n"], stats["dims"]
    number = arithmetic(min(stats["top"] * scale + 1, float(LIMIT)), dims)
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).collect()
    pivots = np.zeros((len(sample), dims))
    for i, r in enumerate(sample):
        pivots[i, :len(r["v"])] = r["v"]
    shipped = spark.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = integers(batch.column("v"), scale, dims)
            with np.errstate(over="ignore", invalid="ignore"):
                near = q.astype(np.float64) @ shipped.value.T
            pivot = near.argmax(axis=1) if near.size else np.zeros(len(q), int)
            close = np.nan_to_num(near[np.arange(len(q)), pivot]) if near.size else np.zeros(len(q))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(pivot, pa.int32()), pa.array(close),
                 pa.array([x.tobytes() for x in q], pa.binary())], ["id", "pivot", "close", "q"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number_of, last = TaskContext.get().partitionId(), 0, None
        ids, rows = [], []

        def flush() -> pa.RecordBatch:
            x = np.frombuffer(b"".join(rows), np.int64).reshape(len(rows), dims)
            made = cut(np.array(ids, np.int64), x, every, k, number)
            kinds = dict.fromkeys(("ids", "rows", "most", "least", "floors"), pa.list_(pa.int64())) | {
                "asked": pa.list_(pa.int32())}
            cols = [pa.array([m[f].tolist() for m in made], kinds[f]) for f in FIELDS[2:]]
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number_of] * len(made), pa.int64()),
                 pa.array(range(len(made)), pa.int32()), *cols], FIELDS)

        for batch in batches:
            for key, q in zip(batch.column("id").to_pylist(), batch.column("q").to_pylist()):
                if (key, q) == last:
                    continue
                last = (key, q)
                ids.append(key)
                rows.append(q)
                if len(ids) == BUFFER_ROWS:
                    yield flush()
                    number_of += 1
                    ids, rows = [], []
        if ids:
            yield flush()

    order = ["pivot", "close", "id", "q"]
    tasks = max(1, math.ceil(n / BUFFER_ROWS))
    placed = rows.mapInArrow(place, "id bigint, pivot int, close double, q binary")
    # many small copies of one vector differ in id, so a range never has to hold them all
    built = placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(lean(build), BLOCK_SCHEMA)
    return written(built, "op11-blocks"), dims, n, number


def top_k(df: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0, id: str = "vec_id",
          vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best other rows of each row whose id ``every`` divides."""
    spark = df.sparkSession
    index, dims, n, number = blocks(df, every, k, scale, id, vector)
    width = 8 * max(dims, 1)
    chunks = max(1, math.ceil(n / every * width / CHUNK_BYTES))
    tasks = 2 * spark.sparkContext.defaultParallelism
    shards = max(1, math.ceil(n * width / SHARD_BYTES), min(math.ceil(tasks / chunks), math.ceil(n / BUFFER_ROWS)))
    # queries that stood together stay together, and so do blocks: one hash of the buffer each
    chunk = F.pmod(F.xxhash64("buffer", F.lit("chunk")), F.lit(chunks)).cast("int")
    shard = F.pmod(F.xxhash64("buffer", F.lit("shard")), F.lit(shards)).cast("int")
    every_chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    # a query travels to the shards by itself, without the block it stood in
    none = F.array().cast("array<bigint>")
    alone = {"ids": F.transform("asked", lambda i: F.get("ids", i)), "most": none, "least": none,
             "rows": F.flatten(F.transform("asked", lambda i: F.slice("rows", i * dims + 1, dims)))}
    asking = index.where(F.size("asked") > 0).select(
        *[alone.get(f, F.col(f)).alias(f) for f in FIELDS], chunk.alias("chunk"), every_shard.alias("shard")) \
        .withColumn("is_block", F.lit(0))
    answering = index.select(*FIELDS, shard.alias("shard"), every_chunk.alias("chunk")) \
        .withColumn("is_block", F.lit(1))
    met = asking.unionByName(answering).repartition(chunks * shards, "chunk", "shard") \
        .sortWithinPartitions("chunk", "shard", "is_block", "buffer", "place")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in runs(batches, ["chunk", "shard"]):
            split = int(np.searchsorted(pair.column("is_block").to_numpy(), 1))
            if split in (0, pair.num_rows):
                continue
            q = pair.slice(0, split).combine_chunks()
            asked, own, floors = (flat(q, c) for c in ("asked", "ids", "floors"))
            counts = np.diff(q.column("asked").combine_chunks().offsets.to_numpy())
            buffer = np.repeat(q.column("buffer").to_numpy(), counts)
            within = np.repeat(q.column("place").to_numpy() * BLOCK_ROWS, counts) + asked
            found, ids, scores = Blocks(pair.slice(split).combine_chunks(), dims, number).search(
                flat(q, "rows").reshape(len(own), dims).astype(number), own, floors, k)
            scores = np.clip(scores, LEAST, -LEAST - 1) if number is object else scores
            yield pa.RecordBatch.from_arrays(
                [pa.array(buffer[found], pa.int64()), pa.array(within[found], pa.int32()),
                 pa.array(own[found], pa.int64()), pa.array(ids, pa.int64()),
                 pa.array(scores.astype(np.int64), pa.int64())],
                ["buffer", "place", "query_id", "vec_id", "score"])

    found = met.mapInArrow(lean(task), "buffer bigint, place int, query_id bigint, vec_id bigint, score bigint")
    best_first = Window.partitionBy("buffer", "place").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
