"""Isolation forest (Liu, Ting and Zhou 2008) over monthly shop-item patterns."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..sources.staging import spread, stage
from .cleaning import fill_feature_matrix, present
from .monthly import GRAIN
from .sampling import sample_exact

ANOMALY_FEATURES = ["qty", "avg_price", "promo_intensity", "stockout_days", "price_ratio",
                    "holiday_days", "festive_days"]
NODES = "tree int, node int, feature int, cut double, left int, right int, path double"


def expected_path(m: int) -> float:
    """Mean path length of an unsuccessful search among m points."""
    if m <= 1:
        return 0.0
    if m == 2:
        return 1.0
    return 2.0 * (math.log(m - 1) + 0.5772156649) - 2.0 * (m - 1) / m


class Draw:
    """The rows with the smallest hashes for each tree, of all rows seen so far: a state that merges."""

    def __init__(self, trees: int, size: int, seed: int):
        rng = np.random.default_rng([seed, trees])
        self.salts = rng.integers(0, 2 ** 63, trees, dtype=np.uint64)
        self.size = size
        self.hashes = [np.zeros(0, np.uint64)] * trees
        self.rows: list[np.ndarray] = [np.zeros((0, 0))] * trees

    def add(self, row_hash: np.ndarray, x: np.ndarray) -> None:
        for tree, salt in enumerate(self.salts):
            h = _mixed(row_hash ^ salt)
            old = self.hashes[tree]
            if len(old) == self.size:
                near = h < old[-1]
                if not near.any():
                    continue
                h, rows = h[near], x[near]
            else:
                rows = x
            every = np.concatenate([old, h])
            both = np.concatenate([self.rows[tree].reshape(-1, x.shape[1]), rows])
            order = np.lexsort((*both.T[::-1], every))[:self.size]  # equal hashes by the row's values
            self.hashes[tree], self.rows[tree] = every[order], both[order]


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def draw_rows(pool: DataFrame, features: list[str], keys: list[str], trees: int, size: int, seed: int) -> DataFrame:
    """(tree, h, *features): from each task, at most ``size`` rows for each tree, those with the smallest hashes."""
    rows = pool.select(F.xxhash64(*keys, F.lit(seed)).alias("row_hash"), *features)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = Draw(trees, size, seed)
        for batch in batches:
            if batch.num_rows:
                draw.add(batch.column("row_hash").to_numpy().view(np.uint64),
                         np.column_stack([batch.column(f).to_numpy() for f in features]))
        for tree, (h, x) in enumerate(zip(draw.hashes, draw.rows)):
            if len(h):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(h), tree), pa.int32()), pa.array(h.view(np.int64)),
                     *(pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(features)))], ["tree", "h", *features])

    return rows.mapInArrow(task, "tree int, h bigint, " + ", ".join(f"`{f}` double" for f in features))


def grow_forest(pool: DataFrame, features: list[str], keys: list[str], n_rows: int,
                trees: int = 200, subsample: int = 256, seed: int = 42) -> DataFrame:
    """Node table of all trees, each grown in its own task on at most ``subsample`` rows.

    A tree's sample are the rows with its smallest hashes. Each task sends its own smallest ones only, and the
    smallest of those are the sample, so trees are the same for any partitioning.
    """
    psi = min(subsample, n_rows)
    # hashes are unsigned: half the range is moved so that signed order is theirs
    place = Window.partitionBy("tree").orderBy(F.col("h").bitwiseXOR(F.lit(-2 ** 63)), *features)
    # a fixed partition count keeps AQE from growing all trees in one task
    tasks = int(pool.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = draw_rows(pool, features, keys, trees, psi, seed)
    members = drawn.repartition(tasks, "tree").withColumn("place", F.row_number().over(place)).where(F.col("place") <= psi)
    depth = math.ceil(math.log2(max(psi, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        tree = int(pdf["tree"].iloc[0])
        x = pdf[features].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes = []
        waiting = [(np.arange(len(x)), 0)]
        for rows, level in waiting:  # grows below: the children of a node take the next two numbers
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            split = np.flatnonzero(high > low)
            if level >= depth or len(rows) <= 1 or len(split) == 0:
                nodes.append((tree, len(nodes), -1, 0.0, -1, -1, level + expected_path(len(rows))))
                continue
            f = int(rng.choice(split))
            cut = float(rng.uniform(low[f], high[f]))
            goes_left = x[rows, f] <= cut
            left = len(waiting)
            nodes.append((tree, len(nodes), f, cut, left, left + 1, 0.0))
            waiting += [(rows[goes_left], level + 1), (rows[~goes_left], level + 1)]
        return pd.DataFrame(nodes, columns=["tree", "node", "feature", "cut", "left", "right", "path"])

    return members.select("tree", "place", *features).groupBy("tree").applyInPandas(grow, NODES)


def score_rows(df: DataFrame, nodes: DataFrame, features: list[str], subsample_used: int) -> DataFrame:
    """Adds ``score`` = -2**(-mean path / expected path); the lower, the more isolated.

    The node table has at most 2 * subsample rows per tree, whatever the data
    size, and is shipped to every task.
    """
    table = nodes.orderBy("tree", "node").toPandas()
    trees = [t[["feature", "cut", "left", "right", "path"]].to_numpy() for _, t in table.groupby("tree")]
    shared = df.sparkSession.sparkContext.broadcast([full_tree(t) for t in trees])
    scale = expected_path(subsample_used) or 1.0

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.ascontiguousarray(pdf[features].to_numpy(dtype=float).T)
            total = np.zeros(len(pdf))
            for tree in shared.value:
                total += _path_lengths(tree, x)
            yield pdf.assign(score=-np.exp2(-total / len(shared.value) / scale))

    schema = df.withColumn("score", F.lit(0.0)).schema
    return df.mapInPandas(score, schema)


def full_tree(tree: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(feature, cut) of the nodes of each level, and the path length at each place of the last: a leaf further up
    passes all its rows on to the left. Children then need no look-up: those of place i are 2i and 2i + 1."""
    levels, at = [], np.zeros(1, int)
    while (tree[at, 0] >= 0).any():
        inner = tree[at, 0] >= 0
        levels.append((np.where(inner, tree[at, 0], 0).astype(int), np.where(inner, tree[at, 1], np.inf)))
        at = np.stack([np.where(inner, tree[at, 2], at), np.where(inner, tree[at, 3], at)], axis=1).ravel().astype(int)
    return levels, tree[at, 4]


def _path_lengths(tree: tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray], x: np.ndarray) -> np.ndarray:
    """Path length of every row; ``x`` has one row a feature and no NaN."""
    levels, path = tree
    n = x.shape[1]
    at, everyone, flat = np.zeros(n, int), np.arange(n), x.ravel()
    for feature, cut in levels:
        value = flat.take((feature * n).take(at) + everyone)
        at = 2 * at + (value > cut.take(at))
    return path.take(at)


@dataclass
class IsolationForest:
    """Nodes of all trees, the size of a tree's sample, and the score below which a row is anomalous."""
    features: list[str]
    nodes: DataFrame
    sample_size: int
    offset: float

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``anomaly_score`` (below 0 is anomalous) and ``is_anomaly`` (-1 or 1)."""
        rows = fill_feature_matrix(df, self.features)
        decision = F.col("score") - F.lit(self.offset)
        return (score_rows(rows, self.nodes, self.features, self.sample_size).withColumn("anomaly_score", decision)
                .withColumn("is_anomaly", F.when(decision < 0, -1).otherwise(1)).drop("score"))

    def save(self, path: str) -> None:
        spark = self.nodes.sparkSession
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        facts = json.dumps({"features": self.features, "sample_size": self.sample_size, "offset": self.offset})
        spark.createDataFrame([(facts,)], "facts string").write.mode("overwrite").parquet(f"{path}/facts")

    @staticmethod
    def load(spark: SparkSession, path: str) -> IsolationForest:
        facts = json.loads(spark.read.parquet(f"{path}/facts").first()["facts"])
        return IsolationForest(facts["features"], spark.read.parquet(f"{path}/nodes"), facts["sample_size"],
                               facts["offset"])


def fit_isolation_forest(monthly: DataFrame, trees: int = 200, contamination: float = 0.02,
                         max_rows: int | None = None, seed: int = 42, subsample: int = 256,
                         features: list[str] = ANOMALY_FEATURES, keys: list[str] = GRAIN
                         ) -> tuple[IsolationForest | None, DataFrame]:
    """The forest, and the scored rows it was fitted on; no forest for an empty table."""
    features = present(monthly, features)
    pool = monthly if max_rows is None else sample_exact(monthly, max_rows, keys, seed)
    pool = stage(fill_feature_matrix(pool.select(*keys, *features), features), "anomaly-pool")
    n_rows = pool.count()
    if n_rows == 0:
        return None, pool.withColumns({"anomaly_score": F.lit(0.0), "is_anomaly": F.lit(1)})
    pool = spread(pool, *keys)
    nodes = stage(grow_forest(pool, features, keys, n_rows, trees, subsample, seed), "anomaly-nodes")
    size = min(subsample, n_rows)
    scored = stage(score_rows(pool, nodes, features, size), "anomaly-scores")
    offset = exact_quantiles(scored, {"score": [contamination]})["score"][0]
    decision = F.col("score") - F.lit(offset)
    return IsolationForest(features, nodes, size, offset), (
        scored.withColumn("anomaly_score", decision)
        .withColumn("is_anomaly", F.when(decision < 0, -1).otherwise(1)).drop("score"))


def isolation_forest(monthly: DataFrame, trees: int = 200, contamination: float = 0.02,
                     max_rows: int | None = None, seed: int = 42, subsample: int = 256,
                     features: list[str] = ANOMALY_FEATURES, keys: list[str] = GRAIN) -> DataFrame:
    """Rows with ``anomaly_score`` (below 0 is anomalous) and ``is_anomaly`` (-1 or 1).

    Trees grow from, and scores cover, the whole table. A given ``max_rows`` asks for
    a reproducible sample of that size instead.
    """
    return fit_isolation_forest(monthly, trees, contamination, max_rows, seed, subsample, features, keys)[1]


def top_anomalies(scored: DataFrame, k: int | None = None, keys: list[str] = GRAIN) -> DataFrame:
    """The anomalous rows, most isolated first; only the first ``k`` if asked for."""
    found = scored.where("is_anomaly = -1").orderBy("anomaly_score", *keys)
    return found if k is None else found.limit(k)
