import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfsight.operators import anomaly as A
from shelfsight.operators.monthly import GRAIN

FEATURES = ["qty", "avg_price"]


@pytest.fixture(scope="module")
def pool(spark):
    rng = np.random.default_rng(3)
    rows = [("2020-01", 1, i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))]
    rows.append(("2020-01", 1, 600, 50.0, -50.0))
    return spark.createDataFrame(rows, "year_month string, shop_id long, item_id long, qty double, avg_price double")


def test_expected_path():
    assert [A.expected_path(m) for m in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert A.expected_path(256) == pytest.approx(10.2448, abs=1e-3)


def test_scores_follow_the_trees(pool):
    nodes = A.grow_forest(pool, FEATURES, GRAIN, 601, trees=6, subsample=64)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert {t for t, _ in table} == set(range(6))

    def path(tree, x):
        node = table[tree, 0]
        while node["feature"] >= 0:
            node = table[tree, node["left"] if x[node["feature"]] <= node["cut"] else node["right"]]
        return node["path"]

    for r in A.score_rows(pool, nodes, FEATURES, 64).collect():
        mean = np.mean([path(t, (r["qty"], r["avg_price"])) for t in range(6)])
        assert r["score"] == pytest.approx(-2 ** (-mean / A.expected_path(64)))


def test_full_tree_reaches_the_leaves_of_a_lopsided_one():
    """Leaves at three depths; values on a cut, beyond all cuts, and no rows."""
    tree = np.array([[0, 0.5, 1, 2, 0], [-1, 0, -1, -1, 1.5], [1, 2.0, 3, 4, 0], [0, 0.75, 5, 6, 0], [-1, 0, -1, -1, 2.5],
                     [-1, 0, -1, -1, 3.5], [-1, 0, -1, -1, 4.5]])
    levels, path = full = A.full_tree(tree)
    assert [len(f) for f, _ in levels] == [1, 2, 4] and len(path) == 8
    x = np.array([[0.5, 9], [1, 3], [0.75, 2], [0.8, 2], [-9, -9], [1e300, 1e300]])
    assert A._path_lengths(full, np.ascontiguousarray(x.T)).tolist() == [1.5, 2.5, 3.5, 4.5, 1.5, 2.5]
    assert len(A._path_lengths(full, np.zeros((2, 0)))) == 0
    assert A._path_lengths(A.full_tree(tree[1:2]), np.ones((2, 3))).tolist() == [1.5] * 3


def test_outlier_is_found_on_any_partitioning(pool):
    def run(df):
        return {tuple(r) for r in A.isolation_forest(df, trees=30, features=FEATURES).select(
            "item_id", "is_anomaly", F.round("anomaly_score", 9)).collect()}
    one = run(pool)
    assert one == run(pool.repartition(5))
    flagged = {i for i, label, _ in one if label == -1}
    assert min(one, key=lambda r: r[2])[0] == 600
    assert len(flagged) == round(0.02 * 601)


def test_draw_is_bounded_and_takes_the_smallest_hashes(pool):
    """Each task sends at most ``size`` rows a tree; together they hold the sample of one task over all rows."""
    drawn = A.draw_rows(pool.repartition(5), FEATURES, GRAIN, trees=4, size=16, seed=1)
    assert drawn.count() == 5 * 4 * 16
    one = A.draw_rows(pool.coalesce(1), FEATURES, GRAIN, trees=4, size=16, seed=1).collect()
    many = drawn.collect()
    for tree in range(4):
        ranked = sorted((r["h"] & (2 ** 64 - 1), r["qty"]) for r in many if r["tree"] == tree)[:16]
        assert ranked == sorted((r["h"] & (2 ** 64 - 1), r["qty"]) for r in one if r["tree"] == tree)


def test_saved_forest_scores_alike(spark, pool, tmp_path):
    forest, scored = A.fit_isolation_forest(pool, trees=12, features=FEATURES)
    forest.save(str(tmp_path / "forest"))
    again = A.IsolationForest.load(spark.newSession(), str(tmp_path / "forest")).transform(pool.select(*GRAIN, *FEATURES))
    want = {r["item_id"]: (r["anomaly_score"], r["is_anomaly"]) for r in scored.collect()}
    assert {r["item_id"]: (r["anomaly_score"], r["is_anomaly"]) for r in again.collect()} == want
    none, empty = A.fit_isolation_forest(pool.limit(0), trees=3, features=FEATURES)
    assert none is None and empty.count() == 0


def test_report_is_sorted_and_cut(pool):
    scored = A.isolation_forest(pool, trees=20, features=FEATURES)
    top = A.top_anomalies(scored, 5).collect()
    assert len(top) == 5 and [r["anomaly_score"] for r in top] == sorted(r["anomaly_score"] for r in top)
