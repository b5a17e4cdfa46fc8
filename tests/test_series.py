import numpy as np
import pytest

from shelfsight.operators import series as S
from shelfsight.operators.monthly import SERIES


def solve(x, y):
    a, b = x.T @ x, x.T @ y
    det = a[0, 0] * a[1, 1] - a[0, 1] ** 2
    return np.linalg.solve(a, b) if det > 1e-9 * a[0, 0] * a[1, 1] else np.zeros(2)


def brute_force_arima(y, h=3):
    """The definition, row by row."""
    train = y[:-h]
    d = np.diff(train)
    a = solve(np.column_stack([d[1:-1], d[:-2]]), d[2:])
    e = d[2:] - a[0] * d[1:-1] - a[1] * d[:-2]
    coef = np.clip(solve(np.column_stack([d[2:-1], e[:-1]]), d[3:]), -0.99, 0.99)
    step, level, out = coef[0] * d[-1] + coef[1] * e[-1], train[-1], []
    for _ in range(h):
        level += step
        out.append(level)
        step *= coef[0]
    return float(np.sqrt(np.mean((y[-h:] - np.array(out)) ** 2)))


def test_arima_matches_its_definition(monthly):
    rows = monthly.select(*SERIES, "year", "month", "qty").toPandas().sort_values([*SERIES, "year", "month"])
    want = {k: brute_force_arima(g["qty"].to_numpy()) for k, g in rows.groupby(SERIES) if len(g) >= 18}
    got = {(r["shop_id"], r["item_id"]): r["RMSE"] for r in S.arima_backtest(monthly).collect()}
    assert got.keys() == want.keys() and len(got) > 150
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-6)
    assert S.arima_backtest(monthly, top_n=5).count() <= 5


def test_constant_series_is_a_random_walk(spark):
    from test_monthly import months
    r = S.arima_backtest(months(spark, [4.0] * 20)).first()
    assert (r["phi"], r["theta"], r["RMSE"]) == (0.0, 0.0, 0.0)


def test_seasonal_backtest_matches_ridge(monthly):
    cols = [*SERIES, "year", "month", "qty", *S.REGRESSORS]
    rows = monthly.select(*cols).toPandas().sort_values([*SERIES, "year", "month"])
    got = {(r["shop_id"], r["item_id"]): r for r in S.seasonal_regression_backtest(monthly).collect()}
    checked = 0
    for key, g in rows.groupby(SERIES):
        if len(g) < 18:
            assert key not in got
            continue
        if g[S.REGRESSORS].isna().any().any():
            assert got[key]["status"] == "missing regressor" and got[key]["RMSE"] is None
            continue
        angle = np.outer(g["month"], [1, 2, 3]) * 2 * np.pi / 12
        x = np.column_stack([np.arange(1, len(g) + 1) / len(g), np.sin(angle), np.cos(angle),
                             g[S.REGRESSORS].to_numpy(float)])
        tr, y = slice(None, -3), g["qty"].to_numpy()
        sd = x[tr].std(axis=0)
        z = (x - x[tr].mean(axis=0)) / np.where(sd > 0, sd, 1)
        k = z.shape[1]
        # ridge as an augmented least-squares problem
        beta = np.linalg.lstsq(np.vstack([z[tr], np.eye(k)]),
                               np.concatenate([y[tr] - y[tr].mean(), np.zeros(k)]), rcond=None)[0]
        error = y[-3:] - (y[tr].mean() + z[-3:] @ beta)
        assert got[key]["RMSE"] == pytest.approx(np.sqrt((error ** 2).mean()), rel=1e-6)
        checked += 1
    assert checked > 100


def test_sequence_frames(spark):
    from test_monthly import months
    values = [float(v) for v in range(10, 25)]
    rows = S.sequence_frames(months(spark, values).select("year_month", "qty")).orderBy("year_month").collect()
    scaled = (np.array(values) - 10) / (14 + 1e-6)
    assert len(rows) == 3
    for i, r in enumerate(rows):
        assert r["lags"] == pytest.approx(list(scaled[i:i + 12])) and r["scaled"] == pytest.approx(scaled[i + 12])


def test_sequence_regression_learns_a_line(spark):
    from test_monthly import months
    r = S.sequence_regression(months(spark, range(40)).select("year_month", "qty")).first()
    assert r["RMSE"] < 0.01
