"""Linear models of windows against Spark ML and least squares; racing against the full search."""

import datetime as dt

import numpy as np
import pytest

from panelfx.operators import datasets, linear

D = dt.date
FEATURES = ["f0", "f1", "f2"]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(7)
    rows = []
    for k in range(30):
        day = D(2020 + k // 12, k % 12 + 1, 3)
        for code in range(40):
            x = draw.normal(size=3)
            y = 0.5 * x[0] - 0.2 * x[1] + 0.1 * x[2] + draw.normal() * (1 + 0.3 * (k % 5))
            rows.append((day, code, float(x[0]), None if code == 3 else float(x[1]), float(x[2]), None if code == 5 else float(y)))
    return spark.createDataFrame(rows, "trade_date date, code_id long, f0 double, f1 double, f2 double, label double")


@pytest.fixture(scope="module")
def windows(table):
    return datasets.rolling_windows(table, 12, 3, 3, 3)


@pytest.mark.parametrize("penalty", [0.0, 0.3])
def test_equals_spark_ml(table, windows, penalty):
    fits = {r.window_id: r for r in linear.fit_windows(table, FEATURES, "label", windows, penalty).collect()}
    assert len(fits) == windows.count() > 3
    for w in windows.collect():
        part = table.where((table.trade_date >= w.train_start) & (table.trade_date < w.val_start) & table.label.isNotNull())
        ml = datasets._model("linear", {"regParam": penalty}, 1).fit(datasets._assembled(part, FEATURES, "label"))
        assert np.allclose(fits[w.window_id].coef, [ml.intercept, *ml.coefficients], atol=1e-9)
        assert abs(fits[w.window_id].train_rmse - ml.summary.rootMeanSquaredError) < 1e-9


def test_predictions_and_records(table, windows):
    pred, records = datasets.rolling_train_predict(table, FEATURES, "label", windows, kind="linear")
    coef = {r.window_id: r.coef for r in linear.fit_windows(table, FEATURES, "label", windows).collect()}
    rows = {(r.trade_date, r.code_id): r for r in table.collect()}
    got = pred.collect()
    assert len(got) == sum(table.where((table.trade_date >= w.test_start) & (table.trade_date < w.test_end)).count() for w in windows.collect())
    for r in got:
        x = rows[r.trade_date, r.code_id]
        c = coef[r.window_id]
        assert abs(r.ml_factor - (c[0] + sum(b * (x[f] or 0.0) for b, f in zip(c[1:], FEATURES)))) < 1e-12
    assert {r.window_id for r in records.collect()} == set(coef)


def test_one_scan_for_all_windows(table, windows):
    plan = linear.day_sums(table, FEATURES, "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_collinear_and_constant(spark, windows):
    draw = np.random.default_rng(3)
    rows = [(D(2020, 1, 1) + dt.timedelta(days=i % 300), i, float(a), float(2 * a + 1), 4.0, float(3 * a + 2)) for i, a in enumerate(draw.normal(size=600))]
    df = spark.createDataFrame(rows, "trade_date date, code_id long, f0 double, f1 double, f2 double, label double")
    w = datasets.rolling_windows(df, 6, 1, 1, 1)
    for r in linear.fit_windows(df, FEATURES, "label", w).collect():
        a, b = r.coef[0], r.coef[1:]
        assert b[2] == 0 and 0 in b[:2]  # constant; one of the two that depend on each other
        assert abs(b[0] + 2 * b[1] - 3) < 1e-8 and abs(a + b[1] - 2) < 1e-8 and r.train_rmse < 1e-6
    same = linear.ridge_windows(df, FEATURES, "label", w, [0.0]).collect()
    assert all(abs(r.coef[1] + 2 * r.coef[2] - 3) < 1e-8 for r in same)


def test_pivoted_cholesky():
    draw = np.random.default_rng(5)
    for p in (1, 2, 6):
        x = draw.normal(size=(50, p))
        a = np.corrcoef(x.T).reshape(p, p)
        r = draw.normal(size=p)
        assert np.allclose(linear.pivoted_cholesky_solve(a, r), np.linalg.solve(a, r))


def test_empty(spark, table, windows):
    assert linear.fit_windows(table.limit(0), FEATURES, "label", windows).count() == 0
    pred, records = datasets.rolling_train_predict(table.limit(0), FEATURES, "label", windows, kind="linear")
    assert pred.count() == 0 and records.count() == 0
    assert datasets.param_search(table, FEATURES, "label", windows, []).count() == 0


def test_ridge_search_equals_single_fits(table, windows):
    tries = [{"regParam": x} for x in (0.0, 0.2, 5.0)]
    both = {r.trial: r for r in datasets.param_search(table, FEATURES, "label", windows, tries, metric="val_rmse").collect()}
    for i, c in enumerate(tries):
        one = datasets.param_search(table, FEATURES, "label", windows, [c], metric="val_rmse").first()
        assert all(abs(both[i][k] - one[k]) < 1e-9 for k in ("ic_mean", "ic_ir", "train_rmse", "val_rmse", "overfit_ratio"))
    assert min(both.values(), key=lambda r: r.val_rmse).best and sum(r.best for r in both.values()) == 1


def test_race_finds_the_full_searchs_best(table, windows):
    tries = [{"regParam": 0.01, "elasticNetParam": 0.5}, {"regParam": 3.0, "elasticNetParam": 1.0}, {"regParam": 0.02, "elasticNetParam": 0.0}]
    windows = windows.where("window_id <= 4")
    full = datasets.param_search(table, FEATURES, "label", windows, tries, metric="val_rmse").orderBy("trial").collect()
    race = datasets.param_search(table, FEATURES, "label", windows, tries, metric="val_rmse", race=0.9, least=3).orderBy("trial").collect()
    assert [r.best for r in race] == [r.best for r in full]
    assert all(r.windows == full[0].windows for r in full) and race[1].windows < full[1].windows


def test_t_test():
    for level, degrees, want in ((0.95, 1, 6.3138), (0.95, 2, 2.92), (0.95, 3, 2.3534), (0.975, 5, 2.5706), (0.95, 30, 1.6973)):
        assert abs(linear.t_quantile(level, degrees) - want) < 0.03
    losses = [[1.0, 1.1, 0.9, 1.0], [1.5, 1.7, 1.3, 1.6], [1.0, 1.2, 0.8, 1.05]]
    assert linear.worse(losses, [0, 1, 2], 0.95, 4) == [1] and linear.worse(losses, [0, 1, 2], 0.95, 5) == []
