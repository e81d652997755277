"""Boosted trees of rolling windows are grown on cells of binned rows, which stand for all rows."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.operators import datasets as ops

FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(5)
    days = [dt.date(2020 + m // 12, m % 12 + 1, 1) for m in range(30)]
    rows = [(d, c, float(x), float(y), float(2 * x - y + 0.3 * e)) for d in days for c in range(40) for x, y, e in [draw.normal(size=3)]]
    return spark.createDataFrame([*rows, (days[3], 90, None, float("nan"), 1.0), (days[-1], 91, 0.5, None, None)], "trade_date date, code_id long, a double, b double, label double").cache()


def part_of(table, times=1):
    many = table.where("label is not null").na.fill(0.0, FEATURES).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("k")
    return many.withColumn("is_val", F.col("trade_date") >= "2021-07-01")


def test_cells_stand_for_all_rows(table):
    points, _ = ops.boosting_cells(part_of(table), FEATURES, {"maxBins": 4})
    sums = lambda df, w: {r.is_val: tuple(r)[1:] for r in df.groupBy("is_val").agg(F.sum(w), F.sum(w * F.col("label")), F.sum(w * F.col("label") ** 2)).collect()}
    got, want = sums(points, F.col("weight")), sums(part_of(table), F.lit(1.0))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-12) for k in want)


def test_points_of_a_fit_do_not_grow_with_a_days_codes(table):
    """each tree's levels read all rows again."""
    one, more = (ops.boosting_cells(part_of(table, k), FEATURES, {"maxBins": 4})[0].count() for k in (2, 8))
    assert one == more <= 2 * 24 * 25 + 2 * 6 * 25


def test_predictions_cover_the_test_rows_and_follow_the_label(table):
    windows = ops.rolling_windows(table, 24, 6, 3, 3)
    pred, records = ops.rolling_train_predict(table, FEATURES, "label", windows, seeds=(1, 2), params={"maxIter": 5, "minInstancesPerNode": 3})
    got = pred.collect()
    assert len(got) == 6 * 40 + 1 and sum(r.label is None for r in got) == 1 and len({(r.trade_date, r.code_id) for r in got}) == len(got)
    pairs = np.array([(r.ml_factor, r.label) for r in got if r.label is not None])
    assert np.corrcoef(pairs.T)[0, 1] > 0.9
    done = records.collect()
    assert sorted((r.window_id, r.seed) for r in done) == [(w, s) for w in (1, 2) for s in (1, 2)] and all(0 < r.train_rmse < 1.2 and 0 < r.val_rmse < 1.3 for r in done)


def test_errors_of_cells_are_those_of_rows(table):
    """The RMSE of the points is that of the rows with the model's predictions."""
    part = part_of(table)
    points, edges = ops.boosting_cells(part, FEATURES, {})
    fit = ops._boost(points, {"maxIter": 3}, 1)
    square = F.pow(F.col("prediction") - F.col("label"), 2)
    rows = fit.transform(ops._assembled(ops._binned(part, FEATURES, edges), FEATURES, "label")).agg(F.avg(square)).first()[0]
    cells = fit.transform(points).agg(F.sum(square * F.col("weight")) / F.sum("weight")).first()[0]
    assert abs(rows - cells) < 1e-9
    features = points.schema["features"].metadata["ml_attr"]
    assert "nominal" not in str(features)
