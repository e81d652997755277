from pyspark.sql import functions as F

from ..functions import r6
from ..functions.lineage import checkpointed, parquet_copy
from ..operators import datasets as ops
from .cross_section import _PRE
from .registry import query, six

def _pre(column):
    return _PRE.replace("momentum", column).replace("FROM panel", "FROM labelled")


_DATA = f"""labelled AS (SELECT * FROM panel WHERE next_return IS NOT NULL), ds AS (SELECT l.trade_date, l.code_id, l.mv, l.industry, l.next_return AS raw_return, a.z AS momentum, b.z AS volume, c.z AS label
FROM labelled l JOIN {_pre('momentum')} a USING (trade_date, code_id) JOIN {_pre('volume')} b USING (trade_date, code_id) JOIN {_pre('next_return').replace('code_id, trade_date, next_return,', 'code_id, trade_date,')} c USING (trade_date, code_id))"""


def _dataset(t):
    p = parquet_copy(t.panel.select("trade_date", "code_id", "mv", "industry", "next_return", "momentum", "volume"), "panel")  # base, label and features read it
    label = p.select("trade_date", "code_id", F.col("next_return").alias("label"))
    return ops.build_dataset(p.select("trade_date", "code_id", "mv", "industry"), label, p.select("trade_date", "code_id", "momentum", "volume"), "label", ["momentum", "volume", "mv", "industry"])


@query("build_dataset", f"WITH {_DATA} SELECT trade_date, code_id, industry, {six('raw_return')} AS raw_return, {six('momentum')} AS momentum, {six('volume')} AS volume, {six('label')} AS label FROM ds")
def _(t):
    return _dataset(t).select("trade_date", "code_id", "industry", *(r6(c).alias(c) for c in ("raw_return", "momentum", "volume", "label")))


@query("training_set", f"WITH {_DATA} SELECT c AS \"column\", count(*) AS rows, count(*) FILTER (v IS NULL) AS missing FROM (SELECT 'momentum' AS c, momentum AS v FROM ds WHERE label IS NOT NULL UNION ALL SELECT 'volume', volume FROM ds WHERE label IS NOT NULL) GROUP BY 1")
def _(t):
    return ops.training_stats(ops.training_set(_dataset(t), "label"), ["momentum", "volume"])


@query("safe_names", "SELECT code_id, trade_date, close AS \"close_20__x_\" FROM bars_m")
def _(t):
    return ops.safe_names(t.bars_m.select("code_id", "trade_date", F.col("close").alias("close(20):x]")))[0]


_WIN = """(SELECT row_number() OVER (ORDER BY t) AS window_id, CAST(t - INTERVAL 24 MONTH AS DATE) AS train_start, CAST(t - INTERVAL 6 MONTH AS DATE) AS val_start, CAST(t AS DATE) AS test_start, CAST(least(t + INTERVAL 3 MONTH, b + 1) AS DATE) AS test_end
FROM (SELECT b, unnest(generate_series(DATE '1997-01-01', b - 1, INTERVAL 3 MONTH)) AS t FROM (SELECT max(trade_date) AS b FROM bars_m)))"""


def _windows(t):
    return ops.rolling_windows(t.bars_m, 24, 6, 3, 3, "1997-01-01")


@query("rolling_windows", f"SELECT * FROM {_WIN}")
def _(t):
    return _windows(t)


@query("rolling_train_predict")
def _(t):
    pred, _ = ops.rolling_train_predict(_dataset(t), ["momentum", "volume"], "label", _windows(t))
    return pred.withColumn("ml_factor", r6("ml_factor"))


def _ridge(penalties):
    """SQL: CTEs sol (window_id, trial, a, b1, b2) and fit (adds train_rmse, val_rmse) from the normal equations of two
    features, the penalty on unit scale."""
    trials = ", ".join(f"({i}, CAST({x} AS DOUBLE))" for i, x in enumerate(penalties))
    return f"""{_DATA}, win AS {_WIN}, tr AS (SELECT * FROM (VALUES {trials}) t(trial, pen)),
lin AS (SELECT w.*, trade_date, label, coalesce(momentum, 0) AS momentum, coalesce(volume, 0) AS volume, trade_date >= val_start AS is_val FROM ds d JOIN win w ON trade_date >= train_start AND trade_date < w.test_start WHERE label IS NOT NULL),
mom AS (SELECT window_id, avg(momentum) AS m1, avg(volume) AS m2, avg(label) AS m0, var_pop(momentum) AS c11, var_pop(volume) AS c22, covar_pop(momentum, volume) AS c12,
  covar_pop(momentum, label) AS r1, covar_pop(volume, label) AS r2, stddev_pop(label) AS s FROM lin WHERE NOT is_val GROUP BY 1),
raw AS (SELECT window_id, trial, m0, m1, m2, c11 * (1 + pen / s) AS d1, c22 * (1 + pen / s) AS d2, c12, r1, r2 FROM mom CROSS JOIN tr),
b AS (SELECT window_id, trial, m0, m1, m2, (r1 * d2 - r2 * c12) / (d1 * d2 - c12 * c12) AS b1, (r2 * d1 - r1 * c12) / (d1 * d2 - c12 * c12) AS b2 FROM raw),
sol AS (SELECT window_id, trial, m0 - b1 * m1 - b2 * m2 AS a, b1, b2 FROM b),
fit AS (SELECT window_id, trial, sqrt(avg((a + b1 * momentum + b2 * volume - label) ** 2) FILTER (NOT is_val)) AS train_rmse,
  sqrt(avg((a + b1 * momentum + b2 * volume - label) ** 2) FILTER (is_val)) AS val_rmse FROM lin JOIN sol USING (window_id) GROUP BY 1, 2)"""


@query("rolling_train_linear", f"""WITH {_ridge([0.0])} SELECT w.window_id, trade_date, code_id, label, {six('a + b1 * momentum + b2 * volume')} AS ml_factor
FROM (SELECT trade_date, code_id, {six('label')} AS label, coalesce(momentum, 0) AS momentum, coalesce(volume, 0) AS volume FROM ds) d JOIN win w ON trade_date >= test_start AND trade_date < test_end JOIN sol ON sol.window_id = w.window_id""")
def _(t):
    """The deterministic baseline: one linear fit a window."""
    pred, _ = ops.rolling_train_predict(_dataset(t), ["momentum", "volume"], "label", _windows(t), kind="linear")
    return pred.withColumns({c: r6(c) for c in ("label", "ml_factor")})


@query("rolling_fits_linear", f"WITH {_ridge([0.0])} SELECT window_id, {six('train_rmse')} AS train_rmse, {six('val_rmse')} AS val_rmse FROM fit")
def _(t):
    _, fits = ops.rolling_train_predict(_dataset(t), ["momentum", "volume"], "label", _windows(t), kind="linear")
    return fits.select("window_id", r6("train_rmse").alias("train_rmse"), r6("val_rmse").alias("val_rmse"))


_PREDS = "(SELECT code_id % 4 AS window_id, code_id % 3 AS seed, close / 1000 AS label, open / 1000 AS prediction, CASE WHEN month(trade_date) < 9 THEN 'train' ELSE 'val' END AS part FROM bars_m)"
_MET = f"(SELECT window_id, seed, sqrt(avg(CASE WHEN part = 'train' THEN (prediction - label) ** 2 END)) AS train_rmse, sqrt(avg(CASE WHEN part = 'val' THEN (prediction - label) ** 2 END)) AS val_rmse FROM {_PREDS} GROUP BY 1, 2)"


def _metrics(t):
    p = t.bars_m.select((F.col("code_id") % 4).alias("window_id"), (F.col("code_id") % 3).alias("seed"), (F.col("close") / 1000).alias("label"), (F.col("open") / 1000).alias("prediction"), F.when(F.month("trade_date") < 9, "train").otherwise("val").alias("part"))
    return ops.training_metrics(p, ["window_id", "seed"])


@query("training_metrics", f"SELECT window_id, seed, {six('train_rmse')} AS train_rmse, {six('val_rmse')} AS val_rmse, {six('val_rmse / train_rmse')} AS overfit_ratio FROM {_MET}")
def _(t):
    return _metrics(t).select("window_id", "seed", *(r6(c).alias(c) for c in ("train_rmse", "val_rmse", "overfit_ratio")))


@query("overfit_summary", f"SELECT window_id, {six('avg(train_rmse)')} AS train_rmse, {six('avg(val_rmse)')} AS val_rmse, {six('avg(val_rmse / train_rmse)')} AS mean_ratio, {six('max(val_rmse / train_rmse)')} AS max_ratio FROM {_MET} GROUP BY 1")
def _(t):
    return ops.overfit_summary(_metrics(t)).select("window_id", *(r6(c).alias(c) for c in ("train_rmse", "val_rmse", "mean_ratio", "max_ratio")))


_SCORES = ("ic_mean", "ic_ir", "train_rmse", "val_rmse", "overfit_ratio")


def _search(penalties):
    """SQL for param_search over ridge penalties by ic_mean."""
    names = ", ".join(f"({i}, '{{''regParam'': {x}}}')" for i, x in enumerate(penalties))
    return f"""WITH {_ridge(penalties)}, nm AS (SELECT * FROM (VALUES {names}) n(trial, params)),
val AS (SELECT trial, trade_date, label, a + b1 * momentum + b2 * volume AS p FROM lin JOIN sol USING (window_id) WHERE is_val),
rk AS (SELECT trial, trade_date, rank() OVER (PARTITION BY trial, trade_date ORDER BY p) + (count(*) OVER (PARTITION BY trial, trade_date, p) - 1) / 2.0 AS x,
  rank() OVER (PARTITION BY trial, trade_date ORDER BY label) + (count(*) OVER (PARTITION BY trial, trade_date, label) - 1) / 2.0 AS y FROM val),
ic AS (SELECT trial, trade_date, corr(x, y) AS ic FROM rk GROUP BY 1, 2 HAVING count(DISTINCT x) >= 2 AND count(DISTINCT y) >= 2),
sc AS (SELECT trial, avg(ic) AS ic_mean, avg(ic) / stddev_samp(ic) AS ic_ir FROM ic GROUP BY 1),
er AS (SELECT trial, count(*) AS windows, avg(train_rmse) AS train_rmse, avg(val_rmse) AS val_rmse, avg(val_rmse / train_rmse) AS overfit_ratio FROM fit GROUP BY 1)
SELECT trial, params, windows, {six('ic_mean')} AS ic_mean, {six('ic_ir')} AS ic_ir, {six('train_rmse')} AS train_rmse, {six('val_rmse')} AS val_rmse, {six('overfit_ratio')} AS overfit_ratio,
  row_number() OVER (ORDER BY floor(ic_mean * 1e9 + 0.5) DESC, trial) = 1 AS best FROM nm JOIN sc USING (trial) JOIN er USING (trial)"""


@query("param_search", _search([0.0, 0.1, 1.0]))
def _(t):
    tries = ops.param_candidates({"regParam": [0.0, 0.1, 1.0]}, 3)
    return ops.param_search(_dataset(t), ["momentum", "volume"], "label", _windows(t), tries).withColumns({c: r6(c) for c in _SCORES})


@query("validate_params", _search([0.05]))
def _(t):
    """One parameter set on validation rows."""
    return ops.param_search(_dataset(t), ["momentum", "volume"], "label", _windows(t), [{"regParam": 0.05}]).withColumns({c: r6(c) for c in _SCORES})


@query("model_importance")
def _(t):
    """Gain and split shares of boosted models, one for each window."""
    imp = ops.rolling_importance(_dataset(t).where("label is not null"), ["momentum", "volume"], "label", _windows(t))
    return ops.importance_table(imp).select("feature", r6("gain_pct").alias("gain_pct"), r6("split_pct").alias("split_pct"))


_IMP = "(SELECT industry AS model, 'f' || code_id % 7 AS feature, sum(float_shares) AS gain, count(*) AS splits FROM securities GROUP BY 1, 2)"
_TAB = f"(SELECT feature, avg(g) AS gain_pct, avg(s) AS split_pct FROM (SELECT feature, gain / sum(gain) OVER m * 100 AS g, splits / sum(splits) OVER m * 100 AS s FROM {_IMP} WINDOW m AS (PARTITION BY model)) GROUP BY 1)"


def _table(t):
    imp = t.securities.groupBy(F.col("industry").alias("model"), F.concat(F.lit("f"), F.col("code_id") % 7).alias("feature")).agg(F.sum("float_shares").alias("gain"), F.count("*").alias("splits"))
    return ops.importance_table(imp)


@query("importance_table", f"SELECT feature, {six('gain_pct')} AS gain_pct, {six('split_pct')} AS split_pct FROM {_TAB}")
def _(t):
    return _table(t).select("feature", r6("gain_pct").alias("gain_pct"), r6("split_pct").alias("split_pct"))


@query("low_importance", f"""WITH e AS (SELECT 'f' || code_id % 8 AS feature, sum(close) AS delta FROM bars_m GROUP BY 1), b AS (SELECT coalesce(a.feature, e.feature) AS feature, coalesce(gain_pct, 0) AS g, coalesce(split_pct, 0) AS s, coalesce(delta, 0) AS d FROM {_TAB} a FULL JOIN e ON a.feature = e.feature),
r AS (SELECT feature, ((rank() OVER (ORDER BY g DESC) + (count(*) OVER (PARTITION BY g) - 1) / 2.0) + (rank() OVER (ORDER BY s DESC) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) + (rank() OVER (ORDER BY d DESC) + (count(*) OVER (PARTITION BY d) - 1) / 2.0)) / 3 AS mean_rank, count(*) OVER () AS n FROM b)
SELECT feature, {six('mean_rank')} AS mean_rank FROM r WHERE mean_rank > 0.5 * n""")
def _(t):
    effect = t.bars_m.groupBy(F.concat(F.lit("f"), F.col("code_id") % 8).alias("feature")).agg(F.sum("close").alias("delta"))
    return ops.low_importance(_table(t), effect, 0.5).withColumn("mean_rank", r6("mean_rank"))


@query("permutation_importance")
def _(t):
    data = checkpointed(_dataset(t).where("label is not null").select("trade_date", "code_id", "label", "momentum", "volume"))  # the fit and the sample read it
    model = ops._model("linear", {}, 1).fit(ops._assembled(data, ["momentum", "volume"], "label"))
    return ops.permutation_importance(model, data, ["momentum", "volume"], "label").withColumn("delta", r6("delta"))


@query("sample_rows", "SELECT code_id, trade_date, close FROM bars_m ORDER BY md5(code_id || '|' || trade_date || '|1'), code_id, trade_date LIMIT 2000")
def _(t):
    return ops.sample_rows(t.bars_m, 2000, ["code_id", "trade_date"]).select("code_id", "trade_date", "close")
