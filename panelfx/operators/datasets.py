"""Dataset assembly, rolling windows and model runs on Spark ML."""

from __future__ import annotations

from itertools import product as cartesian

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import avg_rank
from ..functions.lineage import checkpointed, shared_folder
from .cross_section import preprocess_wide
from .evaluate import ic_summary, rank_ic
from .joins import factor_attach
from .linear import fit_windows, predict_windows, ridge_windows, worse

DAY, KEY = "trade_date", "code_id"


def build_dataset(base: DataFrame, label: DataFrame, features: DataFrame, label_col: str, feature_cols: list[str], mv: str = "mv", industry: str = "industry", plain: tuple[str, ...] = ("industry", "mv")) -> DataFrame:
    """Base rows with label and features, rows without label dropped, label and features (but the plain ones) clipped,
    neutralised and z-scored; the raw label stays as raw_return. A (date, code) is one row."""
    wide = factor_attach(base.select(DAY, KEY, mv, industry), label.select(DAY, KEY, label_col), features.select(DAY, KEY, *[c for c in feature_cols if c not in (mv, industry)]))
    wide = wide.where(F.col(label_col).isNotNull()).withColumn("raw_return", F.col(label_col))
    todo = [label_col, *(c for c in feature_cols if c not in plain)]
    return preprocess_wide(wide.select(DAY, KEY, mv, industry, "raw_return", *todo), todo, mv, industry)


def training_set(dataset: DataFrame, label_col: str, drop: tuple[str, ...] = ("mv",)) -> DataFrame:
    """Without the market-cap feature and rows whose processed label is missing."""
    return dataset.drop(*drop).where(F.col(label_col).isNotNull())


def training_stats(dataset: DataFrame, features: list[str]) -> DataFrame:
    """column, rows, missing: one pass."""
    one = dataset.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in features), F.count("*").alias("__n"))
    return one.unpivot(["__n"], features, "column", "missing").select("column", F.col("__n").alias("rows"), "missing")


def safe_names(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """Replaces (){}[]",: in column names by _; also the way back."""
    table = str.maketrans({c: "_" for c in '(){}[]",: '})
    new, back = {}, {}
    for c in df.columns:
        n = c.translate(table)
        while n in back:
            n += "_"
        new[c], back[n] = n, c
    return df.toDF(*new.values()), back


def rolling_windows(days: DataFrame, train: int = 72, val: int = 12, test: int = 3, stride: int = 3, test_start: str | None = None) -> DataFrame:
    """window_id, train_start, val_start, test_start, test_end: test windows every `stride` months from test_start (or
    `train` months after the first day) while before the last day; the end is capped one day after it. All parts are half
    open; val is the last `val` of the `train` months. `days` is reduced to its first and last day."""
    ends = days.agg(F.min(DAY).alias("a"), F.max(DAY).alias("b"))
    first = F.lit(test_start).cast("date") if test_start else F.add_months("a", train)
    out = ends.select("b", F.explode(F.when(first < F.col("b"), F.sequence(first, F.date_sub("b", 1), F.make_ym_interval(F.lit(0), F.lit(stride))))).alias("test_start"))
    return out.select(
        F.row_number().over(Window.orderBy("test_start")).alias("window_id"), F.add_months("test_start", -train).alias("train_start"), F.add_months("test_start", -val).alias("val_start"), "test_start",
        F.least(F.add_months("test_start", test), F.date_add("b", 1)).alias("test_end"),
    )


def _assembled(df: DataFrame, features: list[str], label: str) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    ready = df.na.fill(0.0, features)
    return VectorAssembler(inputCols=features, outputCol="features").transform(ready).withColumn("label", F.col(label).cast("double"))


def _model(kind: str, params: dict, seed: int):
    from pyspark.ml.regression import GBTRegressor, LinearRegression

    if kind == "linear":
        return LinearRegression(featuresCol="features", labelCol="label", predictionCol="prediction", **params)
    defaults = {"maxDepth": 5, "maxIter": 20, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.6", "validationIndicatorCol": "is_val"}
    return GBTRegressor(featuresCol="features", labelCol="label", predictionCol="prediction", seed=seed, **(defaults | params))


def _binned(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """rows with each feature as the number of its bin: those between edges, closed on the left."""
    from pyspark.ml.feature import Bucketizer

    names = [f"__b{i}" for i in range(len(features))]
    splits = [[float("-inf"), *e, float("inf")] for e in edges]
    out = Bucketizer(inputCols=features, outputCols=names, splitsArray=splits, handleInvalid="keep").transform(rows)
    return out.drop(*features).withColumns({f: F.col(n).cast("int") for n, f in zip(names, features, strict=True)}).drop(*names)  # numbers, not categories


def _at_once(spark, fn, items) -> list:
    """fn of each item, the Spark jobs of which run side by side: fits are rows of short jobs."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    with ThreadPool(max(1, min(8, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(fn), items, 1)


def boosting_cells(part: DataFrame, features: list[str], params: dict) -> tuple[DataFrame, list[list[float]]] | None:
    """The rows of a window (is_val, label, features without NULLs) as boosted trees see them: features in as many bins as
    the trees have (maxBins, 32), by the quantiles of the training rows; rows of a day and part that are alike in all bins
    are one cell. A cell has its rows' number as weight and stands as two points, mean label plus and minus the deviation:
    number, sum and sum of squares of the labels are its rows' own, and squared errors, gains and leaves follow from these.
    So a fit takes no more points than there are cells, however many codes a day has. Other losses keep labels apart. Also
    the bins' edges; None without training rows."""
    bins = params.get("maxBins", 32)
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = part.where("not is_val").agg(*(F.percentile_approx(F.col(f).cast("double"), shares).alias(f"e{i}") for i, f in enumerate(features))).first()
    if found[0] is None:
        return None
    edges = [sorted({x for x in e if abs(x) < float("inf")}) for e in found]
    own = [] if params.get("lossType", "squared") == "squared" else ["label"]
    cells = _binned(part, features, edges).groupBy(DAY, "is_val", *features, *own).agg(F.count("*").alias("n"), F.avg("label").alias("m"), F.stddev_pop("label").alias("s"))
    points = F.when(F.col("s") > 0, F.array(F.col("m") - F.col("s"), F.col("m") + F.col("s"))).otherwise(F.array("m"))
    points = cells.select("is_val", *features, F.explode(points).alias("label"), (F.col("n") / F.size(points)).alias("weight"))
    return checkpointed(_assembled(points, features, "label").select("is_val", "label", "weight", "features")), edges


def _boost(cells: DataFrame, params: dict, seed: int):
    """A boosted model of weighted cells; the least number of rows in a node counts rows, not cells."""
    params = {"weightCol": "weight"} | params
    if "minInstancesPerNode" in params:
        rows = cells.where("not is_val").agg(F.sum("weight")).first()[0]
        params["minWeightFractionPerNode"] = min(params.pop("minInstancesPerNode") / rows, 0.499)
    return _model("gbt", params, seed).fit(cells)


def rolling_train_predict(dataset: DataFrame, features: list[str], label: str, windows: DataFrame, seeds: tuple[int, ...] = (1, 2, 3, 4, 5), kind: str = "gbt", params: dict | None = None, predict_on: str = "test") -> tuple[DataFrame, DataFrame]:
    """Predictions (window_id, trade_date, code_id, raw label, ml_factor: mean over seeds) and training records
    (window_id, seed, trees, train_rmse, val_rmse). Each fit is distributed; the driver loops over windows and seeds, both
    few. Validation rows stop boosting early; trees are grown on cells of binned rows (boosting_cells). Linear models, plain or ridge, come from sums (operators/linear.py): one scan for
    all windows."""
    spark = dataset.sparkSession
    if kind == "linear" and set(params or {}) <= {"regParam"}:
        ready = checkpointed(dataset.select(DAY, KEY, label, *features))
        fits = checkpointed(fit_windows(ready, features, label, windows, (params or {}).get("regParam", 0.0)))
        records = fits.select("window_id", F.lit(int(seeds[0])).alias("seed"), F.lit(0).alias("trees"), "train_rmse", "val_rmse")
        found = predict_windows(ready, features, label, windows, fits, predict_on)
        return found.select("window_id", DAY, KEY, "label", F.col("prediction").alias("ml_factor")), records
    trees = kind != "linear"
    ready = dataset.na.fill(0.0, features).withColumn("label", F.col(label).cast("double"))
    ready = checkpointed(ready.select(DAY, KEY, "label", *features) if trees else _assembled(dataset, features, label).select(DAY, KEY, "label", "features"))  # each fit plans anew
    predictions, records = None, []
    for w in windows.orderBy("window_id").collect():
        part = ready.where((F.col(DAY) >= F.lit(w.train_start)) & (F.col(DAY) < F.lit(w.test_start)) & F.col("label").isNotNull())
        part = part.withColumn("is_val", F.col(DAY) >= F.lit(w.val_start))
        target = ready.where((F.col(DAY) >= F.lit(w.test_start)) & (F.col(DAY) < F.lit(w.test_end))) if predict_on == "test" else part.where("is_val")
        if trees:
            cells = boosting_cells(part, features, params or {})
            if cells is None:
                continue
            points, edges = cells
            target = _assembled(_binned(target, features, edges), features, "label")
        elif part.isEmpty():
            continue
        else:
            points = part.withColumn("weight", F.lit(1.0))

        def train(seed: int, points=points):
            fit = _boost(points, params or {}, seed) if trees else _model(kind, params or {}, seed).fit(points.where("not is_val"))
            square = F.pow(F.col("prediction") - F.col("label"), 2) * F.col("weight")
            err = fit.transform(points).groupBy("is_val").agg(F.sqrt(F.sum(square) / F.sum("weight")).alias("rmse"))
            return fit, {r.is_val: r.rmse for r in err.collect()}

        own, names = target.select(DAY, KEY, "label", "features"), []
        used = seeds if trees else seeds[:1]
        for seed, (fit, rmse) in zip(used, _at_once(spark, train, used), strict=True):
            records.append((int(w.window_id), int(seed), int(getattr(fit, "getNumTrees", 0) or 0), rmse.get(False), rmse.get(True)))
            names.append(f"__p{len(names)}")
            own = fit.setPredictionCol(names[-1]).transform(own)
        mean = sum((F.col(n) for n in names[1:]), F.col(names[0])) / len(names)
        own = checkpointed(own.select(F.lit(int(w.window_id)).alias("window_id"), DAY, KEY, "label", mean.alias("ml_factor")))  # the plan doesn't grow with windows and seeds
        predictions = own if predictions is None else predictions.unionByName(own)
    record = spark.createDataFrame(records, "window_id int, seed int, trees int, train_rmse double, val_rmse double")
    if predictions is None:
        empty = spark.createDataFrame([], f"window_id int, {DAY} date, {KEY} long, label double, ml_factor double")
        return empty, record
    return predictions, record


def training_metrics(predictions: DataFrame, by: list[str], label: str = "label", prediction: str = "prediction", part: str = "part") -> DataFrame:
    """train_rmse, val_rmse and their ratio, by window and seed."""
    sq = F.pow(F.col(prediction) - F.col(label), 2)
    out = predictions.groupBy(*by).agg(F.sqrt(F.avg(F.when(F.col(part) == "train", sq))).alias("train_rmse"), F.sqrt(F.avg(F.when(F.col(part) == "val", sq))).alias("val_rmse"))
    return out.withColumn("overfit_ratio", F.try_divide("val_rmse", "train_rmse"))


def overfit_summary(records: DataFrame) -> DataFrame:
    """By window: mean RMSEs, mean and largest ratio."""
    return records.groupBy("window_id").agg(F.avg("train_rmse").alias("train_rmse"), F.avg("val_rmse").alias("val_rmse"), F.avg("overfit_ratio").alias("mean_ratio"), F.max("overfit_ratio").alias("max_ratio"))


def param_candidates(grid: dict[str, list], trials: int, seed: int = 1) -> list[dict]:
    """A seeded sample of `trials` points of a grid (all, if fewer)."""
    import random

    points = [dict(zip(grid, values, strict=True)) for values in cartesian(*grid.values())]
    return points if len(points) <= trials else random.Random(seed).sample(points, trials)


def sample_params(ranges: dict[str, tuple | list], trials: int, seed: int = 1) -> list[dict]:
    """A seeded sample of `trials` points: of (low, high, step) a number on those steps, of a list one of its items."""
    import random

    draw = random.Random(seed)

    def one(r):
        if isinstance(r, list):
            return draw.choice(r)
        low, high, step = r
        x = low + step * draw.randint(0, int(round((high - low) / step)))
        return int(x) if isinstance(low, int) and isinstance(step, int) else round(x, 10)

    return [{k: one(r) for k, r in ranges.items()} for _ in range(trials)]


#: Measures that are better when smaller; the others when larger.
SMALLER = ("train_rmse", "val_rmse", "overfit_ratio")


_TRIALS = "trial int, params string, windows long, ic_mean double, ic_ir double, train_rmse double, val_rmse double, overfit_ratio double"


def _ranked(trials: DataFrame, metric: str) -> DataFrame:
    """Adds best: the best trial by the metric among those with all windows, of equal ones the first."""
    full = F.col("windows") == F.max("windows").over(Window.partitionBy(F.lit(0)))
    order = F.asc_nulls_last(metric) if metric in SMALLER else F.desc_nulls_last(metric)
    first = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("__full"), order, "trial"))  # a row a trial
    return trials.withColumn("__full", full).withColumn("best", F.col("__full") & (first == 1)).drop("__full")


def _scores(predictions: DataFrame, fits: DataFrame, params: list[dict]) -> DataFrame:
    """A trial's row: measures of its validation predictions (window_id, trial, trade_date, label, prediction) and fits."""
    daily = rank_ic(predictions, "prediction", "label", ("trial",))
    ic = daily.groupBy("trial").agg(F.avg("ic").alias("ic_mean"), F.try_divide(F.avg("ic"), F.stddev("ic")).alias("ic_ir"))
    errors = fits.groupBy("trial").agg(F.count("*").alias("windows"), F.avg("train_rmse").alias("train_rmse"), F.avg("val_rmse").alias("val_rmse"), F.avg(F.try_divide("val_rmse", "train_rmse")).alias("overfit_ratio"))
    names = predictions.sparkSession.createDataFrame([(i, str(p)) for i, p in enumerate(params)], "trial int, params string")
    return F.broadcast(names).join(errors, "trial", "left").join(ic, "trial", "left").select("trial", "params", F.coalesce("windows", F.lit(0)).alias("windows"), "ic_mean", "ic_ir", *SMALLER)


def param_search(dataset: DataFrame, features: list[str], label: str, windows: DataFrame, candidates: list[dict], kind: str = "linear", seeds: tuple[int, ...] = (1,), metric: str = "ic_mean", race: float | None = None, least: int = 4) -> DataFrame:
    """trial, params, windows (used), ic_mean, ic_ir (rank IC on validation rows), train_rmse, val_rmse and overfit_ratio (means
    over windows and seeds; the ratio is validation over training), best: the best by the metric among the candidates that
    ran over all windows, which of equal ones is the first.

    Ridge candidates (regParam alone) share one scan of the table and one eigendecomposition a window. Other candidates are
    fitted window by window; with race, a level such as 0.95, those whose validation loss (the RMSE, or the negated mean
    rank IC if the metric is an IC) is worse than the best one's by a paired t-test at that level are given up once they
    have run over `least` windows. The candidates and windows are short driver-side lists; the fits are distributed."""
    spark = dataset.sparkSession
    if not candidates:
        return spark.createDataFrame([], f"{_TRIALS}, best boolean")
    if kind == "linear" and all(set(c) <= {"regParam"} for c in candidates):
        ready = checkpointed(dataset.select(DAY, KEY, label, *features))
        fits = checkpointed(ridge_windows(ready, features, label, windows, [c.get("regParam", 0.0) for c in candidates]))
        return _ranked(_scores(predict_windows(ready, features, label, windows, fits, "val"), fits, candidates), metric)
    ready = checkpointed(dataset.select(DAY, KEY, label, *features))
    alive, losses = list(range(len(candidates))), [[] for _ in candidates]
    found = records = None
    for w in windows.select("window_id").orderBy("window_id").collect():
        one = windows.where(F.col("window_id") == int(w.window_id))
        ran = []
        for c in alive:
            pred, fits = rolling_train_predict(ready, features, label, one, seeds, kind, candidates[c], predict_on="val")
            pred = pred.withColumnRenamed("ml_factor", "prediction").withColumn("trial", F.lit(c))
            own = fits.groupBy("window_id").agg(F.avg("train_rmse").alias("train_rmse"), F.avg("val_rmse").alias("val_rmse")).withColumn("trial", F.lit(c))
            found = pred if found is None else found.unionByName(pred)
            own = checkpointed(own)
            records = own if records is None else records.unionByName(own)
            if race is not None:
                row = own.first()
                loss = row.val_rmse if row else None
                if row and metric not in SMALLER:
                    mean = rank_ic(pred, "prediction", "label").agg(F.avg("ic")).first()[0]
                    loss = None if mean is None else -mean
                if loss is not None:
                    ran.append((c, loss))
        if race is not None and len(ran) == len(alive):  # a window counts if all have a loss there
            for c, loss in ran:
                losses[c].append(loss)
            gone = worse(losses, alive, race, least)
            alive = [c for c in alive if c not in gone]
    if found is None:
        return spark.createDataFrame([(i, str(c), 0, *[None] * 5, False) for i, c in enumerate(candidates)], f"{_TRIALS}, best boolean")
    return _ranked(_scores(found, records, candidates), metric)


def tree_importance(model, features: list[str], name: str) -> DataFrame:
    """model, feature, gain, splits of a fitted tree ensemble: a split's gain counts by the rows (the weight) that reached
    it. Features without a split have 0. Read from the saved model's nodes, a row a node; the folder is deleted again."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    path = shared_folder(spark, "model")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select("nodeData.*").where("split.featureIndex >= 0")
    used = nodes.groupBy(F.col("split.featureIndex").alias("i")).agg(F.sum(F.col("gain") * F.col("impurityStats")[0]).alias("gain"), F.count("*").alias("splits"))
    found = {r.i: (r.gain, r.splits) for r in used.collect()}  # a row a feature
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    rows = [(name, f, *found.get(i, (0.0, 0))) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "model string, feature string, gain double, splits long")


def rolling_importance(dataset: DataFrame, features: list[str], label: str, windows: DataFrame, seeds: tuple[int, ...] = (1,), params: dict | None = None) -> DataFrame:
    """tree_importance of one boosted model for each window and seed, as importance_table takes it."""
    ready = dataset.na.fill(0.0, features).withColumn("label", F.col(label).cast("double"))
    ready = checkpointed(ready.where("label is not null").select(DAY, "label", *features))

    def grow(w) -> list[DataFrame]:
        part = ready.where((F.col(DAY) >= F.lit(w.train_start)) & (F.col(DAY) < F.lit(w.test_start))).withColumn("is_val", F.col(DAY) >= F.lit(w.val_start))
        cells = boosting_cells(part, features, params or {})
        return [tree_importance(_boost(cells[0], params or {}, seed), features, f"{w.window_id}-{seed}") for seed in seeds] if cells else []

    out = None
    for one in (x for found in _at_once(dataset.sparkSession, grow, windows.orderBy("window_id").collect()) for x in found):
        out = one if out is None else out.unionByName(one)
    return out if out is not None else dataset.sparkSession.createDataFrame([], "model string, feature string, gain double, splits long")


def importance_table(importances: DataFrame) -> DataFrame:
    """feature, gain_pct, split_pct: percentages within each model (model, feature, gain, splits), averaged over models."""
    m = Window.partitionBy("model")
    pct = importances.select("model", "feature", (F.try_divide(F.col("gain"), F.sum("gain").over(m)) * 100).alias("g"), (F.try_divide(F.col("splits"), F.sum("splits").over(m)) * 100).alias("s"))
    return pct.groupBy("feature").agg(F.avg("g").alias("gain_pct"), F.avg("s").alias("split_pct"))


def sample_rows(df: DataFrame, n: int, keys: list[str], seed: int = 1) -> DataFrame:
    """n rows by a keyed hash (md5 of the keys' texts and the seed, joined by |): the same ones however the table is
    partitioned."""
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys), F.lit(str(seed)))
    return df.orderBy(F.md5(text.cast("binary")), *keys).limit(n)


def permuted(i: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A keyed bijection of 0..n-1: four Feistel rounds on the next even number of bits, walked along its cycle until the
    value is below n again."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        a, b = x >> np.uint64(half), x & mask
        for r in range(4):
            f = (b + np.uint64(seed * 4 + r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            a, b = b, a ^ (f >> np.uint64(32) & mask)
        return a << np.uint64(half) | b

    with np.errstate(over="ignore"):
        out = once(np.asarray(i).astype(np.uint64))
        while (beyond := out >= np.uint64(n)).any():
            out[beyond] = once(out[beyond])
    return out.astype(np.int64)


def with_ordinals(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """df, checkpointed, with its rows numbered from 0 without gaps, and their number: by partition, from the partitions'
    counts; no sort."""
    held = checkpointed(df)
    counts = {r.p: r.n for r in held.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()}
    starts, total = [0] * (max(counts, default=0) + 1), 0
    for p in sorted(counts):
        starts[p], total = total, total + counts[p]
    place = F.monotonically_increasing_id()
    first = F.array(*[F.lit(x).cast("long") for x in starts])
    numbered = held.withColumn("__id", place)
    return numbered.withColumn(name, F.element_at(first, (F.shiftright("__id", 33) + 1).cast("int")) + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))).drop("__id"), total


def permutation_importance(model, df: DataFrame, features: list[str], label: str, n: int | None = 2000, seed: int = 1) -> DataFrame:
    """feature, delta: rise of the RMSE when the feature is shuffled among the rows, a sample of n or, without n, all. Rows
    are numbered by partition and moved by a keyed bijection of the numbers (`permuted`), so no row count needs one sort."""
    ready = df.na.fill(0.0, features)
    chosen = sample_rows(ready, n, [DAY, KEY], seed) if n else ready
    base, total = with_ordinals(chosen.select(DAY, KEY, label, *features), "__i")
    base = checkpointed(base)

    def rmse():
        return F.sqrt(F.avg(F.pow(F.col("prediction") - F.col("label"), 2)))

    plain = model.transform(_assembled(base, features, label)).agg(rmse().alias("r0"))
    out = None
    for k, f in enumerate(features):

        def move(batches, key=seed * 1000 + k):
            for batch in batches:
                to = permuted(batch.column(0).to_numpy(), total, key)
                yield pa.RecordBatch.from_arrays([pa.array(to), batch.column(1)], ["__i", "__x"])

        mixed = base.select("__i", F.col(f).cast("double").alias("__x")).mapInArrow(move, "__i long, __x double")
        moved = base.drop(f).join(mixed, "__i").withColumnRenamed("__x", f)
        one = model.transform(_assembled(moved, features, label)).agg(rmse().alias("r")).join(plain, F.lit(True)).select(F.lit(f).alias("feature"), (F.col("r") - F.col("r0")).alias("delta"))
        out = one if out is None else out.unionByName(one)
    return out


def low_importance(gain: DataFrame, effect: DataFrame, quantile: float = 0.8) -> DataFrame:
    """Features whose mean of three descending average ranks (gain_pct, split_pct, delta) is beyond quantile * number of
    features, worst first."""
    both = gain.join(effect, "feature", "full").withColumn("__a", F.lit(1))
    ranks = [avg_rank(F.coalesce(c, F.lit(0.0)), "__a", ascending=False) for c in ("gain_pct", "split_pct", "delta")]
    out = both.withColumn("mean_rank", (ranks[0] + ranks[1] + ranks[2]) / 3).withColumn("__n", F.count("*").over(Window.partitionBy("__a")))
    return out.where(F.col("mean_rank") > quantile * F.col("__n")).select("feature", "mean_rank")
