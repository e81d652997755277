"""Linear models of many windows from additive sums.

A least-squares fit needs a window's sums of products only, and those of a window are the sums of its days'. So the table
is read once for all windows: one row of sums a day, then a few windows' sums of days, then small systems of equations,
each solved in a task. Predictions are a join of rows with their windows' coefficients.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY, KEY = "trade_date", "code_id"
#: A pivot (share of a feature's variance that the features before it leave) or eigenvalue below this counts as 0.
TINY = 1e-10


def _terms(features: list[str], label: str) -> list[Column]:
    """1, the label and its square; for each feature itself, its product with the label and with itself and those after."""
    y = F.col(label).cast("double")
    x = [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]
    out = [F.lit(1.0), y, y * y]
    for j, a in enumerate(x):
        out += [a, a * y, *(a * b for b in x[j:])]
    return out


def day_sums(dataset: DataFrame, features: list[str], label: str) -> DataFrame:
    """trade_date, sums: of each day's rows that have a label (missing features count as 0). Their number grows with the
    square of the features'; they are summed before the shuffle."""
    known = dataset.where(F.col(label).isNotNull())
    terms = _terms(features, label)
    return known.groupBy(DAY).agg(*(F.sum(t).alias(f"s{i}") for i, t in enumerate(terms))).select(DAY, F.array(*[f"s{i}" for i in range(len(terms))]).alias("sums"))


def window_sums(daily: DataFrame, windows: DataFrame) -> DataFrame:
    """window_id, is_val, sums: training and validation parts of each window. Days and windows are few (broadcast)."""
    inside = (F.col(DAY) >= F.col("train_start")) & (F.col(DAY) < F.col("test_start"))
    parts = daily.join(F.broadcast(windows), inside).select("window_id", (F.col(DAY) >= F.col("val_start")).alias("is_val"), F.posexplode("sums").alias("i", "x"))
    total = parts.groupBy("window_id", "is_val", "i").agg(F.sum("x").alias("x"))
    return total.groupBy("window_id", "is_val").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("s")).select("window_id", "is_val", F.col("s.x").alias("sums"))


class Moments:
    """Means, covariances and scales of features and label from their sums."""

    def __init__(self, sums, p: int):
        s = np.asarray(sums, float)
        self.n = s[0]
        self.y, yy = s[1] / s[0], s[2] / s[0]
        self.x, self.xy, self.xx = np.zeros(p), np.zeros(p), np.zeros((p, p))
        at = 3
        for j in range(p):
            self.x[j], self.xy[j] = s[at] / self.n, s[at + 1] / self.n
            self.xx[j, j:] = self.xx[j:, j] = s[at + 2 : at + 2 + p - j] / self.n
            at += 2 + p - j
        self.yy = yy
        self.c = self.xx - np.outer(self.x, self.x)
        self.r = self.xy - self.x * self.y
        self.sd = np.sqrt(np.maximum(np.diag(self.c), 0))
        self.sd[self.sd**2 <= TINY * np.diag(self.xx)] = 0  # constant features
        self.y_sd = math.sqrt(max(yy - self.y**2, 0.0))

    def standard(self) -> tuple[np.ndarray, np.ndarray]:
        """Correlations of the features, and their covariances with the label at unit scale (constant features: 0)."""
        inv = np.divide(1.0, self.sd, out=np.zeros_like(self.sd), where=self.sd > 0)
        return self.c * np.outer(inv, inv), self.r * inv

    def coefficients(self, standard: np.ndarray) -> np.ndarray:
        """Intercept and coefficients from those at unit scale."""
        b = np.divide(standard, self.sd, out=np.zeros_like(standard), where=self.sd > 0)
        return np.concatenate([[self.y - self.x @ b], b])

    def rmse(self, coef: np.ndarray) -> float:
        a, b = coef[0], coef[1:]
        mean = self.yy - 2 * (a * self.y + b @ self.xy) + a * a + 2 * a * (b @ self.x) + b @ self.xx @ b
        return math.sqrt(max(mean, 0.0))


def pivoted_cholesky_solve(a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The solution of a x = r, a positive semidefinite with unit diagonal; columns that depend on those taken before (the
    largest remaining pivot first, of equal ones the first) get 0."""
    p = len(r)
    low, left, order = np.zeros((p, p)), np.diag(a).astype(float).copy(), []
    for k in range(p):
        j = int(np.argmax(left))
        if left[j] <= TINY:
            break
        low[:, k] = (a[:, j] - low[:, :k] @ low[j, :k]) / math.sqrt(left[j])
        order.append(j)
        left = left - low[:, k] ** 2
        left[order] = -1.0
    m, x = len(order), np.zeros(p)
    t = low[order, :m]
    z, w = np.zeros(m), np.zeros(m)
    for i in range(m):
        z[i] = (r[order[i]] - t[i, :i] @ z[:i]) / t[i, i]
    for i in range(m - 1, -1, -1):
        w[i] = (z[i] - t[i + 1 :, i] @ w[i + 1 :]) / t[i, i]
    x[order] = w
    return x


def ridge_path(m: Moments, penalties: list[float]) -> list[np.ndarray]:
    """Coefficients for each penalty, from one eigendecomposition. A penalty counts as Spark ML's regParam does, on features
    and label at unit scale; without one, directions without variance get 0."""
    corr, r = m.standard()
    values, vectors = np.linalg.eigh(corr)
    turned = vectors.T @ r
    out = []
    for penalty in penalties:
        weight = np.maximum(values, 0.0) + (penalty / m.y_sd if m.y_sd > 0 else penalty)
        out.append(m.coefficients(vectors @ np.divide(turned, weight, out=np.zeros_like(turned), where=weight > TINY)))
    return out


def _fits(sums: DataFrame, p: int, solve, names: list[int]) -> DataFrame:
    """window_id, trial, coef (intercept first), train_rmse, val_rmse of every window that has training rows."""
    import pandas as pd

    def one(g: pd.DataFrame) -> pd.DataFrame:
        parts = {bool(v): Moments(s, p) for v, s in zip(g["is_val"], g["sums"], strict=True)}
        if False not in parts:
            return pd.DataFrame({"window_id": [], "trial": [], "coef": [], "train_rmse": [], "val_rmse": []})
        coefs = solve(parts[False])
        val = [parts[True].rmse(c) if True in parts else None for c in coefs]
        return pd.DataFrame({"window_id": g["window_id"].iloc[0], "trial": names, "coef": [c.tolist() for c in coefs], "train_rmse": [parts[False].rmse(c) for c in coefs], "val_rmse": val})

    return sums.groupBy("window_id").applyInPandas(one, "window_id int, trial int, coef array<double>, train_rmse double, val_rmse double")


def fit_windows(dataset: DataFrame, features: list[str], label: str, windows: DataFrame, penalty: float = 0.0) -> DataFrame:
    """window_id, trial (0), coef (intercept first), train_rmse, val_rmse: a least-squares fit, or with a penalty a ridge
    fit, of each window's rows before val_start. Rows without label are left out, missing features are 0, constant features
    and those that depend on others get 0; windows without training rows have no row."""
    p = len(features)

    def solve(m: Moments) -> list[np.ndarray]:
        return ridge_path(m, [penalty]) if penalty else [m.coefficients(pivoted_cholesky_solve(*m.standard()))]

    return _fits(window_sums(day_sums(dataset, features, label), windows), p, solve, [0])


def ridge_windows(dataset: DataFrame, features: list[str], label: str, windows: DataFrame, penalties: list[float]) -> DataFrame:
    """As fit_windows for many penalties (trial: their places), from one scan and one eigendecomposition a window."""
    return _fits(window_sums(day_sums(dataset, features, label), windows), len(features), lambda m: ridge_path(m, penalties), list(range(len(penalties))))


def predict_windows(dataset: DataFrame, features: list[str], label: str, windows: DataFrame, fits: DataFrame, part: str = "test") -> DataFrame:
    """window_id, trial, trade_date, code_id, label, prediction for the rows of each window's test (or val) part. Fits are a
    row a window and trial (broadcast)."""
    begin, end = ("test_start", "test_end") if part == "test" else ("val_start", "test_start")
    spans = fits.join(windows, "window_id").select("window_id", "trial", "coef", F.col(begin).alias("__a"), F.col(end).alias("__b"))
    rows = dataset.join(F.broadcast(spans), (F.col(DAY) >= F.col("__a")) & (F.col(DAY) < F.col("__b")))
    value = F.col("coef")[0]
    for j, f in enumerate(features):
        value = value + F.col("coef")[j + 1] * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return rows.select("window_id", "trial", DAY, KEY, F.col(label).cast("double").alias("label"), value.alias("prediction"))


def t_quantile(level: float, degrees: int) -> float:
    """The quantile of Student's t (expansion around the normal quantile; exact for 1 and 2 degrees)."""
    if degrees == 1:
        return math.tan(math.pi * (level - 0.5))
    if degrees == 2:
        return (2 * level - 1) * math.sqrt(2 / (4 * level * (1 - level)))
    z, v = NormalDist().inv_cdf(level), degrees
    return z + (z**3 + z) / (4 * v) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * v**2) + (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / (384 * v**3)


def worse(losses: list[list[float]], alive: list[int], level: float, least: int) -> list[int]:
    """Of the candidates alive, those that a paired t-test over the windows so far shows to lose more than the best."""
    n = len(losses[alive[0]])
    if n < least or len(alive) < 2:
        return []
    best = min(alive, key=lambda c: (float(np.mean(losses[c])), c))
    out = []
    for c in alive:
        d = np.array(losses[c]) - np.array(losses[best])
        spread = float(np.std(d, ddof=1))
        if c != best and d.mean() > 0 and (spread == 0 or d.mean() / (spread / math.sqrt(n)) > t_quantile(level, n - 1)):
            out.append(c)
    return out
