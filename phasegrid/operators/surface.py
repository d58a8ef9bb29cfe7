"""Spline surfaces of a response over psi and the logarithm of the horizon, for all folds at once.

A surface is linear in its columns: cubic B-splines of psi and of ln h, their products if the two interact, and in context the controls, volatility times the splines of
psi, and a column for each asset class. Columns are scaled by their mean and standard deviation. A pass over the rows adds up each fold's sums in every partition;
what grows with the data stays in tasks, and the driver solves one small system a fold: once for the ridge fit, once an iteration for the logistic one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.operators.ranks import exact_quantiles

FOLD = ("return_mode", "fold")
CONTROLS = ("vol20", "range20", "log_dollar_volume20")
INPUTS = ("psi_primary", "horizon", *CONTROLS, "asset_class")
#: Shares between which psi is held, and on which roots are looked for.
DOMAIN = (0.005, 0.995)
_CHUNK = 4096


@dataclass(frozen=True)
class Design:
    interaction: bool = True
    context: bool = False
    n_knots: int = 7
    degree: int = 3


def b_splines(x: np.ndarray, knots: np.ndarray, degree: int = 3) -> np.ndarray:
    """B-splines over the knots, continued at both ends by equal steps, less the last one, which the others and an intercept imply; constant beyond the outer knots."""
    knots, steps = np.asarray(knots, float), np.arange(1, degree + 1)
    t = np.concatenate([knots[0] - (knots[1] - knots[0]) * steps[::-1], knots, knots[-1] + (knots[-1] - knots[-2]) * steps])
    x = np.clip(x, knots[0], knots[-1])
    at = np.where(x >= knots[-1], np.searchsorted(t, knots[-1], "left") - 1, np.searchsorted(t, x, "right") - 1)
    b = np.zeros((len(x), len(t) - 1))
    b[np.arange(len(x)), at] = 1.0
    for d in range(1, degree + 1):
        for i in range(len(t) - 1 - d):
            left = (x - t[i]) / (t[i + d] - t[i]) * b[:, i] if t[i + d] > t[i] else 0.0
            right = (t[i + d + 1] - x) / (t[i + d + 1] - t[i + 1]) * b[:, i + 1] if t[i + d + 1] > t[i + 1] else 0.0
            b[:, i] = left + right
    return b[:, : len(knots) + degree - 2]


@dataclass
class Basis:
    """Where a fold's knots lie and how its controls are scaled, all from its training rows."""

    low: float
    high: float
    psi_knots: np.ndarray
    h_knots: np.ndarray
    medians: np.ndarray
    means: np.ndarray
    sds: np.ndarray
    classes: list[str]

    def columns(self, design: Design, rows: dict[str, np.ndarray]) -> np.ndarray:
        bp = b_splines(np.clip(rows["psi_primary"], self.low, self.high), self.psi_knots, design.degree)
        bh = b_splines(np.log(rows["horizon"].astype(float)), self.h_knots, design.degree)
        parts = [bp, bh]
        if design.interaction:
            parts.append((bp[:, :, None] * bh[:, None, :]).reshape(len(bp), -1))
        if design.context:
            c = np.column_stack([rows[x].astype(float) for x in CONTROLS])
            c = (np.where(np.isfinite(c), c, self.medians) - self.means) / self.sds
            own = rows["asset_class"].astype(str)
            parts += [c, bp * c[:, :1], (own[:, None] == np.array(self.classes, dtype=own.dtype if own.dtype.kind == "U" else str)[None, :]).astype(float)]
        return np.concatenate(parts, axis=1)


@dataclass
class Fit:
    basis: Basis
    design: Design
    beta: np.ndarray
    intercept: float
    logistic: bool

    def predict(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        y = self.basis.columns(self.design, rows) @ self.beta + self.intercept
        return 1.0 / (1.0 + np.exp(-y)) if self.logistic else y


def _counted_quantiles(values: np.ndarray, counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Linearly interpolated quantiles of values (sorted) that occur counts times."""
    ends = np.cumsum(counts)
    at = (ends[-1] - 1) * shares
    low, high = (values[np.searchsorted(ends, f(at), "right")] for f in (np.floor, np.ceil))
    return low + (high - low) * (at - np.floor(at))


def fold_bases(train: DataFrame, design: Design, keys: Sequence[str] = FOLD) -> dict[tuple, Basis]:
    """By keys. Quantiles are exact, rows weigh alike; horizons and classes are few. train is scanned several times."""
    keys, n = list(keys), design.n_knots
    inner = [i / (n - 1) for i in range(1, n - 1)]
    psi = {tuple(r[k] for k in keys): r["q"] for r in exact_quantiles(train, "psi_primary", [*DOMAIN, *inner], keys).collect()}
    by_h: dict[tuple, list] = {}
    for r in train.groupBy(*keys, "horizon").count().collect():
        by_h.setdefault(tuple(r[k] for k in keys), []).append((int(r["horizon"]), int(r["count"])))
    medians = {k: np.zeros(3) for k in psi}
    means, sds, classes = {k: np.zeros(3) for k in psi}, {k: np.ones(3) for k in psi}, {k: [] for k in psi}
    if design.context:
        for j, c in enumerate(CONTROLS):
            for r in exact_quantiles(train.filter(~F.isnan(c)), c, [0.5], keys).collect():
                medians[tuple(r[k] for k in keys)][j] = r["q"][0]
        place = train.sparkSession.createDataFrame([(*k, *map(float, m)) for k, m in medians.items()], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in train.select(*keys).schema), *(f"_m{j} double" for j in range(3))]))
        filled = [F.when(F.isnan(c), None).otherwise(F.col(c)) for c in CONTROLS]
        filled = [F.coalesce(x, F.col(f"_m{j}")) for j, x in enumerate(filled)]
        each = train.join(F.broadcast(place), keys).groupBy(*keys).agg(*(F.avg(x).alias(f"a{j}") for j, x in enumerate(filled)), *(F.stddev_pop(x).alias(f"s{j}") for j, x in enumerate(filled)), F.array_sort(F.collect_set("asset_class")).alias("classes"))
        for r in each.collect():
            k = tuple(r[x] for x in keys)
            means[k], sds[k], classes[k] = np.array([r[f"a{j}"] for j in range(3)]), np.array([r[f"s{j}"] or 1.0 for j in range(3)]), list(r["classes"])
    out = {}
    for k, q in psi.items():
        h = np.array(sorted(by_h[k]))
        steps = np.linspace(0.0, 1.0, min(n, max(2, len(h))))
        h_knots = _counted_quantiles(np.log(h[:, 0].astype(float)), h[:, 1], steps)
        out[k] = Basis(q[0], q[1], np.array([q[0], *np.clip(q[2:], q[0], q[1]), q[1]]), h_knots, medians[k], means[k], sds[k], classes[k])
    return out


def _arrays(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    return {c: pdf[c].to_numpy() for c in pdf.columns}


def _sums(rows: DataFrame, keys: Sequence[str], part: Callable[[tuple, dict[str, np.ndarray]], np.ndarray]) -> dict[tuple, np.ndarray]:
    """By keys, the sum over batches of part's vectors. Partitions add up first; then pieces of the vectors meet in tasks of their own."""
    keys = list(keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema) + ", _at int, _v binary"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            for k, g in pdf.groupby(keys, sort=False):
                v = part(k, _arrays(g))
                total[k] = total[k] + v if k in total else v
        lines = [(*k, at, v[at : at + _CHUNK].tobytes()) for k, v in total.items() for at in range(0, len(v), _CHUNK)]
        if lines:
            yield pd.DataFrame(lines, columns=[*keys, "_at", "_v"])

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[:1].copy()
        first["_v"] = [sum(np.frombuffer(v) for v in pdf["_v"]).tobytes()]
        return first

    got: dict[tuple, list] = {}
    for r in rows.mapInPandas(add, schema).groupBy(*keys, "_at").applyInPandas(join, schema).collect():
        got.setdefault(tuple(r[k] for k in keys), []).append((r["_at"], r["_v"]))
    return {k: np.frombuffer(b"".join(v for _, v in sorted(parts, key=lambda x: x[0]))) for k, parts in got.items()}


def _scaled(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return (x - scale[0]) / scale[1]


def fit_surfaces(train: DataFrame, design: Design, logistic: bool = False, ridge: float = 4.0, c: float = 0.5, keys: Sequence[str] = FOLD, bases: dict[tuple, Basis] | None = None, most: int = 50, close: float = 1e-9) -> dict[tuple, Fit]:
    """By keys, the surface of train (keys, psi_primary, horizon, controls, asset_class, phase_product or phase_label, weight).

    Ridge: weighted squares plus ridge times the squared coefficients of scaled columns. Logistic: weighted log loss times c plus half of them, by Newton
    steps that are halved while the loss would rise; the intercept is free in both. All rows count: sums are bounded, so no sample is drawn.
    """
    bases = bases or fold_bases(train, design, keys)
    own = [x for x in INPUTS if design.context or x in ("psi_primary", "horizon")]
    rows = train.select(*keys, *own, F.col("phase_label" if logistic else "phase_product").cast("double").alias("y"), F.col("weight").cast("double").alias("weight"))

    def plain(k: tuple, a: dict) -> np.ndarray:
        x = np.column_stack([np.ones(len(a["y"])), bases[k].columns(design, a)])
        wx = x * a["weight"][:, None]
        return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0), (wx.T @ x).ravel(), wx.T @ a["y"]])

    out, scales, first = {}, {}, _sums(rows, keys, plain)
    for k, v in first.items():
        d = int(round(-1.5 + np.sqrt(2.25 + len(v) - 1)))
        n, s, ss = v[0], v[1 : d + 1], v[d + 1 : 2 * d + 1]
        a, b = v[2 * d + 1 : 2 * d + 1 + d * d].reshape(d, d), v[2 * d + 1 + d * d :]
        mean = s[1:] / n
        var = ss[1:] / n - mean**2
        scale = np.where(var > 1e-12 * np.maximum(ss[1:] / n, 1e-300), np.sqrt(np.maximum(var, 0.0)), 1.0)
        scales[k] = (mean, scale)
        if not logistic:
            wm = a[0, 1:] / a[0, 0]  # weighted means: the intercept takes them
            g = (a[1:, 1:] - a[0, 0] * np.outer(wm, wm)) / np.outer(scale, scale)
            r = (b[1:] - wm * b[0]) / scale
            beta = np.linalg.solve(g + ridge * np.eye(d - 1), r) / scale
            out[k] = Fit(bases[k], design, beta, float(b[0] / a[0, 0] - wm @ beta), False)
    if not logistic:
        return out
    size = {k: len(s[0]) + 1 for k, s in scales.items()}
    at = {k: np.zeros(n) for k, n in size.items()}
    step, last = {k: np.zeros(n) for k, n in size.items()}, {k: np.inf for k in size}
    todo = set(size)
    for _ in range(most):

        def newton(k: tuple, a: dict) -> np.ndarray:
            if k not in todo:
                return np.zeros(1)
            x = np.column_stack([np.ones(len(a["y"])), _scaled(bases[k].columns(design, a), scales[k])])
            z = x @ at[k]
            p = 1.0 / (1.0 + np.exp(-z))
            wx = x * (a["weight"] * p * (1.0 - p))[:, None]
            return np.concatenate([[(a["weight"] * (np.logaddexp(0.0, z) - a["y"] * z)).sum()], x.T @ (a["weight"] * (p - a["y"])), (wx.T @ x).ravel()])

        for k, v in _sums(rows, keys, newton).items():
            if k not in todo:
                continue
            d = size[k]
            free = np.append(0.0, np.ones(d - 1))
            loss = c * v[0] + 0.5 * (free * at[k] ** 2).sum()
            if loss > last[k] * (1 + 1e-12) + 1e-12:
                step[k] = step[k] / 2
                at[k] = at[k] - step[k]
                continue
            last[k] = loss
            step[k] = -np.linalg.solve(c * v[d + 1 :].reshape(d, d) + np.diag(free) + 1e-12 * np.eye(d), c * v[1 : d + 1] + free * at[k])
            at[k] = at[k] + step[k]
            if np.abs(step[k]).max() < close:
                todo.discard(k)
        if not todo:
            break
    for k, z in at.items():
        mean, scale = scales[k]
        beta = z[1:] / scale
        out[k] = Fit(bases[k], design, beta, float(z[0] - mean @ beta), True)
    return out


def predicted(fits: dict[tuple, Fit], keys: Sequence[str] = FOLD) -> Column:
    """The surface's value at a row, by the row's own keys; null where no surface is."""
    keys = list(keys)

    @F.pandas_udf("double")
    def value(a: pd.DataFrame) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        for k, g in a.groupby(keys, sort=False):
            if k in fits:
                out[g.index] = fits[k].predict(_arrays(g))
        return out

    context = any(f.design.context for f in fits.values())
    x = value(F.struct(*keys, *(c for c in INPUTS if context or c in ("psi_primary", "horizon"))))
    return F.when(~F.isnan(x), x)


def curves(df: DataFrame, fits: dict[tuple, Fit], points: int = 2048, keys: Sequence[str] = FOLD, domain: tuple[float, float] | None = None) -> DataFrame:
    """df (a row for each curve: keys, horizon, and the controls and asset_class that a context needs) with psi_primary on a grid over the surface's domain, place, and fit."""
    keys = list(keys)
    ends = df.sparkSession.createDataFrame([(*k, *(domain or (f.basis.low, f.basis.high))) for k, f in fits.items()], ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema), "_lo double", "_hi double"]))
    out = df.join(F.broadcast(ends), keys).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    out = out.withColumn("psi_primary", F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("place") / (points - 1.0)).drop("_lo", "_hi")
    return out.withColumn("fit", predicted(fits, keys))
