"""Isotonic fits of many groups in one job, their boundaries and their scores of later rows.

Points are dealt out by ranges of value, summed by value, and pooled within each range; the pooled blocks are all that the ranges of a group hand on. Blocks of
neighbouring ranges pool again to the blocks of the whole group, because a fit's level sets never split what adjacent violators pooled.

A row of a panel trains or tests many fits. Which ones, and how much a row weighs in each, is the same for all rows of a day, horizon and class; so it is found from counts
of these, and a row meets its fits in the scan that needs them. Rows are moved and sorted by value once, before that.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators.ranks import exact_quantiles
from phasegrid.operators.splits import fold_rows
from phasegrid.sources.store import drop_stored, stored

GROUP = ("return_mode", "fold", "model", "unit")
#: Training and test rows that a fit of each kind needs.
LEAST = {"universal": (1000, 200), "horizon": (400, 100), "class_left_out": (1000, 100)}


def pooled(blocks: Iterable[tuple[float, float, float, float]], out: list[list[float]] | None = None) -> list[list[float]]:
    """Blocks (first x, last x, weight, weighted sum) in order of x, adjacent ones pooled until their means rise; behind those of out, if it is given."""
    out = [] if out is None else out
    for a, b, w, s in blocks:
        block = [a, b, w, s]
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:
            last = out.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        out.append(block)
    return out


def falling_pooled(x: np.ndarray, w: np.ndarray, s: np.ndarray) -> Iterable[tuple[float, float, float, float]]:
    """Blocks of points in order of x, as pooled() takes them: whole runs whose means don't rise are pooled at once, as long as that leaves markedly fewer."""
    lo = hi = x
    while len(w):
        mean = s / w
        first = np.flatnonzero(np.r_[True, mean[1:] > mean[:-1]])
        if len(first) > 0.9 * len(w):
            break
        lo, hi, w, s = lo[first], hi[np.r_[first[1:], len(w)] - 1], np.add.reduceat(w, first), np.add.reduceat(s, first)
    return zip(lo.tolist(), hi.tolist(), w.tolist(), s.tolist(), strict=True)


def _kinds(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)


def _parts(ranged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lo, hi, w, s): blocks within each partition of the points (keys, x, w, s), which is sorted by keys and x and holds all points of its values."""
    keys = list(keys)

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held, last = None, [], None  # last is the newest point: more of its x may come

        def done() -> pd.DataFrame:
            return pd.DataFrame([(*now, *b) for b in pooled([(last[0], *last)], held)], columns=[*keys, "lo", "hi", "w", "s"])

        for pdf in batches:
            for k, g in pdf.groupby(keys, sort=False):
                if k != now:
                    if last is not None:
                        yield done()
                    now, held, last = k, [], None
                x, w, s = (np.r_[[] if last is None else last[i], g[c].to_numpy()] for i, c in enumerate(("x", "w", "s")))
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
                x, w, s = x[first], np.add.reduceat(w, first), np.add.reduceat(s, first)
                held = pooled(falling_pooled(x[:-1], w[:-1], s[:-1]), held)
                last = (float(x[-1]), float(w[-1]), float(s[-1]))
        if last is not None:
            yield done()

    return ranged.mapInPandas(within, f"{_kinds(ranged, keys)}, lo double, hi double, w double, s double")


def _across(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, lo, hi, p, weight): the blocks of the parts of each group, pooled."""
    keys = list(keys)

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        b = pooled(pdf.sort_values("lo")[["lo", "hi", "w", "s"]].itertuples(index=False, name=None))
        return pd.DataFrame([(*pdf[keys].iloc[0], lo, hi, s / w, w) for lo, hi, w, s in b], columns=[*keys, "lo", "hi", "p", "weight"])

    return parts.groupBy(*keys).applyInPandas(across, f"{_kinds(parts, keys)}, lo double, hi double, p double, weight double")


def isotonic_blocks(points: DataFrame, keys: Sequence[str], x: str, y: str, weight: str) -> DataFrame:
    """(keys, lo, hi, p, weight): the blocks of each group's weighted isotonic fit, by x; p is the block's mean. Rows without x or y don't count."""
    keys = list(keys)
    some = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & (F.col(weight) > 0))
    each = some.groupBy(*keys, F.col(x).cast("double").alias("x")).agg(F.sum(F.col(weight).cast("double")).alias("w"), F.sum(F.col(weight) * F.col(y)).cast("double").alias("s"))
    return _across(_parts(each.repartitionByRange(*keys, "x").sortWithinPartitions(*keys, "x"), keys), keys)


def _lines(blocks: DataFrame, keys: Sequence[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """By keys the corners of the fitted line: flat within a block, straight between two. Blocks are few."""
    out: dict[tuple, list] = {}
    for r in blocks.collect():
        out.setdefault(tuple(r[k] for k in keys), []).append((r["lo"], r["hi"], r["p"]))
    made = {}
    for k, b in out.items():
        b = np.array(sorted(b))
        made[k] = (b[:, :2].ravel(), np.repeat(b[:, 2], 2))
    return made


def isotonic_score(lines: dict[tuple, tuple[np.ndarray, np.ndarray]], keys: Sequence[str], x: str) -> Column:
    """The fitted line at x, by the row's keys; outside its ends their values; null where no fit is."""
    keys = list(keys)

    @F.pandas_udf("double")
    def value(a: pd.DataFrame) -> pd.Series:
        out = pd.Series(np.nan, index=a.index, dtype="float64")
        for k, g in a.groupby(keys, sort=False):
            if k in lines:
                out[g.index] = np.interp(g[x], *lines[k])
        return out

    v = value(F.struct(*keys, x))
    return F.when(~F.isnan(v), v)


def boundary(corners: tuple[np.ndarray, np.ndarray], low: float, high: float, steps: int = 4096, level: float = 0.5) -> float | None:
    """Where the line on a grid over [low, high] first reaches the level, by interpolation; the first point if it does at once; None if nowhere.

    Means of exactly the level are common where rows weigh alike; the order of their sum must not decide whether they reach it.
    """
    grid = np.linspace(low, high, steps)
    y = np.interp(grid, *corners)
    hit = np.flatnonzero(y >= level - 1e-12)
    if not len(hit):
        return None
    j = int(hit[0])
    return float(grid[0]) if j == 0 else float(grid[j - 1] + min(1.0, (level - y[j - 1]) / (y[j] - y[j - 1])) * (grid[j] - grid[j - 1]))


def fit_isotonic(train: DataFrame, keys: Sequence[str], x: str = "psi_primary", y: str = "phase_label") -> tuple[dict, DataFrame]:
    """Lines by keys, and (keys, low, high, base, boundary, n_train) of each group: x is held within its 0.5 and 99.5 percent quantiles, dates weigh alike, base is the mean of y. train should be stored."""
    keys = list(keys)
    q = exact_quantiles(train, x, [0.005, 0.995], keys).select(*keys, F.get("q", F.lit(0)).alias("_lo"), F.get("q", F.lit(1)).alias("_hi"))
    rows = xs.with_date_weight(train, tuple(keys)).join(F.broadcast(q), keys)
    held = rows.withColumn("_x", F.greatest(F.least(F.col(x), F.col("_hi")), F.col("_lo")))
    lines = _lines(isotonic_blocks(held, keys, "_x", y, "weight"), keys)
    facts = rows.groupBy(*keys).agg(F.max("_lo").alias("low"), F.max("_hi").alias("high"), (F.sum(F.col("weight") * F.col(y)) / F.sum("weight")).alias("base"), F.count("*").alias("n_train")).collect()
    own = [(*(r[k] for k in keys), r["low"], r["high"], r["base"], boundary(lines[tuple(r[k] for k in keys)], r["low"], r["high"]), r["n_train"]) for r in facts]
    return lines, train.sparkSession.createDataFrame(own, f"{_kinds(train, keys)}, low double, high double, base double, boundary double, n_train long")


def isotonic_groups(panel: DataFrame, folds: DataFrame, horizons: Sequence[int], values: Sequence[str] = ("psi_primary", "phase_label", "phase_product")) -> DataFrame:
    """panel's rows beside each fit that they train or test: part, model, unit. All horizons together, purged by the longest; each horizon, purged by itself; all but one class, tested on it."""
    columns = ["return_mode", "fold", "part", "date", "horizon", "asset_class", *values]
    rows = fold_rows(panel, folds, max(horizons)).select(*columns)
    out = rows.withColumns({"model": F.lit("universal"), "unit": F.lit("ALL")})
    for h in horizons:
        own = fold_rows(panel.filter(F.col("horizon") == h), folds, h).select(*columns)
        out = out.unionByName(own.withColumns({"model": F.lit("horizon"), "unit": F.lit(str(h))}))
    # the class that each fold's test rows have are the ones that are left out; classes are few
    classes = F.broadcast(rows.filter("part = 'test' AND asset_class IS NOT NULL").groupBy("return_mode", "fold").agg(F.collect_set("asset_class").alias("_c")))
    left = rows.join(classes, ["return_mode", "fold"]).withColumn("unit", F.explode(F.when(F.col("part") == "test", F.array("asset_class")).otherwise(F.filter("_c", lambda c: ~c.eqNullSafe(F.col("asset_class"))))))
    return out.unionByName(left.filter(F.col("unit").isNotNull()).drop("_c").withColumn("model", F.lit("class_left_out")))


def fit_days(panel: DataFrame, folds: DataFrame, horizons: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(fit, return_mode, fold, model, unit) of the fits with enough rows, numbered, and (return_mode, date, fits), stored: the fits that a day's rows train or test, with their weight there.

    All from counts by day, horizon and class; the second has a row a day, which bounds its broadcast.
    """
    spark = panel.sparkSession
    cells = stored(panel.groupBy("return_mode", "date", "horizon", "asset_class").agg(F.count("*").alias("n")), "isotonic-cells")
    days = stored(isotonic_groups(cells, folds, horizons, ("n",)).groupBy(*GROUP, "part", "date").agg(F.sum("n").alias("n")), "isotonic-counts")
    size = days.groupBy(*GROUP).agg(*(F.coalesce(F.sum(F.when(F.col("part") == part, F.col("n"))), F.lit(0)).alias(part) for part in ("train", "test")))
    least = lambda i: F.coalesce(*(F.when(F.col("model") == m, n[i]) for m, n in LEAST.items()))
    enough = size.filter((F.col("train") >= least(0)) & (F.col("test") >= least(1))).select(*GROUP)
    fits = spark.createDataFrame([(i, *r) for i, r in enumerate(sorted(map(tuple, enough.collect())))], f"fit int, {_kinds(days, GROUP)}")
    w = Window.partitionBy("fit", "part")
    each = days.join(F.broadcast(fits), list(GROUP)).withColumn("weight", F.sum("n").over(w) / F.count("*").over(w) / F.col("n"))
    of = lambda model: F.when(F.col("model") == model, F.col("unit"))
    fit = F.struct("fit", (F.col("part") == "train").alias("train"), of("horizon").cast("int").alias("horizon"), of("class_left_out").alias("left_out"), "weight")
    out = stored(each.groupBy("return_mode", "date").agg(F.collect_list(fit).alias("fits")), "isotonic-days")
    drop_stored(cells, days)
    return fits, out


def fit_rows(panel: DataFrame, days: DataFrame) -> DataFrame:
    """panel's rows beside each fit of fit_days() that they train or test: fit, train, weight. The partitions stay."""
    f = lambda c: F.col(f"_f.{c}")
    own = (f("horizon").isNull() | (f("horizon") == F.col("horizon"))) & (f("left_out").isNull() | (f("left_out").eqNullSafe(F.col("asset_class")) != f("train")))
    out = panel.join(F.broadcast(days), ["return_mode", "date"]).withColumn("_f", F.explode("fits")).filter(own)
    return out.select(*panel.columns, "_f.fit", "_f.train", "_f.weight")


def fit_all(rows: DataFrame, days: DataFrame) -> tuple[dict, DataFrame]:
    """fit_isotonic() of all fits of fit_days() at once, by fit. rows: the panel, stored.

    What lies at or beyond a fit's ends is summed to one point each; between them values are a row's own, so rows are dealt out by value before they meet their fits.
    """
    spark = rows.sparkSession
    trained = lambda r: fit_rows(r, days).filter("train")
    q = exact_quantiles(trained(rows), "psi_primary", [0.005, 0.995], ["fit"]).select("fit", F.get("q", F.lit(0)).alias("low"), F.get("q", F.lit(1)).alias("high"))
    ends = F.broadcast(q)
    x, y, w = F.col("psi_primary"), F.col("phase_label"), F.col("weight")
    left, right = x <= F.col("low"), (x >= F.col("high")) & (x > F.col("low"))
    some = {f"{c}_{side}": F.sum(F.when(at & y.isNotNull(), v)) for side, at in (("left", left), ("right", right)) for c, v in (("w", w), ("s", w * y))}
    facts = trained(rows).join(ends, "fit").groupBy("fit", "low", "high").agg((F.sum(w * y) / F.sum(w)).alias("base"), F.count("*").alias("n_train"), *(v.alias(k) for k, v in some.items())).collect()
    tails: dict[tuple, list[float]] = {}
    for r in facts:
        for at, weight, total in ((r["low"], r["w_left"], r["s_left"]), (r["high"], r["w_right"], r["s_right"])):
            if weight:
                point = tails.setdefault((r["fit"], at), [0.0, 0.0])
                point[0] += weight
                point[1] += total
    dealt = trained(rows.repartitionByRange("return_mode", "psi_primary")).join(ends, "fit").filter((x > F.col("low")) & (x < F.col("high")) & y.isNotNull())
    parts = _parts(dealt.select("fit", x.alias("x"), w.alias("w"), (w * y).alias("s")).sortWithinPartitions("fit", "x"), ("fit",))
    parts = parts.unionByName(spark.createDataFrame([(k, at, at, *v) for (k, at), v in tails.items()], parts.schema))
    lines = _lines(_across(parts, ("fit",)), ("fit",))
    own = [(r["fit"], r["low"], r["high"], r["base"], boundary(lines[(r["fit"],)], r["low"], r["high"]), r["n_train"]) for r in facts]
    return lines, spark.createDataFrame(own, "fit int, low double, high double, base double, boundary double, n_train long")


def evaluate_isotonic(panel: DataFrame, folds: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(return_mode, fold, model, unit, n_train, n, boundary, auc, brier, base_rate, base_brier, skill, log_loss, spearman) of every isotonic fit: universal, of each horizon, without each class.

    All fits are made in one job. Fits with fewer training or test rows than LEAST are left out. panel should be stored.
    """
    rows = panel.select("return_mode", "date", "horizon", "asset_class", "psi_primary", "phase_label", "phase_product")
    fits, days = fit_days(rows, folds, horizons)
    lines, facts = fit_all(rows, days)
    test = fit_rows(rows, days).filter("NOT train").join(F.broadcast(facts), "fit")
    scored = test.withColumn("x", F.greatest(F.least("psi_primary", "high"), F.col("low")))
    scored = stored(scored.withColumn("score", isotonic_score(lines, ("fit",), "x")).select("fit", "score", "psi_primary", "phase_label", "phase_product", "weight", "base"), "isotonic-scores")
    out = inf.score_metrics(scored, ("fit",), "score", "phase_label", "weight", "base").join(inf.spearman(scored, ("fit",), "psi_primary", "phase_product").drop("n"), "fit", "left")
    out = out.join(facts.select("fit", "boundary", "n_train"), "fit").join(F.broadcast(fits), "fit")
    out = stored(out.select(*GROUP, *(c for c in out.columns if c not in ("fit", *GROUP))), "isotonic-metrics")
    drop_stored(days, scored)
    return out


def isotonic_boundaries(panel: DataFrame, keys: Sequence[str] = ("return_mode", "horizon")) -> DataFrame:
    """(keys, boundary): where the isotonic chance of momentum first reaches a half; null if nowhere."""
    return fit_isotonic(panel, keys)[1].select(*keys, "boundary")


def boundary_summary(metrics: DataFrame) -> DataFrame:
    """(return_mode, model, unit, mean, sd, n) of boundaries over folds."""
    return metrics.groupBy("return_mode", "model", "unit").agg(F.avg("boundary").alias("mean"), F.stddev_samp("boundary").alias("sd"), F.count("boundary").alias("n"))
