"""Multiplicity control, regimes, onsets, gates, selection, metrics and resampling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from phasegrid.operators.ranks import running_sums, value_ranks


def holm_adjusted(df: DataFrame, family: tuple[str, ...], p: str = "p", order: tuple[str, ...] = ("horizon",), out: str = "p_holm") -> DataFrame:
    """Adjusted p-values: running maximum of (m - rank) * p, at most 1; null p-values aren't in the family and stay null."""
    w = Window.partitionBy(*family)
    up = w.orderBy(F.col(p).asc_nulls_last(), *order)
    m, r = F.count(p).over(w), F.row_number().over(up)
    run = F.max("_a").over(up.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_a", (m - r + 1) * F.col(p)).withColumn(out, F.when(F.col(p).isNotNull(), F.least(run, F.lit(1.0)))).drop("_a")


def holm_null_as_one(df: DataFrame, family: tuple[str, ...], p: str = "p", order: tuple[str, ...] = ("horizon",), out: str = "p_holm") -> DataFrame:
    """The same with null p-values as 1, in the family."""
    return holm_adjusted(df.withColumn("_p", F.coalesce(p, F.lit(1.0))), family, "_p", order, out).drop("_p")


def holm_stepdown(df: DataFrame, family: tuple[str, ...], p: str = "p", alpha: float = 0.05, order: tuple[str, ...] = ("horizon",), out: str = "passes") -> DataFrame:
    """Step-down decisions: true until the first p above alpha / (n - rank); nulls count in n and fail."""
    w = Window.partitionBy(*family)
    up = w.orderBy(F.col(p).asc_nulls_last(), *order)
    ok = F.coalesce(F.col(p) <= alpha / (F.count("*").over(w) - F.row_number().over(up) + 1), F.lit(False))
    return df.withColumn("_ok", ok).withColumn(out, F.min("_ok").over(up.rowsBetween(Window.unboundedPreceding, 0))).drop("_ok")


def regimes_of_all_folds(folds: DataFrame, min_folds: int = 3, min_fraction: float = 0.75) -> DataFrame:
    """R, M, CONFLICT or UNRESOLVED by (mode, horizon): enough folds of all must be certified for a phase."""
    g = folds.groupBy("return_mode", "horizon").agg(F.countDistinct("fold").alias("folds_total"), F.count_if(F.col("certified") & (F.col("phase") == "R")).alias("r_support"), F.count_if(F.col("certified") & (F.col("phase") == "M")).alias("m_support"), F.count_if(F.col("n_roots") == 0).alias("root_free"))
    g = g.withColumn("required", F.greatest(F.lit(min_folds), F.ceil(min_fraction * F.col("folds_total"))).cast("long"))
    r, m = F.col("r_support") >= F.col("required"), F.col("m_support") >= F.col("required")
    return g.withColumn("regime", F.when(r & m, "CONFLICT").when(r, "R").when(m, "M").otherwise("UNRESOLVED"))


def regimes_of_eligible_folds(folds: DataFrame, min_folds: int = 3, min_fraction: float = 0.75) -> DataFrame:
    """The tail rule: certified folds over eligible ones, which need not be all."""
    g = folds.groupBy("return_mode", "horizon").agg(F.count_if("eligible").alias("eligible_folds"), F.count_if(F.col("certified") & (F.col("phase") == "R")).alias("certified_folds"))
    g = g.withColumn("support_fraction", F.col("certified_folds") / F.greatest(F.lit(1), "eligible_folds"))
    return g.withColumn("certified_tail", (F.col("certified_folds") >= min_folds) & (F.col("support_fraction") >= min_fraction))


def modal_phase(folds: DataFrame) -> DataFrame:
    """The phase most certified folds have; ties by letter."""
    n = folds.filter("certified").groupBy("return_mode", "horizon", "phase").agg(F.count("*").alias("support"))
    w = Window.partitionBy("return_mode", "horizon").orderBy(F.col("support").desc(), "phase")
    return n.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def persistent_onset(grid: DataFrame, keys: tuple[str, ...], r: str = "is_r", m: str = "is_m", run: int = 3, tail: float = 0.8) -> DataFrame:
    """(keys, hc_grid, hc_lower_exclusive, tail_fraction, strict_tail): the first horizon from which `run` in a row are R, none later is M and the tail's R share is at least `tail`."""
    w = Window.partitionBy(*keys).orderBy("horizon")
    ahead, rest = w.rowsBetween(0, run - 1), w.rowsBetween(0, Window.unboundedFollowing)
    one = F.col(r).cast("int")
    out = grid.withColumns({"_run": (F.min(one).over(ahead) == 1) & (F.count("*").over(ahead) == run), "tail_fraction": F.avg(one).over(rest), "_m": F.max(F.col(m).cast("int")).over(rest), "hc_lower_exclusive": F.lag("horizon").over(w)})
    out = out.filter(F.col("_run") & (F.col("_m") == 0) & (F.col("tail_fraction") + 1e-15 >= tail))
    first = out.groupBy(*keys).agg(F.min(F.struct("horizon", "hc_lower_exclusive", "tail_fraction")).alias("f"))
    return first.select(*keys, F.col("f.horizon").alias("hc_grid"), F.col("f.hc_lower_exclusive").alias("hc_lower_exclusive"), F.col("f.tail_fraction").alias("tail_fraction"), (F.col("f.tail_fraction") == 1.0).alias("strict_tail"))


def tail_onset(grid: DataFrame, keys: tuple[str, ...], horizons: list[int], flag: str, run: int = 3, tail: float = 0.8) -> DataFrame:
    """(keys, identified, hc_grid) on a fixed list of horizons: missing ones are false; no rule about M and no tolerance."""
    spark = grid.sparkSession
    dense = grid.select(*keys).distinct().join(F.broadcast(spark.createDataFrame([(i, h) for i, h in enumerate(horizons)], "i int, horizon int"))).join(grid.select(*keys, "horizon", F.col(flag).alias("_f")), [*keys, "horizon"], "left")
    w = Window.partitionBy(*keys).orderBy("i")
    one = F.coalesce(F.col("_f"), F.lit(False)).cast("int")
    ahead, rest = w.rowsBetween(0, run - 1), w.rowsBetween(0, Window.unboundedFollowing)
    ok = (F.count("*").over(ahead) == run) & (F.min(one).over(ahead) == 1) & (F.avg(one).over(rest) >= tail)
    out = dense.withColumn("_ok", ok).groupBy(*keys).agg(F.min_by(F.when(F.col("_ok"), F.col("horizon")), F.when(F.col("_ok"), F.col("i"))).alias("hc_grid"))
    return out.select(*keys, F.col("hc_grid").isNotNull().alias("identified"), "hc_grid")


def consensus_onset(onsets: DataFrame, keys: tuple[str, ...], modes: int = 2) -> DataFrame:
    """(keys, identified, hc_grid): the largest onset, if every mode has one."""
    g = onsets.groupBy(*keys).agg(F.count("hc_grid").alias("n"), F.max("hc_grid").alias("h"))
    return g.select(*keys, (F.col("n") >= modes).alias("identified"), F.when(F.col("n") >= modes, F.col("h")).alias("hc_grid"))


def fixed_sequence_gate(fine: DataFrame, anchors: DataFrame, anchor: int, alpha: float = 0.05) -> DataFrame:
    """fine with gate_active and gate_pass: from a passed anchor downwards, until the first horizon that fails; the anchor itself inherits its own result."""
    keys = ["return_mode", "fold"]
    out = fine.join(anchors.select(*keys, F.col("certified_r").alias("_anchor")), keys, "left").withColumn("_anchor", F.coalesce("_anchor", F.lit(False)))
    local = F.coalesce(F.col("eligible") & F.col("certified") & (F.col("phase") == "R") & (F.col("p") <= alpha), F.lit(False))
    own = F.when(F.col("horizon") == anchor, F.col("_anchor")).otherwise(local)
    down = Window.partitionBy(*keys).orderBy(F.col("horizon").desc())
    out = out.withColumn("_own", own)
    before = F.coalesce(F.min("_own").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)) & F.col("_anchor")
    return out.withColumn("gate_active", before).withColumn("gate_pass", F.col("gate_active") & F.col("_own")).withColumnRenamed("_own", "local_pass").drop("_anchor")


def fixed_sequence_regimes(gated: DataFrame, min_folds: int = 3, min_fraction: float = 0.75) -> DataFrame:
    """(return_mode, horizon, folds_total, required, local_support, support, support_fraction, root_free, root_free_fraction, regime) of gated folds: R where enough of all folds pass the gate, else UNRESOLVED.

    local_support counts folds that pass by themselves, whatever the gate says above them.
    """
    g = gated.groupBy("return_mode", "horizon").agg(F.countDistinct("fold").alias("folds_total"), F.count_if("local_pass").alias("local_support"), F.count_if("gate_pass").alias("support"), F.count_if(F.col("n_roots") == 0).alias("root_free"))
    g = g.withColumn("required", F.greatest(F.lit(min_folds), F.ceil(min_fraction * F.col("folds_total"))).cast("long"))
    share = lambda c: F.col(c) / F.col("folds_total")
    return g.select("return_mode", "horizon", "folds_total", "required", "local_support", "support", share("support").alias("support_fraction"), "root_free", share("root_free").alias("root_free_fraction"), F.when(F.col("support") >= F.col("required"), "R").otherwise("UNRESOLVED").alias("regime"))


def refined_onset(fine: DataFrame, coarse: DataFrame, lower: int, upper: int, spacing: int, run: int = 3, tail: float = 0.8) -> DataFrame:
    """(return_mode, identified, reason, hc_grid, hc_lower_exclusive, hc_midpoint, tail_r_fraction, strict_r_tail, anchors) of regimes (return_mode, horizon, regime) on a fine and a coarse grid.

    From the certified anchor `upper` down through fine horizons, one by one, while they are R and none is missing. The onset holds if the first horizons at or beyond
    onset + spacing, + 2 spacing, ... (run - 1 of them; coarse ones beyond the anchor) are R, no later one is M, and enough of the tail is R. reason says what fails. Regimes are some rows a mode.
    """
    fine = fine.filter((F.col("horizon") > lower) & (F.col("horizon") <= upper)).select("return_mode", "horizon", "regime")
    down = Window.partitionBy("return_mode").orderBy(F.col("horizon").desc())
    walk = fine.withColumn("_on", (F.col("horizon") == F.lit(upper + 1) - F.row_number().over(down)) & (F.min((F.col("regime") == "R").cast("int")).over(down.rowsBetween(Window.unboundedPreceding, 0)) == 1))
    onset = walk.groupBy("return_mode").agg(F.min(F.when(F.col("_on"), F.col("horizon"))).alias("onset"))
    every = fine.unionByName(coarse.filter(F.col("horizon") > upper).select("return_mode", "horizon", "regime"))
    points = every.groupBy("return_mode").agg(F.sort_array(F.collect_list(F.struct(F.col("horizon").alias("h"), F.col("regime").alias("r")))).alias("p"))
    out = onset.join(points, "return_mode").withColumn("p", F.filter("p", lambda x: x["h"] >= F.col("onset")))

    def first_from(days: int) -> Column:
        return F.get(F.filter("p", lambda x: x["h"] >= F.col("onset") + days), F.lit(0))

    out = out.withColumn("_a", F.array(*(first_from(j * spacing) for j in range(run))))
    share = F.size(F.filter("p", lambda x: x["r"] == "R")) / F.size("p")
    held = F.forall("_a", lambda a: F.coalesce(a["r"] == "R", F.lit(False)))
    reason = F.when(F.col("onset").isNull(), "coarse_upper_anchor_not_replicated_at_required_fold_support").when(~held, "refined_onset_lacks_coarse_scale_persistence_anchors").when(F.exists("p", lambda x: x["r"] == "M") | (share + 1e-15 < tail), "refined_tail_fails_persistence_fraction").otherwise("")
    out = out.withColumn("reason", reason).withColumn("identified", F.col("reason") == "")
    only = lambda c: F.when(F.col("identified"), c)
    low = F.greatest(F.col("onset") - 1, F.lit(lower))
    return out.select("return_mode", "identified", "reason", only(F.col("onset")).alias("hc_grid"), only(low).alias("hc_lower_exclusive"), only((low + F.col("onset")) / 2.0).alias("hc_midpoint"), only(share).alias("tail_r_fraction"), (F.col("identified") & (share == 1)).alias("strict_r_tail"), only(F.array_join(F.transform("_a", lambda a: a["h"]), ",")).alias("anchors"))


def consensus_of_all_modes(onsets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, identified, hc_lower_exclusive, hc_grid, hc_midpoint, hc_months): the largest onset with its own lower end, if every mode that was tried has one."""
    g = onsets.groupBy(*keys).agg(F.count("*").alias("n"), F.count("hc_grid").alias("k"), F.max(F.struct("hc_grid", "hc_lower_exclusive")).alias("m"))
    only = lambda c: F.when(F.col("n") == F.col("k"), c)
    h, low = F.col("m.hc_grid"), F.col("m.hc_lower_exclusive")
    return g.select(*keys, (F.col("n") == F.col("k")).alias("identified"), only(low).alias("hc_lower_exclusive"), only(h).alias("hc_grid"), only((low + h) / 2.0).alias("hc_midpoint"), only(h / 21.0).alias("hc_months"))


def runs(grid: DataFrame, keys: tuple[str, ...], flag: str) -> DataFrame:
    """(keys, run_start, run_end, n): stretches of rows with the flag that follow one another on the grid."""
    w = Window.partitionBy(*keys).orderBy("horizon")
    out = grid.withColumn("_i", F.row_number().over(w)).filter(flag)
    out = out.withColumn("_g", F.col("_i") - F.row_number().over(w))
    return out.groupBy(*keys, "_g").agg(F.min("horizon").alias("run_start"), F.max("horizon").alias("run_end"), F.count("*").alias("n")).drop("_g")


def tail_guard(grid: DataFrame, keys: tuple[str, ...], start: int, least: float = 0.8) -> DataFrame:
    """Whether from `start` on enough horizons are R, none is M and the last is R."""
    g = grid.filter(F.col("horizon") >= start).groupBy(*keys).agg(F.avg((F.col("regime") == "R").cast("double")).alias("r_fraction"), F.count_if(F.col("regime") == "M").alias("n_m"), F.max_by("regime", "horizon").alias("last"))
    return g.withColumn("passes", (F.col("r_fraction") >= least) & (F.col("n_m") == 0) & (F.col("last") == "R"))


def auc(df: DataFrame, keys: tuple[str, ...], score: str, label: str, weight: str) -> DataFrame:
    """Weighted area under the ROC curve, ties half; null if one class is missing. Scores are summed by value and by ranges of values."""
    up = F.col(label) > 0.5
    each = running_sums(df, keys, score, {"p": F.when(up, F.col(weight)).otherwise(0.0), "n": F.when(up, 0.0).otherwise(F.col(weight))})
    return each.groupBy(*keys).agg((F.sum(F.col("p") * (F.col("before_n") + 0.5 * F.col("n"))) / F.nullif(F.sum("p") * F.sum("n"), F.lit(0.0))).alias("auc"))


def response_metrics(df: DataFrame, keys: tuple[str, ...], score: str, value: str, label: str, weight: str, base: str) -> DataFrame:
    """Weighted squared and absolute errors of a score of a continuous value, the squared error of the constant `base` and the skill against it, rank correlation, and the AUC for the label."""
    p, y, w = F.col(score), F.col(value), F.col(weight)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), (F.sum(w * (y - p) ** 2) / F.sum(w)).alias("mse"), (F.sum(w * (y - F.col(base)) ** 2) / F.sum(w)).alias("baseline_mse"), (F.sum(w * F.abs(y - p)) / F.sum(w)).alias("mae"))
    g = g.withColumn("mse_skill", 1 - F.col("mse") / F.nullif(F.col("baseline_mse"), F.lit(0.0)))
    return g.join(spearman(df, keys, score, value).drop("n"), list(keys), "left").join(auc(df, keys, score, label, weight), list(keys), "left")


def score_metrics(df: DataFrame, keys: tuple[str, ...], score: str, label: str, weight: str, base: str | None = None) -> DataFrame:
    """Brier score, its baseline and skill, log loss, beside the AUC. The baseline is the constant `base`, or else the rate of these rows."""
    p, y, w = F.col(score), F.col(label), F.col(weight)
    q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
    g = df.groupBy(*keys).agg((F.sum(w * (p - y) ** 2) / F.sum(w)).alias("brier"), (F.sum(w * y) / F.sum(w)).alias("base_rate"), (-F.sum(w * (y * F.ln(q) + (1 - y) * F.ln(1 - q))) / F.sum(w)).alias("log_loss"), F.count("*").alias("n"))
    if base is None:
        g = g.withColumn("base_brier", F.col("base_rate") * (1 - F.col("base_rate")))
    else:
        g = g.join(df.groupBy(*keys).agg((F.sum(w * (F.col(base) - y) ** 2) / F.sum(w)).alias("base_brier")), list(keys))
    g = g.withColumn("skill", 1 - F.col("brier") / F.nullif(F.col("base_brier"), F.lit(0.0)))
    return g.join(auc(df, keys, score, label, weight), list(keys))


def spearman(df: DataFrame, keys: tuple[str, ...], x: str, y: str) -> DataFrame:
    """Correlation of average ranks over rows that have both values; ranks come from ranges of values."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    out = both.join(value_ranks(both, keys, x, "_rx"), [*keys, x]).join(value_ranks(both, keys, y, "_ry"), [*keys, y])
    return out.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


#: Draws are integers modulo this prime, mixed by squares; all products fit 64 bits, so any engine draws the same.
PRIME, MIX, STEP = 2_147_483_647, (48_271, 69_621), (1_000_003, 7_919)


#: Resamples that one row of the exploded bootstrap draws.
DRAWS = 50


def _mixed(x: np.ndarray, a: int) -> np.ndarray:
    return (x * x % PRIME * a + x + a) % PRIME


def draws(seed: int, reps: np.ndarray, blocks: int) -> np.ndarray:
    """A pseudo-random integer below PRIME for each (seed, rep, block)."""
    x = (seed + STEP[0] * (reps[:, None] + 1) + STEP[1] * (np.arange(blocks)[None, :] + 1)) % PRIME
    return _mixed(_mixed(x.astype(np.int64), MIX[0]), MIX[1])


@F.pandas_udf(ArrayType(DoubleType()))
def _resampled(run: pd.Series, seed: pd.Series, size: pd.Series, first: pd.Series, reps: pd.Series) -> pd.Series:
    """Means of resamples first, first + 1, ... (DRAWS at most, below reps) of a series with running sums `run`, in blocks of `size`."""
    out = []
    for c, s, b, r, most in zip(run, seed, size, first, reps, strict=True):
        c = np.concatenate([[0.0], np.asarray(c, float)])
        n = len(c) - 1
        k = -(-n // b)
        at = draws(int(s), np.arange(r, min(r + DRAWS, most)), k) % (n - b + 1)
        length = np.full(k, b)
        length[-1] = n - (k - 1) * b
        out.append((c[at + length] - c[at]).sum(1) / n)
    return pd.Series(out)


def bootstrap(days: DataFrame, keys: tuple[str, ...], value: str, reps: int, seed: Column, block: int | None) -> DataFrame:
    """(keys, estimate, ci_lo, ci_hi, p_two, p_gt0, p_lt0, n_dates): moving-block bootstrap of the mean of a daily series for each key.

    block: its length; then series shorter than 10 or than two blocks get an estimate only. None: about the cube root of the series, 5 at least, for
    any length; a single value is its own interval; only p_lt0. A resample's mean adds up blocks as differences of the series' running sum; p-values
    count resamples on the wrong side, itself included. A row holds one series of daily means and DRAWS of its resamples, so tasks share the work of a long series. Null days are left out.
    """
    series = days.filter(F.col(value).isNotNull()).withColumn("_seed", seed.cast("long"))
    w = Window.partitionBy(*keys).orderBy("date")
    series = series.withColumn("_c", F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = series.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("date", "_c"))).alias("_l"), F.avg(value).alias("estimate"), F.count("*").alias("n_dates"), F.max("_seed").alias("_seed"))
    n = F.col("n_dates")
    size = F.lit(max(1, block)) if block is not None else F.greatest(F.lit(5), F.round(F.pow(n, F.lit(1.0 / 3.0))))
    g = g.withColumns({"_b": F.least(size.cast("long"), n), "_run": F.transform("_l", lambda x: x["_c"])})
    enough = n >= (max(10, 2 * block) if block is not None else 2)
    some = g.filter(enough).select(*keys, "_run", "_seed", "_b", F.explode(F.sequence(F.lit(0), F.lit(reps - 1), F.lit(DRAWS))).alias("_first"))
    # a row of some KB is dealt out by what it draws, not by its key
    some = some.repartition(F.xxhash64(*keys, "_first")).select(*keys, _resampled("_run", "_seed", "_b", "_first", F.lit(reps)).alias("_part"))
    means = some.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list("_part"))).alias("_m"))
    g = g.drop("_run", "_l", "_seed").join(means, list(keys), "left")

    def quantile(p: float) -> Column:
        at = (reps - 1) * p
        lo, hi = F.get("_m", F.lit(int(at))), F.get("_m", F.lit(min(int(at) + 1, reps - 1)))
        return lo + (hi - lo) * (at - int(at))

    share = lambda wrong: F.when(F.col("_m").isNotNull(), (1 + F.size(F.filter("_m", wrong))) / (reps + 1.0))
    g = g.withColumns({"ci_lo": quantile(0.025), "ci_hi": quantile(0.975), "p_gt0": share(lambda m: m <= 0), "p_lt0": share(lambda m: m >= 0)})
    if block is None:
        one = lambda c, x: F.when(n == 1, x).otherwise(F.col(c))
        g = g.withColumns({"ci_lo": one("ci_lo", F.col("estimate")), "ci_hi": one("ci_hi", F.col("estimate")), "p_lt0": one("p_lt0", F.when(F.col("estimate") >= 0, 1.0).otherwise(0.5)), "p_gt0": F.lit(None).cast("double")})
    g = g.withColumn("p_two", F.when(F.col("p_gt0").isNotNull(), F.least(F.lit(1.0), 2 * F.least("p_gt0", "p_lt0"))))
    return g.select(*keys, "estimate", "ci_lo", "ci_hi", "p_two", "p_gt0", "p_lt0", "n_dates")


def paired_days(df: DataFrame, keys: tuple[str, ...], first: str, second: str, label: str = "phase_label") -> DataFrame:
    """(keys, date, auc_0, auc_1, delta_auc, delta_brier, n) of two scores of the same rows on each day that has both labels; a positive delta speaks for the second.

    A day's AUC is its share of (positive, negative) pairs in the right order, ties half, from mean ranks within the day.
    """
    day = Window.partitionBy(*keys, "date")

    def ranked(c: str) -> Column:
        return F.rank().over(day.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, "date", c)) - 1) / 2.0

    out = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*keys, "date", first, second, F.col(label).alias("_y")).withColumns({"_r0": ranked(first), "_r1": ranked(second)})
    up = F.col("_y") > 0.5
    g = out.groupBy(*keys, "date").agg(F.count_if(up).alias("_p"), F.count("*").alias("n"), *(F.sum(F.when(up, F.col(f"_r{i}"))).alias(f"_s{i}") for i in (0, 1)), *(F.avg((F.col("_y") - F.col(c)) ** 2).alias(f"_b{i}") for i, c in enumerate((first, second))))
    g = g.filter((F.col("_p") > 0) & (F.col("_p") < F.col("n")))
    p, n = F.col("_p"), F.col("n") - F.col("_p")
    g = g.withColumns({f"auc_{i}": (F.col(f"_s{i}") - p * (p + 1) / 2.0) / (p * n) for i in (0, 1)})
    return g.select(*keys, "date", "auc_0", "auc_1", (F.col("auc_1") - F.col("auc_0")).alias("delta_auc"), (F.col("_b0") - F.col("_b1")).alias("delta_brier"), "n")


def paired_bootstrap(days: DataFrame, keys: tuple[str, ...], reps: int, seed: Column, block: int) -> DataFrame:
    """(keys, metric, estimate, ci_lo, ..., n_dates): bootstraps of both mean deltas of paired_days. A resample draws the same days for both, since draws depend on seed, resample and block alone."""
    names = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(c).alias("v")) for m, c in (("mean_datewise_auc_delta", "delta_auc"), ("mean_datewise_brier_improvement", "delta_brier"))))
    each = days.select(*keys, "date", F.explode(names).alias("m")).select(*keys, "date", "m.*").withColumn("_own", seed)
    return bootstrap(each, (*keys, "metric"), "v", reps, F.col("_own"), block)


def cluster_roots(roots: DataFrame, width: float = 0.06) -> DataFrame:
    """(return_mode, horizon, direction, cluster, support, root, root_quantile, q25, q75, iqr, folds) of roots (those keys, fold, root, root_quantile): in order they join the cluster whose median is nearest, if within width; of a fold the one nearest to the median counts. A group is the roots of a few folds."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["root_quantile", "fold"])
        groups: list[list[tuple[int, float, float]]] = []
        for fold, q, root in zip(pdf["fold"], pdf["root_quantile"], pdf["root"], strict=True):
            far = [abs(float(np.median([v for _, v, _ in g])) - q) for g in groups]
            if far and min(far) <= width:
                groups[int(np.argmin(far))].append((fold, q, root))
            else:
                groups.append([(fold, q, root)])
        rows = []
        for i, g in enumerate(groups, 1):
            mid = float(np.median([v for _, v, _ in g]))
            best = {f: (v, root) for f, v, root in sorted(g, key=lambda r: -abs(r[1] - mid))}
            x = np.array([v for v, _ in best.values()])
            lo, hi = np.quantile(x, [0.25, 0.75])
            own = [*(pdf[k].iloc[0] for k in ("return_mode", "horizon", "direction")), i, len(best), float(np.median([r for _, r in best.values()])), float(np.median(x)), float(lo), float(hi), float(hi - lo)]
            rows.append([*own, ",".join(map(str, sorted(best)))])
        return pd.DataFrame(rows, columns=["return_mode", "horizon", "direction", "cluster", "support", "root", "root_quantile", "q25", "q75", "iqr", "folds"])

    kind = "return_mode string, horizon int, direction string, cluster int, support int, root double, root_quantile double, q25 double, q75 double, iqr double, folds string"
    return roots.groupBy("return_mode", "horizon", "direction").applyInPandas(run, kind)
