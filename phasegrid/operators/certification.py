"""Certification of the negative upper tail by fold, its regimes, onsets and consensus; comparisons of flags with what their parts say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators import splits

FOLD = ("return_mode", "fold", "horizon")


def tail_bands(cells: DataFrame, q0: float, seed: int, reps: int, effect: float = 0.02, rows: int = 250, dates: int = 40) -> DataFrame:
    """(return_mode, fold, horizon, band, estimate, ci_lo, ci_hi, p_lt0, epsilon, n_test_rows, n_test_dates, n_train_dates, supported, effect_pass, ci_pass).

    Two bands of equal width from q0 up. Test days' band means of the robust response are the estimand, bootstrapped in blocks of about the
    cube root of their number; epsilon is `effect` standard deviations of training days' band means. Folds expand and aren't purged. Cells shuffle once, to band means of
    days; all else is some rows a day.
    """
    days = xs.daily_means(xs.banded(cells, [q0, (q0 + 1.0) / 2.0, 1.0]), "phase_product_robust", ("return_mode", "horizon", "band"))
    folds = F.broadcast(splits.expanding_folds(cells).select(F.col("return_mode").alias("_m"), "fold", "train_end", "test_end"))
    both = days.join(folds, (F.col("return_mode") == F.col("_m")) & (F.col("date") <= F.col("test_end"))).withColumn("_train", F.col("date") <= F.col("train_end"))
    train, test = F.col("_train"), ~F.col("_train")
    g = both.groupBy(*FOLD, "band").agg(F.stddev_samp(F.when(train, F.col("day_mean"))).alias("_sd"), F.count_if(train).alias("n_train_dates"), F.count_if(test).alias("n_test_dates"), F.coalesce(F.sum(F.when(test, F.col("rows"))), F.lit(0)).alias("n_test_rows"))
    own = inf.bootstrap(both.filter(test), (*FOLD, "band"), "day_mean", reps, F.lit(seed) + 100_000 * F.col("fold") + 1000 * F.col("horizon") + 10 * F.col("band") + round(100 * q0), None)
    out = g.join(own.select(*FOLD, "band", "estimate", "ci_lo", "ci_hi", "p_lt0"), [*FOLD, "band"], "left").withColumn("epsilon", effect * F.col("_sd")).drop("_sd")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.withColumns({
        "supported": (F.col("n_test_rows") >= rows) & (F.col("n_test_dates") >= dates) & (F.col("n_train_dates") >= dates),
        "effect_pass": yes(F.col("estimate") <= -F.col("epsilon")), "ci_pass": yes(F.col("ci_hi") < 0),
    })


def certified_folds(bands: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(return_mode, fold, horizon, eligible, tail_negative, p, passes, certified, bands): a fold is certified if both bands are supported and negative, and its p,
    the larger of theirs, passes the step-down over the fold's horizons. A missing p of the first band makes p missing; one of the second is ignored. Ineligible horizons stay in the family."""
    first, second = (F.max(F.when(F.col("band") == i, F.col("p_lt0"))) for i in (0, 1))
    p = F.when(first.isNotNull(), F.greatest(first, F.coalesce(second, first)))
    nested = F.sort_array(F.collect_list(F.struct("band", "estimate", "ci_hi", "p_lt0", "supported", "effect_pass", "ci_pass", "n_test_rows")))
    g = bands.groupBy(*FOLD).agg(((F.count("*") == 2) & F.min("supported")).alias("eligible"), F.min(F.col("effect_pass") & F.col("ci_pass")).alias("_neg"), p.alias("p"), nested.alias("bands"))
    g = g.withColumn("tail_negative", F.col("eligible") & F.col("_neg")).drop("_neg")
    return inf.holm_stepdown(g, ("return_mode", "fold"), "p", alpha).withColumn("certified", F.col("tail_negative") & F.col("passes"))


def regimes(folds: DataFrame, min_folds: int = 3, min_fraction: float = 0.75) -> DataFrame:
    return inf.regimes_of_eligible_folds(folds.withColumn("phase", F.lit("R")), min_folds, min_fraction)


def disagreements(folds: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(return_mode, fold, horizon, stored, recomputed, same): certified flags of folds against what their nested bands say."""
    each = folds.select(*FOLD, F.explode("bands").alias("b")).select(*FOLD, "b.*")
    g = each.groupBy(*FOLD).agg(((F.count("*") == 2) & F.min(F.col("supported") & F.col("effect_pass") & F.col("ci_pass"))).alias("_neg"), F.max(F.when(F.col("band") == 0, F.col("p_lt0"))).alias("_p0"), F.max("p_lt0").alias("_p"))
    g = inf.holm_stepdown(g.withColumn("_p", F.when(F.col("_p0").isNotNull(), F.col("_p"))), ("return_mode", "fold"), "_p", alpha, out="_passes")
    both = folds.select(*FOLD, F.col("certified").alias("stored")).join(g.select(*FOLD, (F.col("_neg") & F.col("_passes")).alias("recomputed")), list(FOLD), "left")
    return both.withColumn("same", F.col("stored").eqNullSafe(F.col("recomputed")))
