"""Walk-forward splits: blocks of dates, purging by business days, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.config import MODES


def minus_business_days(d: Column, n: Column | int) -> Column:
    """d less n weekdays (no holidays); a weekend counts as the Monday after it."""
    n = F.lit(n) if isinstance(n, int) else n
    day = F.weekday(d)
    monday = F.when(day >= 5, F.date_add(d, 7 - day)).otherwise(d)
    at = F.when(day >= 5, F.lit(0)).otherwise(day)
    weeks, rest = F.floor(n / 5).cast("int"), (n % 5).cast("int")
    return F.date_sub(monday, 7 * weeks + rest + F.when(at < rest, 2).otherwise(0))


def numbered_dates(panel: DataFrame, keys: tuple[str, ...] = ("return_mode",)) -> DataFrame:
    """(keys, date, i, n): distinct dates in order, from 0. Days are few; the window runs over them, not over rows."""
    dates = panel.select(*keys, "date").distinct()
    w = Window.partitionBy(*keys)
    return dates.withColumns({"i": F.row_number().over(w.orderBy("date")) - 1, "n": F.count("*").over(w)})


def walkforward_folds(panel: DataFrame, splits: int = 4, min_train: float = 0.5) -> DataFrame:
    """(return_mode, fold, test_start, test_end, n_test_dates): after the first share of dates, blocks between floored equal steps; none if fewer than 5 dates a block."""
    d = numbered_dates(panel).withColumn("start", F.greatest(F.lit(1), F.floor(F.col("n") * min_train)).cast("int")).filter(F.col("n") - F.col("start") >= 5 * splits)
    fold = F.lit(None).cast("int")
    for k in reversed(range(splits)):
        edge = lambda j: F.floor(F.col("start") + (F.col("n") - F.col("start")) * j / splits)
        fold = F.when((F.col("i") >= edge(k)) & (F.col("i") < edge(k + 1)), k + 1).otherwise(fold)
    out = d.withColumn("fold", fold).filter(F.col("fold").isNotNull())
    return out.groupBy("return_mode", "fold").agg(F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.count("*").alias("n_test_dates"))


def expanding_folds(panel: DataFrame, splits: int = 4, min_train: float = 0.5) -> DataFrame:
    """(return_mode, fold, train_end, test_start, test_end): chunks of equal length, the first ones longer by one; no purge; none below 10 dates."""
    d = numbered_dates(panel).filter("n >= 10").withColumn("start", F.floor(F.col("n") * min_train).cast("int"))
    rest = F.col("n") - F.col("start")
    size, more, k = F.floor(rest / splits), rest % splits, F.col("i") - F.col("start")
    fold = F.when(k < more * (size + 1), F.floor(k / (size + 1))).otherwise(more + F.floor((k - more * (size + 1)) / F.nullif(size, F.lit(0)))) + 1
    out = d.withColumn("fold", F.when(k >= 0, fold).cast("int"))
    out = out.withColumn("before", F.lag("date").over(Window.partitionBy("return_mode").orderBy("date"))).filter(F.col("fold").isNotNull())
    return out.groupBy("return_mode", "fold").agg(F.min_by("before", "date").alias("train_end"), F.min("date").alias("test_start"), F.max("date").alias("test_end"))


def fold_rows(panel: DataFrame, folds: DataFrame, purge: int) -> DataFrame:
    """panel's rows beside each fold that they train or test, with part = train or test.

    A row trains if its date lies before the test block less `purge` business days. There are a few folds a mode: they are broadcast and
    joined by range.
    """
    f = F.broadcast(folds.select(F.col("return_mode").alias("_m"), "fold", "test_start", "test_end").withColumn("_train", minus_business_days(F.col("test_start"), purge)))
    both = panel.join(f, (F.col("return_mode") == F.col("_m")) & ((F.col("date") < F.col("_train")) | F.col("date").between(F.col("test_start"), F.col("test_end"))))
    return both.withColumn("part", F.when(F.col("date") < F.col("_train"), "train").otherwise("test")).drop("_m", "_train")


def balanced_sample(panel: DataFrame, size: int, seed: int, keys: tuple[str, ...] = ("return_mode", "date", "ticker", "horizon")) -> DataFrame:
    """At most size rows, without replacement, a row's chance in proportion to 1 / rows of its date: the largest weighted keys -ln(u) * rows, u from a hash of seed and keys."""
    n = F.count("*").over(Window.partitionBy("date"))
    u = (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return panel.withColumn("_k", -F.ln(u) * n).orderBy("_k", *keys).limit(size).drop("_k")


def mode_number(mode: Column) -> Column:
    """1, 2, ... in order of MODES; 0 for others."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, MODES)), mode), F.lit(0)).cast("long")


def fold_seed(seed: int, scheme: str = "fit", mode: Column | None = None, fold: Column | None = None, h: Column | None = None, extra: Column | None = None) -> Column:
    """Seeds of fits and bootstraps, by mode, fold, horizon and what a scheme adds. The offsets of each scheme."""
    of = lambda c, d: F.lit(0).cast("long") if c is None else (F.col(d) if c is True else c).cast("long")
    m = mode_number(F.col("return_mode") if mode is None else mode)
    k, h, extra = of(True if fold is None else fold, "fold"), of(h, "horizon"), of(extra, "")
    base = F.lit(seed) + 100_000 * m + k
    return {
        "fit": base,
        "single_phase": base + 50_000 * h,
        "root": base + 10_000 * h + 97 * extra,
        "tail": F.lit(seed) + 200_000 * m + 10_000 * k + h,
        "scaled_tail": F.lit(seed) + 300_000 * m + 10_000 * k + h + extra,
        "robust_tail": F.lit(seed) + 100_000 * k + 1000 * h + extra,
    }[scheme]
