"""Cross-sections of the panel: percentiles, robust responses, weights, quantiles, bands and curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.config import HUBER_C, MAD_SCALE, QUANTILES
from phasegrid.operators.ranks import exact_quantiles

CELL = ("return_mode", "date", "horizon")


def average_rank(value: str, keys: tuple[str, ...]) -> Column:
    """Rank with ties averaged; nulls get none."""
    w = Window.partitionBy(*keys)
    return F.when(F.col(value).isNotNull(), F.rank().over(w.orderBy(F.col(value).asc_nulls_last())) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0)


def with_percentile(panel: DataFrame, value: str = "psi_primary", keys: tuple[str, ...] = CELL, out: str = "q_psi", least: int = 1) -> DataFrame:
    """panel with the percentile of value in its cell: average rank over count; null in cells of fewer than `least`."""
    n = F.count(value).over(Window.partitionBy(*keys))
    return panel.withColumn(out, F.when(n >= least, average_rank(value, keys) / n))


def with_robust_response(panel: DataFrame, value: str = "phase_product", keys: tuple[str, ...] = CELL, c: float = HUBER_C) -> DataFrame:
    """panel with med, robust_scale_xs (scaled MAD; else sample sd; else 1), phase_product_robust (deviations held within c scales) and was_clipped."""
    w = Window.partitionBy(*keys)
    out = panel.withColumn("med", F.median(value).over(w))
    out = out.withColumns({"_mad": MAD_SCALE * F.median(F.abs(F.col(value) - F.col("med"))).over(w), "_sd": F.coalesce(F.stddev_samp(value).over(w), F.lit(0.0))})
    out = out.withColumn("robust_scale_xs", F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd")).otherwise(1.0))
    cap, off = c * F.col("robust_scale_xs"), F.col(value) - F.col("med")
    return out.withColumns({"phase_product_robust": F.col("med") + F.greatest(F.least(off, cap), -cap), "was_clipped": F.abs(off) > cap}).drop("_mad", "_sd")


def date_weights(panel: DataFrame, keys: tuple[str, ...] = ("return_mode", "horizon")) -> DataFrame:
    """(keys, date, weight): 1 / rows of the date, scaled to mean 1 over the rows of keys, which is dates / rows. A row a day."""
    days = panel.groupBy(*keys, "date").agg(F.count("*").alias("_k"))
    w = Window.partitionBy(*keys)
    return days.select(*keys, "date", (F.sum("_k").over(w) / F.count("*").over(w) / F.col("_k")).alias("weight"))


def with_date_weight(panel: DataFrame, keys: tuple[str, ...] = ("return_mode", "horizon")) -> DataFrame:
    """panel with its date weights. Those are a row a day and key, which bounds their broadcast; panel is scanned twice, so it should be stored."""
    return panel.join(F.broadcast(date_weights(panel, keys)), [*keys, "date"])


def weighted_moments(df: DataFrame, value: str, weight: str, keys: tuple[str, ...]) -> DataFrame:
    """Weighted mean and population sd in one pass."""
    v, w = F.col(value), F.col(weight)
    out = df.groupBy(*keys).agg((F.sum(w * v) / F.sum(w)).alias("mean"), (F.sum(w * v * v) / F.sum(w)).alias("_m2"))
    return out.withColumn("sd", F.sqrt(F.greatest(F.col("_m2") - F.col("mean") ** 2, F.lit(0.0)))).drop("_m2")


def in_band(q: Column, low: Column, high: Column, last: Column) -> Column:
    """low <= q < high; the last band takes its upper edge, too."""
    return (q >= low) & F.when(last, q <= high).otherwise(q < high)


def banded(cells: DataFrame, edges: list[float], value: str = "q_psi") -> DataFrame:
    """Rows within the edges, with the number of their band; the last band is closed."""
    band = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        hit = in_band(F.col(value), F.lit(edges[i]), F.lit(edges[i + 1]), F.lit(i == len(edges) - 2))
        band = F.when(hit, i).otherwise(band)
    return cells.withColumn("band", band).filter(F.col("band").isNotNull())


def daily_means(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean within (keys, date): the first level of an equal-date mean."""
    return df.groupBy(*keys, "date").agg(F.avg(value).alias("day_mean"), F.count("*").alias("rows"))


def equal_date_mean(df: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Mean over dates of the means within dates, with numbers of dates and rows."""
    return daily_means(df, value, keys).groupBy(*keys).agg(F.avg("day_mean").alias("estimate"), F.stddev_samp("day_mean").alias("day_sd"), F.count("*").alias("n_dates"), F.sum("rows").alias("n_rows"))


def quantile_table(panel: DataFrame, value: str = "psi_primary", keys: tuple[str, ...] = ("return_mode", "horizon")) -> DataFrame:
    """n, mean, sd and exact, linearly interpolated quantiles."""
    out = panel.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    out = out.join(exact_quantiles(panel, value, QUANTILES, keys, "_q").drop("n"), list(keys), "left")
    return out.select(*keys, "n", "mean", "sd", *(F.get("_q", F.lit(i)).alias(f"q{round(100 * x):02d}") for i, x in enumerate(QUANTILES)))


def bin_edges(df: DataFrame, value: str, bins: int, keys: tuple[str, ...]) -> DataFrame:
    """(keys, edges): inner edges at equal shares of df's values, a row for each key."""
    q = exact_quantiles(df, value, [i / bins for i in range(1, bins)], keys, "_q")
    return q.select(*keys, F.array_distinct("_q").alias("edges"))


def with_bin(df: DataFrame, edges: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """df with bin = number of edges at or below the value; outer bins are open."""
    return df.join(F.broadcast(edges), list(keys)).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value)))).drop("edges")


def equal_width_curve(cells: DataFrame, bins: int = 20, value: str = "phase_product") -> DataFrame:
    """Mean and count of value in equal bins of q_psi, closed on the right, the first on both sides."""
    n = F.greatest(F.ceil(F.round(F.col("q_psi") * bins, 9)) - 1, F.lit(0)).cast("int")
    return cells.withColumn("bin", n).groupBy("return_mode", "horizon", "bin").agg(F.avg(value).alias("mean"), F.count("*").alias("n"))


def curve_distance(left: DataFrame, right: DataFrame, on: list[str], value: str = "mean") -> DataFrame:
    """RMSE and MAE of two curves where both have a bin."""
    both = left.select(*on, F.col(value).alias("_l")).join(right.select(*on, F.col(value).alias("_r")), on)
    keys = [k for k in on if k != "bin"]
    d = F.col("_l") - F.col("_r")
    return both.groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), F.count("*").alias("n_bins"))


def zero_crossings(curve: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, root, direction, slope) of a curve of points: sign changes by interpolation, exact zeros as they are."""
    w = Window.partitionBy(*keys).orderBy(x)
    out = curve.withColumns({"_x1": F.lead(x).over(w), "_y1": F.lead(y).over(w), "_y0": F.lag(y).over(w)})
    here, there = F.col(y), F.col("_y1")
    cross = here * there < 0
    root = F.when(here == 0, F.col(x)).otherwise(F.col(x) - here * (F.col("_x1") - F.col(x)) / (there - here))
    before = F.when(here == 0, F.col("_y0")).otherwise(here)
    way = F.when((before < 0) & (there > 0), "R_to_M").when((before > 0) & (there < 0), "M_to_R").otherwise("touch")
    out = out.filter((here == 0) | cross)
    return out.select(*keys, root.alias("root"), way.alias("direction"), ((there - here) / (F.col("_x1") - F.col(x))).alias("slope"))


def phase_path(curve: DataFrame, x: str, y: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, path): M and R along the curve, joined by arrows, one letter for each stretch of a sign."""
    w = Window.partitionBy(*keys).orderBy(x)
    out = curve.filter(F.col(y) != 0).withColumn("_s", F.when(F.col(y) > 0, "M").otherwise("R"))
    out = out.withColumn("_new", F.coalesce(F.col("_s") != F.lag("_s").over(w), F.lit(True))).filter("_new")
    steps = F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col("_s").alias("s"))))
    return out.groupBy(*keys).agg(F.array_join(F.transform(steps, lambda e: e["s"]), "→").alias("path"))
