"""Queries over cross-sections of the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.config import HUBER_C, MAD_SCALE, QUANTILES, SMALL
from phasegrid.operators import crosssection as xs
from phasegrid.oracles.base import with_panel
from phasegrid.plans.panels import KEY, cells, panel, rounded


def tail_daily_mean(spark: SparkSession, sf_dir: str, key: str = KEY, q0: float = 0.85) -> DataFrame:
    """Equal-date mean of the robust response in the upper tail, by mode and horizon."""
    tail = cells(spark, sf_dir, key).filter(F.col("q_psi") >= q0)
    return rounded(xs.equal_date_mean(tail, "phase_product_robust", ("return_mode", "horizon")))


def _weights(s, d):
    out = xs.with_date_weight(panel(s, d))
    return rounded(out.groupBy("return_mode", "horizon", "date").agg(F.max("weight").alias("weight"), F.count("*").alias("n")))


def _sector(s, d):
    return rounded(xs.with_percentile(panel(s, d), keys=(*xs.CELL, "asset_class"), out="q_sector", least=3).select("date", "ticker", "return_mode", "horizon", "asset_class", "q_sector"))


def _quantile_curve(s, d):
    """Training rows set the edges of 30 bins; later ones fill them."""
    p = panel(s, d)
    keys = ("return_mode", "horizon")
    edges = xs.bin_edges(p.filter(F.col("date") < "1999-01-01"), "psi_primary", 30, keys)
    test = xs.with_bin(p.filter(F.col("date") >= "1999-01-01"), edges, "psi_primary", keys)
    return rounded(test.groupBy(*keys, "bin").agg(F.avg("phase_product").alias("mean"), F.avg("psi_primary").alias("psi"), F.count("*").alias("n"), F.countDistinct("date").alias("n_dates")))


def _pivot(s, d):
    """Share of momentum by psi bin (20, over all horizons) and horizon."""
    p = panel(s, d)
    edges = xs.bin_edges(p, "psi_primary", 20, ("return_mode",))
    out = xs.with_bin(p, edges, "psi_primary", ("return_mode",)).groupBy("return_mode", "bin").pivot("horizon", list(SMALL.horizons)).agg(F.avg("phase_label"))
    return rounded(out.toDF("return_mode", "bin", *(f"h{h}" for h in SMALL.horizons)))


def _distance(s, d):
    c = cells(s, d)
    half = lambda when: xs.equal_width_curve(c.filter(when))
    return rounded(xs.curve_distance(half(F.col("date") < "1999-01-01"), half(F.col("date") >= "1999-01-01"), ["return_mode", "horizon", "bin"]))


def _extremes(s, d):
    """The 50 rows that clipping moves most."""
    c = cells(s, d).withColumn("delta", F.abs(F.col("phase_product") - F.col("phase_product_robust")))
    top = c.orderBy(F.col("delta").desc(), "return_mode", "date", "ticker", "horizon").limit(50)
    return rounded(top.select("return_mode", "date", "ticker", "horizon", "delta"))


def _per_group(s, d):
    w = Window.partitionBy("return_mode", "horizon").orderBy(F.col("phase_product").desc(), "date", "ticker")
    c = cells(s, d).filter("q_psi >= 0.875")
    return rounded(c.withColumn("r", F.row_number().over(w).cast("long")).filter("r <= 5").select("return_mode", "horizon", "r", "date", "ticker", "phase_product"))


def _crossings(s, d):
    curve = xs.equal_width_curve(cells(s, d)).withColumn("q", (F.col("bin") + 0.5) / 20.0)
    return rounded(xs.zero_crossings(curve, "q", "mean", ("return_mode", "horizon")))


def _paths(s, d):
    curve = xs.equal_width_curve(cells(s, d))
    return xs.phase_path(curve, "bin", "mean", ("return_mode", "horizon"))


def _bands(s, d):
    c = xs.banded(cells(s, d), [0.85, (0.85 + 1.0) / 2.0, 1.0])
    return rounded(xs.equal_date_mean(c, "phase_product_robust", ("return_mode", "horizon", "band")))


def _single_phase(s, d):
    """Five bands of equal psi shares of the training days, filled by later ones: estimate and whether each has one sign."""
    p, keys = panel(s, d), ("return_mode", "horizon")
    edges = xs.bin_edges(p.filter(F.col("date") < "1999-01-01"), "psi_primary", 5, keys)
    test = xs.with_bin(p.filter(F.col("date") >= "1999-01-01"), edges, "psi_primary", keys)
    e = xs.equal_date_mean(test, "phase_product", (*keys, "bin"))
    return rounded(e.groupBy(*keys).agg(F.count("*").alias("bands"), F.min("estimate").alias("low"), F.max("estimate").alias("high"), (F.count_if(F.col("estimate") < 0) == F.count("*")).alias("all_r"), (F.count_if(F.col("estimate") > 0) == F.count("*")).alias("all_m")))


def _subgroups(s, d):
    """Tail means within each class, percentiles taken anew inside it."""
    c = xs.with_percentile(panel(s, d), keys=(*xs.CELL, "asset_class")).filter("q_psi >= 0.75")
    return rounded(xs.equal_date_mean(c, "phase_product", ("asset_class", "return_mode", "horizon")).drop("day_sd"))


QUERIES = {
    "xs_percentile": lambda s, d: rounded(cells(s, d).select("date", "ticker", "return_mode", "horizon", "q_psi")),
    "sector_percentile": _sector,
    "cell_median_mad": lambda s, d: rounded(cells(s, d).select("date", "return_mode", "horizon", "med", "robust_scale_xs").distinct()),
    "huber_response": lambda s, d: rounded(cells(s, d).select("date", "ticker", "return_mode", "horizon", "phase_product_robust", "was_clipped")),
    "date_weights": _weights,
    "weighted_mean_std": lambda s, d: rounded(xs.weighted_moments(xs.with_date_weight(panel(s, d)), "phase_product", "weight", ("return_mode", "horizon"))),
    "tail_daily_mean": tail_daily_mean,
    "tail_bands": _bands,
    "psi_quantiles": lambda s, d: rounded(xs.quantile_table(panel(s, d))),
    "quantile_curve_oos": _quantile_curve,
    "qbin_curve": lambda s, d: rounded(xs.equal_width_curve(cells(s, d))),
    "phase_diagram_pivot": _pivot,
    "curve_distance": _distance,
    "topk_extremes": _extremes,
    "topk_per_group": _per_group,
    "zero_crossings": _crossings,
    "phase_paths": _paths,
    "single_phase_bands": _single_phase,
    "subgroup_tails": _subgroups,
}

_CELL = "return_mode, date, horizon"
_Q = f""",
xq AS (SELECT *, (rank() OVER (PARTITION BY {_CELL} ORDER BY psi_primary) + (count(*) OVER (PARTITION BY {_CELL}, psi_primary) - 1) / 2.0) / count(*) OVER (PARTITION BY {_CELL}) AS q_psi FROM panel)"""
_ROBUST = f"""{_Q},
x1 AS (SELECT *, median(phase_product) OVER (PARTITION BY {_CELL}) AS med FROM xq),
x2 AS (SELECT *, {MAD_SCALE} * median(abs(phase_product - med)) OVER (PARTITION BY {_CELL}) AS mad, coalesce(stddev_samp(phase_product) OVER (PARTITION BY {_CELL}), 0) AS sd FROM x1),
x3 AS (SELECT *, (CASE WHEN mad > 0 THEN mad WHEN sd > 0 THEN sd ELSE 1.0 END)::DOUBLE AS robust_scale_xs FROM x2),
cells AS (SELECT *, med + greatest(least(phase_product - med, {HUBER_C} * robust_scale_xs), -{HUBER_C} * robust_scale_xs) AS phase_product_robust, abs(phase_product - med) > {HUBER_C} * robust_scale_xs AS was_clipped FROM x3)"""
_CURVE = f"""{_Q}, curve AS (SELECT return_mode, horizon, greatest(ceil(round(q_psi * 20, 9)) - 1, 0)::INT AS bin, avg(phase_product) AS mean, count(*) AS n FROM xq GROUP BY 1, 2, 3)"""


def _day(source: str, value: str, keys: str, where: str = "true", sd: bool = True) -> str:
    return f""", dm AS (SELECT {keys}, date, avg({value}) AS m, count(*) AS k FROM {source} WHERE {where} GROUP BY {keys}, date)
SELECT {keys}, round(avg(m), 6) AS estimate, {'round(stddev_samp(m), 6) AS day_sd, ' if sd else ''}count(*) AS n_dates, sum(k)::BIGINT AS n_rows FROM dm GROUP BY {keys}"""


def _edges(bins: int, keys: str, where: str) -> str:
    shares = ", ".join(repr(i / bins) for i in range(1, bins))
    return f", edges AS (SELECT {keys}, list_distinct(quantile_cont(psi_primary, [{shares}])) AS edges FROM panel WHERE {where} GROUP BY {keys})"


_BIN = "len(list_filter(edges, lambda e: e <= psi_primary))::INT AS bin"
_P = lambda rest: with_panel(KEY, SMALL, rest)
_WT = f""", dw AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY {_CELL}) AS w0 FROM panel), wt AS (SELECT *, w0 / avg(w0) OVER (PARTITION BY return_mode, horizon) AS weight FROM dw)"""
_QS = ", ".join(f"round(quantile_cont(psi_primary, {q!r}::DOUBLE), 6) AS q{round(100 * q):02d}" for q in QUANTILES)
_LETTER = "CASE WHEN mean > 0 THEN 'M' ELSE 'R' END"

ORACLES = {
    "xs_percentile": _P(f"{_Q} SELECT date, ticker, return_mode, horizon, round(q_psi::DOUBLE, 6) AS q_psi FROM xq"),
    "sector_percentile": _P(f""" SELECT date, ticker, return_mode, horizon, asset_class, CASE WHEN count(*) OVER c >= 3 THEN round((rank() OVER (PARTITION BY {_CELL}, asset_class ORDER BY psi_primary)
      + (count(*) OVER (PARTITION BY {_CELL}, asset_class, psi_primary) - 1) / 2.0::DOUBLE) / count(*) OVER c, 6) END AS q_sector FROM panel WINDOW c AS (PARTITION BY {_CELL}, asset_class)"""),
    "cell_median_mad": _P(f"{_ROBUST} SELECT DISTINCT date, return_mode, horizon, round(med, 6) AS med, round(robust_scale_xs, 6) AS robust_scale_xs FROM cells"),
    "huber_response": _P(f"{_ROBUST} SELECT date, ticker, return_mode, horizon, round(phase_product_robust, 6) AS phase_product_robust, was_clipped FROM cells"),
    "date_weights": _P(f"{_WT} SELECT return_mode, horizon, date, round(max(weight), 6) AS weight, count(*) AS n FROM wt GROUP BY 1, 2, 3"),
    "weighted_mean_std": _P(f"{_WT}, a AS (SELECT return_mode, horizon, sum(weight * phase_product) / sum(weight) AS mean, sum(weight * phase_product * phase_product) / sum(weight) AS m2 FROM wt GROUP BY 1, 2) SELECT return_mode, horizon, round(mean, 6) AS mean, round(sqrt(greatest(m2 - mean * mean, 0)), 6) AS sd FROM a"),
    "tail_daily_mean": _P(_ROBUST + _day("cells", "phase_product_robust", "return_mode, horizon", "q_psi >= 0.85")),
    "tail_bands": _P(f"{_ROBUST}, b AS (SELECT *, CASE WHEN q_psi < 0.925::DOUBLE THEN 0 ELSE 1 END AS band FROM cells WHERE q_psi >= 0.85::DOUBLE)" + _day("b", "phase_product_robust", "return_mode, horizon, band")),
    "psi_quantiles": _P(f" SELECT return_mode, horizon, count(*) AS n, round(avg(psi_primary), 6) AS mean, round(stddev_samp(psi_primary), 6) AS sd, {_QS} FROM panel GROUP BY 1, 2"),
    "quantile_curve_oos": _P(f"{_edges(30, 'return_mode, horizon', 'date < DATE ' + repr('1999-01-01'))}, b AS (SELECT p.*, {_BIN} FROM panel p JOIN edges USING (return_mode, horizon) WHERE date >= DATE '1999-01-01') SELECT return_mode, horizon, bin, round(avg(phase_product), 6) AS mean, round(avg(psi_primary), 6) AS psi, count(*) AS n, count(DISTINCT date) AS n_dates FROM b GROUP BY 1, 2, 3"),
    "qbin_curve": _P(f"{_CURVE} SELECT return_mode, horizon, bin, round(mean, 6) AS mean, n FROM curve"),
    "phase_diagram_pivot": _P(f"{_edges(20, 'return_mode', 'true')}, b AS (SELECT p.*, {_BIN} FROM panel p JOIN edges USING (return_mode)) SELECT return_mode, bin, {', '.join(f'round(avg(phase_label) FILTER (horizon = {h}), 6) AS h{h}' for h in SMALL.horizons)} FROM b GROUP BY 1, 2"),
    "curve_distance": _P(f"{_Q}, c AS (SELECT return_mode, horizon, greatest(ceil(round(q_psi * 20, 9)) - 1, 0)::INT AS bin, avg(phase_product) FILTER (date < DATE '1999-01-01') AS l, avg(phase_product) FILTER (date >= DATE '1999-01-01') AS r FROM xq GROUP BY 1, 2, 3) SELECT return_mode, horizon, round(sqrt(avg((l - r) * (l - r))), 6) AS rmse, round(avg(abs(l - r)), 6) AS mae, count(*) AS n_bins FROM c WHERE l IS NOT NULL AND r IS NOT NULL GROUP BY 1, 2"),
    "topk_extremes": _P(f"{_ROBUST} SELECT return_mode, date, ticker, horizon, round(abs(phase_product - phase_product_robust), 6) AS delta FROM cells ORDER BY abs(phase_product - phase_product_robust) DESC, return_mode, date, ticker, horizon LIMIT 50"),
    "topk_per_group": _P(f"{_Q}, t AS (SELECT *, row_number() OVER (PARTITION BY return_mode, horizon ORDER BY phase_product DESC, date, ticker) AS r FROM xq WHERE q_psi >= 0.875) SELECT return_mode, horizon, r, date, ticker, round(phase_product, 6) AS phase_product FROM t WHERE r <= 5"),
    "zero_crossings": _P(f"{_CURVE}, c AS (SELECT *, (bin + 0.5) / 20.0::DOUBLE AS q, lead(mean) OVER w AS y1, lag(mean) OVER w AS y0, lead((bin + 0.5) / 20.0::DOUBLE) OVER w AS x1 FROM curve WINDOW w AS (PARTITION BY return_mode, horizon ORDER BY bin)), e AS (SELECT *, CASE WHEN mean = 0 THEN y0 ELSE mean END AS before FROM c WHERE mean = 0 OR mean * y1 < 0) SELECT return_mode, horizon, round(CASE WHEN mean = 0 THEN q ELSE q - mean * (x1 - q) / (y1 - mean) END, 6) AS root, CASE WHEN before < 0 AND y1 > 0 THEN 'R_to_M' WHEN before > 0 AND y1 < 0 THEN 'M_to_R' ELSE 'touch' END AS direction, round((y1 - mean) / (x1 - q), 6) AS slope FROM e"),
    "phase_paths": _P(f"{_CURVE}, c AS (SELECT *, {_LETTER} AS s, lag({_LETTER}) OVER (PARTITION BY return_mode, horizon ORDER BY bin) AS s0 FROM curve WHERE mean <> 0) SELECT return_mode, horizon, string_agg(s, '→' ORDER BY bin) AS path FROM c WHERE s0 IS NULL OR s <> s0 GROUP BY 1, 2"),
    "single_phase_bands": _P(f"{_edges(5, 'return_mode, horizon', 'date < DATE ' + repr('1999-01-01'))}, b AS (SELECT p.*, {_BIN} FROM panel p JOIN edges USING (return_mode, horizon) WHERE date >= DATE '1999-01-01'), dm AS (SELECT return_mode, horizon, bin, date, avg(phase_product) AS m FROM b GROUP BY 1, 2, 3, 4), e AS (SELECT return_mode, horizon, bin, avg(m) AS estimate FROM dm GROUP BY 1, 2, 3) SELECT return_mode, horizon, count(*) AS bands, round(min(estimate), 6) AS low, round(max(estimate), 6) AS high, bool_and(estimate < 0) AS all_r, bool_and(estimate > 0) AS all_m FROM e GROUP BY 1, 2"),
    "subgroup_tails": _P(f", sq AS (SELECT *, (rank() OVER (PARTITION BY {_CELL}, asset_class ORDER BY psi_primary) + (count(*) OVER (PARTITION BY {_CELL}, asset_class, psi_primary) - 1) / 2.0::DOUBLE) / count(*) OVER (PARTITION BY {_CELL}, asset_class) AS q FROM panel)" + _day("sq", "phase_product", "asset_class, return_mode, horizon", "q >= 0.75", sd=False)),
}
