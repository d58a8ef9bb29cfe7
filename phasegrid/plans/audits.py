"""Queries on universes, audits and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.config import SMALL
from phasegrid.oracles.base import with_panel
from phasegrid.plans.certification import GRID_SQL as _GRID
from phasegrid.plans.certification import grid
from phasegrid.plans.panels import KEY, panel, rounded
from phasegrid.sources.tables import canonical_ticker, html_rows, table


def universes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two universes of tickers with a class: names and segments of the customers with orders before 1998, and of those with orders from then on."""
    c = table(spark, sf_dir, "customer").select(canonical_ticker(F.col("c_name")).alias("ticker"), F.col("c_mktsegment").alias("asset_class"), "c_custkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderdate")
    of = lambda when: c.join(o.filter(when), "c_custkey", "left_semi").drop("c_custkey")
    return of(F.col("o_orderdate") < "1998-01-01"), of(F.col("o_orderdate") >= "1998-01-01")


_U = """WITH c AS (SELECT replace(upper(trim(c_name)), '.', '-') AS ticker, c_mktsegment AS asset_class, c_custkey FROM customer),
a AS (SELECT ticker, asset_class FROM c WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')), b AS (SELECT ticker, asset_class FROM c WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'))"""


def metadata(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows, tickers, their sorted list's hash, dates, horizons. Tickers of a panel are some thousand: their set is small."""
    names = F.array_sort(F.collect_set("ticker"))
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows"), F.countDistinct("ticker").alias("n_tickers"), F.sha2(F.concat_ws("\n", names), 256).alias("ticker_set_sha256"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.array_join(F.array_sort(F.collect_set("horizon")), ",").alias("horizons"))


def _independence(s, d):
    a, b = universes(s, d)
    over = a.select("ticker").intersect(b.select("ticker"))
    n = lambda df, name: df.agg(F.count("*").alias(name))
    one = lambda df: df.withColumn("_k", F.lit(1))
    out = one(n(a, "n_first")).join(one(n(b, "n_second")), "_k").join(one(n(over, "n_overlap")), "_k").drop("_k")
    return out.withColumn("universe_pass", F.col("n_overlap") == 0)


def _coverage(s, d):
    a, b = universes(s, d)
    g = b.join(a.select("ticker", F.lit(1).alias("_there")), "ticker", "left").groupBy("asset_class").agg(F.count("*").alias("n_bound"), F.count("_there").alias("n_there"))
    return rounded(g.withColumns({"coverage": F.col("n_there") / F.col("n_bound"), "passes": F.col("n_there") >= 0.8 * F.col("n_bound")}))


def _failures(s, d):
    g = grid(s, d)
    why = F.when(~F.col("eligible"), "support").when(~F.col("certified"), "p_value").when(F.col("phase") == "M", "sign").otherwise("none")
    return g.withColumn("mechanism", why).groupBy("return_mode", "horizon").agg(*(F.count_if(F.col("mechanism") == m).alias(f"n_{m}") for m in ("support", "p_value", "sign", "none")), F.count("*").alias("n"))


def _forensic(s, d):
    """Flags recomputed from parts against stored ones that were rounded; where they differ."""
    g = grid(s, d)
    stored = g.select("return_mode", "fold", "horizon", (F.round("p", 2) <= 0.4).alias("stored"))
    new = g.select("return_mode", "fold", "horizon", (F.col("p") <= 0.4).alias("recomputed"))
    both = new.join(stored, ["return_mode", "fold", "horizon"], "left").withColumn("same", F.col("recomputed").eqNullSafe(F.col("stored")))
    return both.groupBy("return_mode").agg(F.count_if("same").alias("n_same"), F.count_if(~F.col("same")).alias("n_differ"), F.count_if(F.col("stored").isNull()).alias("n_null"))


def _json_rows(s, d):
    """Numbers in JSON properties of events, as rows by key."""
    e = table(s, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,int>")).alias("k", "v"))
    return rounded(e.groupBy("event_type", "k").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.avg("v").alias("mean")))


def _combine(s, d):
    """Fine rows first, coarse ones where no fine row is."""
    g = grid(s, d).groupBy("return_mode", "horizon").agg(F.avg("est").alias("est"))
    fine, coarse = g.filter("horizon <= 30").withColumn("source", F.lit("fine")), g.withColumn("est", -F.col("est")).withColumn("source", F.lit("coarse"))
    w = Window.partitionBy("return_mode", "horizon").orderBy(F.col("source").desc())
    return rounded(fine.unionByName(coarse).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r"), digits=8)


def _spacing(s, d):
    """Steps between distinct quantities' horizons."""
    h = grid(s, d).select("horizon").distinct()
    step = h.withColumn("step", F.lead("horizon").over(Window.orderBy("horizon")) - F.col("horizon"))
    return step.agg(F.median("step").alias("median_step"), F.min("step").alias("min_step"), F.count("*").alias("n"))


def _flags(s, d):
    """Text flags of two dialects as booleans."""
    o = table(s, d, "orders").select(F.lower(F.trim(F.when(F.col("o_orderkey") % 3 == 0, " Yes ").when(F.col("o_orderkey") % 3 == 1, "PASS").otherwise(F.col("o_orderstatus")))).alias("f"))
    return o.groupBy("f").agg(F.max(F.col("f").isin("true", "1", "yes", "y")).alias("plain"), F.max(F.col("f").isin("true", "1", "yes", "y", "pass", "r")).alias("wide"), F.count("*").alias("n"))


def _normalised_symbols(s, d):
    p = table(s, d, "part").select(F.concat(F.upper(F.substring("p_brand", 1, 1)), F.lit("."), F.substring_index("p_brand", "#", -1)).alias("raw"))
    return p.distinct().select("raw", canonical_ticker(F.col("raw")).alias("us"), canonical_ticker(F.col("raw"), False).alias("kept"), F.lpad(F.substring_index("raw", ".", -1), 4, "0").alias("code"))


def _cells_of_pages(s, d):
    return html_rows(table(s, d, "pages")).groupBy("page_id").agg(F.count("*").alias("n_cells"), F.max(F.length("cell")).alias("longest"))


def _join(how):
    def run(s, d):
        a, b = universes(s, d)
        return a.join(b.select("ticker"), "ticker", how)

    return run


QUERIES = {
    "panel_metadata": lambda s, d: metadata(panel(s, d), ("return_mode",)),
    "universe_anti_join": _join("left_anti"),
    "universe_semi_join": _join("left_semi"),
    "universe_union": lambda s, d: universes(s, d)[0].union(universes(s, d)[1]).distinct(),
    "universe_intersect": lambda s, d: universes(s, d)[0].intersect(universes(s, d)[1]),
    "universe_except": lambda s, d: universes(s, d)[0].exceptAll(universes(s, d)[1]),
    "independence_audit": _independence,
    "coverage_audit": _coverage,
    "failure_decomposition": _failures,
    "forensic_merge": _forensic,
    "json_explode": _json_rows,
    "combine_keep_first": _combine,
    "grid_spacing": _spacing,
    "text_flags": _flags,
    "symbol_forms": _normalised_symbols,
    "html_cells": _cells_of_pages,
    "class_control_medians": lambda s, d: rounded(panel(s, d).groupBy("asset_class").agg(*(F.median(c).alias(c) for c in ("vol20", "range20", "log_dollar_volume20")))),
    "horizon_tail_summary": lambda s, d: rounded(grid(s, d).filter("horizon >= 30").groupBy("return_mode", "horizon").agg(F.avg("est").alias("mean"), F.stddev_samp("est").alias("sd"), F.sum("n").alias("n_obs"), F.min("p").alias("p_min"), F.median("p").alias("p_median"), F.max("p").alias("p_max")), digits=8),
    "metadata_join": lambda s, d: table(s, d, "supplier").join(F.broadcast(table(s, d, "nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("sector")).agg(F.count("*").alias("n"), F.round(F.avg("s_acctbal"), 6).alias("mean_balance")),
    "parameter_grid": lambda s, d: grid(s, d).select("return_mode", "fold").distinct().join(F.broadcast(s.createDataFrame([(q,) for q in (0.6, 0.75, 0.9)], "q0 double"))).groupBy("return_mode", "q0").agg(F.count("*").alias("n")),
}

_P = lambda rest: with_panel(KEY, SMALL, rest)
_MECH = "CASE WHEN NOT eligible THEN 'support' WHEN NOT certified THEN 'p_value' WHEN phase = 'M' THEN 'sign' ELSE 'none' END"
ORACLES = {
    "panel_metadata": _P(" SELECT return_mode, count(*) AS n_rows, count(DISTINCT ticker) AS n_tickers, sha256(array_to_string(list_sort(list(DISTINCT ticker)), chr(10))) AS ticker_set_sha256, min(date) AS date_min, max(date) AS date_max, array_to_string(list_sort(list(DISTINCT horizon)), ',') AS horizons FROM panel GROUP BY 1"),
    "universe_anti_join": f"{_U} SELECT * FROM a WHERE ticker NOT IN (SELECT ticker FROM b)",
    "universe_semi_join": f"{_U} SELECT * FROM a WHERE ticker IN (SELECT ticker FROM b)",
    "universe_union": f"{_U} SELECT * FROM a UNION SELECT * FROM b",
    "universe_intersect": f"{_U} SELECT * FROM a INTERSECT SELECT * FROM b",
    "universe_except": f"{_U} SELECT * FROM a EXCEPT ALL SELECT * FROM b",
    "independence_audit": f"{_U}, o AS (SELECT count(*) AS n FROM (SELECT ticker FROM a INTERSECT SELECT ticker FROM b)) SELECT (SELECT count(*) FROM a) AS n_first, (SELECT count(*) FROM b) AS n_second, n AS n_overlap, n = 0 AS universe_pass FROM o",
    "coverage_audit": f"{_U} SELECT b.asset_class, count(*) AS n_bound, count(a.ticker) AS n_there, round(count(a.ticker) / count(*), 6) AS coverage, count(a.ticker) >= 0.8 * count(*) AS passes FROM b LEFT JOIN a ON a.ticker = b.ticker GROUP BY 1",
    "failure_decomposition": f"{_GRID} SELECT return_mode, horizon, {', '.join(f'count(*) FILTER ({_MECH} = {m!r}) AS n_{m}' for m in ('support', 'p_value', 'sign', 'none'))}, count(*) AS n FROM grid GROUP BY 1, 2",
    "forensic_merge": f"{_GRID} SELECT return_mode, count(*) FILTER ((p <= 0.4) IS NOT DISTINCT FROM (round(p, 2) <= 0.4)) AS n_same, count(*) FILTER ((p <= 0.4) IS DISTINCT FROM (round(p, 2) <= 0.4)) AS n_differ, count(*) FILTER (p IS NULL) AS n_null FROM grid GROUP BY 1",
    "json_explode": "WITH e AS (SELECT event_type, unnest(json_keys(props)) AS k, props FROM events) SELECT event_type, k, count(*) AS n, sum((props->>k)::INT)::BIGINT AS total, round(avg((props->>k)::INT), 6) AS mean FROM e GROUP BY 1, 2",
    "combine_keep_first": f"{_GRID}, g AS (SELECT return_mode, horizon, avg(est) AS est FROM grid GROUP BY 1, 2) SELECT return_mode, horizon, round(CASE WHEN horizon <= 30 THEN est ELSE -est END, 8) AS est, CASE WHEN horizon <= 30 THEN 'fine' ELSE 'coarse' END AS source FROM g",
    "grid_spacing": f"{_GRID}, h AS (SELECT lead(horizon) OVER (ORDER BY horizon) - horizon AS step FROM (SELECT DISTINCT horizon FROM grid)) SELECT median(step)::DOUBLE AS median_step, min(step) AS min_step, count(*) AS n FROM h",
    "text_flags": "WITH o AS (SELECT lower(trim(CASE WHEN o_orderkey % 3 = 0 THEN ' Yes ' WHEN o_orderkey % 3 = 1 THEN 'PASS' ELSE o_orderstatus END)) AS f FROM orders) SELECT f, bool_or(f IN ('true', '1', 'yes', 'y')) AS plain, bool_or(f IN ('true', '1', 'yes', 'y', 'pass', 'r')) AS wide, count(*) AS n FROM o GROUP BY 1",
    "symbol_forms": "WITH p AS (SELECT DISTINCT upper(substr(p_brand, 1, 1)) || '.' || split_part(p_brand, '#', -1) AS raw FROM part) SELECT raw, replace(raw, '.', '-') AS us, raw AS kept, lpad(split_part(raw, '.', -1), 4, '0') AS code FROM p",
    "html_cells": "WITH c AS (SELECT page_id, trim(unnest(regexp_extract_all(html, '<(?:p|li|td)[^>]*>([^<]+)</', 1)), ' ') AS cell FROM pages) SELECT page_id, count(*) AS n_cells, max(length(cell))::INT AS longest FROM c WHERE cell <> '' GROUP BY 1",
    "class_control_medians": _P(" SELECT asset_class, round(median(vol20), 6) AS vol20, round(median(range20), 6) AS range20, round(median(log_dollar_volume20), 6) AS log_dollar_volume20 FROM panel GROUP BY 1"),
    "horizon_tail_summary": f"{_GRID} SELECT return_mode, horizon, round(avg(est), 8) AS mean, round(stddev_samp(est), 8) AS sd, sum(n)::BIGINT AS n_obs, round(min(p), 8) AS p_min, round(median(p), 8) AS p_median, round(max(p), 8) AS p_max FROM grid WHERE horizon >= 30 GROUP BY 1, 2",
    "metadata_join": "SELECT r_name AS sector, count(*) AS n, round(avg(s_acctbal), 6) AS mean_balance FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1",
    "parameter_grid": f"{_GRID}, q AS (SELECT unnest([0.6, 0.75, 0.9])::DOUBLE AS q0), m AS (SELECT DISTINCT return_mode, fold FROM grid) SELECT return_mode, q0, count(*) AS n FROM m, q GROUP BY 1, 2",
}
