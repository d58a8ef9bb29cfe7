"""Queries from bars to the panel."""

from __future__ import annotations

from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.config import SMALL, PanelConfig
from phasegrid.functions.protocol import canonical_hash
from phasegrid.operators import crosssection as xs
from phasegrid.operators import series
from phasegrid.oracles.base import bars_sql, features_sql, panel_sql, returns_sql
from phasegrid.sources.store import kept
from phasegrid.sources.tables import asset_and_market_bars, daily_bars, enough_history, index_close, table, write_panel

KEY = "p_brand"


def rounded(df: DataFrame, *exact: str, digits: int = 6) -> DataFrame:
    """df with doubles rounded, for comparison with SQL."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" and c not in exact else F.col(c) for c, t in df.dtypes))


def returns(spark: SparkSession, sf_dir: str, key: str = KEY, cfg: PanelConfig = SMALL) -> DataFrame:
    assets, market = asset_and_market_bars(spark, sf_dir, key)
    out = series.log_returns(assets).withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).filter(F.col("_n") >= cfg.min_rows).drop("_n")
    return series.rolling_beta(series.with_market(out, market), cfg)


def features(spark: SparkSession, sf_dir: str, key: str = KEY, cfg: PanelConfig = SMALL) -> DataFrame:
    return series.series_features(*asset_and_market_bars(spark, sf_dir, key), cfg)


def built_panel(spark: SparkSession, sf_dir: str, key: str = KEY, cfg: PanelConfig = SMALL) -> DataFrame:
    return series.phase_panel(features(spark, sf_dir, key, cfg), cfg)


def panel(spark: SparkSession, sf_dir: str, key: str = KEY, cfg: PanelConfig = SMALL) -> DataFrame:
    """The stored panel: built when first asked for, then read by mode and horizon."""
    return kept(spark, f"panel-{key}-{canonical_hash(asdict(cfg))[:12]}", panel_sources(sf_dir), lambda: built_panel(spark, sf_dir, key, cfg), write_panel)


def cells(spark: SparkSession, sf_dir: str, key: str = KEY, cfg: PanelConfig = SMALL) -> DataFrame:
    """The stored panel with percentiles and robust responses, stored, too."""
    made = lambda: xs.with_robust_response(xs.with_percentile(panel(spark, sf_dir, key, cfg)))
    return kept(spark, f"cells-{key}-{canonical_hash(asdict(cfg))[:12]}", panel_sources(sf_dir), made, write_panel)


def panel_sources(sf_dir: str) -> list[str]:
    return [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "part")]


def _bars(spark, d):
    return rounded(daily_bars(spark, d, KEY).drop("drift"))


def _market_bars(spark, d):
    return rounded(asset_and_market_bars(spark, d, KEY)[1].select("date", "close", "volume"))


def _history(spark, d):
    out = enough_history(index_close(daily_bars(spark, d, KEY)), 1000)
    return out.groupBy("ticker").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def _event_days(spark, d):
    """Daily bars of event values for each user."""
    e = table(spark, d, "events").select(F.col("user_id"), F.col("ts").cast("date").alias("date"), "value", F.struct("ts", "event_id").alias("seq"))
    return rounded(e.groupBy("user_id", "date").agg(F.min_by("value", "seq").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "seq").alias("close"), F.count("*").alias("n")))


QUERIES = {
    "bars_ohlcv": _bars,
    "market_bars": _market_bars,
    "bars_history_gate": _history,
    "event_day_bars": _event_days,
    "log_returns": lambda s, d: rounded(returns(s, d).select("ticker", "date", F.col("rn").cast("long").alias("rn"), "raw_r"), digits=10),
    "market_left_join": lambda s, d: rounded(returns(s, d).select("ticker", "date", "raw_r", "mkt_r"), digits=10),
    "rolling_beta": lambda s, d: rounded(returns(s, d).select("ticker", "date", "beta")),
    "residual_returns": lambda s, d: rounded(series.by_mode(returns(s, d)).select("ticker", "date", "return_mode", "r"), digits=9),
    "vol_normalized": lambda s, d: rounded(features(s, d).select("ticker", "return_mode", "date", "sigma", "z")),
    "spectral_bank": lambda s, d: rounded(features(s, d).select("ticker", "return_mode", "date", "psi_5", "psi_10", "psi_21")),
    "ewm_levels": lambda s, d: rounded(features(s, d).select("ticker", "return_mode", "date", "lam_5", "lam_10", "lam_21")),
    "controls": lambda s, d: rounded(features(s, d).filter("return_mode = 'raw'").select("ticker", "date", "vol20", "range20", "log_dollar_volume20")),
    "phase_panel": lambda s, d: rounded(built_panel(s, d).select("date", "ticker", "asset_class", "return_mode", "horizon", "psi_primary", "poisson_excess_primary", "past_state", "future_state", "phase_product", "phase_label")),
    "stride_sample": lambda s, d: rounded(panel(s, d, cfg=replace(SMALL, stride=5)).select("date", "ticker", "return_mode", "horizon", "psi_primary", "phase_product")),
    "phase_panel_types": lambda s, d: rounded(panel(s, d, "p_type").groupBy("ticker", "return_mode", "horizon").agg(F.count("*").alias("n"), F.avg("phase_product").alias("mean_product"), F.avg("phase_label").alias("share_m"), F.avg("vol20").alias("mean_vol20"))),
}

_W = "WITH RECURSIVE "


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


ORACLES = {
    "bars_ohlcv": f"{_W}{bars_sql(KEY)} SELECT ticker, date, {_r('open', 'high', 'low')}, round(trade_close, 6) AS close, {_r('volume')} FROM bars",
    "market_bars": f"{_W}{bars_sql(KEY)} SELECT date, {_r('close', 'volume')} FROM mbars",
    "bars_history_gate": f"{_W}{bars_sql(KEY)} SELECT ticker, count(*) AS n, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1 HAVING count(close) >= 1000",
    "event_day_bars": "SELECT user_id, ts::DATE AS date, round(arg_min(value, (ts, event_id)), 6) AS open, round(max(value), 6) AS high, round(min(value), 6) AS low, round(arg_max(value, (ts, event_id)), 6) AS close, count(*) AS n FROM events GROUP BY 1, 2",
    "log_returns": f"{_W}{returns_sql(KEY, SMALL)} SELECT ticker, date, rn, round(raw_r, 10) AS raw_r FROM ret",
    "market_left_join": f"{_W}{returns_sql(KEY, SMALL)} SELECT ticker, date, round(raw_r, 10) AS raw_r, round(mkt_r, 10) AS mkt_r FROM ret",
    "rolling_beta": f"{_W}{returns_sql(KEY, SMALL)} SELECT ticker, date, {_r('beta')} FROM ret",
    "residual_returns": f"{_W}{returns_sql(KEY, SMALL)} SELECT ticker, date, 'raw' AS return_mode, round(raw_r, 9) AS r FROM ret UNION ALL SELECT ticker, date, 'market_residual', round(raw_r - beta * mkt_r, 9) FROM ret",
    "vol_normalized": f"{_W}{features_sql(KEY, SMALL)} SELECT ticker, return_mode, date, {_r('sigma', 'z')} FROM feat",
    "spectral_bank": f"{_W}{features_sql(KEY, SMALL)} SELECT ticker, return_mode, date, {_r('psi_5', 'psi_10', 'psi_21')} FROM feat",
    "ewm_levels": f"{_W}{features_sql(KEY, SMALL)} SELECT ticker, return_mode, date, {_r('lam_5', 'lam_10', 'lam_21')} FROM feat",
    "controls": f"{_W}{features_sql(KEY, SMALL)} SELECT ticker, date, {_r('vol20', 'range20', 'log_dollar_volume20')} FROM feat WHERE return_mode = 'raw'",
    "phase_panel": f"{_W}{panel_sql(KEY, SMALL)} SELECT date, ticker, asset_class, return_mode, horizon, {_r('psi_primary', 'poisson_excess_primary', 'past_state', 'future_state', 'phase_product')}, phase_label FROM panel",
    "stride_sample": f"{_W}{panel_sql(KEY, replace(SMALL, stride=5))} SELECT date, ticker, return_mode, horizon, {_r('psi_primary', 'phase_product')} FROM panel",
    "phase_panel_types": f"{_W}{panel_sql('p_type', SMALL)} SELECT ticker, return_mode, horizon, count(*) AS n, round(avg(phase_product), 6) AS mean_product, round(avg(phase_label), 6) AS share_m, round(avg(vol20), 6) AS mean_vol20 FROM panel GROUP BY 1, 2, 3",
}
