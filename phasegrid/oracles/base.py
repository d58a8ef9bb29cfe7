"""SQL for the panel, written from its definitions: recursive steps for the exponentially weighted means, frames for the rest."""

from __future__ import annotations

import math

from phasegrid.config import PanelConfig


def _bars(name: str, key: str, source: str) -> str:
    order = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)"
    return f"""{name}_0 AS (SELECT {key} AS ticker, l_shipdate::DATE AS date, arg_min(l_extendedprice / l_quantity, {order}) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {order}) AS trade_close, sum(l_quantity) AS volume, avg(l_discount) - 0.05 AS drift FROM {source} GROUP BY 1, 2),
{name} AS (SELECT ticker, date, open, high, low, trade_close, volume, exp(sum(drift) OVER (PARTITION BY ticker ORDER BY date ROWS UNBOUNDED PRECEDING)) AS close FROM {name}_0)"""


def bars_sql(key: str) -> str:
    source = "lineitem JOIN part ON l_partkey = p_partkey" if key.startswith("p_") else "lineitem"
    return _bars("bars", f"{key}::VARCHAR", source) + ",\n" + _bars("mbars", "'__MKT__'", "lineitem")


def returns_sql(key: str, cfg: PanelConfig) -> str:
    b, m = cfg.beta_window - 1, cfg.beta_min
    return f"""{bars_sql(key)},
ret_0 AS (SELECT *, row_number() OVER w AS rn, ln(close) - lag(ln(close)) OVER w AS raw_r, count(*) OVER (PARTITION BY ticker) AS n_rows FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
mret AS (SELECT date, ln(close) - lag(ln(close)) OVER (ORDER BY date) AS mkt_r FROM mbars),
ret_1 AS (SELECT r.*, m.mkt_r FROM ret_0 r LEFT JOIN mret m USING (date) WHERE n_rows >= {cfg.min_rows}),
ret_2 AS (SELECT *, CASE WHEN count(raw_r * mkt_r) OVER w >= {m} AND count(mkt_r) OVER w >= {m} THEN covar_samp(raw_r, mkt_r) OVER w / nullif(var_pop(mkt_r) OVER w, 0) END AS b0
  FROM ret_1 WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN {b} PRECEDING AND CURRENT ROW)),
ret AS (SELECT *, lag(b0) OVER (PARTITION BY ticker ORDER BY date) AS beta FROM ret_2)"""


def features_sql(key: str, cfg: PanelConfig) -> str:
    """CTEs up to feat: (ticker, return_mode, date, rn, r, sigma, z, lam_s, psi_s, controls)."""
    a, spans, w = 2.0 / (cfg.vol_span + 1.0), cfg.horizons, cfg.spectral_window - 1
    lam = ", ".join(f"CASE WHEN k >= {s} THEN m{s} END AS lam_{s}" for s in spans)
    start = ", ".join(f"x AS m{s}" for s in spans)
    step = ", ".join(f"{2.0 / (s + 1.0)!r} * d.x + {1 - 2.0 / (s + 1.0)!r} * e.m{s}" for s in spans)
    psi = ",\n  ".join(f"{(s - 1.0) / (s + 1.0) / (1.0 - (s - 1.0) / (s + 1.0))!r} * CASE WHEN count(z * lam_{s}) OVER w >= {cfg.spectral_min} THEN covar_samp(z, lam_{s}) OVER w END / nullif(CASE WHEN count(z) OVER w >= {cfg.spectral_min} THEN var_pop(z) OVER w END, 0) AS psi_{s}" for s in spans)
    return f"""{returns_sql(key, cfg)},
ctl AS (SELECT *, CASE WHEN count(raw_r) OVER w >= 15 THEN stddev_pop(raw_r) OVER w END * {math.sqrt(252.0)!r} AS vol20,
  CASE WHEN count(ln(high / low)) OVER w >= 15 THEN avg(ln(high / low)) OVER w END AS range20, CASE WHEN count(ln(close * volume)) OVER w >= 15 THEN avg(ln(close * volume)) OVER w END AS log_dollar_volume20
  FROM ret WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
modal AS (SELECT *, 'raw' AS return_mode, raw_r AS r FROM ctl UNION ALL SELECT *, 'market_residual', raw_r - beta * mkt_r FROM ctl),
d1 AS MATERIALIZED (SELECT ticker, return_mode, date, r AS x, row_number() OVER (PARTITION BY ticker, return_mode ORDER BY date) AS k FROM modal WHERE r IS NOT NULL),
e1 AS (SELECT ticker, return_mode, date, k, x AS m, 0.0::DOUBLE AS c, 1.0::DOUBLE AS s2 FROM d1 WHERE k = 1
  UNION ALL SELECT d.ticker, d.return_mode, d.date, d.k, e.m + {a!r} * (d.x - e.m), {1 - a!r} * (e.c + {a!r} * (d.x - e.m) * (d.x - e.m)), {(1 - a) ** 2!r} * e.s2 + {a * a!r}
  FROM e1 e JOIN d1 d ON d.ticker = e.ticker AND d.return_mode = e.return_mode AND d.k = e.k + 1),
sg AS (SELECT ticker, return_mode, date, CASE WHEN k >= {cfg.vol_span} AND s2 < 1 THEN sqrt(c / (1 - s2)) END AS sd FROM e1),
z0 AS (SELECT m.*, lag(sg.sd) OVER (PARTITION BY m.ticker, m.return_mode ORDER BY m.date) AS sigma FROM modal m LEFT JOIN sg USING (ticker, return_mode, date)),
z1 AS (SELECT *, r / nullif(sigma, 0) AS zz FROM z0),
z2 AS (SELECT *, CASE WHEN count(zz) OVER w >= {cfg.demean_min} THEN avg(zz) OVER w END AS mu0 FROM z1 WINDOW w AS (PARTITION BY ticker, return_mode ORDER BY date ROWS BETWEEN {cfg.demean - 1} PRECEDING AND CURRENT ROW)),
z3 AS (SELECT *, zz - lag(mu0) OVER (PARTITION BY ticker, return_mode ORDER BY date) AS zd FROM z2),
zs AS (SELECT *, CASE WHEN zd IS NOT NULL THEN greatest(least(zd, {cfg.z_clip!r}), {-cfg.z_clip!r}) END AS z FROM z3),
d2 AS MATERIALIZED (SELECT ticker, return_mode, date, z AS x, row_number() OVER (PARTITION BY ticker, return_mode ORDER BY date) AS k FROM zs WHERE z IS NOT NULL),
e2 AS (SELECT ticker, return_mode, date, k, {start} FROM d2 WHERE k = 1
  UNION ALL SELECT d.ticker, d.return_mode, d.date, d.k, {step} FROM e2 e JOIN d2 d ON d.ticker = e.ticker AND d.return_mode = e.return_mode AND d.k = e.k + 1),
lam AS (SELECT ticker, return_mode, date, {lam} FROM e2),
f0 AS (SELECT zs.*, {', '.join(f'lag(lam.lam_{s}) OVER (PARTITION BY zs.ticker, zs.return_mode ORDER BY zs.date) AS lam_{s}' for s in spans)} FROM zs LEFT JOIN lam USING (ticker, return_mode, date)),
feat AS (SELECT *,
  {psi}
  FROM f0 WINDOW w AS (PARTITION BY ticker, return_mode ORDER BY date ROWS BETWEEN {w} PRECEDING AND CURRENT ROW))"""


def panel_sql(key: str, cfg: PanelConfig) -> str:
    """CTEs up to panel."""
    each = []
    for h in cfg.horizons:
        w = "(PARTITION BY ticker, return_mode ORDER BY date"
        past = f"CASE WHEN count(z) OVER {w} ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) = {h} THEN sum(z) OVER {w} ROWS BETWEEN {h - 1} PRECEDING AND CURRENT ROW) END / {math.sqrt(h)!r}"
        ahead = f"CASE WHEN rn >= {h} AND count(z) OVER {w} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} THEN sum(z) OVER {w} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END / {math.sqrt(h)!r}"
        each.append(f"SELECT date, ticker, return_mode, rn, {', '.join(f'psi_{s}' for s in cfg.horizons)}, vol20, range20, log_dollar_volume20, {h}::INT AS horizon, psi_{h} AS psi_primary, {past} AS past_state, {ahead} AS future_state FROM feat")
    return f"""{features_sql(key, cfg)},
panel_0 AS ({' UNION ALL '.join(each)}),
panel AS MATERIALIZED (SELECT * EXCLUDE (rn), past_state * future_state AS phase_product, 2.0 * psi_primary AS poisson_excess_primary, CASE WHEN past_state * future_state > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS phase_label,
  'C' || substr(regexp_replace(ticker, '[^0-9]', '', 'g'), 1, 1) AS asset_class FROM panel_0 WHERE (rn - 1) % {cfg.stride} = 0 AND psi_primary IS NOT NULL AND past_state * future_state IS NOT NULL)"""


def with_panel(key: str, cfg: PanelConfig, rest: str) -> str:
    return f"WITH RECURSIVE {panel_sql(key, cfg)}{rest}"
