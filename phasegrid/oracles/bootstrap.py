"""SQL for the block bootstrap: the same draws, as joins of starts and ends of blocks with running sums."""

from __future__ import annotations

from phasegrid.operators.inference import MIX, PRIME, STEP


def bootstrap_sql(source: str, keys: str, value: str, seed: str, reps: int, block: int | None, name: str = "bs") -> str:
    """CTEs up to `name`: (keys, estimate, ci_lo, ci_hi, p_two, p_gt0, p_lt0, n_dates) of source (keys, date, value)."""
    size = f"{max(1, block)}" if block is not None else "greatest(5, round(pow(n, 1.0 / 3.0)))"
    enough = f"n >= {max(10, 2 * block)}" if block is not None else "n >= 2"
    own = ", ".join(f"d.{k.strip()}" for k in keys.split(","))
    on = lambda t: " AND ".join(f"d.{k.strip()} = {t}.{k.strip()}" for k in keys.split(","))
    one = lambda c, x: f"CASE WHEN n = 1 THEN {x} ELSE {c} END" if block is None else c
    gt = "NULL::DOUBLE" if block is None else "p_gt0"
    return f""", {name}_s AS (SELECT {keys}, date, {value} AS v, row_number() OVER w AS i, sum({value}) OVER w AS c, ({seed})::BIGINT AS seed FROM {source} WHERE {value} IS NOT NULL WINDOW w AS (PARTITION BY {keys} ORDER BY date ROWS UNBOUNDED PRECEDING)),
{name}_0 AS (SELECT {keys}, avg(v) AS estimate, count(*) AS n, max(seed) AS seed FROM {name}_s GROUP BY {keys}),
{name}_1 AS (SELECT *, least(({size})::BIGINT, n) AS b FROM {name}_0),
{name}_2 AS (SELECT *, ceil(n / b)::BIGINT AS k FROM {name}_1),
{name}_c AS (SELECT {keys}, i, c FROM {name}_s UNION ALL SELECT {keys}, 0, 0.0::DOUBLE FROM {name}_0),
{name}_r AS (SELECT *, unnest(range({reps})) AS r FROM {name}_2 WHERE {enough}),
{name}_j AS (SELECT *, unnest(range(k)) AS j FROM {name}_r),
{name}_x AS (SELECT *, (seed + {STEP[0]} * (r + 1) + {STEP[1]} * (j + 1)) % {PRIME} AS x FROM {name}_j),
{name}_y AS (SELECT *, ((x * x) % {PRIME} * {MIX[0]} + x + {MIX[0]}) % {PRIME} AS y FROM {name}_x),
{name}_z AS (SELECT *, (((y * y) % {PRIME} * {MIX[1]} + y + {MIX[1]}) % {PRIME}) % (n - b + 1) AS at, CASE WHEN j = k - 1 THEN n - (k - 1) * b ELSE b END AS len FROM {name}_y),
{name}_m AS (SELECT {own}, d.r, sum(e.c - s.c) / max(d.n) AS m FROM {name}_z d JOIN {name}_c s ON {on('s')} AND s.i = d.at JOIN {name}_c e ON {on('e')} AND e.i = d.at + d.len GROUP BY {own}, d.r),
{name}_q AS (SELECT {keys}, quantile_cont(m, 0.025::DOUBLE) AS ci_lo, quantile_cont(m, 0.975::DOUBLE) AS ci_hi, (1 + count(*) FILTER (m <= 0)) / {reps + 1}.0 AS p_gt0, (1 + count(*) FILTER (m >= 0)) / {reps + 1}.0 AS p_lt0 FROM {name}_m GROUP BY {keys}),
{name} AS (SELECT {own}, estimate, {one('ci_lo', 'estimate')} AS ci_lo, {one('ci_hi', 'estimate')} AS ci_hi, least(1.0::DOUBLE, 2 * least({gt}, p_lt0)) * CASE WHEN {gt} IS NOT NULL THEN 1 END AS p_two, {gt} AS p_gt0,
  {one('p_lt0', 'CASE WHEN estimate >= 0 THEN 1.0 ELSE 0.5 END')}::DOUBLE AS p_lt0, n AS n_dates FROM {name}_0 d LEFT JOIN {name}_q q ON {on('q')})"""
