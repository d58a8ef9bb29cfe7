"""Queries on multiplicity, regimes, onsets, certification, metrics, resampling and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.config import ANCHOR, COARSE_GRID, SEED, SMALL
from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators import models, splits
from phasegrid.oracles.base import with_panel
from phasegrid.oracles.bootstrap import bootstrap_sql
from phasegrid.plans.certification import GRID_SQL, grid
from phasegrid.plans.crosssection import _BIN, _Q, _ROBUST, _edges
from phasegrid.plans.panels import KEY, cells, panel, rounded
from phasegrid.sources.tables import table

GRID, _GRID = COARSE_GRID, GRID_SQL


_FAMILY = ("return_mode", "fold")


def _flags(s, d):
    """By mode and horizon: whether any fold certifies R, and whether most certify M."""
    r = inf.regimes_of_all_folds(grid(s, d), 1, 0.25)
    return r.withColumns({"is_r": F.col("r_support") >= F.col("required"), "is_m": F.col("m_support") >= 3})


_REG = f"""{_GRID}, rg0 AS (SELECT return_mode, horizon, count(DISTINCT fold) AS folds_total, count(*) FILTER (certified AND phase = 'R') AS r_support, count(*) FILTER (certified AND phase = 'M') AS m_support, count(*) FILTER (n_roots = 0) AS root_free FROM grid GROUP BY 1, 2)"""


def _reg(least: int, frac: float) -> str:
    return f"""{_REG}, rg AS (SELECT *, greatest({least}, ceil({frac} * folds_total))::BIGINT AS required FROM rg0),
regimes AS (SELECT *, CASE WHEN r_support >= required AND m_support >= required THEN 'CONFLICT' WHEN r_support >= required THEN 'R' WHEN m_support >= required THEN 'M' ELSE 'UNRESOLVED' END AS regime FROM rg)"""


_FLAGS = _reg(1, 0.25) + ", fl AS (SELECT *, r_support >= required AS is_r, m_support >= 3 AS is_m FROM regimes)"


def _gate(s, d):
    g = grid(s, d)
    a = g.filter(F.col("horizon") == ANCHOR).select("return_mode", "fold", (F.col("certified") | (F.col("fold") == 1)).alias("certified_r"))
    return inf.fixed_sequence_gate(g, a, ANCHOR, 0.6).select("return_mode", "fold", "horizon", "gate_active", "gate_pass")


def _onsets(s, d):
    return inf.tail_onset(_flags(s, d), ("return_mode",), list(GRID), "is_r", 2, 0.4)


def _select(s, d):
    """By share of R folds asked for: consensus in two halves of the folds, then the nearest pair, the lowest share first."""
    g = grid(s, d)
    out = None
    for q in (0.25, 0.5):
        both = []
        for half in (0, 1):
            r = inf.regimes_of_all_folds(g.filter(F.col("fold") % 2 == half), 1, q).withColumn("f", F.col("r_support") >= F.col("required")).withColumn("q0", F.lit(q))
            both.append(inf.consensus_onset(inf.tail_onset(r, ("return_mode", "q0"), list(GRID), "f", 1, 0.3), ("q0",), 2).withColumnRenamed("hc_grid", f"hc_{half}").drop("identified"))
        c = both[0].join(both[1], "q0")
        out = c if out is None else out.unionByName(c)
    out = out.filter("hc_0 IS NOT NULL AND hc_1 IS NOT NULL").withColumn("delta", F.abs(F.col("hc_0") - F.col("hc_1")))
    return out.orderBy("delta", "q0").limit(1)


def _select_sql() -> str:
    parts = []
    for q in (0.25, 0.5):
        for h in (0, 1):
            parts.append(f"""o{h}_{int(q * 100)} AS (SELECT return_mode, min(horizon) AS hc FROM (SELECT return_mode, horizon, f, avg(f::INT) OVER (PARTITION BY return_mode ORDER BY horizon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS tail FROM
  (SELECT return_mode, horizon, count(*) FILTER (certified AND phase = 'R') >= greatest(1, ceil({q} * count(DISTINCT fold))) AS f FROM grid WHERE fold % 2 = {h} GROUP BY 1, 2)) WHERE f AND tail >= 0.3 GROUP BY 1)""")
    union = " UNION ALL ".join(f"SELECT {q}::DOUBLE AS q0, (SELECT CASE WHEN count(*) >= 2 THEN max(hc) END FROM o0_{int(q * 100)}) AS hc_0, (SELECT CASE WHEN count(*) >= 2 THEN max(hc) END FROM o1_{int(q * 100)}) AS hc_1" for q in (0.25, 0.5))
    return f"{_GRID}, {', '.join(parts)}, u AS ({union}) SELECT q0, hc_0, hc_1, abs(hc_0 - hc_1) AS delta FROM u WHERE hc_0 IS NOT NULL AND hc_1 IS NOT NULL ORDER BY delta, q0 LIMIT 1"


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows with a score: the share of momentum in their psi bin (10) among earlier ones."""
    p, keys = panel(spark, sf_dir), ("return_mode", "horizon")
    early = p.filter(F.col("date") < "1999-01-01")
    edges = xs.bin_edges(early, "psi_primary", 10, keys)
    share = xs.with_bin(early, edges, "psi_primary", keys).groupBy(*keys, "bin").agg(F.avg("phase_label").alias("score"))
    late = xs.with_bin(p.filter(F.col("date") >= "1999-01-01"), edges, "psi_primary", keys)
    return xs.with_date_weight(late.join(F.broadcast(share), [*keys, "bin"]))


_SCORED = f"""{_edges(10, 'return_mode, horizon', "date < DATE '1999-01-01'")}, pb AS (SELECT p.*, {_BIN} FROM panel p JOIN edges USING (return_mode, horizon)),
sh AS (SELECT return_mode, horizon, bin, avg(phase_label) AS score FROM pb WHERE date < DATE '1999-01-01' GROUP BY 1, 2, 3),
s0 AS (SELECT pb.*, score, 1.0::DOUBLE / count(*) OVER (PARTITION BY return_mode, horizon, date) AS w0 FROM pb JOIN sh USING (return_mode, horizon, bin) WHERE date >= DATE '1999-01-01'),
sc AS (SELECT *, w0 / avg(w0) OVER (PARTITION BY return_mode, horizon) AS weight FROM s0)"""


def _metrics(s, d):
    return rounded(inf.score_metrics(scored(s, d), ("return_mode", "horizon"), "score", "phase_label", "weight"))


def _datewise(s, d):
    """By day the Brier scores of the binned score and of a constant half."""
    e = scored(s, d)
    g = e.groupBy("return_mode", "horizon", "date").agg(F.avg((F.col("score") - F.col("phase_label")) ** 2 - 0.25).alias("delta_brier"), F.count("*").alias("n"), F.avg("phase_label").alias("rate"))
    g = g.filter("rate > 0 AND rate < 1")
    return rounded(g.groupBy("return_mode", "horizon").agg(F.avg("delta_brier").alias("mean_delta"), F.count("*").alias("n_dates")))


def _tail_days(s, d):
    c = xs.banded(cells(s, d), [0.85, (0.85 + 1.0) / 2.0, 1.0])
    return xs.daily_means(c, "phase_product_robust", ("return_mode", "horizon", "band"))


def _certified_tails(s, d):
    """The robust tail rule without intervals: an estimate below -0.02 standard deviations of training days in both bands, by expanding fold."""
    p = cells(s, d)
    f = F.broadcast(splits.expanding_folds(p).select(F.col("return_mode").alias("_m"), "fold", "train_end", "test_start", "test_end"))
    days = xs.daily_means(xs.banded(p, [0.85, (0.85 + 1.0) / 2.0, 1.0]), "phase_product_robust", ("return_mode", "horizon", "band"))
    both = days.join(f, (F.col("return_mode") == F.col("_m")) & (F.col("date") <= F.col("test_end"))).withColumn("train", F.col("date") <= F.col("train_end"))
    g = both.groupBy("return_mode", "fold", "horizon", "band").agg(F.avg(F.when(~F.col("train"), F.col("day_mean"))).alias("estimate"), F.stddev_samp(F.when(F.col("train"), F.col("day_mean"))).alias("train_sd"), F.count_if(~F.col("train")).alias("n_dates"), F.sum(F.when(~F.col("train"), F.col("rows"))).alias("n_rows"))
    g = g.withColumns({"epsilon": 0.02 * F.col("train_sd"), "eligible": (F.col("n_dates") >= 20) & (F.col("n_rows") >= 20)})
    return rounded(g.withColumn("negative", F.col("estimate") < -F.col("epsilon")).drop("train_sd"))


def _boot(block):
    def run(s, d):
        seed = F.lit(SEED) + 1000 * F.col("horizon") + 10 * F.col("band")
        return inf.bootstrap(_tail_days(s, d), ("return_mode", "horizon", "band"), "day_mean", 200, seed, block)

    return run


def _clusters(s, d):
    """Crossings of each expanding fold's test curve, clustered over folds."""
    c = cells(s, d)
    rows = splits.fold_rows(c, splits.walkforward_folds(c), 0).filter("part = 'test'")
    n = F.greatest(F.ceil(F.round(F.col("q_psi") * 20, 9)) - 1, F.lit(0)).cast("int")
    curve = rows.withColumn("bin", n).groupBy("return_mode", "fold", "horizon", "bin").agg(F.avg("phase_product").alias("mean")).withColumn("q", (F.col("bin") + 0.5) / 20.0)
    roots = xs.zero_crossings(curve, "q", "mean", ("return_mode", "fold", "horizon")).select("return_mode", "fold", "horizon", "direction", "root", F.col("root").alias("root_quantile"))
    return inf.cluster_roots(roots)


QUERIES = {
    "holm_adjusted": lambda s, d: rounded(inf.holm_adjusted(grid(s, d), _FAMILY).select("return_mode", "fold", "horizon", "p_holm"), digits=8),
    "holm_stepdown": lambda s, d: inf.holm_stepdown(grid(s, d), _FAMILY, alpha=0.9).select("return_mode", "fold", "horizon", "passes"),
    "holm_null_as_one": lambda s, d: rounded(inf.holm_null_as_one(grid(s, d), _FAMILY).select("return_mode", "fold", "horizon", "p_holm"), digits=8),
    "regimes_total": lambda s, d: inf.regimes_of_all_folds(grid(s, d), 2, 0.5),
    "regimes_eligible": lambda s, d: rounded(inf.regimes_of_eligible_folds(grid(s, d), 1, 0.3)),
    "modal_phase": lambda s, d: inf.modal_phase(grid(s, d)),
    "onset_persistent": lambda s, d: rounded(inf.persistent_onset(_flags(s, d), ("return_mode",), run=2, tail=0.4)),
    "onset_tail_fraction": _onsets,
    "consensus_onset": lambda s, d: inf.consensus_onset(_onsets(s, d).withColumn("scope", F.lit("all")), ("scope",), 2),
    "fixed_sequence_gate": _gate,
    "flag_runs": lambda s, d: inf.runs(_flags(s, d), ("return_mode",), "is_r"),
    "tail_guard": lambda s, d: rounded(inf.tail_guard(inf.regimes_of_all_folds(grid(s, d), 1, 0.25), ("return_mode",), 30)),
    "intersection_union_p": lambda s, d: rounded(grid(s, d).groupBy("return_mode", "horizon").agg(F.when(F.count("p") == F.count("*"), F.max("p")).alias("p_iut"), F.median("p").alias("p_median"), F.min("p").alias("p_min")), digits=8),
    "select_candidate": _select,
    "weighted_auc_brier": _metrics,
    "spearman_ranks": lambda s, d: rounded(inf.spearman(panel(s, d), ("return_mode", "horizon"), "psi_primary", "phase_product")),
    "datewise_pair_delta": _datewise,
    "tail_cert_estimates": _certified_tails,
    "bootstrap_ci_a": lambda s, d: rounded(_boot(21)(s, d)),
    "bootstrap_ci_b": lambda s, d: rounded(_boot(None)(s, d)),
    "root_clusters": _clusters,
    "logistic_designs": lambda s, d: models.logistic_designs(panel(s, d)),
}

_FAM = "PARTITION BY return_mode, fold"
_UP = f"({_FAM} ORDER BY p NULLS LAST, horizon)"
_P = lambda rest: with_panel(KEY, SMALL, rest)
_GATE = f"""{_GRID}, a AS (SELECT return_mode, fold, certified OR fold = 1 AS anchor FROM grid WHERE horizon = {ANCHOR}),
o AS (SELECT g.*, coalesce(anchor, false) AS anchor, CASE WHEN horizon = {ANCHOR} THEN coalesce(anchor, false) ELSE coalesce(eligible AND certified AND phase = 'R' AND p <= 0.6, false) END AS own FROM grid g LEFT JOIN a USING (return_mode, fold)),
b AS (SELECT *, coalesce(bool_and(own) OVER ({_FAM} ORDER BY horizon DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AND anchor AS gate_active FROM o)"""
_TAIL = "(PARTITION BY return_mode ORDER BY horizon ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
_NEXT = "(PARTITION BY return_mode ORDER BY horizon ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)"
_ONSET = f"""{_FLAGS}, f1 AS (SELECT *, bool_and(is_r) OVER {_NEXT} AND count(*) OVER {_NEXT} = 2 AS run, avg(is_r::INT) OVER {_TAIL} AS tail_fraction, bool_or(is_m) OVER {_TAIL} AS any_m, lag(horizon) OVER (PARTITION BY return_mode ORDER BY horizon) AS lo FROM fl)"""
_TON = f"{_ONSET}, onset AS (SELECT return_mode, min(horizon) FILTER (run AND tail_fraction >= 0.4) AS hc_grid FROM f1 GROUP BY 1)"

_TAILS = f"""{_ROBUST}, td AS (SELECT return_mode, horizon, CASE WHEN q_psi < 0.925::DOUBLE THEN 0 ELSE 1 END AS band, date, avg(phase_product_robust) AS m FROM cells WHERE q_psi >= 0.85::DOUBLE GROUP BY 1, 2, 3, 4)"""


def _boot_sql(block: int | None) -> str:
    columns = ", ".join(f"round({c}, 6) AS {c}" for c in ("estimate", "ci_lo", "ci_hi", "p_two", "p_gt0", "p_lt0"))
    return _P(f"{_TAILS}{bootstrap_sql('td', 'return_mode, horizon, band', 'm', f'{SEED} + 1000 * horizon + 10 * band', 200, block)} SELECT return_mode, horizon, band, {columns}, n_dates FROM bs")


ORACLES = {
    "bootstrap_ci_a": _boot_sql(21),
    "bootstrap_ci_b": _boot_sql(None),
    "holm_adjusted": f"{_GRID}, a AS (SELECT *, (count(p) OVER ({_FAM}) - row_number() OVER {_UP} + 1) * p AS a FROM grid) SELECT return_mode, fold, horizon, CASE WHEN p IS NOT NULL THEN round(least(1.0, max(a) OVER ({_FAM} ORDER BY p NULLS LAST, horizon ROWS UNBOUNDED PRECEDING)), 8) END AS p_holm FROM a",
    "holm_stepdown": f"{_GRID}, a AS (SELECT *, coalesce(p <= 0.9::DOUBLE / (count(*) OVER ({_FAM}) - row_number() OVER {_UP} + 1), false) AS ok FROM grid) SELECT return_mode, fold, horizon, bool_and(ok) OVER ({_FAM} ORDER BY p NULLS LAST, horizon ROWS UNBOUNDED PRECEDING) AS passes FROM a",
    "holm_null_as_one": f"{_GRID}, q AS (SELECT * REPLACE (coalesce(p, 1.0::DOUBLE) AS p) FROM grid), a AS (SELECT *, (count(p) OVER ({_FAM}) - row_number() OVER {_UP} + 1) * p AS a FROM q) SELECT return_mode, fold, horizon, round(least(1.0, max(a) OVER ({_FAM} ORDER BY p, horizon ROWS UNBOUNDED PRECEDING)), 8) AS p_holm FROM a",
    "regimes_total": f"{_reg(2, 0.5)} SELECT * FROM regimes",
    "regimes_eligible": f"{_GRID}, a AS (SELECT return_mode, horizon, count(*) FILTER (eligible) AS eligible_folds, count(*) FILTER (certified AND phase = 'R') AS certified_folds FROM grid GROUP BY 1, 2) SELECT return_mode, horizon, eligible_folds, certified_folds, round(certified_folds / greatest(1, eligible_folds), 6) AS support_fraction, certified_folds >= 1 AND certified_folds / greatest(1, eligible_folds) >= 0.3 AS certified_tail FROM a",
    "modal_phase": f"{_GRID}, a AS (SELECT return_mode, horizon, phase, count(*) AS support FROM grid WHERE certified GROUP BY 1, 2, 3) SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY return_mode, horizon ORDER BY support DESC, phase) = 1",
    "onset_persistent": f"{_ONSET}, h AS (SELECT * FROM f1 WHERE run AND NOT any_m AND tail_fraction + 1e-15 >= 0.4 QUALIFY row_number() OVER (PARTITION BY return_mode ORDER BY horizon) = 1) SELECT return_mode, horizon AS hc_grid, lo AS hc_lower_exclusive, round(tail_fraction, 6) AS tail_fraction, tail_fraction = 1 AS strict_tail FROM h",
    "onset_tail_fraction": f"{_TON} SELECT return_mode, hc_grid IS NOT NULL AS identified, hc_grid FROM onset",
    "consensus_onset": f"{_TON} SELECT 'all' AS scope, count(hc_grid) >= 2 AS identified, CASE WHEN count(hc_grid) >= 2 THEN max(hc_grid) END AS hc_grid FROM onset",
    "fixed_sequence_gate": f"{_GATE} SELECT return_mode, fold, horizon, gate_active, gate_active AND own AS gate_pass FROM b",
    "flag_runs": f"{_FLAGS}, i AS (SELECT *, row_number() OVER (PARTITION BY return_mode ORDER BY horizon) AS i FROM fl), j AS (SELECT *, i - row_number() OVER (PARTITION BY return_mode ORDER BY horizon) AS grp FROM i WHERE is_r) SELECT return_mode, min(horizon) AS run_start, max(horizon) AS run_end, count(*) AS n FROM j GROUP BY return_mode, grp",
    "tail_guard": f"{_reg(1, 0.25)}, t AS (SELECT return_mode, avg((regime = 'R')::INT) AS r_fraction, count(*) FILTER (regime = 'M') AS n_m, arg_max(regime, horizon) AS last FROM regimes WHERE horizon >= 30 GROUP BY 1) SELECT return_mode, round(r_fraction, 6) AS r_fraction, n_m, last, r_fraction >= 0.8 AND n_m = 0 AND last = 'R' AS passes FROM t",
    "intersection_union_p": f"{_GRID} SELECT return_mode, horizon, CASE WHEN count(p) = count(*) THEN round(max(p), 8) END AS p_iut, round(median(p), 8) AS p_median, round(min(p), 8) AS p_min FROM grid GROUP BY 1, 2",
    "select_candidate": _select_sql(),
    "weighted_auc_brier": _P(f"""{_SCORED}, e AS (SELECT return_mode, horizon, score, sum(CASE WHEN phase_label > 0.5 THEN weight ELSE 0 END) AS pw, sum(CASE WHEN phase_label > 0.5 THEN 0 ELSE weight END) AS nw FROM sc GROUP BY 1, 2, 3),
ez AS (SELECT *, coalesce(sum(nw) OVER (PARTITION BY return_mode, horizon ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM e), au AS (SELECT return_mode, horizon, sum(pw * (b + 0.5 * nw)) / (sum(pw) * sum(nw)) AS auc FROM ez GROUP BY 1, 2),
m AS (SELECT return_mode, horizon, sum(weight * (score - phase_label) * (score - phase_label)) / sum(weight) AS brier, sum(weight * phase_label) / sum(weight) AS base_rate, -sum(weight * (phase_label * ln(greatest(least(score, 1 - 1e-6), 1e-6)) + (1 - phase_label) * ln(1 - greatest(least(score, 1 - 1e-6), 1e-6)))) / sum(weight) AS log_loss, count(*) AS n FROM sc GROUP BY 1, 2)
SELECT return_mode, horizon, round(brier, 6) AS brier, round(base_rate, 6) AS base_rate, round(log_loss, 6) AS log_loss, n, round(base_rate * (1 - base_rate), 6) AS base_brier, round(1 - brier / (base_rate * (1 - base_rate)), 6) AS skill, round(auc, 6) AS auc FROM m JOIN au USING (return_mode, horizon)"""),
    "spearman_ranks": _P(", r AS (SELECT return_mode, horizon, rank() OVER (PARTITION BY return_mode, horizon ORDER BY psi_primary) + (count(*) OVER (PARTITION BY return_mode, horizon, psi_primary) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY return_mode, horizon ORDER BY phase_product) + (count(*) OVER (PARTITION BY return_mode, horizon, phase_product) - 1) / 2.0::DOUBLE AS ry FROM panel) SELECT return_mode, horizon, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r GROUP BY 1, 2"),
    "datewise_pair_delta": _P(f"{_SCORED}, g AS (SELECT return_mode, horizon, date, avg((score - phase_label) * (score - phase_label) - 0.25) AS db, avg(phase_label) AS rate FROM sc GROUP BY 1, 2, 3) SELECT return_mode, horizon, round(avg(db), 6) AS mean_delta, count(*) AS n_dates FROM g WHERE rate > 0 AND rate < 1 GROUP BY 1, 2"),
    "tail_cert_estimates": _P(f"""{_ROBUST}, dd AS (SELECT return_mode, date, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY return_mode) AS n, lag(date) OVER w AS before FROM (SELECT DISTINCT return_mode, date FROM panel) WINDOW w AS (PARTITION BY return_mode ORDER BY date)),
e AS (SELECT *, i - n // 2 AS k, (n - n // 2) // 4 AS sz, (n - n // 2) % 4 AS more FROM dd WHERE n >= 10),
f AS (SELECT *, (CASE WHEN k < more * (sz + 1) THEN k // (sz + 1) ELSE more + (k - more * (sz + 1)) // sz END + 1)::INT AS fold FROM e WHERE k >= 0),
ef AS (SELECT return_mode, fold, arg_min(before, date) AS train_end, max(date) AS test_end FROM f GROUP BY 1, 2),
dm AS (SELECT return_mode, horizon, CASE WHEN q_psi < 0.925::DOUBLE THEN 0 ELSE 1 END AS band, date, avg(phase_product_robust) AS m, count(*) AS k FROM cells WHERE q_psi >= 0.85::DOUBLE GROUP BY 1, 2, 3, 4),
g AS (SELECT dm.return_mode, fold, horizon, band, avg(m) FILTER (date > train_end) AS estimate, stddev_samp(m) FILTER (date <= train_end) AS sd, count(*) FILTER (date > train_end) AS n_dates, (sum(k) FILTER (date > train_end))::BIGINT AS n_rows FROM dm JOIN ef ON dm.return_mode = ef.return_mode AND date <= test_end GROUP BY 1, 2, 3, 4)
SELECT return_mode, fold, horizon, band, round(estimate, 6) AS estimate, n_dates, n_rows, round(0.02 * sd, 6) AS epsilon, n_dates >= 20 AND n_rows >= 20 AS eligible, estimate < -0.02 * sd AS negative FROM g"""),
}
