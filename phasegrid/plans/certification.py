"""Queries on certified tails: bands, folds, regimes, onsets, consensus, audits; and summaries of curves over folds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from phasegrid.config import ANCHOR, COARSE_GRID, FINE_GRID, SEED, SMALL, TAILS
from phasegrid.operators import certification as cert
from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators import splits
from phasegrid.oracles.base import with_panel
from phasegrid.oracles.bootstrap import bootstrap_sql
from phasegrid.plans.crosssection import _Q, _ROBUST
from phasegrid.plans.panels import KEY, cells, panel, panel_sources, rounded
from phasegrid.plans.splits import _WF
from phasegrid.sources.store import kept

Q0, REPS, ALPHA = 0.6, 500, 0.05
GATES = {"rows": 250, "dates": 40}
RUN, TAIL, MIN_FOLDS, MIN_FRACTION = 3, 0.8, 3, 0.75


def bands(s, d):
    return cert.tail_bands(cells(s, d, KEY, TAILS), Q0, SEED, REPS, **GATES)


def folds(s, d):
    """The stored folds of certified tails: some rows a mode, fold and horizon."""
    made = lambda: cert.certified_folds(bands(s, d), ALPHA)
    return kept(s, "tail-folds", panel_sources(d), made, lambda df, path: df.coalesce(1).write.parquet(path))


def grid(s, d):
    """(return_mode, fold, horizon, est, n, eligible, p, phase, certified, n_roots) of the folds: the inner band's mean, both bands' rows, the mean's sign, and whether the bands' signs differ."""
    b = lambda i, c: F.get("bands", F.lit(i))[c]
    return folds(s, d).select(*cert.FOLD, b(0, "estimate").alias("est"), F.aggregate("bands", F.lit(0).cast("long"), lambda n, x: n + x["n_test_rows"]).alias("n"), "eligible", F.round("p", 10).alias("p"), F.when(b(0, "estimate") < 0, "R").otherwise("M").alias("phase"), "certified", F.when(b(0, "estimate") * b(1, "estimate") < 0, 1).otherwise(0).cast("long").alias("n_roots"))


def _regimes(s, d):
    return cert.regimes(folds(s, d), MIN_FOLDS, MIN_FRACTION)


def _onsets(s, d):
    return inf.tail_onset(_regimes(s, d).filter(F.col("horizon").isin(*COARSE_GRID)), ("return_mode",), list(COARSE_GRID), "certified_tail", RUN, TAIL)


def gated(s, d):
    """Fine horizons of each fold, tested downwards from the anchor, which inherits its coarse result."""
    local = grid(s, d)
    anchors = local.filter(F.col("horizon") == ANCHOR).select("return_mode", "fold", (F.col("certified") & (F.col("phase") == "R")).alias("certified_r"))
    fine = local.filter(F.col("horizon").isin(*FINE_GRID)).withColumn("certified", F.col("eligible") & (F.col("phase") == "R") & (F.col("n_roots") == 0))
    return inf.fixed_sequence_gate(fine, anchors, ANCHOR, ALPHA)


def _fine_regimes(s, d):
    return inf.fixed_sequence_regimes(gated(s, d), MIN_FOLDS, MIN_FRACTION)


def refined(s, d):
    coarse = inf.regimes_of_all_folds(grid(s, d).filter(F.col("horizon").isin(*COARSE_GRID)), MIN_FOLDS, MIN_FRACTION)
    return inf.refined_onset(_fine_regimes(s, d), coarse, min(FINE_GRID) - 1, ANCHOR, 7, RUN, TAIL)


def _adjusted(s, d):
    """Bands as rows, with the adjusted p of their fold and horizon."""
    f = folds(s, d)
    p = inf.holm_adjusted(f.select(*cert.FOLD, "p"), ("return_mode", "fold"))
    rows = f.select(*cert.FOLD, F.explode("bands").alias("b")).select(*cert.FOLD, "b.band", "b.estimate", "b.p_lt0")
    return rounded(rows.join(p.select(*cert.FOLD, "p_holm"), list(cert.FOLD), "left"))


def _nearest(s, d):
    """The five uncertified tests of each mode with the smallest p."""
    w = Window.partitionBy("return_mode").orderBy(F.col("p").asc_nulls_last(), "fold", "horizon")
    out = folds(s, d).filter("NOT certified").withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 5")
    return rounded(out.select("return_mode", "place", "fold", "horizon", "p", "eligible", "tail_negative"))


def _best(s, d):
    """By mode the horizon with most certified folds (ties: the shorter), the first with any, and the least support from it on."""
    g = folds(s, d).groupBy("return_mode", "horizon").agg(F.count_if("certified").alias("support"), F.count("*").alias("n"))
    first = F.min(F.when(F.col("support") > 0, F.col("horizon"))).over(Window.partitionBy("return_mode"))
    g = g.withColumn("first", first)
    out = g.groupBy("return_mode").agg(F.max_by("horizon", F.struct("support", -F.col("horizon"))).alias("best"), F.max("support").alias("support"), F.max("first").alias("first"), F.min(F.when(F.col("horizon") >= F.col("first"), F.col("support"))).alias("quality"))
    return out


def _why(s, d):
    """What keeps tests from certification, by mode and horizon: support, effect, interval, multiplicity, none."""
    each = folds(s, d).withColumns({"effect": F.forall("bands", lambda b: b["effect_pass"]), "ci": F.forall("bands", lambda b: b["ci_pass"])})
    why = F.when(~F.col("eligible"), "support").when(~F.col("effect"), "effect").when(~F.col("ci"), "interval").when(~F.col("passes"), "multiplicity").otherwise("none")
    return each.withColumn("why", why).groupBy("return_mode", "horizon").agg(*(F.count_if(F.col("why") == m).alias(f"n_{m}") for m in ("support", "effect", "interval", "multiplicity", "none")), F.count("*").alias("n"))


def _p_summary(s, d):
    """p over folds by mode and horizon, and the union-intersection p."""
    g = folds(s, d).groupBy("return_mode", "horizon").agg(F.min("p").alias("p_min"), F.median("p").alias("p_median"), F.max("p").alias("p_max"), F.count("p").alias("n"))
    return rounded(g)


def _effect(s, d):
    """Tail days by mode and horizon: mean, and the mean in units of days' standard deviation and of rows'."""
    tail = cells(s, d, KEY, TAILS).filter(F.col("q_psi") >= Q0)
    rows = tail.groupBy("return_mode", "horizon").agg(F.stddev_samp("phase_product_robust").alias("_sd"), F.count("*").alias("n_obs"))
    days = xs.equal_date_mean(tail, "phase_product_robust", ("return_mode", "horizon")).drop("n_rows")
    out = days.join(rows, ["return_mode", "horizon"])
    return rounded(out.select("return_mode", "horizon", "estimate", (F.col("estimate") / F.col("day_sd")).alias("d_daily"), (F.col("estimate") / F.col("_sd")).alias("d_rows"), "n_dates", "n_obs"))


def fold_curves(s, d):
    """(return_mode, fold, horizon, bin, mean, n): test rows of each walk-forward fold in 20 bins of percentile."""
    c = cells(s, d)
    rows = splits.fold_rows(c, splits.walkforward_folds(c), max(SMALL.horizons)).filter("part = 'test'")
    n = F.greatest(F.ceil(F.round(F.col("q_psi") * 20, 9)) - 1, F.lit(0)).cast("int")
    return rows.withColumn("bin", n).groupBy("return_mode", "fold", "horizon", "bin").agg(F.avg("phase_product").alias("mean"), F.count("*").alias("n"))


def fold_roots(s, d):
    return xs.zero_crossings(fold_curves(s, d).withColumn("q", (F.col("bin") + 0.5) / 20.0), "q", "mean", ("return_mode", "fold", "horizon"))


def _topology(s, d):
    """Roots over folds: mean number, folds with any, and the middle half of their places."""
    k = ["return_mode", "horizon"]
    curves = fold_curves(s, d).select(*k, "fold").distinct()
    n = curves.join(fold_roots(s, d).groupBy(*k, "fold").agg(F.count("*").alias("roots")), [*k, "fold"], "left").na.fill(0, ["roots"])
    return rounded(n.groupBy(*k).agg(F.avg("roots").alias("mean_roots"), F.count_if(F.col("roots") > 0).alias("folds_with_roots"), F.count("*").alias("folds")))


def _stability(s, d):
    k = ["return_mode", "horizon"]
    q = F.percentile("root", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = fold_roots(s, d).groupBy(*k).agg(q.alias("q"), F.avg("root").alias("mean"), F.stddev_samp("root").alias("sd"), F.count("*").alias("n"))
    return rounded(g.select(*k, F.get("q", F.lit(1)).alias("median"), (F.get("q", F.lit(2)) - F.get("q", F.lit(0))).alias("iqr"), "mean", "sd", "n"))


QUERIES = {
    "tail_bands_certified": lambda s, d: rounded(bands(s, d)),
    "tail_folds_certified": lambda s, d: rounded(folds(s, d).drop("bands")),
    "tail_regimes": lambda s, d: rounded(_regimes(s, d)),
    "tail_onsets": _onsets,
    "tail_consensus": lambda s, d: inf.consensus_onset(_onsets(s, d).withColumn("scope", F.lit("all")), ("scope",), 2),
    "tail_forensics": lambda s, d: cert.disagreements(folds(s, d), ALPHA),
    "tail_band_rows": lambda s, d: rounded(folds(s, d).select(*cert.FOLD, F.explode("bands").alias("b")).select(*cert.FOLD, *(f"b.{c}" for c in ("band", "estimate", "ci_hi", "p_lt0", "supported", "effect_pass", "ci_pass")))),
    "tail_bands_adjusted": _adjusted,
    "fine_gate": lambda s, d: gated(s, d).select(*cert.FOLD, "gate_active", "gate_pass"),
    "fine_regimes": lambda s, d: rounded(_fine_regimes(s, d)),
    "refined_onsets": lambda s, d: rounded(refined(s, d)),
    "refined_consensus": lambda s, d: rounded(inf.consensus_of_all_modes(refined(s, d).withColumn("scope", F.lit("all")), ("scope",))),
    "nearest_to_pass": _nearest,
    "best_horizons": _best,
    "certification_failures": _why,
    "fold_p_summary": _p_summary,
    "tail_effect_sizes": _effect,
    "curve_over_folds": lambda s, d: rounded(fold_curves(s, d).groupBy("return_mode", "horizon", "bin").agg(F.avg("mean").alias("mean"), F.stddev_samp("mean").alias("sd"), F.countDistinct("fold").alias("n_folds"))),
    "root_topology": _topology,
    "root_stability": _stability,
    "local_resolution": lambda s, d: panel(s, d).select("horizon").distinct().withColumn("step", F.lead("horizon").over(Window.orderBy("horizon")) - F.col("horizon")).agg(F.min("step").alias("resolution"), F.count("step").alias("n")),
}

_P = lambda rest: with_panel(KEY, SMALL, rest)
_C = lambda rest: with_panel(KEY, TAILS, rest)
_MID = (Q0 + 1) / 2
EXPANDING = """, dd AS (SELECT return_mode, date, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY return_mode) AS n, lag(date) OVER w AS before FROM (SELECT DISTINCT return_mode, date FROM panel) WINDOW w AS (PARTITION BY return_mode ORDER BY date)),
ee AS (SELECT *, i - n // 2 AS k, (n - n // 2) // 4 AS sz, (n - n // 2) % 4 AS more FROM dd WHERE n >= 10),
ew AS (SELECT *, (CASE WHEN k < more * (sz + 1) THEN k // (sz + 1) ELSE more + (k - more * (sz + 1)) // sz END + 1)::INT AS fold FROM ee WHERE k >= 0),
ef AS (SELECT return_mode, fold, arg_min(before, date) AS train_end, max(date) AS test_end FROM ew GROUP BY 1, 2)"""
_K = "return_mode, fold, horizon, band"
_BANDS = f"""{_ROBUST}{EXPANDING},
dm AS (SELECT return_mode, horizon, CASE WHEN q_psi < {_MID}::DOUBLE THEN 0 ELSE 1 END AS band, date, avg(phase_product_robust) AS m, count(*) AS k FROM cells WHERE q_psi >= {Q0}::DOUBLE GROUP BY 1, 2, 3, 4),
bt AS (SELECT dm.*, fold, date <= train_end AS train FROM dm JOIN ef ON dm.return_mode = ef.return_mode AND date <= test_end),
st AS (SELECT {_K}, stddev_samp(m) FILTER (train) AS sd, count(*) FILTER (train) AS n_train_dates, count(*) FILTER (NOT train) AS n_test_dates, coalesce(sum(k) FILTER (NOT train), 0)::BIGINT AS n_test_rows FROM bt GROUP BY ALL),
te AS (SELECT * FROM bt WHERE NOT train){bootstrap_sql('te', _K, 'm', f'{SEED} + 100000 * fold + 1000 * horizon + 10 * band + {round(100 * Q0)}', REPS, None)},
bands AS (SELECT st.return_mode, st.fold, st.horizon, st.band, n_train_dates, st.n_test_dates, n_test_rows, estimate, ci_lo, ci_hi, p_lt0, 0.02::DOUBLE * sd AS epsilon, n_test_rows >= {GATES['rows']} AND st.n_test_dates >= {GATES['dates']} AND n_train_dates >= {GATES['dates']} AS supported,
  coalesce(estimate <= -0.02::DOUBLE * sd, false) AS effect_pass, coalesce(ci_hi < 0, false) AS ci_pass FROM st LEFT JOIN bs ON st.return_mode = bs.return_mode AND st.fold = bs.fold AND st.horizon = bs.horizon AND st.band = bs.band)"""
_FOLDS = f"""{_BANDS}, g0 AS (SELECT return_mode, fold, horizon, count(*) = 2 AND bool_and(supported) AS eligible, bool_and(effect_pass AND ci_pass) AS neg, bool_and(effect_pass) AS effect, bool_and(ci_pass) AS ci, max(p_lt0) FILTER (band = 0) AS p0, max(p_lt0) FILTER (band = 1) AS p1 FROM bands GROUP BY ALL),
g1 AS (SELECT *, CASE WHEN p0 IS NOT NULL THEN greatest(p0, coalesce(p1, p0)) END AS p, eligible AND neg AS tail_negative FROM g0),
g2 AS (SELECT *, coalesce(p <= {ALPHA}::DOUBLE / (count(*) OVER (PARTITION BY return_mode, fold) - row_number() OVER (PARTITION BY return_mode, fold ORDER BY p NULLS LAST, horizon) + 1), false) AS ok FROM g1),
g3 AS (SELECT *, bool_and(ok) OVER (PARTITION BY return_mode, fold ORDER BY p NULLS LAST, horizon ROWS UNBOUNDED PRECEDING) AS passes FROM g2),
folds AS (SELECT *, tail_negative AND passes AS certified FROM g3)"""
_REG = f"""{_FOLDS}, r0 AS (SELECT return_mode, horizon, count(*) FILTER (eligible) AS eligible_folds, count(*) FILTER (certified) AS certified_folds FROM folds GROUP BY 1, 2),
regimes AS (SELECT *, certified_folds / greatest(1, eligible_folds) AS support_fraction, certified_folds >= {MIN_FOLDS} AND certified_folds / greatest(1, eligible_folds) >= {MIN_FRACTION} AS certified_tail FROM r0)"""
_ON = f"""{_REG}, dn AS (SELECT m.return_mode, h.horizon, h.i, coalesce(certified_tail, false) AS f FROM (SELECT DISTINCT return_mode FROM regimes) m CROSS JOIN (SELECT unnest({list(COARSE_GRID)}) AS horizon, unnest(range({len(COARSE_GRID)})) AS i) h LEFT JOIN regimes r ON r.return_mode = m.return_mode AND r.horizon = h.horizon),
dk AS (SELECT *, count(*) OVER a = {RUN} AND bool_and(f) OVER a AND avg(f::INT) OVER t >= {TAIL} AS ok FROM dn WINDOW a AS (PARTITION BY return_mode ORDER BY i ROWS BETWEEN CURRENT ROW AND {RUN - 1} FOLLOWING), t AS (PARTITION BY return_mode ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
onsets AS (SELECT return_mode, min(horizon) FILTER (ok) AS hc_grid FROM dk GROUP BY 1)"""
_R = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_CURVES = f"""{_Q}{_WF}, fq AS (SELECT xq.*, wf.fold FROM xq JOIN wf ON xq.return_mode = wf.return_mode AND date BETWEEN test_start AND test_end),
curves AS (SELECT return_mode, fold, horizon, greatest(ceil(round(q_psi * 20, 9)) - 1, 0)::INT AS bin, avg(phase_product) AS mean, count(*) AS n FROM fq GROUP BY 1, 2, 3, 4)"""
_ROOTS = f"""{_CURVES}, c1 AS (SELECT *, (bin + 0.5) / 20.0::DOUBLE AS q, lead(mean) OVER w AS y1, lead((bin + 0.5) / 20.0::DOUBLE) OVER w AS x1 FROM curves WINDOW w AS (PARTITION BY return_mode, fold, horizon ORDER BY bin)),
roots AS (SELECT *, CASE WHEN mean = 0 THEN q ELSE q - mean * (x1 - q) / (y1 - mean) END AS root FROM c1 WHERE mean = 0 OR mean * y1 < 0)"""
_WHY = "CASE WHEN NOT eligible THEN 'support' WHEN NOT effect THEN 'effect' WHEN NOT ci THEN 'interval' WHEN NOT passes THEN 'multiplicity' ELSE 'none' END"

GRID_SQL = _C(f"""{_FOLDS}, gb AS (SELECT return_mode, fold, horizon, max(estimate) FILTER (band = 0) AS e0, max(estimate) FILTER (band = 1) AS e1, sum(n_test_rows)::BIGINT AS n FROM bands GROUP BY ALL),
grid AS MATERIALIZED (SELECT f.return_mode, f.fold, f.horizon, e0 AS est, n, eligible, round(p, 10) AS p, CASE WHEN e0 < 0 THEN 'R' ELSE 'M' END AS phase, certified, CASE WHEN e0 * e1 < 0 THEN 1 ELSE 0 END::BIGINT AS n_roots FROM folds f JOIN gb USING (return_mode, fold, horizon))""")
_GATED = f"""{GRID_SQL}, fa AS (SELECT return_mode, fold, certified AND phase = 'R' AS anchor FROM grid WHERE horizon = {ANCHOR}),
fo AS (SELECT g.*, coalesce(anchor, false) AS anchor, CASE WHEN horizon = {ANCHOR} THEN coalesce(anchor, false) ELSE coalesce(eligible AND phase = 'R' AND n_roots = 0 AND p <= {ALPHA}::DOUBLE, false) END AS own FROM grid g LEFT JOIN fa USING (return_mode, fold) WHERE horizon IN {FINE_GRID}),
fg AS (SELECT *, coalesce(bool_and(own) OVER (PARTITION BY return_mode, fold ORDER BY horizon DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AND anchor AS gate_active FROM fo),
fr0 AS (SELECT return_mode, horizon, count(DISTINCT fold) AS folds_total, greatest({MIN_FOLDS}, ceil({MIN_FRACTION} * count(DISTINCT fold)))::BIGINT AS required, count(*) FILTER (own) AS local_support, count(*) FILTER (gate_active AND own) AS support, count(*) FILTER (n_roots = 0) AS root_free FROM fg GROUP BY ALL),
fr1 AS (SELECT *, support / folds_total AS support_fraction, root_free / folds_total AS root_free_fraction, CASE WHEN support >= required THEN 'R' ELSE 'UNRESOLVED' END AS regime FROM fr0)"""
_REFINED = f"""{_GATED}, co AS (SELECT return_mode, horizon, count(*) FILTER (certified AND phase = 'R') >= greatest({MIN_FOLDS}, ceil({MIN_FRACTION} * count(DISTINCT fold))) AS r, count(*) FILTER (certified AND phase = 'M') >= greatest({MIN_FOLDS}, ceil({MIN_FRACTION} * count(DISTINCT fold))) AS m FROM grid WHERE horizon IN {COARSE_GRID} GROUP BY ALL),
cr AS (SELECT return_mode, horizon, CASE WHEN r AND m THEN 'CONFLICT' WHEN r THEN 'R' WHEN m THEN 'M' ELSE 'UNRESOLVED' END AS regime FROM co),
wd AS (SELECT *, bool_and(regime = 'R') OVER (PARTITION BY return_mode ORDER BY horizon DESC ROWS UNBOUNDED PRECEDING) AND horizon = {ANCHOR} - row_number() OVER (PARTITION BY return_mode ORDER BY horizon DESC) + 1 AS down FROM fr1),
on0 AS (SELECT return_mode, bool_or(horizon = {ANCHOR} AND regime = 'R') AS anchored, min(horizon) FILTER (down) AS onset FROM wd GROUP BY 1),
al AS (SELECT return_mode, horizon, regime FROM fr1 UNION ALL SELECT return_mode, horizon, regime FROM cr WHERE horizon > {ANCHOR}),
an AS (SELECT return_mode, j, min(horizon) FILTER (horizon >= onset + 7 * j) AS a FROM al JOIN on0 USING (return_mode), (SELECT unnest(range(1, {RUN})) AS j) GROUP BY ALL),
ao AS (SELECT an.return_mode, count(*) FILTER (regime = 'R') = {RUN - 1} AS held, string_agg(a, ',' ORDER BY j) AS later FROM an LEFT JOIN al ON al.return_mode = an.return_mode AND horizon = a GROUP BY ALL),
tl AS (SELECT return_mode, avg((regime = 'R')::INT) AS f, bool_or(regime = 'M') AS m FROM al JOIN on0 USING (return_mode) WHERE horizon >= onset GROUP BY 1),
rf AS (SELECT *, CASE WHEN NOT anchored THEN 'coarse_upper_anchor_not_replicated_at_required_fold_support' WHEN NOT coalesce(held, false) THEN 'refined_onset_lacks_coarse_scale_persistence_anchors' WHEN m OR f + 1e-15 < {TAIL}::DOUBLE THEN 'refined_tail_fails_persistence_fraction' ELSE '' END AS reason FROM on0 LEFT JOIN ao USING (return_mode) LEFT JOIN tl USING (return_mode))"""
_LOWER = min(FINE_GRID) - 1

ORACLES = {
    "tail_bands_adjusted": _C(f"""{_FOLDS}, ha AS (SELECT *, (count(p) OVER (PARTITION BY return_mode, fold) - row_number() OVER (PARTITION BY return_mode, fold ORDER BY p NULLS LAST, horizon) + 1) * p AS a FROM folds),
hp AS (SELECT return_mode, fold, horizon, CASE WHEN p IS NOT NULL THEN least(1.0, max(a) OVER (PARTITION BY return_mode, fold ORDER BY p NULLS LAST, horizon ROWS UNBOUNDED PRECEDING)) END AS p_holm FROM ha)
SELECT {_K}, {_R('estimate', 'p_lt0', 'p_holm')} FROM bands JOIN hp USING (return_mode, fold, horizon)"""),
    "fine_gate": f"{_GATED} SELECT return_mode, fold, horizon, gate_active, gate_active AND own AS gate_pass FROM fg",
    "fine_regimes": f"{_GATED} SELECT return_mode, horizon, folds_total, required, local_support, support, round(support_fraction, 6) AS support_fraction, root_free, round(root_free_fraction, 6) AS root_free_fraction, regime FROM fr1",
    "refined_onsets": f"""{_REFINED} SELECT return_mode, reason = '' AS identified, reason, CASE WHEN reason = '' THEN onset END AS hc_grid, CASE WHEN reason = '' THEN greatest(onset - 1, {_LOWER}) END AS hc_lower_exclusive, CASE WHEN reason = '' THEN (greatest(onset - 1, {_LOWER}) + onset) / 2 END AS hc_midpoint,
CASE WHEN reason = '' THEN round(f, 6) END AS tail_r_fraction, reason = '' AND f = 1 AS strict_r_tail, CASE WHEN reason = '' THEN onset || ',' || later END AS anchors FROM rf""",
    "refined_consensus": f"""{_REFINED}, rx AS (SELECT count(*) AS n, count(*) FILTER (reason = '') AS k, max(onset) FILTER (reason = '') AS u, arg_max(greatest(onset - 1, {_LOWER}), onset) FILTER (reason = '') AS l FROM rf) SELECT 'all' AS scope, n = k AS identified, CASE WHEN n = k THEN l END AS hc_lower_exclusive, CASE WHEN n = k THEN u END AS hc_grid, CASE WHEN n = k THEN (l + u) / 2 END AS hc_midpoint, CASE WHEN n = k THEN round(u / 21, 6) END AS hc_months FROM rx""",
    "tail_bands_certified": _C(f"{_BANDS} SELECT {_K}, n_train_dates, n_test_dates, n_test_rows, {_R('estimate', 'ci_lo', 'ci_hi', 'p_lt0', 'epsilon')}, supported, effect_pass, ci_pass FROM bands"),
    "tail_folds_certified": _C(f"{_FOLDS} SELECT return_mode, fold, horizon, eligible, round(p, 6) AS p, tail_negative, passes, certified FROM folds"),
    "tail_regimes": _C(f"{_REG} SELECT return_mode, horizon, eligible_folds, certified_folds, round(support_fraction, 6) AS support_fraction, certified_tail FROM regimes"),
    "tail_onsets": _C(f"{_ON} SELECT return_mode, hc_grid IS NOT NULL AS identified, hc_grid FROM onsets"),
    "tail_consensus": _C(f"{_ON} SELECT 'all' AS scope, count(hc_grid) >= 2 AS identified, CASE WHEN count(hc_grid) >= 2 THEN max(hc_grid) END AS hc_grid FROM onsets"),
    "tail_forensics": _C(f"""{_FOLDS}, q0 AS (SELECT return_mode, fold, horizon, count(*) = 2 AND bool_and(supported AND effect_pass AND ci_pass) AS neg, CASE WHEN max(p_lt0) FILTER (band = 0) IS NOT NULL THEN max(p_lt0) END AS p FROM bands GROUP BY ALL),
q1 AS (SELECT *, coalesce(p <= {ALPHA}::DOUBLE / (count(*) OVER (PARTITION BY return_mode, fold) - row_number() OVER (PARTITION BY return_mode, fold ORDER BY p NULLS LAST, horizon) + 1), false) AS ok FROM q0),
q2 AS (SELECT *, neg AND bool_and(ok) OVER (PARTITION BY return_mode, fold ORDER BY p NULLS LAST, horizon ROWS UNBOUNDED PRECEDING) AS recomputed FROM q1)
SELECT f.return_mode, f.fold, f.horizon, f.certified AS stored, recomputed, f.certified IS NOT DISTINCT FROM recomputed AS same FROM folds f LEFT JOIN q2 USING (return_mode, fold, horizon)"""),
    "tail_band_rows": _C(f"{_BANDS} SELECT {_K}, {_R('estimate', 'ci_hi', 'p_lt0')}, supported, effect_pass, ci_pass FROM bands"),
    "nearest_to_pass": _C(f"{_FOLDS}, t AS (SELECT *, row_number() OVER (PARTITION BY return_mode ORDER BY p NULLS LAST, fold, horizon) AS place FROM folds WHERE NOT certified) SELECT return_mode, place, fold, horizon, round(p, 6) AS p, eligible, tail_negative FROM t WHERE place <= 5"),
    "best_horizons": _C(f"{_FOLDS}, h AS (SELECT return_mode, horizon, count(*) FILTER (certified) AS support FROM folds GROUP BY 1, 2), f AS (SELECT *, min(horizon) FILTER (support > 0) OVER (PARTITION BY return_mode) AS first FROM h) SELECT return_mode, arg_max(horizon, support * 100000 - horizon) AS best, max(support) AS support, max(first) AS first, min(support) FILTER (horizon >= first) AS quality FROM f GROUP BY 1"),
    "certification_failures": _C(f"{_FOLDS} SELECT return_mode, horizon, {', '.join(f'count(*) FILTER ({_WHY} = {m!r}) AS n_{m}' for m in ('support', 'effect', 'interval', 'multiplicity', 'none'))}, count(*) AS n FROM folds GROUP BY 1, 2"),
    "fold_p_summary": _C(f"{_FOLDS} SELECT return_mode, horizon, round(min(p), 6) AS p_min, round(median(p), 6) AS p_median, round(max(p), 6) AS p_max, count(p) AS n FROM folds GROUP BY 1, 2"),
    "tail_effect_sizes": _C(f"{_ROBUST}, t AS (SELECT * FROM cells WHERE q_psi >= {Q0}::DOUBLE), dm AS (SELECT return_mode, horizon, date, avg(phase_product_robust) AS m FROM t GROUP BY 1, 2, 3), a AS (SELECT return_mode, horizon, avg(m) AS estimate, stddev_samp(m) AS day_sd, count(*) AS n_dates FROM dm GROUP BY 1, 2), b AS (SELECT return_mode, horizon, stddev_samp(phase_product_robust) AS sd, count(*) AS n_obs FROM t GROUP BY 1, 2) SELECT return_mode, horizon, round(estimate, 6) AS estimate, round(estimate / day_sd, 6) AS d_daily, round(estimate / sd, 6) AS d_rows, n_dates, n_obs FROM a JOIN b USING (return_mode, horizon)"),
    "curve_over_folds": _P(f"{_CURVES} SELECT return_mode, horizon, bin, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS sd, count(DISTINCT fold) AS n_folds FROM curves GROUP BY 1, 2, 3"),
    "root_topology": _P(f"{_ROOTS}, n AS (SELECT return_mode, horizon, fold, count(*) AS roots FROM roots GROUP BY 1, 2, 3), a AS (SELECT DISTINCT return_mode, horizon, fold FROM curves) SELECT return_mode, horizon, round(avg(coalesce(roots, 0)), 6) AS mean_roots, count(roots) AS folds_with_roots, count(*) AS folds FROM a LEFT JOIN n USING (return_mode, horizon, fold) GROUP BY 1, 2"),
    "root_stability": _P(f"{_ROOTS} SELECT return_mode, horizon, round(median(root), 6) AS median, round(quantile_cont(root, 0.75::DOUBLE) - quantile_cont(root, 0.25::DOUBLE), 6) AS iqr, round(avg(root), 6) AS mean, round(stddev_samp(root), 6) AS sd, count(*) AS n FROM roots GROUP BY 1, 2"),
    "local_resolution": _P(", h AS (SELECT lead(horizon) OVER (ORDER BY horizon) - horizon AS step FROM (SELECT DISTINCT horizon FROM panel)) SELECT min(step) AS resolution, count(step) AS n FROM h"),
}
