"""Queries on zeros of training curves: topology, certification on later rows, single phases, paired scores by day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.config import SEED, SMALL
from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators import roots as rt
from phasegrid.operators import splits
from phasegrid.oracles.base import with_panel
from phasegrid.oracles.bootstrap import bootstrap_sql
from phasegrid.plans.panels import KEY, cells, panel, rounded
from phasegrid.plans.splits import _WF, PURGE

BINS, REPS = 10, 200
#: Rows and days that a band needs; the panel of small tables has some thousand rows a fold.
GATES = {"obs": 100, "dates": 40}


def rows_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel(spark, sf_dir)
    return splits.fold_rows(p, splits.walkforward_folds(p), PURGE)


def _curve(s, d):
    """Mean response by percentile, in 20 bins, over all rows."""
    return xs.equal_width_curve(cells(s, d)).withColumn("q", (F.col("bin") + 0.5) / 20.0)


def training_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(return_mode, fold, horizon, psi, mean): each fold's training rows in bins of equal shares of psi."""
    train = rows_of_folds(spark, sf_dir).filter("part = 'train'")
    edges = xs.bin_edges(train, "psi_primary", BINS, rt.TEST)
    return xs.with_bin(train, edges, "psi_primary", rt.TEST).groupBy(*rt.TEST, "bin").agg(F.avg("psi_primary").alias("psi"), F.avg("phase_product").alias("mean"))


def topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rt.curve_topology(training_curves(spark, sf_dir), "psi", "mean", rt.TEST)


def certified(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = splits.fold_seed(SEED, "root", h=F.col("horizon"), extra=F.col("root_index"))
    return rt.certify_roots(rows_of_folds(spark, sf_dir), rt.root_rows(topology(spark, sf_dir), rt.TEST), REPS, seed, PURGE, **GATES)


def _phases(s, d):
    seed = splits.fold_seed(SEED, "single_phase", h=F.col("horizon"))
    return rt.single_phase_folds(rows_of_folds(s, d), topology(s, d), REPS, seed, PURGE, **GATES)


def _all_roots(s, d):
    return rt.root_rows(topology(s, d), rt.TEST)


def pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later rows with two scores from earlier ones: the share of momentum by psi bin of all horizons, and by psi bin within the horizon."""
    p = panel(spark, sf_dir)
    first = splits.walkforward_folds(p).groupBy("return_mode").agg(F.min("test_start").alias("_start"))
    rows = p.join(F.broadcast(first), "return_mode")
    early, late = rows.filter(F.col("date") < F.col("_start")), rows.filter(F.col("date") >= F.col("_start"))
    for name, keys in (("pooled", ("return_mode",)), ("own", ("return_mode", "horizon"))):
        edges = xs.bin_edges(early, "psi_primary", 10, keys)
        share = xs.with_bin(early, edges, "psi_primary", keys).groupBy(*keys, "bin").agg(F.avg("phase_label").alias(name))
        late = xs.with_bin(late, edges, "psi_primary", keys).join(F.broadcast(share), [*keys, "bin"], "left").drop("bin")
    return late


def pair_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inf.paired_days(pair(spark, sf_dir), ("return_mode",), "pooled", "own")


QUERIES = {
    "curve_topology": lambda s, d: rounded(rt.curve_topology(_curve(s, d), "q", "mean", ("return_mode", "horizon")).select("return_mode", "horizon", "n_roots", "path", F.array_join(F.transform("roots", lambda r: F.concat_ws(":", F.format_string("%.6f", r["root"]), r["direction"])), ",").alias("roots"))),
    "training_roots": lambda s, d: rounded(_all_roots(s, d)),
    "root_certification": lambda s, d: rounded(certified(s, d).drop("train_scale", "n_train").select(*rt.TEST, "root_index", "root", "direction", "reason", "eligible", "root_quantile", "left_lo", "left_hi", "right_lo", "right_hi", "epsilon", "left_estimate", "left_ci_lo", "left_ci_hi", "right_estimate", "right_ci_lo", "right_ci_hi", "left_n_rows", "right_n_rows", "candidate_p", "candidate_p_holm", "effect_pass", "certified")),
    "certified_transitions": lambda s, d: rounded(rt.certified_transitions(certified(s, d), topology(s, d).select(*rt.TEST), min_folds=1, min_fraction=0.25)),
    "root_order": lambda s, d: rt.certified_topology(_all_roots(s, d), rt.TEST, "root").select(*rt.TEST, "n_transitions", "directions", "consistent", "path"),
    "root_order_over_folds": lambda s, d: rt.certified_topology(_all_roots(s, d), ("return_mode", "horizon"), "root").select("return_mode", "horizon", "n_transitions", "directions", "consistent", "path"),
    "single_phase_certification": lambda s, d: rounded(_phases(s, d).drop("detail")),
    "single_phase_regimes": lambda s, d: rt.single_phases(_phases(s, d), 1, 0.25),
    "paired_score_days": lambda s, d: rounded(pair_days(s, d), digits=12),
    "paired_score_bootstrap": lambda s, d: rounded(inf.paired_bootstrap(pair_days(s, d), ("return_mode",), REPS, SEED + 1009 * splits.mode_number(F.col("return_mode")), PURGE)),
}

_P = lambda rest: with_panel(KEY, SMALL, rest)
_R = lambda *cols: ", ".join(f"round({c}, 6) AS {c}" for c in cols)
_T = "return_mode, fold, horizon"
_MODE = "CASE return_mode WHEN 'market_residual' THEN 1 WHEN 'raw' THEN 2 ELSE 0 END"
_SHARES = ", ".join(repr(i / BINS) for i in range(1, BINS))


def roots_sql(source: str, keys: str, x: str, y: str) -> str:
    """CTEs rz0, rz1, rk (keys, i, root, direction, slope, kept): sign changes of source's curves; kept ones lie over two mean steps from the last one kept."""
    eq = lambda a, b: " AND ".join(f"{a}.{k.strip()} = {b}.{k.strip()}" for k in keys.split(","))
    own = lambda a: ", ".join(f"{a}.{k.strip()}" for k in keys.split(","))
    return f""", rz0 AS (SELECT {keys}, {x} AS x0, {y} AS y0, lead({x}) OVER w AS x1, lead({y}) OVER w AS y1, (max({x}) OVER (PARTITION BY {keys}) - min({x}) OVER (PARTITION BY {keys})) / greatest(2, count(*) OVER (PARTITION BY {keys}) - 1) AS step FROM {source} WINDOW w AS (PARTITION BY {keys} ORDER BY {x})),
rz1 AS MATERIALIZED (SELECT {keys}, greatest(1e-12, step) AS step, CASE WHEN y0 = 0 THEN x0 ELSE x0 - y0 * (x1 - x0) / (y1 - y0) END AS root, CASE WHEN y0 < 0 AND y1 >= 0 THEN 'R_to_M' WHEN y0 > 0 AND y1 <= 0 THEN 'M_to_R' ELSE 'touch' END AS direction, (y1 - y0) / (x1 - x0) AS slope, row_number() OVER (PARTITION BY {keys} ORDER BY x0) AS i
  FROM rz0 WHERE x1 IS NOT NULL AND (y0 = 0 OR y0 * y1 < 0)),
rk0 AS (SELECT {keys}, i, root, direction, slope, step, root AS last, true AS keep FROM rz1 WHERE i = 1
  UNION ALL SELECT {own('n')}, n.i, n.root, n.direction, n.slope, n.step, CASE WHEN abs(n.root - p.last) > 2 * n.step THEN n.root ELSE p.last END, abs(n.root - p.last) > 2 * n.step FROM rk0 p JOIN rz1 n ON {eq('n', 'p')} AND n.i = p.i + 1),
rk AS MATERIALIZED (SELECT {keys}, root, direction, slope, row_number() OVER (PARTITION BY {keys} ORDER BY i) AS root_index FROM rk0 WHERE keep)"""


_TRAIN = f"""{_WF}, tr AS (SELECT * FROM fr WHERE part = 'train'), te AS (SELECT * FROM fr WHERE part = 'test'),
be AS (SELECT {_T}, list_distinct(quantile_cont(psi_primary, [{_SHARES}])) AS edges FROM tr GROUP BY ALL),
tb AS (SELECT tr.*, len(list_filter(edges, lambda e: e <= psi_primary))::INT AS bin FROM tr JOIN be USING ({_T})),
tc AS MATERIALIZED (SELECT {_T}, bin, avg(psi_primary) AS psi, avg(phase_product) AS mean FROM tb GROUP BY ALL){roots_sql('tc', _T, 'psi', 'mean')}"""
_SCALE = f""", wt AS (SELECT {_T}, date, count(*) AS k, avg(phase_product) AS m, avg(phase_product * phase_product) AS m2 FROM tr GROUP BY ALL),
sc AS MATERIALIZED (SELECT {_T}, sqrt(greatest(avg(m2) - avg(m) * avg(m), 0)) AS train_scale, sum(k) AS n_train, 0.02::DOUBLE * sqrt(greatest(avg(m2) - avg(m) * avg(m), 0)) AS epsilon FROM wt GROUP BY ALL)"""
_K = f"{_T}, root_index"


def _edge(d: float) -> str:
    at = f"((len(l) - 1) * (root_quantile + {d!r}::DOUBLE))"
    return f"l[floor({at})::INT + 1] + (l[ceil({at})::INT + 1] - l[floor({at})::INT + 1]) * ({at} - floor({at}))"


_CERT = f"""{_TRAIN}{_SCALE},
ll AS MATERIALIZED (SELECT {_T}, list_sort(list(psi_primary)) AS l FROM tr GROUP BY ALL),
rq AS (SELECT rk.*, l, train_scale, epsilon, n_train, (len(list_filter(l, lambda v: v <= root)) / len(l))::DOUBLE AS root_quantile FROM rk JOIN ll USING ({_T}) JOIN sc USING ({_T})),
r1 AS (SELECT *, CASE WHEN n_train < 200 THEN 'insufficient_train' WHEN NOT (root_quantile - 0.08::DOUBLE > 0 AND root_quantile + 0.08::DOUBLE < 1) THEN 'root_too_close_to_domain_edge' END AS why FROM rq),
r2 AS MATERIALIZED (SELECT * EXCLUDE (l), {', '.join(f'CASE WHEN why IS NULL THEN {_edge(x)} END AS {n}' for n, x in (('left_lo', -0.08), ('left_hi', -0.01), ('right_lo', 0.01), ('right_hi', 0.08)))} FROM r1),
rb AS (SELECT {_K}, 0 AS side, left_lo AS lo, left_hi AS hi FROM r2 WHERE why IS NULL UNION ALL SELECT {_K}, 1, right_lo, right_hi FROM r2 WHERE why IS NULL),
rd AS (SELECT te.return_mode, te.fold, te.horizon, root_index, side, date, avg(phase_product) AS m, count(*) AS k FROM te JOIN rb ON te.return_mode = rb.return_mode AND te.fold = rb.fold AND te.horizon = rb.horizon AND psi_primary BETWEEN lo AND hi GROUP BY ALL){bootstrap_sql('rd', f'{_K}, side', 'm', f'{SEED} + 100000 * {_MODE} + fold + 10000 * horizon + 97 * root_index + CASE WHEN side = 0 THEN 11 ELSE 29 END', REPS, PURGE)},
rn AS (SELECT {_K}, side, sum(k) AS n_rows, count(*) AS n_days FROM rd GROUP BY ALL),
r3 AS (SELECT {_K}, {', '.join(f'max({c}) FILTER (side = {s}) AS {n}_{c}' for s, n in ((0, 'left'), (1, 'right')) for c in ('estimate', 'ci_lo', 'ci_hi', 'p_gt0', 'p_lt0', 'n_rows', 'n_days'))} FROM bs JOIN rn USING ({_K}, side) GROUP BY ALL),
r4 AS (SELECT r2.*, r3.* EXCLUDE ({_K}), coalesce(why, CASE WHEN NOT (coalesce(left_n_rows, 0) >= {GATES['obs']} AND coalesce(right_n_rows, 0) >= {GATES['obs']} AND coalesce(left_n_days, 0) >= {GATES['dates']} AND coalesce(right_n_days, 0) >= {GATES['dates']}) THEN 'insufficient_oos_support' WHEN direction = 'touch' THEN 'touch_not_transition' ELSE '' END) AS reason FROM r2 LEFT JOIN r3 USING ({_K})),
r5 AS (SELECT *, reason = '' AS eligible, CASE WHEN reason = '' AND left_p_lt0 IS NOT NULL AND right_p_lt0 IS NOT NULL THEN CASE WHEN direction = 'R_to_M' THEN greatest(left_p_lt0, right_p_gt0) ELSE greatest(left_p_gt0, right_p_lt0) END END AS candidate_p,
  reason = '' AND coalesce(CASE WHEN direction = 'R_to_M' THEN -left_estimate >= epsilon AND left_ci_hi < 0 AND right_estimate >= epsilon AND right_ci_lo > 0 ELSE left_estimate >= epsilon AND left_ci_lo > 0 AND -right_estimate >= epsilon AND right_ci_hi < 0 END, false) AS effect_pass FROM r4),
r6 AS (SELECT *, (count(candidate_p) OVER (PARTITION BY {_T}) - row_number() OVER (PARTITION BY {_T} ORDER BY candidate_p NULLS LAST, root_index) + 1) * candidate_p AS a FROM r5),
r7 AS (SELECT *, CASE WHEN candidate_p IS NOT NULL THEN least(1.0::DOUBLE, max(a) OVER (PARTITION BY {_T} ORDER BY candidate_p NULLS LAST, root_index ROWS UNBOUNDED PRECEDING)) END AS candidate_p_holm FROM r6)"""
_FIVE = ", ".join(f"{i / 5!r}::DOUBLE" for i in range(6))
_PHASE = f"""{_TRAIN}{_SCALE}, nr AS (SELECT {_T}, count(rk.root_index) AS n_roots FROM (SELECT DISTINCT {_T} FROM tc) c LEFT JOIN rk USING ({_T}) GROUP BY ALL),
pe AS (SELECT {_T}, quantile_cont(psi_primary, [{_FIVE}]) AS e FROM tr GROUP BY ALL),
pb AS (SELECT te.return_mode, te.fold, te.horizon, date, phase_product, len(list_filter(e[2:5], lambda v: v <= psi_primary))::INT AS band FROM te JOIN pe USING ({_T}) WHERE len(list_distinct(e)) = 6),
pd AS (SELECT {_T}, band, date, avg(phase_product) AS m, count(*) AS k FROM pb GROUP BY ALL){bootstrap_sql('pd', f'{_T}, band', 'm', f'{SEED} + 100000 * {_MODE} + fold + 50000 * horizon + 101 * (band + 1)', REPS, PURGE)},
pn AS (SELECT {_T}, band, sum(k) AS n_rows, count(*) AS n_days FROM pd GROUP BY ALL),
ps AS (SELECT bs.*, n_rows, n_days, epsilon, CASE WHEN estimate >= epsilon AND ci_lo > 0 THEN 1 WHEN estimate <= -epsilon AND ci_hi < 0 THEN -1 ELSE 0 END AS sg FROM bs JOIN pn USING ({_T}, band) JOIN sc USING ({_T})),
pg AS (SELECT {_T}, count(*) AS nb, bool_and(n_rows >= {GATES['obs']} AND n_days >= {GATES['dates']}) AS ok, bool_and(ci_lo IS NOT NULL) AS ci, min(sg) AS lo, max(sg) AS hi, count(*) FILTER (sg <> 0) AS np, max(CASE WHEN sg > 0 THEN p_gt0 WHEN sg < 0 THEN p_lt0 END) AS p, max(epsilon) AS epsilon FROM ps GROUP BY ALL),
pr AS (SELECT nr.*, nb, ci, lo, hi, np, p, pg.epsilon, CASE WHEN n_roots <> 0 THEN 'train_surface_has_candidate_roots' WHEN coalesce(len(list_distinct(e)), 0) <> 6 THEN 'degenerate_psi_bins' WHEN coalesce(nb, 0) < 5 OR NOT coalesce(ok, false) THEN 'insufficient_oos_band_support' WHEN NOT ci THEN 'bootstrap_unavailable' ELSE '' END AS reason FROM nr LEFT JOIN pe USING ({_T}) LEFT JOIN pg USING ({_T})),
pf AS (SELECT {_T}, n_roots, reason, reason = '' AS eligible, CASE WHEN reason = '' AND lo = hi AND lo <> 0 THEN CASE WHEN lo > 0 THEN 'M' ELSE 'R' END ELSE '' END AS phase, CASE WHEN reason = '' AND np = 5 THEN p END AS candidate_p, reason = '' AND coalesce(lo = hi AND lo <> 0 AND p <= 0.05::DOUBLE AND np = 5, false) AS certified, epsilon FROM pr)"""
_PAIR = f"""{_WF}, st1 AS (SELECT return_mode, min(test_start) AS start FROM wf GROUP BY 1), al AS (SELECT p.*, start FROM panel p JOIN st1 USING (return_mode)),
ea AS (SELECT return_mode, list_distinct(quantile_cont(psi_primary, [{_SHARES}])) AS edges_a FROM al WHERE date < start GROUP BY 1), eo AS (SELECT return_mode, horizon, list_distinct(quantile_cont(psi_primary, [{_SHARES}])) AS edges_o FROM al WHERE date < start GROUP BY 1, 2),
ab AS (SELECT al.*, len(list_filter(edges_a, lambda e: e <= psi_primary))::INT AS ba, len(list_filter(edges_o, lambda e: e <= psi_primary))::INT AS bo FROM al JOIN ea USING (return_mode) JOIN eo USING (return_mode, horizon)),
sa AS (SELECT return_mode, ba, avg(phase_label) AS pooled FROM ab WHERE date < start GROUP BY 1, 2), so AS (SELECT return_mode, horizon, bo, avg(phase_label) AS own FROM ab WHERE date < start GROUP BY 1, 2, 3),
pr0 AS (SELECT ab.*, pooled, own FROM ab JOIN sa USING (return_mode, ba) JOIN so USING (return_mode, horizon, bo) WHERE date >= start),
pr1 AS (SELECT *, {', '.join(f'rank() OVER (PARTITION BY return_mode, date ORDER BY {c}) + (count(*) OVER (PARTITION BY return_mode, date, {c}) - 1) / 2.0::DOUBLE AS r{i}' for i, c in enumerate(('pooled', 'own')))} FROM pr0),
pr2 AS (SELECT return_mode, date, count(*) FILTER (phase_label > 0.5) AS p, count(*) AS n, sum(r0) FILTER (phase_label > 0.5) AS s0, sum(r1) FILTER (phase_label > 0.5) AS s1, avg((phase_label - pooled) ** 2) AS b0, avg((phase_label - own) ** 2) AS b1 FROM pr1 GROUP BY 1, 2),
pday AS (SELECT return_mode, date, (s0 - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) AS auc_0, (s1 - p * (p + 1) / 2.0::DOUBLE) / (p * (n - p)) AS auc_1, (s1 - s0) / (p * (n - p)) AS delta_auc, b0 - b1 AS delta_brier, n FROM pr2 WHERE p > 0 AND p < n)"""
_MH = "return_mode, horizon"
_ORDER = lambda keys: f"""{_TRAIN}, od AS (SELECT {keys}, list(direction ORDER BY root, direction) AS d FROM rk GROUP BY {keys}), oc AS (SELECT *, len(list_filter(range(len(d)), lambda i: d[i + 1] = CASE WHEN (d[1] = 'R_to_M') = (i % 2 = 0) THEN 'R_to_M' ELSE 'M_to_R' END)) = len(d) AS consistent FROM od)
SELECT {keys}, len(d) AS n_transitions, array_to_string(d, ',') AS directions, consistent, CASE WHEN consistent THEN array_to_string(list_transform(range(len(d) + 1), lambda i: CASE WHEN (d[1] = 'R_to_M') = (i % 2 = 0) THEN 'R' ELSE 'M' END), '→') ELSE 'INCONSISTENT' END AS path FROM oc"""  # noqa: E731
_CURVE20 = """, xq AS (SELECT *, (rank() OVER (PARTITION BY return_mode, date, horizon ORDER BY psi_primary) + (count(*) OVER (PARTITION BY return_mode, date, horizon, psi_primary) - 1) / 2.0) / count(*) OVER (PARTITION BY return_mode, date, horizon) AS q_psi FROM panel),
cv AS MATERIALIZED (SELECT return_mode, horizon, (greatest(ceil(round(q_psi * 20, 9)) - 1, 0) + 0.5) / 20.0::DOUBLE AS q, avg(phase_product) AS mean FROM xq GROUP BY ALL)"""

ORACLES = {
    "curve_topology": _P(f"""{_CURVE20}{roots_sql('cv', _MH, 'q', 'mean')},
e AS (SELECT {_MH}, min(q) AS lo, max(q) AS hi FROM cv GROUP BY ALL), cuts AS (SELECT {_MH}, lo AS c FROM e UNION ALL SELECT {_MH}, root FROM rk UNION ALL SELECT {_MH}, hi FROM e),
mids AS (SELECT *, (c + lead(c) OVER (PARTITION BY {_MH} ORDER BY c)) / 2 AS mid FROM cuts),
seg AS (SELECT *, lead(q) OVER (PARTITION BY {_MH} ORDER BY q) AS q1, lead(mean) OVER (PARTITION BY {_MH} ORDER BY q) AS m1 FROM cv),
val AS (SELECT mids.return_mode, mids.horizon, mid, mean + (m1 - mean) * (mid - q) / (q1 - q) AS y FROM mids JOIN seg ON mids.return_mode = seg.return_mode AND mids.horizon = seg.horizon AND mid >= q AND mid < q1 WHERE mid IS NOT NULL),
pt AS (SELECT {_MH}, string_agg(CASE WHEN y > 0 THEN 'M' WHEN y < 0 THEN 'R' ELSE '0' END, '→' ORDER BY mid) AS path FROM val GROUP BY ALL),
rr AS (SELECT {_MH}, count(*) AS n, string_agg(printf('%.6f', root) || ':' || direction, ',' ORDER BY root) AS roots FROM rk GROUP BY ALL)
SELECT {_MH}, coalesce(n, 0) AS n_roots, path, coalesce(roots, '') AS roots FROM pt LEFT JOIN rr USING ({_MH})"""),
    "training_roots": _P(f"{_TRAIN} SELECT {_T}, root_index, {_R('root')}, direction, {_R('slope')} FROM rk"),
    "root_certification": _P(f"{_CERT} SELECT {_T}, root_index, {_R('root')}, direction, reason, eligible, {_R('root_quantile', 'left_lo', 'left_hi', 'right_lo', 'right_hi', 'epsilon', 'left_estimate', 'left_ci_lo', 'left_ci_hi', 'right_estimate', 'right_ci_lo', 'right_ci_hi')}, left_n_rows::BIGINT AS left_n_rows, right_n_rows::BIGINT AS right_n_rows, {_R('candidate_p', 'candidate_p_holm')}, effect_pass, effect_pass AND coalesce(candidate_p_holm <= 0.05::DOUBLE, false) AS certified FROM r7"),
    "root_order": _P(_ORDER(_T)),
    "root_order_over_folds": _P(_ORDER(_MH)),
    "single_phase_certification": _P(f"{_PHASE} SELECT {_T}, n_roots, reason, eligible, phase, {_R('candidate_p')}, certified, {_R('epsilon')} FROM pf"),
    "single_phase_regimes": _P(f"""{_PHASE}, s0 AS (SELECT {_MH}, phase, count(*) AS support FROM pf WHERE certified GROUP BY ALL), s1 AS (SELECT * FROM s0 QUALIFY row_number() OVER (PARTITION BY {_MH} ORDER BY support DESC, phase) = 1), s2 AS (SELECT {_MH}, count(DISTINCT fold) AS folds_total FROM pf GROUP BY ALL)
SELECT {_MH}, folds_total, greatest(1, ceil(0.25 * folds_total))::BIGINT AS required, coalesce(support, 0) AS support, coalesce(phase, '') AS phase, coalesce(support, 0) >= greatest(1, ceil(0.25 * folds_total)) AS certified_single_phase FROM s2 LEFT JOIN s1 USING ({_MH})"""),
    "paired_score_days": _P(f"{_PAIR} SELECT return_mode, date, {', '.join(f'round({c}, 12) AS {c}' for c in ('auc_0', 'auc_1', 'delta_auc', 'delta_brier'))}, n FROM pday"),
    "paired_score_bootstrap": _P(f"""{_PAIR}, pm AS (SELECT return_mode, 'mean_datewise_auc_delta' AS metric, date, delta_auc AS v FROM pday UNION ALL SELECT return_mode, 'mean_datewise_brier_improvement', date, delta_brier FROM pday){bootstrap_sql('pm', 'return_mode, metric', 'v', f'{SEED} + 1009 * {_MODE}', REPS, PURGE)}
SELECT return_mode, metric, {_R('estimate', 'ci_lo', 'ci_hi', 'p_two', 'p_gt0', 'p_lt0')}, n_dates FROM bs"""),
}
