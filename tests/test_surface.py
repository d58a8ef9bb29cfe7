"""Spline surfaces against dense fits in this process, roots and certification on tables with known phases."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import inference as inf
from phasegrid.operators import roots as rt
from phasegrid.operators import surface as sf

HORIZONS = (5, 10, 21, 42, 63, 126)


def phases(seed=7, days=60, each=28):
    """R, M, R along psi, with a middle that moves with the horizon: zeros at shift(h) +- sqrt(0.62)."""
    rng = np.random.default_rng(seed)
    rows = []
    for d in pd.bdate_range("2020-01-01", periods=days):
        for h in HORIZONS:
            psi = rng.uniform(-1.8, 1.8, each)
            y = 0.62 - (psi - 0.16 * np.log(h / 21.0)) ** 2 + rng.normal(0.0, 0.22, each)
            vol, cls = rng.uniform(0.1, 0.4, each), rng.choice(["a", "b"], each)
            rows += [("raw", 1, d.date(), h, float(p), float(v), None if v > 0.39 else 0.02, 20.0, str(c), float(q), float(q > 0), 1.0 + (i % 3)) for i, (p, v, c, q) in enumerate(zip(psi, vol, cls, y, strict=True))]
    return pd.DataFrame(rows, columns=["return_mode", "fold", "date", "horizon", "psi_primary", "vol20", "range20", "log_dollar_volume20", "asset_class", "phase_product", "phase_label", "weight"])


@pytest.fixture(scope="module")
def table(spark):
    pdf = phases()
    kinds = "return_mode string, fold int, date date, horizon int, psi_primary double, vol20 double, range20 double, log_dollar_volume20 double, asset_class string, phase_product double, phase_label double, weight double"
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None).values.tolist(), kinds).repartition(6).cache()
    return pdf, df


def dense(pdf, design):
    """The design matrix by plain recursion over numpy's quantiles, scaled; with its own scaling."""
    psi = pdf["psi_primary"].to_numpy()
    lo, hi = np.quantile(psi, [0.005, 0.995])
    x = np.clip(psi, lo, hi)

    def basis(v, knots, p=3):
        a, b = knots[1] - knots[0], knots[-1] - knots[-2]
        t = np.concatenate([[knots[0] - a * j for j in range(p, 0, -1)], knots, [knots[-1] + b * j for j in range(1, p + 1)]])

        def one(i, d, z):
            if d == 0:
                return float(t[i] <= z < t[i + 1])
            l = (z - t[i]) / (t[i + d] - t[i]) * one(i, d - 1, z) if t[i + d] > t[i] else 0.0
            r = (t[i + d + 1] - z) / (t[i + d + 1] - t[i + 1]) * one(i + 1, d - 1, z) if t[i + d + 1] > t[i + 1] else 0.0
            return l + r

        known = {z: [one(i, p, z) for i in range(len(knots) + p - 2)] for z in set(v.tolist())}
        return np.array([known[z] for z in v.tolist()])

    h = np.log(pdf["horizon"].to_numpy(float))
    parts = [basis(x, np.quantile(x, np.linspace(0, 1, 7))), basis(h, np.quantile(h, np.linspace(0, 1, 6)))]
    if design.interaction:
        parts.append(np.einsum("ij,ik->ijk", parts[0], parts[1]).reshape(len(x), -1))
    if design.context:
        c = pdf[list(sf.CONTROLS)].to_numpy(float)
        c = np.where(np.isfinite(c), c, np.nanmedian(c, axis=0))
        s = c.std(0)
        c = (c - c.mean(0)) / np.where(s > 1e-12, s, 1.0)
        parts += [c, parts[0] * c[:, :1], np.array([[float(v == k) for k in ("a", "b")] for v in pdf["asset_class"]])]
    m = np.concatenate(parts, axis=1)
    s = m.std(0)
    return (m - m.mean(0)) / np.where(s > 1e-9, s, 1.0)


DESIGNS = [sf.Design(interaction=False), sf.Design(), sf.Design(context=True)]


@pytest.mark.parametrize("design", DESIGNS)
def test_ridge_equals_a_dense_fit(table, design):
    pdf, df = table
    fit = sf.fit_surfaces(df, design)[("raw", 1)]
    x, y, w = dense(pdf, design), pdf["phase_product"].to_numpy(), pdf["weight"].to_numpy()
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    root = np.sqrt(w)[:, None]
    a = np.vstack([root * (x - xm), 2.0 * np.eye(x.shape[1])])
    beta = np.linalg.lstsq(a, np.concatenate([root[:, 0] * (y - ym), np.zeros(x.shape[1])]), rcond=None)[0]
    got = fit.predict({c: pdf[c].to_numpy() for c in sf.INPUTS})
    assert np.abs(got - ((x - xm) @ beta + ym)).max() < 1e-8


@pytest.mark.parametrize("design", DESIGNS[:2])
def test_logistic_fit_is_at_the_minimum_of_the_dense_loss(table, design):
    pdf, df = table
    fit = sf.fit_surfaces(df, design, logistic=True)[("raw", 1)]
    x, y, w = dense(pdf, design), pdf["phase_label"].to_numpy(), pdf["weight"].to_numpy()
    x1, free = np.column_stack([np.ones(len(x)), x]), np.append(0.0, np.ones(x.shape[1]))
    b = np.zeros(x1.shape[1])
    for _ in range(60):  # plain Newton steps on the dense matrix
        p = 1 / (1 + np.exp(-x1 @ b))
        g = 0.5 * x1.T @ (w * (p - y)) + free * b
        b = b - np.linalg.solve(0.5 * (x1 * (w * p * (1 - p))[:, None]).T @ x1 + np.diag(free + 1e-12), g)
    assert np.abs(fit.predict({c: pdf[c].to_numpy() for c in sf.INPUTS}) - 1 / (1 + np.exp(-x1 @ b))).max() < 1e-6


def test_two_roots_at_known_places_that_move_with_the_horizon(spark, table):
    fits = sf.fit_surfaces(table[1], sf.Design())
    each = spark.createDataFrame([("raw", 1, h) for h in HORIZONS], "return_mode string, fold int, horizon int")
    top = {r.horizon: r for r in rt.curve_topology(sf.curves(each, fits, 1000), "psi_primary", "fit", rt.TEST).collect()}
    for h, r in top.items():
        middle = 0.16 * np.log(h / 21.0)
        assert r.path == "R→M→R" and np.allclose([x.root for x in r.roots], [middle - 0.787, middle + 0.787], atol=0.2)
    assert sum(x.root for x in top[126].roots) > sum(x.root for x in top[5].roots) + 0.4


def test_roots_touch_duplicate_and_alternate(spark):
    curves = {
        "touch": [(0, 1.0), (1, 0.0), (2, 1.0)], "none": [(0, 1.0), (1, 2.0)], "one": [(0, -1.0)], "cross": [(0, -1.0), (1, 1.0), (2, 1.0), (3, 1.0), (4, -1.0)],
        "close": [(0, -1.0), (1, 1.0), (2, -1.0), (3, -1.0), (4, -1.0), (5, 1.0)], "gap": [(0, -1.0), (1, None), (2, 1.0)],
    }
    df = spark.createDataFrame([(k, float(x), y) for k, c in curves.items() for x, y in c], "k string, x double, y double")
    got = {r.k: (r.path, [(round(x.root, 6), x.direction) for x in r.roots]) for r in rt.curve_topology(df, "x", "y", ("k",)).collect()}
    assert got["touch"] == ("M→M", [(1.0, "touch")]) and got["none"] == ("M", []) and got["one"] == ("R", [])
    assert got["cross"] == ("R→M→R", [(0.5, "R_to_M"), (3.5, "M_to_R")])
    assert got["close"] == ("R→R→M", [(0.5, "R_to_M"), (4.5, "R_to_M")])  # 1.5 lies within two steps of 0.5
    assert got["gap"][1] == [(1.0, "R_to_M")]
    ways = spark.createDataFrame([(1, 0.1, "R_to_M"), (1, 0.5, "M_to_R"), (2, 0.1, "M_to_R"), (2, 0.2, "M_to_R"), (3, 0.7, "M_to_R")], "k int, root_quantile double, direction string")
    assert {r.k: (r.path, r.consistent) for r in rt.certified_topology(ways, ("k",)).collect()} == {1: ("R→M→R", True), 2: ("INCONSISTENT", False), 3: ("M→R", True)}
    assert rt.certified_topology(ways.limit(0), ("k",)).count() == 0


def line(slope, start, days, each, rng, noise=0.12, part="test"):
    return [("raw", 1, 21, part, d.date(), float(p), float(slope(p) + rng.normal(0, noise))) for d in pd.bdate_range(start, periods=days) for p in rng.uniform(-1.6, 1.6, each)]


KINDS = "return_mode string, fold int, horizon int, part string, date date, psi_primary double, phase_product double"


def test_a_real_transition_is_certified_and_its_reverse_is_not(spark):
    rng = np.random.default_rng(123)
    rows = spark.createDataFrame(line(lambda p: 0.55 * p, "2020-01-01", 100, 40, rng, part="train") + line(lambda p: 0.55 * p, "2022-01-03", 120, 80, rng), KINDS).cache()
    roots = spark.createDataFrame([("raw", 1, 21, 1, 0.0, "R_to_M"), ("raw", 1, 21, 2, 0.0, "M_to_R"), ("raw", 1, 21, 3, 1.55, "R_to_M"), ("raw", 1, 21, 4, 0.0, "touch"), ("raw", 2, 21, 1, 0.0, "R_to_M")], "return_mode string, fold int, horizon int, root_index long, root double, direction string")
    got = {(r.fold, r.root_index): r for r in rt.certify_roots(rows, roots, 300, F.lit(77), 8, effect=0.01, obs=100, dates=30).collect()}
    a = got[1, 1]
    assert a.eligible and a.effect_pass and a.left_estimate < 0 < a.right_estimate and a.candidate_p <= 0.05 and a.certified
    train = [r for r in rows.filter("part = 'train'").toPandas()["psi_primary"]]
    assert a.root_quantile == pytest.approx(np.mean(np.array(train) <= 0)) and a.left_lo == pytest.approx(np.quantile(train, a.root_quantile - 0.08)) and a.right_hi == pytest.approx(np.quantile(train, a.root_quantile + 0.08))
    assert got[1, 2].eligible and not got[1, 2].effect_pass and not got[1, 2].certified
    assert (got[1, 3].reason, got[1, 4].reason, got[2, 1].reason) == ("root_too_close_to_domain_edge", "touch_not_transition", "insufficient_train")
    few = rt.certify_roots(rows, roots.filter("fold = 1 AND root_index = 1"), 50, F.lit(1), 8, obs=100_000).first()
    assert few.reason == "insufficient_oos_support" and not few.certified
    assert rt.certify_roots(rows, roots.limit(0), 50, F.lit(1), 8).count() == 0


def test_clusters_need_enough_folds(spark):
    rows = [("raw", f, 21, "R_to_M", 2 * q - 1, q, f <= 3) for f, q in ((1, 0.39), (2, 0.41), (3, 0.40), (4, 0.72))]
    cert = spark.createDataFrame(rows, "return_mode string, fold int, horizon int, direction string, root double, root_quantile double, certified boolean")
    attempts = cert.select(*rt.TEST)
    good = rt.certified_transitions(cert, attempts, 0.05, 3, 0.75, 0.03).filter("certified_transition").collect()
    assert len(good) == 1 and good[0].support == 3 and good[0].root_quantile == pytest.approx(0.40) and good[0].folds == "1,2,3"
    assert rt.certified_transitions(cert, attempts, 0.05, 4, 0.75, 0.03).filter("certified_transition").count() == 0


def test_single_phase_is_certified_where_every_band_reverses(spark):
    rng = np.random.default_rng(2026)
    down = lambda p: -0.22 - 0.02 * p**2
    rows = spark.createDataFrame(line(down, "2020-01-01", 100, 60, rng, 0.05, "train") + line(down, "2021-01-01", 100, 60, rng, 0.05), KINDS).cache()
    n = lambda k: spark.createDataFrame([("raw", 1, 21, k)], "return_mode string, fold int, horizon int, n_roots long")
    how = {"reps": 250, "seed": F.lit(9), "block": 8, "effect": 0.01, "obs": 100, "dates": 25}
    got = rt.single_phase_folds(rows, n(0), **how).first()
    assert got.certified and got.phase == "R" and len(got.detail) == 5 and got.candidate_p <= 0.05
    assert rt.single_phase_folds(rows, n(1), **how).first().reason == "train_surface_has_candidate_roots"
    assert rt.single_phase_folds(rows, n(0), **(how | {"obs": 10**6})).first().reason == "insufficient_oos_band_support"
    mixed = spark.createDataFrame(line(lambda p: p, "2020-01-01", 60, 60, rng, 0.05, "train") + line(lambda p: p, "2021-01-01", 60, 60, rng, 0.05), KINDS)
    assert not rt.single_phase_folds(mixed, n(0), **how).first().certified
    folds = rt.single_phase_folds(rows, n(0), **how)
    assert rt.single_phases(folds, 1, 0.5).first().certified_single_phase and not rt.single_phases(folds, 2, 0.5).first().certified_single_phase


def test_days_are_paired_and_share_their_draws(spark):
    rng = np.random.default_rng(5)
    rows = [("m", d.date(), float(a), float(b), float(rng.random() < a)) for d in pd.bdate_range("2020-01-01", periods=60) for a, b in rng.random((9, 2)).round(1)]
    df = spark.createDataFrame(rows, "mode string, date date, p double, q double, phase_label double")
    days = inf.paired_days(df, ("mode",), "q", "p")
    by = {}
    for _, d, a, b, y in rows:
        by.setdefault(d, []).append((b, a, y))
    want = {}
    for d, x in by.items():
        up, down = [r for r in x if r[2] > 0.5], [r for r in x if r[2] < 0.5]
        if up and down:
            auc = [np.mean([(u[i] > v[i]) + 0.5 * (u[i] == v[i]) for u in up for v in down]) for i in (0, 1)]
            want[d] = (auc[0], auc[1], np.mean([(r[2] - r[0]) ** 2 - (r[2] - r[1]) ** 2 for r in x]))
    got = {r.date: (r.auc_0, r.auc_1, r.delta_brier) for r in days.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[d], want[d]) for d in want)
    table = {r.metric: r for r in inf.paired_bootstrap(days, ("mode",), 120, F.lit(11), 5).collect()}
    order = sorted(want)
    for name, values in (("mean_datewise_auc_delta", [want[d][1] - want[d][0] for d in order]), ("mean_datewise_brier_improvement", [want[d][2] for d in order])):
        run, n, b = np.concatenate([[0], np.cumsum(values)]), len(values), 5
        k = -(-n // b)
        at = inf.draws(11, np.arange(120), k) % (n - b + 1)
        size = np.array([b] * (k - 1) + [n - (k - 1) * b])
        means = (run[at + size] - run[at]).sum(1) / n
        assert table[name].ci_lo == pytest.approx(np.quantile(means, 0.025)) and table[name].p_gt0 == pytest.approx((1 + (means <= 0).sum()) / 121)
