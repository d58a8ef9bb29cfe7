"""Isotonic fits against the largest of least means, and against fits in this process."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import isotonic as iso


def brute(x, y, w):
    """Value at each distinct x: the largest, over starts up to it, of the least, over ends from it on, of the weighted means between."""
    u = np.unique(x)
    ws = np.array([w[x == v].sum() for v in u])
    s = np.array([(w * y)[x == v].sum() for v in u])
    cw, cs = np.cumsum(ws), np.cumsum(s)
    with np.errstate(all="ignore"):
        mean = (cs[None, :] - cs[:, None] + s[:, None]) / (cw[None, :] - cw[:, None] + ws[:, None])  # from a to b
    mean[np.tril_indices(len(u), -1)] = np.inf
    least = np.minimum.accumulate(mean[:, ::-1], axis=1)[:, ::-1]
    least[np.tril_indices(len(u), -1)] = -np.inf
    return u, np.array([max(least[: i + 1, i]) for i in range(len(u))])


@pytest.mark.parametrize("seed", range(3))
def test_blocks_of_many_groups_equal_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    groups = {f"g{i}": (rng.integers(0, 25, n).astype(float), rng.random(n), rng.uniform(0.1, 2, n)) for i, n in enumerate((1, 2, 60, 150))}
    rows = [(k, float(a), float(b), float(c)) for k, v in groups.items() for a, b, c in zip(*v, strict=True)] + [("g1", None, 1.0, 1.0), ("g1", 1.0, None, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double").repartition(5)
    lines = iso._lines(iso.isotonic_blocks(df, ("k",), "x", "y", "w"), ("k",))
    for k, v in groups.items():
        u, want = brute(*v)
        assert np.allclose(np.interp(u, *lines[(k,)]), want)
    assert iso.isotonic_blocks(df.limit(0), ("k",), "x", "y", "w").count() == 0


def test_boundary_of_a_line():
    assert iso.boundary((np.array([0.0, 1.0]), np.array([0.0, 1.0])), 0.0, 1.0) == pytest.approx(0.5)
    assert iso.boundary((np.array([0.0, 1.0]), np.array([0.6, 1.0])), 0.0, 1.0) == 0.0
    assert iso.boundary((np.array([0.0, 1.0]), np.array([0.1, 0.4])), 0.0, 1.0) is None


def test_evaluation_equals_local_fits(spark):
    rng = np.random.default_rng(3)
    start, rows = datetime.date(2020, 1, 6), []
    for d in range(120):
        for c in ("a", "b", "c"):
            for h in (2, 5):
                for p in rng.normal(0, 1, 4):
                    y = float(rng.random() < 1 / (1 + np.exp(-2 * p)))
                    rows.append(("raw", start + datetime.timedelta(days=d), h, c, float(p), y, 2 * y - 1))
    panel = spark.createDataFrame(rows, "return_mode string, date date, horizon int, asset_class string, psi_primary double, phase_label double, phase_product double")
    folds = spark.createDataFrame([("raw", 1, start + datetime.timedelta(days=70), start + datetime.timedelta(days=119))], "return_mode string, fold int, test_start date, test_end date")
    got = {(r.model, r.unit): r for r in iso.evaluate_isotonic(panel, folds, (2, 5)).collect()}
    assert set(got) == {("universal", "ALL"), ("horizon", "2"), ("horizon", "5"), ("class_left_out", "a"), ("class_left_out", "b"), ("class_left_out", "c")}
    pdf = panel.toPandas()
    train, test = pdf[pdf.date < start + datetime.timedelta(days=70 - 7)], pdf[pdf.date >= start + datetime.timedelta(days=70)]
    for unit, tr, te in (("ALL", train, test), ("b", train[train.asset_class != "b"], test[test.asset_class == "b"])):
        weight = lambda g: (1 / g.groupby("date")["date"].transform("size")).to_numpy()
        lo, hi = np.quantile(tr.psi_primary, [0.005, 0.995])
        u, fit = brute(np.clip(tr.psi_primary.to_numpy(), lo, hi).round(12), tr.phase_label.to_numpy(), weight(tr)) if unit == "b" else (None, None)
        r = got[("universal", "ALL") if unit == "ALL" else ("class_left_out", unit)]
        assert r.n_train == len(tr) and r.n == len(te)
        if unit == "b":
            p, w = np.interp(np.clip(te.psi_primary, lo, hi), u, fit), weight(te)
            assert r.brier == pytest.approx(np.average((p - te.phase_label) ** 2, weights=w), rel=1e-6)
            assert r.boundary == pytest.approx(iso.boundary((u, fit), lo, hi), abs=1e-3)
    assert abs(got["universal", "ALL"].boundary) < 0.4 and got["universal", "ALL"].auc > 0.7 and got["universal", "ALL"].skill > 0
    assert iso.evaluate_isotonic(panel.filter(F.col("horizon") == 9), folds, (9,)).count() == 0


def test_boundary_at_a_mean_of_the_level_does_not_hang_on_rounding():
    below = np.nextafter(0.5, 0.0)
    corners = lambda p: (np.array([0.0, 0.4, 0.5, 1.0]), np.array([0.1, 0.1, p, p]))
    assert iso.boundary(corners(below), 0.0, 1.0) == pytest.approx(iso.boundary(corners(0.5), 0.0, 1.0)) == pytest.approx(0.5, abs=1e-3)


def test_pooling_runs_at_once_equals_pooling_one_by_one():
    rng = np.random.default_rng(7)
    for y in (rng.random(500), np.arange(500.0), -np.arange(500.0), np.repeat([0.0, 1.0, 0.5], 200)):
        x, w = np.arange(float(len(y))), rng.uniform(0.5, 2, len(y))
        assert np.allclose(iso.pooled(iso.falling_pooled(x, w, w * y)), iso.pooled(zip(x, x, w, w * y, strict=True)))


def test_training_rows_are_not_stored_beside_each_fit_and_repeated_values_fit(spark, monkeypatch):
    rng = np.random.default_rng(5)
    start, rows = datetime.date(2020, 1, 6), []
    for d in range(120):
        for c in ("a", "b", None):
            for h in (2, 5):
                for p in rng.integers(-2, 3, 4):  # most rows lie at a fit's ends
                    rows.append(("raw", start + datetime.timedelta(days=d), h, c, float(p), float(rng.random() < 0.5 + 0.1 * p), float(p)))
    panel = spark.createDataFrame(rows, "return_mode string, date date, horizon int, asset_class string, psi_primary double, phase_label double, phase_product double").repartition(3)
    folds = spark.createDataFrame([("raw", 1, start + datetime.timedelta(days=70), start + datetime.timedelta(days=119))], "return_mode string, fold int, test_start date, test_end date")
    sizes, store = {}, iso.stored

    def seen(df, what):
        out = store(df, what)
        sizes[what] = out.count()
        return out

    monkeypatch.setattr(iso, "stored", seen)
    got = {(r.model, r.unit): r for r in iso.evaluate_isotonic(panel, folds, (2, 5)).collect()}
    assert set(got) == {("universal", "ALL"), ("horizon", "2"), ("horizon", "5"), ("class_left_out", "a"), ("class_left_out", "b")}
    pdf = panel.toPandas()
    day = lambda n: start + datetime.timedelta(days=n)
    test = pdf[pdf.date >= day(70)]
    assert max(sizes.values()) <= 3 * len(test)  # universal, its horizon, its class
    for key, train, own in (
        (("universal", "ALL"), pdf[pdf.date < day(63)], test),
        (("class_left_out", "b"), pdf[(pdf.date < day(63)) & (pdf.asset_class != "b")], test[test.asset_class == "b"]),
        (("horizon", "2"), pdf[(pdf.date < day(66)) & (pdf.horizon == 2)], test[test.horizon == 2]),
    ):
        weight = lambda g: (1 / g.groupby("date")["date"].transform("size")).to_numpy()
        lo, hi = np.quantile(train.psi_primary, [0.005, 0.995])
        u, fit = brute(np.clip(train.psi_primary.to_numpy(), lo, hi), train.phase_label.to_numpy(), weight(train))
        p, w, r = np.interp(np.clip(own.psi_primary, lo, hi), u, fit), weight(own), got[key]
        assert (r.n_train, r.n) == (len(train), len(own))
        assert r.brier == pytest.approx(np.average((p - own.phase_label) ** 2, weights=w), rel=1e-9)
        assert r.boundary == pytest.approx(iso.boundary((u, fit), lo, hi), abs=1e-9)
