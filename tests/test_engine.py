"""Known values of the panel engine, and its windows against pandas."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from phasegrid.config import PanelConfig
from phasegrid.functions import protocol as pr
from phasegrid.operators import certification as cert
from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators import series, splits
from phasegrid.sources.tables import canonical_ticker, normalized_bars, read_universe

DAYS = pd.bdate_range("2000-01-03", periods=700).date


def bars(spark, seed=3, names=("AAA",)):
    rng = np.random.default_rng(seed)
    rows = []
    for n in names:
        close = np.exp(np.cumsum(rng.normal(0, 0.01, len(DAYS))))
        rows += [(n, d, c, c * 1.01, c * 0.99, c, 1000.0) for d, c in zip(DAYS, close.tolist(), strict=True)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def test_windows_equal_pandas(spark):
    cfg = PanelConfig(horizons=(5, 10), vol_span=21, demean=63, spectral_window=252, beta_window=63, stride=1)
    got = series.series_features(bars(spark), bars(spark, 9, ("__MKT__",)), cfg).toPandas().sort_values("date")
    raw = got[got.return_mode == "raw"].reset_index(drop=True)
    r = raw.raw_r.astype(float)
    sigma = r.ewm(span=21, adjust=False, min_periods=21).std().shift(1)
    z = r / sigma
    z = (z - z.rolling(63, min_periods=60).mean().shift(1)).clip(-8, 8)
    np.testing.assert_allclose(raw.z.astype(float), z, rtol=1e-9, equal_nan=True)
    lam = z.ewm(alpha=2 / 6, adjust=False, min_periods=5).mean().shift(1)
    psi = (4 / 6) / (1 - 4 / 6) * z.rolling(252, min_periods=168).cov(lam) / z.rolling(252, min_periods=168).var(ddof=0)
    np.testing.assert_allclose(raw.psi_5.astype(float), psi, rtol=1e-6, atol=1e-9, equal_nan=True)
    beta = (r.rolling(63, min_periods=40).cov(raw.mkt_r) / raw.mkt_r.rolling(63, min_periods=40).var(ddof=0)).shift(1)
    np.testing.assert_allclose(raw.beta.astype(float), beta, rtol=1e-6, equal_nan=True)


def test_states_and_stride(spark):
    cfg = PanelConfig(horizons=(2,), stride=2)
    df = spark.createDataFrame([("A", "raw", i, DAYS[i - 1], float(i), 0.1, 1.0, 1.0, 1.0) for i in range(1, 6)], "ticker string, return_mode string, rn int, date date, z double, psi_2 double, vol20 double, range20 double, log_dollar_volume20 double")
    past, future = series.states(df, 2)
    rows = df.select("rn", past.alias("p"), future.alias("f")).orderBy("rn").collect()
    assert [None if r.f is None else round(r.f * math.sqrt(2), 9) for r in rows] == [None, 7.0, 9.0, None, None]
    assert [r.rn for r in rows if r.p is not None] == [2, 3, 4, 5]
    assert [r.date for r in series.phase_panel(df, cfg).collect()] == [DAYS[2]]


def test_percentile_huber_bands(spark):
    df = spark.createDataFrame([("raw", DAYS[0], 5, float(i), 1000.0 if i == 8 else i / 10) for i in range(1, 9)], "return_mode string, date date, horizon int, psi_primary double, phase_product double")
    got = xs.with_robust_response(xs.with_percentile(df)).orderBy("psi_primary").collect()
    assert [r.q_psi for r in got] == [i / 8 for i in range(1, 9)]
    assert got[-1].was_clipped and got[-1].phase_product_robust < 1000
    ties = xs.with_percentile(df.withColumn("psi_primary", F.lit(1.0))).select("q_psi").distinct().collect()
    assert [r[0] for r in ties] == [4.5 / 8]
    bands = xs.banded(xs.with_percentile(df), [0.5, 0.75, 1.0]).groupBy("band").count().orderBy("band").collect()
    assert [tuple(r) for r in bands] == [(0, 2), (1, 3)]


def test_holm_variants(spark):
    df = spark.createDataFrame([(1, 1, 0.01), (1, 2, 0.04), (1, 3, 0.03), (2, 1, 0.001), (2, 2, 0.01), (2, 3, 0.2), (3, 1, None), (3, 2, 0.02)], "g int, horizon int, p double")
    adj = {(r.g, r.horizon): r.p_holm for r in inf.holm_adjusted(df, ("g",)).collect()}
    assert [round(adj[1, i], 9) for i in (1, 2, 3)] == [0.03, 0.06, 0.06] and adj[3, 1] is None and adj[3, 2] == 0.02
    step = {(r.g, r.horizon): r.passes for r in inf.holm_stepdown(df, ("g",)).collect()}
    assert [step[2, i] for i in (1, 2, 3)] == [True, True, False] and not step[3, 1] and step[3, 2]
    one = {(r.g, r.horizon): r.p_holm for r in inf.holm_null_as_one(df, ("g",)).collect()}
    assert one[3, 1] == 1.0 and one[3, 2] == 0.04


def test_onsets_and_gate(spark):
    hs = [63, 72, 84, 96, 105, 112, 126]
    grid = lambda r, m=(): spark.createDataFrame([("x", h, h in r, h in m) for h in hs], "k string, horizon int, is_r boolean, is_m boolean")
    got = inf.persistent_onset(grid({84, 96, 105, 112, 126}), ("k",)).first()
    assert (got.hc_grid, got.hc_lower_exclusive, got.strict_tail) == (84, 72, True)
    assert inf.persistent_onset(grid({84, 96, 112}), ("k",)).count() == 0
    assert inf.persistent_onset(grid({84, 96, 105, 112}, {126}), ("k",)).count() == 0
    assert inf.tail_onset(grid({84, 96, 105, 112, 126}), ("k",), hs, "is_r").first().hc_grid == 84
    fine = spark.createDataFrame([("raw", 1, h, True, True, "R", 0.2 if h == 130 else 0.01) for h in range(126, 134)], "return_mode string, fold int, horizon int, eligible boolean, certified boolean, phase string, p double")
    anchors = spark.createDataFrame([("raw", 1, True)], "return_mode string, fold int, certified_r boolean")
    assert [r.horizon for r in inf.fixed_sequence_gate(fine, anchors, 133).filter("gate_pass").orderBy("horizon").collect()] == [131, 132, 133]


def test_splits(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    for n in (1, 3, 5, 12):
        want = {d: np.busday_offset(np.datetime64(d), -n, roll="forward").astype(dt.date) for d in days}
        assert {r.d: r.x for r in df.select("d", splits.minus_business_days(F.col("d"), n).alias("x")).collect()} == want
    panel = spark.createDataFrame([("raw", d) for d in pd.bdate_range("2020-01-01", periods=103).date], "return_mode string, date date")
    chunks = np.array_split(np.arange(103)[51:], 4)
    got = splits.expanding_folds(panel).orderBy("fold").collect()
    want = pd.bdate_range("2020-01-01", periods=103).date
    assert [(r.test_start, r.test_end, r.train_end) for r in got] == [(want[c[0]], want[c[-1]], want[c[0] - 1]) for c in chunks]
    sample = lambda: splits.balanced_sample(panel.withColumn("x", F.lit(1)), 50, 7, ("date",)).collect()
    assert len(sample()) == 50 and sample() == sample()


def brute_means(x, block, reps, seed):
    """Means of resamples by joining blocks, with the operator's draws."""
    n, means = len(x), []
    for r in range(reps):
        parts = []
        for j in range(-(-n // block)):
            v = (seed + inf.STEP[0] * (r + 1) + inf.STEP[1] * (j + 1)) % inf.PRIME
            for m in inf.MIX:
                v = (v * v % inf.PRIME * m + v + m) % inf.PRIME
            parts.append(x[v % (n - block + 1) :][:block])
        means.append(np.concatenate(parts)[:n].mean())
    return np.array(means)


def test_bootstraps(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(-0.3, 1, 300)
    rows = [("a", d, float(v)) for d, v in zip(DAYS, x, strict=False)] + [("b", DAYS[i], -1.0) for i in range(5)] + [("c", DAYS[0], 2.0), ("d", DAYS[0], None), ("d", DAYS[1], 0.5)]
    days = spark.createDataFrame(rows, "k string, date date, v double")
    one = {r.k: r for r in inf.bootstrap(days, ("k",), "v", 400, F.lit(5), 8).collect()}
    two = {r.k: r for r in inf.bootstrap(days, ("k",), "v", 400, F.lit(5), None).collect()}
    for got, block in ((one["a"], 8), (two["a"], 7)):
        means = brute_means(x, block, 400, 5)
        np.testing.assert_allclose([got.estimate, got.ci_lo, got.ci_hi], [x.mean(), *np.quantile(means, [0.025, 0.975])], rtol=1e-9)
        assert got.ci_lo < got.estimate < got.ci_hi < 0 and got.p_lt0 == (1 + (means >= 0).sum()) / 401 and got.n_dates == 300
        # as wide as independent draws make it
        free = [np.concatenate([x[s : s + block] for s in r])[:300].mean() for r in rng.integers(0, 301 - block, size=(2000, -(-300 // block)))]
        assert abs(got.ci_hi - got.ci_lo - np.subtract(*np.quantile(free, [0.975, 0.025]))) < 0.04
    assert one["a"].p_two == 2 * one["a"].p_lt0 and two["a"].p_two is None
    assert one["b"].ci_lo is None and one["b"].p_lt0 is None and one["b"].estimate == -1.0
    assert (two["b"].ci_lo, two["b"].p_lt0) == (-1.0, 1 / 401) and (two["c"].ci_lo, two["c"].p_lt0) == (2.0, 1.0) and two["d"].n_dates == 1


def tail_panel(spark, sign=-1.0):
    """8 tickers, 180 days, two modes: all reverse from horizon 105 on."""
    rng = np.random.default_rng(2)
    rows = []
    for mode in ("market_residual", "raw"):
        for h in (63, 84, 105, 112, 126):
            for d in DAYS[:180]:
                for i in range(8):
                    rows.append((mode, h, d, f"T{i}", float(i), float((sign if h >= 105 else -sign) * 0.4 + rng.normal(0, 0.05))))
    return spark.createDataFrame(rows, "return_mode string, horizon int, date date, ticker string, psi_primary double, phase_product double")


def test_tail_certification_end_to_end(spark):
    cells = xs.with_robust_response(xs.with_percentile(tail_panel(spark))).persist()
    bands = cert.tail_bands(cells, 0.75, 7, 100, rows=20, dates=20)
    folds = cert.certified_folds(bands)
    got = {(r.return_mode, r.fold, r.horizon): r for r in folds.collect()}
    assert len(got) == 2 * 4 * 5 and all(r.eligible for r in got.values())
    assert all(r.certified == (h >= 105) == r.passes for (_, _, h), r in got.items())
    regimes = cert.regimes(folds)
    onsets = inf.tail_onset(regimes, ("return_mode",), [63, 84, 105, 112, 126], "certified_tail")
    assert {r.return_mode: r.hc_grid for r in onsets.collect()} == {"market_residual": 105, "raw": 105}
    assert cert.disagreements(folds).filter("NOT same").count() == 0
    few = cert.certified_folds(cert.tail_bands(cells, 0.75, 7, 100))
    assert few.filter("eligible OR certified").count() == 0 and few.filter("p IS NULL").count() == 0
    cells.unpersist()


def test_roots_clusters_metrics(spark):
    curve = spark.createDataFrame([("x", q / 10, (q / 10 - 0.35) * (0.75 - q / 10)) for q in range(11)], "k string, q double, y double")
    roots = xs.zero_crossings(curve, "q", "y", ("k",)).orderBy("root").collect()
    assert [r.direction for r in roots] == ["R_to_M", "M_to_R"] and abs(roots[0].root - 0.35) < 0.02
    assert xs.phase_path(curve, "q", "y", ("k",)).first().path == "R→M→R"
    found = spark.createDataFrame([("raw", f, 21, "R_to_M", 2 * q, q) for f, q in enumerate((0.39, 0.41, 0.40, 0.72))], "return_mode string, fold int, horizon int, direction string, root double, root_quantile double")
    got = inf.cluster_roots(found).orderBy("cluster").collect()
    assert (got[0].support, round(got[0].root_quantile, 9), len(got)) == (3, 0.40, 2)
    s = spark.createDataFrame([("a", 0.2, 0.0, 1.0), ("a", 0.8, 1.0, 1.0), ("a", 0.8, 0.0, 1.0), ("b", 0.5, 1.0, 1.0)], "k string, s double, y double, w double")
    auc = {r.k: r.auc for r in inf.auc(s, ("k",), "s", "y", "w").collect()}
    assert auc == {"a": 0.75, "b": None}


def test_sources(spark, tmp_path):
    (tmp_path / "u.csv").write_text("ticker,asset_class\n aaa ,x\nAAA,y\nb.b,z\n,q\n")
    got = {r.ticker: r.asset_class for r in read_universe(spark, str(tmp_path / "u.csv")).collect()}
    assert got == {"AAA": "x", "B.B": "z"}
    assert spark.range(1).select(canonical_ticker(F.lit(" b.b ")), canonical_ticker(F.lit("b.b"), False)).first()[:] == ("B-B", "B.B")
    raw = spark.createDataFrame([("A", "2020-01-02", 1.0, 1), ("A", "2020-01-02", float("inf"), 2)], "ticker string, Date string, Close double, seq int")
    row = normalized_bars(raw).first()
    assert row.close is None and row.volume is None
    assert series.log_returns(bars(spark).limit(0)).count() == 0


def test_protocol_locks():
    doc = pr.frozen({"b": 1, "a": [1, 2]}, "locked_unicode")
    pr.verify(doc, "locked_unicode")
    with pytest.raises(ValueError):
        pr.verify(doc | {"b": 2}, "locked_unicode")
    new = pr.amended(doc, {"b": 3}, "typo", "locked_unicode")
    assert new["amendments"][0]["previous_sha256"] == doc[pr.HASH_KEY]
    assert pr.canonical_hash({"a": "é"}, "plain") != pr.canonical_hash({"a": "é"}, "unicode")
    assert not pr.independence({"tickers": ["A", "B"], "date_max": 5}, {"tickers": ["B"], "date_min": 6})["passes"]
    assert pr.independence({"tickers": ["A"], "date_max": 5}, {"tickers": ["B"], "date_min": 6}, "both")["passes"]
    base = pr.frozen({"status": "FROZEN"}, "locked_unicode")
    bound = pr.bind(base, [f"T{i}" for i in range(63)], ["Z"])
    assert pr.audit_bound_panel(bound, [f"T{i}" for i in range(55)])["passes"]
    assert not pr.audit_bound_panel(bound, [*(f"T{i}" for i in range(30)), "X"])["passes"]
    with pytest.raises(ValueError):
        pr.bind(base, ["Z"] * 60, ["Z"])
    pr.check_horizons([119, 126, 133], list(range(120, 134)), [119, *range(120, 134)], 133)
    with pytest.raises(ValueError):
        pr.check_horizons([119, 133], [120, 122], [119, 120, 122, 133], 133)
    assert pr.assess(True, False, True) == {"confirmed": False, "missing": ["localization"]}


def _explained(df):
    return df._jdf.queryExecution().toString()


def test_bars_compare_whole_order_keys_of_few_trades_only(spark):
    """No aggregate of all trades holds a struct, for which Spark would sort each task's rows; ties in the first field, missing fields and missing keys come out as before."""
    from phasegrid.sources import tables

    seen = []

    def ends(rows):
        seen.append(rows)
        return trades.join(rows, F.xxhash64("date", "lead") == F.col("_h"))

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, None]), rng.random(), 1.0 + rng.randrange(3), rng.random(), rng.choice([1, 2, 2, 9, None]), i) for i in range(400)]
    trades = spark.createDataFrame(rows, "ticker string, day int, price double, volume double, discount double, k long, l int")
    trades = trades.select("ticker", F.date_add(F.lit("2020-01-01").cast("date"), F.col("day")).alias("date"), "price", "volume", "discount", F.struct("k", "l").alias("seq"), F.coalesce("k", F.lit(-(2**63))).alias("lead"))
    want = trades.groupBy("ticker", "date").agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("volume").alias("volume"))
    order = lambda r: tuple((x is None, x) for x in map(str, r))
    for out in (tables.trade_bars(trades), tables.trade_bars(trades, ends)):
        got = out.select("ticker", "date", "open", "high", "low", "close", "volume")
        assert sorted(map(tuple, got.collect()), key=order) == sorted(map(tuple, want.collect()), key=order)
    assert seen[0].count() <= 2 * want.count()
    market = _explained(tables.asset_and_market_bars(spark, "/root/testdata/sf0.001")[1]).split("== Physical Plan ==")[1]
    assert "SortAggregate" in market and market.index("Join") > market.index("SortAggregate")
