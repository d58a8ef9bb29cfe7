"""Stored tables, exact quantiles and ranks by ranges, refined onsets, panels on disk."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.operators import inference as inf
from phasegrid.operators import ranks
from phasegrid.sources import store, tables
from phasegrid.sources.tables import read_panel, write_panel


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"few": [3.0], "two": [1.0, 2.0], "ties": [5.0] * 50 + [1.0] * 3, "many": rng.normal(0, 1, 5000).round(2).tolist(), "wide": (rng.standard_cauchy(3000) * 1e6).tolist()}
    df = spark.createDataFrame([(k, x) for k, v in groups.items() for x in [*v, None]], "k string, x double").repartition(4)
    shares = [0.0, 0.005, 0.3, 0.5, 0.975, 1.0]
    got = {r.k: r for r in ranks.exact_quantiles(df, "x", shares, ["k"]).collect()}
    for k, v in groups.items():
        assert got[k].n == len(v) and np.allclose(got[k].q, np.quantile(v, shares), rtol=1e-12)
    own = {r.k: r.q for r in ranks.exact_quantiles(df, "x", {("many",): [0.1, 0.9], ("two",): [0.5]}, ["k"]).collect()}
    assert np.allclose(own["many"], np.quantile(groups["many"], [0.1, 0.9])) and own["two"] == [1.5] and own["few"] == []
    assert ranks.exact_quantiles(df.limit(0), "x", shares, ["k"]).count() == 0


def test_ranks_and_auc_by_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(x), float(rng.random() < x), float(w)) for x, w in zip(rng.random(400).round(2), rng.uniform(0.5, 2, 400), strict=True)] + [("b", 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double, w double").repartition(4)
    values = np.array([r[1] for r in rows if r[0] == "a"])
    got = {r.x: r.rank for r in ranks.value_ranks(df, ["k"], "x", "rank").filter("k = 'a'").collect()}
    assert all(got[v] == (values < v).sum() + ((values == v).sum() + 1) / 2 for v in set(values.tolist()))
    up = [(x, w) for k, x, y, w in rows if k == "a" and y > 0.5]
    down = [(x, w) for k, x, y, w in rows if k == "a" and y < 0.5]
    want = sum(u * v * ((a > b) + 0.5 * (a == b)) for a, u in up for b, v in down) / sum(u for _, u in up) / sum(v for _, v in down)
    auc = {r.k: r.auc for r in inf.auc(df, ("k",), "x", "y", "w").collect()}
    assert auc["a"] == pytest.approx(want) and auc["b"] is None


def test_kept_tables_are_built_once_until_sources_change(spark, tmp_path):
    source, built = tmp_path / "in.txt", []
    source.write_text("1")

    def make():
        built.append(1)
        return spark.range(len(source.read_text()))

    write = lambda df, path: df.write.parquet(path)
    one = lambda: store.kept(spark, "t", [str(source)], make, write).count()
    assert (one(), one(), len(built)) == (1, 1, 1)
    source.write_text("123")
    assert (one(), len(built)) == (3, 2)
    df = store.stored(spark.range(5), "x")
    files = df.inputFiles()
    store.drop_stored(df)
    assert files and not any(__import__("os").path.exists(f.removeprefix("file://")) for f in files)


def test_panels_are_written_by_mode_and_horizon_and_read_in_part(spark, tmp_path):
    rows = [("A.X", m, h, "2020-01-02", 0.5 if h > 1 else None) for m in ("raw", "market_residual") for h in (1, 2, 3)]
    df = spark.createDataFrame(rows, "ticker string, return_mode string, horizon int, date string, psi_primary double")
    write_panel(df, str(tmp_path / "p"))
    part = read_panel(spark, str(tmp_path / "p"), ["ticker", "horizon", "psi_primary"], (2, 3))
    assert part.count() == 4 and "PartitionFilters: [" in part._jdf.queryExecution().toString() and "horizon" in part._jdf.queryExecution().toString()
    assert read_panel(spark, str(tmp_path / "p"), ["psi_primary"], (1,)).count() == 0 and read_panel(spark, str(tmp_path / "p"), ["psi_primary"], (1,), strict=False).count() == 2
    with pytest.raises(ValueError):
        read_panel(spark, str(tmp_path / "p"), ["psi_primary"], (2, 9))
    df.write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "p.csv"))
    assert read_panel(spark, str(tmp_path / "p.csv"), ["ticker", "psi_primary"], (2,)).count() == 2


def test_metadata_comes_from_the_same_scan(spark):
    rows = [(f"2026-01-0{1 + i % 3}", t, m, h, 0.1 if h > 63 else None, -0.2) for i, t in enumerate(("A.B", "CC", "DD")) for m in ("raw", "market_residual") for h in (63, 126)]
    df = spark.createDataFrame(rows, "date string, ticker string, return_mode string, horizon int, psi_primary double, phase_product double")
    part, seen = tables.with_metadata(df, ["horizon", "psi_primary"])
    assert part.filter("psi_primary IS NOT NULL").count() == 6
    meta = tables.audit_metadata(seen)
    assert (meta["rows"], meta["ticker_count"], meta["tickers"], meta["horizons"], meta["date_min"], meta["date_max"]) == (12, 3, ["A.B", "CC", "DD"], [63, 126], "2026-01-01", "2026-01-03")
    assert meta["ticker_set_sha256"] == __import__("hashlib").sha256(b"A.B\nCC\nDD").hexdigest()
    small = tables.compact_panel(df, (126,))
    assert small.count() == 6 and small.filter("ticker = 'A-B'").count() == 2 and dict(small.dtypes)["date"] == "date" and tables.compact_panel(df).count() == 6


def test_empty_results_and_documents(spark, tmp_path):
    kinds = "return_mode string, horizon int, root double"
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "head.csv").write_text("return_mode,horizon,root\n")
    (tmp_path / "one.csv").write_text("return_mode,horizon,root\nraw,21,0.5\n")
    for name, n in (("none.csv", 0), ("empty.csv", 0), ("head.csv", 0), ("one.csv", 1)):
        got = tables.read_or_empty(spark, str(tmp_path / name), kinds)
        assert got.columns == ["return_mode", "horizon", "root"] and got.count() == n
    tables.write_document(spark, {"b": [1, 2], "a": "é"}, str(tmp_path / "p.json"))
    assert tables.read_document(spark, str(tmp_path / "p.json")) == {"a": "é", "b": [1, 2]}
    with pytest.raises(Exception, match="exist"):
        tables.write_document(spark, {}, str(tmp_path / "p.json"))


def regimes(spark, pairs):
    return spark.createDataFrame([("raw", h, r) for h, r in pairs], "return_mode string, horizon int, regime string")


COARSE = [(h, "R") for h in (133, 140, 147, 168)]


@pytest.mark.parametrize(("fine", "coarse", "want"), [
    ([(h, "R" if h >= 125 else "UNRESOLVED") for h in range(120, 134)], COARSE, (125, 124, "125,132,140", "")),
    ([(h, "UNRESOLVED" if h == 132 else "R") for h in range(120, 134)], COARSE, (133, 132, "133,140,147", "")),
    ([(h, "R" if h != 130 else "UNRESOLVED") for h in range(120, 134)], COARSE, (131, 130, "131,140,147", "")),
    ([(h, "R") for h in range(120, 134) if h != 131], COARSE, (132, 131, "132,140,147", "")),
    ([(h, "R" if h < 133 else "UNRESOLVED") for h in range(120, 134)], COARSE, (None, None, None, "coarse_upper_anchor_not_replicated_at_required_fold_support")),
    ([(h, "R") for h in range(120, 134)], [(140, "R"), (147, "M"), (168, "R")], (None, None, None, "refined_tail_fails_persistence_fraction")),
    ([(133, "R")], [(140, "UNRESOLVED"), (147, "R")], (None, None, None, "refined_onset_lacks_coarse_scale_persistence_anchors")),
])
def test_refined_onsets(spark, fine, coarse, want):
    r = inf.refined_onset(regimes(spark, fine), regimes(spark, coarse), 119, 133, 7, 3, 0.8).first()
    assert (r.hc_grid, r.hc_lower_exclusive, r.anchors, r.reason) == want and r.identified == (want[3] == "")
    c = inf.consensus_of_all_modes(inf.refined_onset(regimes(spark, fine), regimes(spark, coarse), 119, 133, 7, 3, 0.8).withColumn("s", F.lit(1)), ("s",)).first()
    assert c.identified == r.identified and (not c.identified or c.hc_months == pytest.approx(want[0] / 21))


def test_fixed_sequence_stops_and_needs_enough_folds(spark):
    rows = [("raw", f, h, True, True, "R", 0.2 if h == 130 and f <= 3 else 0.01, 0) for f in range(1, 5) for h in range(120, 134)]
    fine = spark.createDataFrame(rows, "return_mode string, fold int, horizon int, eligible boolean, certified boolean, phase string, p double, n_roots long")
    for passing, top in (((1, 2, 3), "R"), ((1, 2), "UNRESOLVED")):
        anchors = spark.createDataFrame([("raw", f, f in passing) for f in range(1, 5)], "return_mode string, fold int, certified_r boolean")
        got = {r.horizon: r.regime for r in inf.fixed_sequence_regimes(inf.fixed_sequence_gate(fine, anchors, 133)).collect()}
        assert got[133] == top and got[131] == top and got[130] == got[129] == "UNRESOLVED"
