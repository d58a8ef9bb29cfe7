"""Queries on walk-forward splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.config import SEED, SMALL
from phasegrid.operators import splits as sp
from phasegrid.oracles.base import with_panel
from phasegrid.plans.panels import KEY, panel, rounded
from phasegrid.sources.tables import table

PURGE = max(SMALL.horizons)


def _purged(s, d):
    p = panel(s, d)
    return sp.fold_rows(p, sp.walkforward_folds(p), PURGE).groupBy("return_mode", "fold", "horizon", "part").agg(F.count("*").alias("n_rows"), F.countDistinct("date").alias("n_dates"), F.max("date").alias("last_date"))


def _supported(s, d):
    """Folds with enough rows on both sides."""
    g = _purged(s, d).groupBy("return_mode", "fold", "horizon").agg(F.sum(F.when(F.col("part") == "train", F.col("n_rows")).otherwise(0)).alias("train_rows"), F.sum(F.when(F.col("part") == "test", F.col("n_rows")).otherwise(0)).alias("test_rows"))
    return g.withColumn("eligible", (F.col("train_rows") >= 400) & (F.col("test_rows") >= 100))


def _loaco(s, d):
    """Leaving one class out: rows of the others before a fold's test block train, its own in the block test."""
    p = panel(s, d)
    rows = sp.fold_rows(p, sp.walkforward_folds(p), PURGE).groupBy("return_mode", "fold", "part", "asset_class").agg(F.count("*").alias("n"))
    total = rows.filter("part = 'train'").groupBy("return_mode", "fold").agg(F.sum("n").alias("all_train"))
    own = rows.groupBy("return_mode", "fold", "asset_class").pivot("part", ["train", "test"]).agg(F.sum("n")).na.fill(0)
    out = own.join(total, ["return_mode", "fold"])
    return out.select("return_mode", "fold", "asset_class", (F.col("all_train") - F.col("train")).alias("train_rows"), F.col("test").alias("test_rows"))


def _semi(s, d):
    """Panel rows on dates of the second walk-forward block."""
    p = panel(s, d)
    days = sp.fold_rows(p.select("return_mode", "date").distinct(), sp.walkforward_folds(p), PURGE).filter("fold = 2 AND part = 'test'")
    return rounded(p.join(days.select("return_mode", "date"), ["return_mode", "date"], "left_semi").groupBy("return_mode", "horizon").agg(F.count("*").alias("n"), F.avg("phase_product").alias("mean")))


def _days(s, d):
    o = table(s, d, "orders").select(F.col("o_orderdate").cast("date").alias("date")).distinct()
    return o.select("date", *(sp.minus_business_days(F.col("date"), n).alias(f"less_{n}") for n in (1, 5, 21, 126)))


def _sample(s, d):
    """Size and spread of a balanced sample."""
    out = sp.balanced_sample(panel(s, d).filter("horizon = 21"), 5000, SEED)
    return out.select("return_mode", "date", "ticker", "horizon")


QUERIES = {
    "walkforward_folds": lambda s, d: sp.walkforward_folds(panel(s, d)),
    "expanding_folds": lambda s, d: sp.expanding_folds(panel(s, d)),
    "purged_split_sizes": _purged,
    "split_support_gates": _supported,
    "loaco_split_sizes": _loaco,
    "date_semi_join": _semi,
    "business_day_purge": _days,
    "balanced_sample": _sample,
}


def _less(d: str, n: int) -> str:
    monday = f"CASE WHEN isodow({d}) > 5 THEN {d} + (8 - isodow({d}))::INT ELSE {d} END"
    return f"(({monday}) - ({7 * (n // 5) + n % 5} + CASE WHEN (CASE WHEN isodow({d}) > 5 THEN 0 ELSE isodow({d}) - 1 END) < {n % 5} THEN 2 ELSE 0 END)::INT)::DATE"


_WF = """, dd AS (SELECT return_mode, date, row_number() OVER (PARTITION BY return_mode ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY return_mode) AS n FROM (SELECT DISTINCT return_mode, date FROM panel)),
ds AS (SELECT *, greatest(1, floor(n * 0.5))::BIGINT AS st FROM dd),
df AS (SELECT *, """ + "CASE " + " ".join(f"WHEN i >= floor(st + (n - st) * {k} / 4.0) AND i < floor(st + (n - st) * {k + 1} / 4.0) THEN {k + 1}" for k in range(4)) + """ END AS fold FROM ds WHERE n - st >= 20),
wf AS (SELECT return_mode, fold::INT AS fold, min(date) AS test_start, max(date) AS test_end, count(*) AS n_test_dates FROM df WHERE fold IS NOT NULL GROUP BY 1, 2),
fr AS (SELECT p.*, fold, CASE WHEN date < """ + _less("test_start", PURGE) + """ THEN 'train' ELSE 'test' END AS part FROM panel p JOIN wf ON p.return_mode = wf.return_mode AND (date < """ + _less("test_start", PURGE) + """ OR date BETWEEN test_start AND test_end))"""
_P = lambda rest: with_panel(KEY, SMALL, rest)

ORACLES = {
    "walkforward_folds": _P(f"{_WF} SELECT * FROM wf"),
    "expanding_folds": _P(""", dd AS (SELECT return_mode, date, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY return_mode) AS n, lag(date) OVER w AS before FROM (SELECT DISTINCT return_mode, date FROM panel) WINDOW w AS (PARTITION BY return_mode ORDER BY date)),
e AS (SELECT *, i - n // 2 AS k, (n - n // 2) // 4 AS sz, (n - n // 2) % 4 AS more FROM dd WHERE n >= 10),
f AS (SELECT *, (CASE WHEN k < more * (sz + 1) THEN k // (sz + 1) ELSE more + (k - more * (sz + 1)) // sz END + 1)::INT AS fold FROM e WHERE k >= 0)
SELECT return_mode, fold, arg_min(before, date) AS train_end, min(date) AS test_start, max(date) AS test_end FROM f GROUP BY 1, 2"""),
    "purged_split_sizes": _P(f"{_WF} SELECT return_mode, fold, horizon, part, count(*) AS n_rows, count(DISTINCT date) AS n_dates, max(date) AS last_date FROM fr GROUP BY 1, 2, 3, 4"),
    "split_support_gates": _P(f"{_WF}, g AS (SELECT return_mode, fold, horizon, count(*) FILTER (part = 'train') AS train_rows, count(*) FILTER (part = 'test') AS test_rows FROM fr GROUP BY 1, 2, 3) SELECT *, train_rows >= 400 AND test_rows >= 100 AS eligible FROM g"),
    "loaco_split_sizes": _P(f"{_WF}, c AS (SELECT return_mode, fold, asset_class, count(*) FILTER (part = 'train') AS tr, count(*) FILTER (part = 'test') AS te FROM fr GROUP BY 1, 2, 3) SELECT return_mode, fold, asset_class, (sum(tr) OVER (PARTITION BY return_mode, fold) - tr)::BIGINT AS train_rows, te AS test_rows FROM c"),
    "date_semi_join": _P(f"{_WF} SELECT p.return_mode, p.horizon, count(*) AS n, round(avg(phase_product), 6) AS mean FROM panel p JOIN wf ON p.return_mode = wf.return_mode AND fold = 2 AND date BETWEEN test_start AND test_end GROUP BY 1, 2"),
    "business_day_purge": f"SELECT date, {', '.join(f'{_less("date", n)} AS less_{n}' for n in (1, 5, 21, 126))} FROM (SELECT DISTINCT o_orderdate::DATE AS date FROM orders)",
}
