"""Queries on isotonic fits of momentum by psi."""

from __future__ import annotations

from pyspark.sql import functions as F

from phasegrid.config import SMALL
from phasegrid.operators import isotonic as iso
from phasegrid.operators import splits
from phasegrid.oracles.base import with_panel
from phasegrid.plans.crosssection import _Q
from phasegrid.plans.panels import KEY, cells, panel, rounded


def evaluation(s, d):
    p = panel(s, d)
    return iso.evaluate_isotonic(p, splits.walkforward_folds(p), SMALL.horizons)


def _blocks(s, d):
    """Momentum by percentile in 20 bins, made to rise."""
    n = F.greatest(F.ceil(F.round(F.col("q_psi") * 20, 9)) - 1, F.lit(0)).cast("int")
    rows = cells(s, d).select("return_mode", "horizon", n.alias("bin"), "phase_label", F.lit(1.0).alias("one"))
    out = iso.isotonic_blocks(rows, ("return_mode", "horizon"), "bin", "phase_label", "one")
    return rounded(out.select("return_mode", "horizon", F.col("lo").cast("int").alias("lo"), F.col("hi").cast("int").alias("hi"), "p", F.col("weight").cast("long").alias("n")))


QUERIES = {
    "isotonic_evaluation": lambda s, d: rounded(evaluation(s, d)),
    "isotonic_boundary_summary": lambda s, d: rounded(iso.boundary_summary(evaluation(s, d))),
    "isotonic_boundary": lambda s, d: rounded(iso.isotonic_boundaries(panel(s, d))),
    "isotonic_blocks": _blocks,
}
_K = "return_mode, horizon"
ORACLES = {
    "isotonic_blocks": with_panel(KEY, SMALL, f"""{_Q}, b AS (SELECT {_K}, greatest(ceil(round(q_psi * 20, 9)) - 1, 0)::INT AS bin, count(*) AS w, sum(phase_label) AS s FROM xq GROUP BY ALL),
c AS MATERIALIZED (SELECT *, sum(w) OVER v AS cw, sum(s) OVER v AS cs FROM b WINDOW v AS (PARTITION BY {_K} ORDER BY bin ROWS UNBOUNDED PRECEDING)),
m AS (SELECT i.return_mode, i.horizon, i.bin, i.w, a.bin AS a, min((e.cs - a.cs + a.s) / (e.cw - a.cw + a.w)) AS low FROM c i JOIN c a ON i.return_mode = a.return_mode AND i.horizon = a.horizon AND a.bin <= i.bin JOIN c e ON e.return_mode = i.return_mode AND e.horizon = i.horizon AND e.bin >= i.bin GROUP BY ALL),
f AS (SELECT {_K}, bin, w, round(max(low), 9) AS fit FROM m GROUP BY ALL)
SELECT {_K}, min(bin) AS lo, max(bin) AS hi, round(fit, 6) AS p, sum(w)::BIGINT AS n FROM f GROUP BY {_K}, fit"""),
}
