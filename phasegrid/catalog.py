"""All registered queries and their SQL."""

from __future__ import annotations

from phasegrid.plans import audits, certification, crosssection, inference, isotonic, panels, roots, splits, surfaces


_MODULES = (panels, crosssection, splits, inference, certification, roots, surfaces, isotonic, audits)


def flagship(spark, sf_dir: str):
    """Daily mean robust upper-tail response by mode and horizon, on the one key that is dense in small data."""
    return crosssection.tail_daily_mean(spark, sf_dir, key="p_type")


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
