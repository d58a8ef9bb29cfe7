"""Protocols as hash-locked dictionaries: canonical hashes, freezing, checks and verdicts. Small dictionaries at the driver; tables come in as metadata."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path
from typing import Any

#: Canonical forms in use: (the stored hash leaves the dictionary first, other types become text, non-ASCII stays as it is).
DIALECTS = {"plain": (False, True, False), "locked": (True, True, False), "unicode": (False, False, True), "locked_unicode": (True, False, True)}
HASH_KEY = "protocol_sha256"


def canonical_json(doc: dict[str, Any], dialect: str = "locked") -> str:
    """Sorted keys, no spaces."""
    pop, as_text, raw = DIALECTS[dialect]
    doc = {k: v for k, v in doc.items() if not (pop and k == HASH_KEY)}
    return json.dumps(doc, sort_keys=True, separators=(",", ":"), ensure_ascii=not raw, default=str if as_text else None)


def canonical_hash(doc: dict[str, Any], dialect: str = "locked") -> str:
    return hashlib.sha256(canonical_json(doc, dialect).encode()).hexdigest()


def file_hash(path: str, block: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with Path(path).open("rb") as f:
        while x := f.read(block):
            h.update(x)
    return h.hexdigest()


def tickers_hash(tickers: list[str]) -> str:
    """Of the sorted distinct tickers, one a line; equals the aggregate that audits compute over a panel."""
    return hashlib.sha256("\n".join(sorted(set(tickers))).encode()).hexdigest()


def frozen(doc: dict[str, Any], dialect: str = "locked") -> dict[str, Any]:
    """doc with its own hash."""
    return doc | {HASH_KEY: canonical_hash({k: v for k, v in doc.items() if k != HASH_KEY}, dialect)}


def verify(doc: dict[str, Any], dialect: str = "locked") -> None:
    """Fails closed if the hash is missing or the content has changed."""
    if doc.get(HASH_KEY) != frozen(doc, dialect)[HASH_KEY]:
        raise ValueError("the protocol's hash doesn't match its content")


def amended(doc: dict[str, Any], changes: dict[str, Any], reason: str, dialect: str = "locked") -> dict[str, Any]:
    """A frozen doc changed on the record: the old hash and the reason stay in it."""
    verify(doc, dialect)
    if not reason:
        raise ValueError("an amendment needs a reason")
    old = {"previous_sha256": doc[HASH_KEY], "reason": reason, "changed": sorted(changes)}
    return frozen({k: v for k, v in doc.items() if k != HASH_KEY} | changes | {"amendments": [*doc.get("amendments", []), old]}, dialect)


def check_horizons(coarse: list[int], fine: list[int], measured: list[int], anchor: int) -> None:
    """The design of a scan: measured horizons are the union of both grids, the fine one is gapless and ends at the anchor, which is coarse, too."""
    problems = []
    if set(measured) != set(coarse) | set(fine):
        problems.append("measured horizons differ from the grids' union")
    if sorted(fine) != list(range(min(fine), max(fine) + 1)):
        problems.append("the fine grid has gaps")
    if anchor != max(fine) or anchor not in coarse:
        problems.append("the anchor isn't the end of the fine grid and on the coarse one")
    if problems:
        raise ValueError("; ".join(problems))


def independence(first: dict[str, Any], second: dict[str, Any], kind: str = "universe") -> dict[str, Any]:
    """Whether two panels (their metadata: tickers, date_min, date_max) share no ticker, or the second starts after the first ends, or both."""
    overlap = sorted(set(first["tickers"]) & set(second["tickers"]))
    later = second["date_min"] > first["date_max"]
    passes = {"universe": not overlap, "time": later, "both": not overlap and later}[kind]
    return {"kind": kind, "overlap": overlap, "n_overlap": len(overlap), "strictly_later": later, "passes": passes}


def bind(protocol: dict[str, Any], tickers: list[str], used: list[str], least: int = 50, status: str = "FROZEN", dialect: str = "locked_unicode") -> dict[str, Any]:
    """A frozen protocol bound to a universe: of enough tickers, none used before; bound once only."""
    verify(protocol, dialect)
    if protocol.get("status") != status:
        raise ValueError(f"status is {protocol.get('status')!r}, not {status!r}")
    if "bound_sha256" in protocol:
        raise ValueError("already bound")
    seen = sorted(set(tickers) & set(used))
    if seen:
        raise ValueError(f"{len(seen)} tickers were used before: {seen[:5]}")
    if len(set(tickers)) < least:
        raise ValueError(f"{len(set(tickers))} tickers; {least} needed")
    return frozen({k: v for k, v in protocol.items() if k != HASH_KEY} | {"bound_tickers": sorted(set(tickers)), "bound_sha256": tickers_hash(tickers)}, dialect)


def audit_bound_panel(protocol: dict[str, Any], tickers: list[str], coverage: float = 0.8) -> dict[str, Any]:
    """Enough of the bound tickers are in the panel, and none from outside."""
    bound, there = set(protocol["bound_tickers"]), set(tickers)
    share = len(bound & there) / max(1, len(bound))
    return {"coverage": share, "outside": sorted(there - bound), "passes": share >= coverage and not there - bound}


def assess(phenomenon: bool, located: bool, independent: bool) -> dict[str, Any]:
    """The verdict of an independent validation: all three, or which is missing."""
    missing = [n for n, ok in (("phenomenon", phenomenon), ("localization", located), ("independence", independent)) if not ok]
    return {"confirmed": not missing, "missing": missing}


def manifest(config: dict[str, Any], tickers: list[str], spark_version: str) -> dict[str, Any]:
    return {"config": config, "universe_sha256": tickers_hash(tickers), "n_tickers": len(set(tickers)), "spark": spark_version}


def prospective(regions: list[dict[str, Any]], alpha: float = 0.05) -> dict[str, Any]:
    """A protocol for data to come: certified regions become hypotheses H1, H2, ... in order of their horizons."""
    tests = [{"name": f"H{i}", "alpha": alpha} | r for i, r in enumerate(sorted(regions, key=lambda r: (r["horizon"], r.get("low", 0))), 1)]
    return frozen({"hypotheses": tests, "alpha": alpha, "correction": "holm"})
