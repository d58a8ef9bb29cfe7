"""Periodic runs of words against every stretch tried."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from phasegrid.llm import tandem_runs
from phasegrid.llm.common import table

SF = "/root/testdata/sf0.001"


def brute_runs(w, least_words=6, least_times=4):
    """Every period: stretches of words equal to those one period on, whose smallest period it is."""
    out = []
    for q in range(1, len(w) // least_times + 1):
        i = 0
        while i < len(w) - q:
            j = i
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least_words, least_times * q) and not any(w[i : i + n - r] == w[i + r : i + n] for r in range(1, q)):
                out.append((i, n, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_words(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def brute_row(doc_id, text):
    w = brute_words(doc_id, text)
    runs = brute_runs(w)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    return doc_id, len(runs), s, n, q, 1000 * n // q if runs else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_small_alphabets_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        docs = []
        for _ in range(rng.integers(1, 5)):
            w = rng.integers(0, rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 2, 7, 20, 60])).tolist()
            if w and rng.random() < 0.5:
                a = int(rng.integers(len(w)))
                p = int(rng.integers(1, (len(w) - a) // 2 + 2))
                w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
            docs.append(w + w[: len(w) // 3] + w if rng.random() < 0.3 else w)
        least = [(2, 2), (6, 4), (4, 2), (3, 3)][rng.integers(4)]
        symbols = np.array([x + 7 * d for d, w in enumerate(docs) for x in [*w, 6]], np.int64)
        at = np.append(0, np.cumsum([len(w) + 1 for w in docs]))
        assert tandem_runs.find_runs(symbols, at, *least).tolist() == [[d, *r] for d, w in enumerate(docs) for r in brute_runs(w, *least)]


def test_query_equals_brute_force(spark):
    got = sorted(map(tuple, tandem_runs.op13_tandem_runs(spark, SF).collect()))
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got == sorted(brute_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 3


def test_odd_rows(spark, tmp_path):
    long = " ".join(["ab cd"] * 300_000)
    rows = [(i, t) for i, t in enumerate([None, "", " \t\n", "one", "x x x x x", "x x x x x x", "X x x x x x x", "é é é é é é é é é", "a b a b a b a b a", "a\x0bb\x0ca b a b a b c c c c c c", "p q r " * 4])] * 2 + [(None, "z " * 9), (None, None)]
    df = spark.createDataFrame([(*r, 1, "w", "r") for r in rows], "doc_id long, text string, n_words int, collapsed string, runs string")
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in tandem_runs.word_runs(df).collect()), key=str)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        runs = brute_runs(w)
        drop = {j for s, n, q in runs for j in range(s + q, s + n)}
        want.append((i, len(w), runs, b" ".join(x for j, x in enumerate(w) if j not in drop).decode()))
    assert got == sorted(want, key=str)
    r = tandem_runs.word_runs(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert ([tuple(x) for x in r.runs], r.collapsed) == ([(0, 600_000, 2)], "ab cd")
    assert tandem_runs.word_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tandem_runs.find_runs(np.array([0]), np.array([0, 1]), 6, 1)


def test_planted_null_id(spark):
    df = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    assert df.select(tandem_runs.planted(F.col("doc_id"), F.col("text")).alias("t")).first().t == "a b c"
