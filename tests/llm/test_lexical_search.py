"""Ranked lexical search against scores of every document, and against its SQL."""

import math
import re
from collections import Counter

import duckdb
import pytest

from phasegrid.llm import lexical_search
from phasegrid.llm.common import table

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute(docs, items, k):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    own = [(i, split(t)) for i, t in docs]
    own = [(i, Counter(t), len(t)) for i, t in own if t]
    n_docs, n_words = len(own), sum(n for *_, n in own)
    df = Counter(x for _, c, _ in own for x in c)
    w = {x: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * f + 1))) for x, f in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c, n in own:
            m = 25 + (75 * n * n_docs) // n_words
            s = sum(w[x] * ((10**9 * c[x]) // (1000 * c[x] + 8 * m)) for x in split(text) if x in c)
            if s > 0:
                scores.append((-s, i is None, i))
        scores.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(scores[:k], 1)]
    return sorted(out, key=str)


def answers(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_query_equals_sql_and_brute_force(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = answers(lexical_search.op12_lexical_search(spark, SF))
    assert got == sorted(con.execute(lexical_search.ORACLES["op12_lexical_search"]).fetchall(), key=str)
    rows = lambda t, i: [tuple(r) for r in table(spark, SF, t).select(i, "text").collect()]
    assert got == brute(rows("documents", "doc_id"), rows("benchmark", "item_id"), 10)


@pytest.mark.parametrize(("leaf", "branch", "tile", "most"), [(1, 2, 1 << 16, 1 << 21), (2, 2, 9, 1 << 21), (2, 3, 40, 10)])
def test_small_trees_and_tiles_with_ties(spark, monkeypatch, leaf, branch, tile, most):
    """Many equal texts, so that nodes of equal bounds hold smaller ids; blocks, trees and tiles of a few rows."""
    import random

    rng = random.Random(leaf + tile)
    docs = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([1, 2, 2, 3, 9])))) for i in range(120)]
    rng.shuffle(docs)
    docs += docs[:15]
    items = [(i, " ".join(rng.choice("abcdefghxy") for _ in range(rng.choice([1, 2, 5])))) for i in range(12)]
    df, queries = spark.createDataFrame(docs, "doc_id long, text string").coalesce(2), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    monkeypatch.setattr(lexical_search, "TILE_TERMS", tile)
    monkeypatch.setattr(lexical_search, "MOST_POSTINGS", most)
    # workers import the module anew: trees of a few rows are built here, in this process
    for name, value in (("LEAF", leaf), ("BRANCH", branch), ("BLOCK", leaf * branch * branch)):
        monkeypatch.setattr(lexical_search, name, value)
    local = Local()
    assert answers(local.search(docs, items, 5)) == brute(docs, items, 5)
    monkeypatch.undo()
    assert answers(lexical_search.search(df, queries, 5)) == brute(docs, items, 5)


class Local:
    """The same steps on lists, in this process, so that trees may be small."""

    def search(self, docs, items, k):
        terms = sorted({t for _, x in items for t in lexical_search.terms_of(x.encode())})
        place = {t: i for i, t in enumerate(terms)}
        own = [Counter(lexical_search.terms_of(x.encode())) for _, x in items]
        queries = lexical_search._Queries([len(c) for c in own], [place[t] for c in own for t in c], [n for c in own for n in c.values()])
        split = [(i, lexical_search.terms_of(t.encode())) for i, t in docs]
        n_docs, n_words = len(split), sum(len(t) for _, t in split)
        df = Counter(x for _, t in split for x in set(t))
        import numpy as np

        w = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in terms], np.int64)
        least, best = [1] * len(items), [[] for _ in items]
        size, leaf, branch = lexical_search.BLOCK, lexical_search.LEAF, lexical_search.BRANCH
        for a in range(0, len(split), size):
            part = split[a : a + size]
            rows = sorted((place[t], j, n) for j, (_, x) in enumerate(part) for t, n in Counter(x).items() if t in place)
            if not rows:
                continue
            term = np.array(sorted({r[0] for r in rows}), np.int32)
            m = np.array([25 + (75 * len(x) * n_docs) // n_words for _, x in part])
            t, pos, tf = (np.array(c) for c in zip(*rows, strict=True))
            score = w[t] * ((10**9 * tf) // (1000 * tf + 8 * m[pos]))
            low = np.zeros((len(term), branch * branch), np.int64)
            np.maximum.at(low, (np.searchsorted(term, t), pos // leaf), score)
            high = low.reshape(len(term), branch, branch).max(2)
            raw = {"ids": np.array([i for i, _ in part], np.int64), "terms": term, "ends": np.searchsorted(t, term, "right").astype(np.int32), "pos": pos.astype(np.uint16), "score": score, "low": low, "high": high, "root": high.max(1)}
            block = lexical_search._Block({c: v.tobytes() for c, v in raw.items()})
            for q in range(len(items)):
                there, times = queries.rows(q, block.terms)
                if len(there):
                    least[q] = block.search(there, times, best[q], k, least[q])
        out = []
        for (item, _), found in zip(items, best, strict=True):
            out += [(item, r, -d, s) for r, (s, d) in enumerate(sorted(found, reverse=True), 1)]
        self.rows = out
        return self

    def collect(self):
        from types import SimpleNamespace

        class Row(SimpleNamespace):
            def __getitem__(self, name):
                return getattr(self, name)

        return [Row(item_id=a, rank=b, doc_id=c, score=d) for a, b, c, d in self.rows]


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " \x00 -- "), (4, "One two"), (4, "One two"), (None, "one two"), (5, "ONE " * 300_000), (6, "Ünï ünï Ü"), (7, "a1b2 x_y")]
    items = [(1, None), (2, ""), (3, "one ONE zwei"), (3, "one ONE zwei"), (None, "two"), (4, "Ünï"), (5, "y x"), (6, "nowhere")]
    df = spark.createDataFrame([(*r, 1, "t", "b") for r in docs], "doc_id long, text string, score int, terms string, block string")
    queries = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    got = answers(lexical_search.search(df, queries, 3))
    assert got == brute(docs, items, 3) and got
    assert lexical_search.search(df.limit(0), queries).count() == 0
    assert lexical_search.search(df, queries.limit(0)).count() == 0
    assert lexical_search.search(df, queries).columns == ["item_id", "rank", "doc_id", "score"]
