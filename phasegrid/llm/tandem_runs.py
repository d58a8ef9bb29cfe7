"""Periodic runs of words by Gusfield and Stoye's linear-time method for tandem repeats, over batches of whole documents.

A square is two equal stretches side by side; a run of period q is a longest stretch in which words q apart are equal. Of each document:
blocks of the Lempel-Ziv parse give the squares that cover, by turns to the right, the first place of every square; turns along suffix links of the
document's suffix tree add the rest of the vocabulary; the leaves below squares of primitive roots are their places, and places in a row make a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import small_batches, table, words
from phasegrid.llm.packing import _runs as text_runs

#: Shortest run in words, and the least times that its period fits into it.
LEAST_WORDS, LEAST_TIMES = 6, 4
_FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Suffixes:
    """The suffixes of all documents of a batch in order; for each power of two the class of equal stretches of that many words at each place.

    symbols: of each document its words' numbers and an end mark that nothing equals; classes differ between documents. Words at each place
    are held 4 bytes a power of two up to the longest repeat.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        self.order = np.argsort(symbols, kind="stable")
        at, key = np.arange(n), symbols[self.order]
        rank, step = np.empty(n, np.int32), 1
        self.levels: list[np.ndarray] = []
        while True:
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(at)))
            rank[self.order[at]] = np.repeat(at[first], size)
            self.levels.append(rank)
            if len(self.levels) == 2:
                self.twice = at[np.repeat(size > 1, size)]  # in order, the suffixes whose first two words are found more than once
            at = at[np.repeat(size > 1, size)]
            if not len(at):
                break
            place = self.order[at]
            key = rank[place].astype(np.int64) * n + rank[place + step]
            by = np.argsort(key, kind="stable")
            self.order[at], key = place[by], key[by]
            rank, step = rank.copy(), 2 * step
        if len(self.levels) == 1:
            self.twice = at

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words from places a and b on."""
        n = np.zeros(len(a), np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            n += (self.levels[i][a + n] == self.levels[i][b + n]).astype(np.int64) << i
        return n

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal words up to places a < b, backwards."""
        n = np.zeros(len(a), np.int64)
        for i in range(len(self.levels) - 1, -1, -1):
            x, y = a - n - (1 << i) + 1, b - n - (1 << i) + 1
            n += ((x >= 0) & (self.levels[i][np.maximum(x, 0)] == self.levels[i][np.maximum(y, 0)])).astype(np.int64) << i
        return n

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, lengths): the longest stretch from a place that also starts earlier in its document, where that may be two words or more.

        Among earlier places the two next to it in the order of suffixes are the most alike.
        """
        x = self.order[self.twice]
        left, right = np.full(len(x), -1), np.full(len(x), -1)
        stack: list[int] = []
        values, before, after = x.tolist(), left.tolist(), right.tolist()
        for i, v in enumerate(values):
            while stack and values[stack[-1]] > v:
                after[stack.pop()] = i
            before[i] = stack[-1] if stack else -1
            stack.append(i)
        length = np.zeros(len(x), np.int64)
        for side in (np.array(before, np.int64), np.array(after, np.int64)):
            has = np.flatnonzero(side >= 0)
            length[has] = np.maximum(length[has], self.ahead(x[has], x[side[has]]))
        return x, length


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each unit of counts its row, and its number from 1 within the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def covering_squares(s: Suffixes, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of squares whose turns to the right reach the first place of each square; heads: starts of blocks, ends: the end of each one's document."""
    word = s.levels[0]
    if not len(heads):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    after = np.minimum(np.append(heads[1:], ends[-1]), ends)
    size = after - heads
    size_after = np.where(after < ends, np.append(size[1:], 0), 0)
    # the second half begins at the next block, or the first half ends in this one: both halves meet the next block's first word
    row, k = _spread(np.where(after < ends, size, 0))
    hit = np.flatnonzero(word[after[row] - k] == word[after[row]])
    k, h = k[hit], after[row[hit]]
    q = h - k
    ahead, behind = s.ahead(q, h), s.behind(q - 1, h - 1)
    ok = ahead + behind >= k
    start, period = [np.maximum(q - behind, q - k + 1)[ok]], [k[ok]]
    # the square begins before this block and reaches into it or the next one
    row, k = _spread(np.minimum(size + size_after, np.maximum(ends - heads - 1, 0)))
    h = heads[row]
    q = h + k
    hit = np.flatnonzero((word[h] == word[q]) & (h > 0) & (word[h - 1] == word[q - 1]))
    k, h, q, row = k[hit], h[hit], q[hit], row[hit]
    ahead, behind = s.ahead(h, q), s.behind(h - 1, q - 1)
    begin = np.maximum(h - behind, h - k + 1)
    ok = (ahead + behind >= k) & (begin + k <= after[row])
    start.append(begin[ok])
    period.append(k[ok])
    return np.concatenate(start), np.concatenate(period)


class Tree:
    """The suffix tree of the document at [begin, end] (its end mark included): inner nodes first, the root is 0, then leaves in order of suffixes."""

    def __init__(self, s: Suffixes, begin: int, end: int) -> None:
        order = s.order[begin : end + 1]
        m = len(order)
        shared = [*s.ahead(order[:-1], order[1:]).tolist(), 0]
        depth, lo, hi, up, leaf_up, stack = [0], [0], [m - 1], [0], [0] * m, [0]
        for i, b in enumerate(shared):
            if b > depth[stack[-1]]:
                stack.append(len(depth))
                depth.append(b), lo.append(i), hi.append(0), up.append(0)
            leaf_up[i] = stack[-1]
            while depth[stack[-1]] > b:
                v = stack.pop()
                hi[v] = i
                if depth[stack[-1]] < b:
                    stack.append(len(depth))
                    depth.append(b), lo.append(lo[v]), hi.append(0), up.append(0)
                up[v] = stack[-1]
        inner = len(depth)
        self.depth = depth + (end + 1 - order).tolist()
        self.lo, self.hi, self.up = lo + list(range(m)), hi + list(range(m)), up + leaf_up
        self.order, self.word, self.base = order.tolist(), s.levels[0][begin : end + 1].tolist(), begin
        above = np.array(self.up[1:])
        symbol = s.levels[0][order[np.array(self.lo[1:], np.int64)] + np.array(depth)[above]].astype(np.int64)
        self.width = int(s.levels[0][begin : end + 1].max()) + 1
        self.kids = dict(zip((above * self.width + symbol).tolist(), range(1, inner + m), strict=True))
        self.link = {0: 0}

    def down(self, node: int, at: int, length: int) -> tuple[int, int]:
        """(u, v): the edge, below node, on which the `length` words from place `at` end: depth(u) < length <= depth(v)."""
        depth, word, kids, width = self.depth, self.word, self.kids, self.width
        while True:
            v = kids[node * width + word[at - self.base + depth[node]]]
            if depth[v] >= length:
                return node, v
            node = v

    def linked(self, node: int) -> int:
        """The node of node's words but the first."""
        path = []
        while node not in self.link:
            path.append(node)
            node = self.up[node]
        for node in reversed(path):
            length, s = self.depth[node] - 1, self.link[self.up[node]]
            self.link[node] = s if self.depth[s] == length else self.down(s, self.order[self.lo[node]] + 1, length)[1]
        return self.link[node]

    def vocabulary(self, starts: list[int], periods: list[int]) -> list[tuple[int, int]]:
        """(node, period) of all squares of the document, each once, from those that cover them (sorted by start, then period)."""
        depth, seen, here, last = self.depth, set(), 0, -1
        for i, k in zip(starts, periods, strict=True):
            size = 2 * k
            u, v = self.down(here if i == last else 0, i, size)
            here, last = u, i
            while (v, k) not in seen:
                seen.add((v, k))
                first = self.word[i - self.base]
                s, d = self.linked(u), size - 1
                if depth[s] == d:
                    u, v = s, s
                else:
                    u, v = self.down(s, i + 1, d)
                if depth[v] == d:
                    u, v = v, self.kids.get(v * self.width + first, -1)
                    if v < 0:
                        break
                elif self.word[self.order[self.lo[v]] + d - self.base] != first:
                    break
                i = self.order[self.lo[v]]
        return list(seen)


def _primitive(s: Suffixes, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Whether squares' halves are no powers of anything shorter: for no prime r do they repeat after period / r."""
    ok = np.ones(len(at), bool)
    if not len(at):
        return ok
    factor = np.arange(int(period.max()) + 1)
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            own = factor[p * p :: p]
            own[own == np.arange(p * p, len(factor), p)] = p
    rest = period.copy()
    while True:
        open_ = np.flatnonzero(ok & (rest > 1))
        if not len(open_):
            return ok
        r = factor[rest[open_]]
        part = period[open_] // r
        ok[open_] = s.ahead(at[open_], at[open_] + part) < 2 * period[open_] - part
        while len(again := np.flatnonzero(rest[open_] % r == 0)):
            rest[open_[again]] //= r[again]
            open_, r = open_[again], r[again]


def find_runs(symbols: np.ndarray, at: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of at least least_words words and least_times (>= 2) periods, by document, start, period.

    symbols: numbers of the words of some documents, one after the other, each with an end mark; at: where each begins, and the end.
    A run of period q repeats all but its first q words earlier, so documents that repeat less need no tree.
    """
    if least_times < 2:
        raise ValueError("a run holds its period twice at least")
    s = Suffixes(symbols)
    place, length = s.previous()
    owner = np.searchsorted(at, place, "right") - 1
    k = np.arange(1, least_words + 1)
    short = int((np.maximum(least_words, least_times * k) - k).min())
    step = np.ones(len(symbols), np.int64)
    step[place] = np.maximum(length, 1)
    heads: list[int] = []
    ends: list[int] = []
    repeating = np.unique(owner[length >= short]) if short > 1 else np.arange(len(at) - 1)
    for d in repeating.tolist():
        i, end, known = int(at[d]), int(at[d + 1]) - 1, len(heads)
        steps, begin = step[i:end].tolist(), i
        while i < end:
            heads.append(i)
            i += steps[i - begin]
        ends.extend([end] * (len(heads) - known))
    start, period = covering_squares(s, np.array(heads, np.int64), np.array(ends, np.int64))
    by = np.lexsort((period, start))
    start, period = start[by], period[by]
    owner, found = np.searchsorted(at, start, "right") - 1, []
    for d in np.unique(owner).tolist():
        own = slice(*np.searchsorted(owner, [d, d + 1]))
        tree = Tree(s, int(at[d]), int(at[d + 1]) - 1)
        marks = np.array(tree.vocabulary(start[own].tolist(), period[own].tolist()), np.int64).reshape(-1, 2)
        low, high, p = np.array(tree.lo)[marks[:, 0]], np.array(tree.hi)[marks[:, 0]], marks[:, 1]
        ok = _primitive(s, np.array(tree.order)[low], p)
        low, high, p = low[ok], high[ok], p[ok]
        row, j = _spread(high - low + 1)
        x, p = np.array(tree.order)[low[row] + j - 1], p[row]
        by = np.lexsort((x, p))
        x, p = x[by], p[by]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1] + 1) | (p[1:] != p[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(x)) - 1
        found.append(np.column_stack([np.full(len(first), d), x[first] - at[d], x[last] + 2 * p[last] - x[first], p[first]]))
    rows = np.concatenate(found) if found else np.empty((0, 4), np.int64)
    rows = rows[rows[:, 2] >= np.maximum(least_words, least_times * rows[:, 3])]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def word_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed): periodic runs of each text's words, and its words without repeats.

    runs are ordered by start, then period; collapsed holds the words, joined by a space, less those that stand in some run after that run's first
    period. Each row is judged by itself, whole, in batches of about 2 MB of text (a longer text alone): nothing is shuffled. Null and empty texts
    have no words and no runs; repeated rows give repeated rows, null ids stay null; an empty table gives no rows; other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in text_runs(b.column(1)):
                split = [x.as_buffer().to_pybytes().split() if x.is_valid else [] for x in b.column(1)[lo:hi]]
                size = np.fromiter(map(len, split), np.int64, len(split))
                at = np.append(0, np.cumsum(size + 1))
                coded = pa.array(list(chain.from_iterable(split)), pa.binary()).dictionary_encode()
                kinds = len(coded.dictionary) + 1
                symbols = np.full(at[-1], kinds - 1, np.int64)
                inside = np.ones(at[-1], bool)
                inside[at[1:] - 1] = False
                symbols[inside] = coded.indices.to_numpy(zero_copy_only=False)
                symbols += np.repeat(np.arange(len(split)), size + 1) * kinds
                rows = find_runs(symbols, at, least_words, least_times)
                cuts = np.searchsorted(rows[:, 0], np.arange(len(split) + 1)).tolist()
                runs, text = [], []
                for d, own in enumerate(split):
                    each = rows[cuts[d] : cuts[d + 1], 1:].tolist()
                    if each:
                        keep = np.ones(len(own), bool)
                        for start, length, period in each:
                            keep[start + period : start + length] = False
                        own = [own[i] for i in np.flatnonzero(keep).tolist()]
                    runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in each])
                    text.append(b" ".join(own).decode())
                kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array(size), pa.array(runs, kind), pa.array(text, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _FOUND)


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def planted(doc_id: Column, text: Column) -> Column:
    """The text to search: of a tenth of the documents, chosen by a hash of the id, all words from a place on repeat those that follow the place. Null ids: as it is."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def repeat(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("int")
        return F.when(n > 0, _bound(F.struct(a.alias("a"), p.alias("p")), lambda x: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < x["a"], i).otherwise(x["a"] + (i - x["a"]) % x["p"]))), " ")))

    return F.when(h % 10 == 0, _bound(words(text), repeat)).otherwise(text)


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    out = word_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.withColumns({"_b": best, "n_runs": F.size("runs").cast("long")})
    length, period = -F.col("_b.l"), F.col("_b.period")
    return out.select("doc_id", "n_runs", F.col("_b.start").alias("start"), length.alias("length"), period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES = {"op13_tandem_runs": op13_tandem_runs}
ORACLES: dict[str, str] = {}
