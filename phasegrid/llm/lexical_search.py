"""Ranked lexical search: for each term a tree of the largest scores over ranges of documents, searched best first by branch and bound."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import drop_stored, small_batches, stored, table

#: Documents of the lowest ranges, branches of each node above them, and documents below a root.
LEAF, BRANCH = 64, 8
BLOCK = LEAF * BRANCH * BRANCH
#: Postings that close a block before it has all its documents; distinct terms of the queries that are searched at once.
MOST_POSTINGS, TILE_TERMS = 1 << 21, 1 << 16
#: Stands for a null id: it comes last among equal scores.
_NO_ID = np.iinfo(np.int64).max
#: ASCII capitals become small, other ASCII but letters and digits separates.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_POSTINGS = "block long, docs long, words long, ids binary, n binary, terms binary, ends binary, pos binary, tf binary"
_INDEX = "block long, ids binary, terms binary, ends binary, pos binary, score binary, low binary, high binary, root binary"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def query_tiles(items: DataFrame) -> DataFrame:
    """(tile, item_ids, sizes, terms, times) of items (item_id, text): rows that pack items of about TILE_TERMS distinct terms together; items without terms go."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 33, 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            flat = [x for _, c in held for x in c.items()]
            return pa.RecordBatch.from_pydict({
                "tile": pa.array([base + n], pa.int64()), "item_ids": pa.array([[i for i, _ in held]], pa.list_(pa.int64())), "sizes": pa.array([[len(c) for _, c in held]], pa.list_(pa.int32())),
                "terms": pa.array([[t for t, _ in flat]], pa.list_(pa.binary())), "times": pa.array([[k for _, k in flat]], pa.list_(pa.int64())),
            })

        size = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                own = Counter(terms_of(text))
                if held and size + len(own) > TILE_TERMS:
                    yield row()
                    held, size, n = [], 0, n + 1
                if own:
                    held.append((i, own))
                    size += len(own)
        if held:
            yield row()

    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return own.mapInArrow(pack, "tile long, item_ids array<long>, sizes array<int>, terms array<binary>, times array<long>")


def postings(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """Blocks of at most BLOCK documents where they are stored: ids, numbers of terms, and for each of `terms` in order the places of its documents in the block and how often they hold it."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, base, block = shared.value.get, TaskContext.get().partitionId() << 33, 0
        ids: list[int] = []
        sizes: list[int] = []
        keys: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            term, first = np.unique(key // BLOCK, return_index=True)
            ends = np.append(first[1:], len(key))[: len(term)]
            values = [base + block, len(ids), sum(sizes), np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes(), term.astype(np.int32).tobytes(), ends.astype(np.int32).tobytes(), (key % BLOCK).astype(np.uint16).tobytes(), tf.astype(np.int32).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], [c.split()[0] for c in _POSTINGS.split(", ")])

        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), _texts(b.column(1)), strict=True):
                own = terms_of(text)
                if not own:
                    continue
                hits = np.fromiter((x for x in map(find, own) if x is not None), np.int64)
                keys.append(hits * BLOCK + len(ids))
                ids.append(_NO_ID if i is None else i)
                sizes.append(len(own))
                held += len(hits)
                if len(ids) == BLOCK or held > MOST_POSTINGS:
                    yield row()
                    ids, sizes, keys, held, block = [], [], [], 0, block + 1
        if ids:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(build, _POSTINGS)


def _ints(value: bytes, kind=np.int64) -> np.ndarray:
    return np.frombuffer(value, kind)


def document_counts(blocks: DataFrame) -> dict[int, int]:
    """Documents that hold each term; at most the terms of a tile."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(_ints(r["terms"], np.int32)), pa.array(np.diff(_ints(r["ends"], np.int32), prepend=0).astype(np.int64))], ["term", "df"])

    each = blocks.select("terms", "ends").mapInArrow(count, "term int, df long")
    return {int(t): int(n) for t, n in each.groupBy("term").agg(F.sum("df")).collect()}


def max_trees(blocks: DataFrame, weight: np.ndarray, n_docs: int, n_words: int) -> DataFrame:
    """blocks with each posting's score and, of each term, the largest scores in ranges of LEAF documents (low), of BRANCH such ranges (high) and of the block (root)."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                term, ends, pos, tf = _ints(r["terms"], np.int32), _ints(r["ends"], np.int32), _ints(r["pos"], np.uint16), _ints(r["tf"], np.int32).astype(np.int64)
                m = 25 + (75 * _ints(r["n"]) * n_docs) // n_words
                row = np.repeat(np.arange(len(term)), np.diff(ends, prepend=0))
                score = weight[term[row]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[pos]))
                low = np.zeros(len(term) * (BLOCK // LEAF), np.int64)
                cell = row * (BLOCK // LEAF) + pos // LEAF
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                if len(first):
                    low[cell[first]] = np.maximum.reduceat(score, first)
                high = low.reshape(-1, BRANCH).max(1)
                values = [r["block"], r["ids"], r["terms"], r["ends"], r["pos"], score.tobytes(), low.tobytes(), high.tobytes(), high.reshape(-1, BRANCH).max(1).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], [c.split()[0] for c in _INDEX.split(", ")])

    return blocks.select("block", "ids", "n", "terms", "ends", "pos", "tf").mapInArrow(build, _INDEX)


class _Queries:
    """A tile's items: their terms as places in the tile's list, and how often each occurs."""

    def __init__(self, sizes: list[int], terms: list[int], times: list[int]) -> None:
        at = np.append(0, np.cumsum(sizes)).tolist()
        self.terms = [np.array(terms[a:b], np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]
        self.times = [np.array(times[a:b], np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]

    def rows(self, q: int, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of a block's terms (sorted) that the item holds, and how often."""
        at = np.minimum(np.searchsorted(there, self.terms[q]), len(there) - 1)
        ok = there[at] == self.terms[q]
        return at[ok], self.times[q][ok]


class _Block:
    def __init__(self, r: dict) -> None:
        self.ids, self.terms, self.pos, self.score = _ints(r["ids"]), _ints(r["terms"], np.int32), _ints(r["pos"], np.uint16), _ints(r["score"])
        self.root, self.high, self.low = _ints(r["root"]), _ints(r["high"]).reshape(-1, BRANCH), _ints(r["low"]).reshape(-1, BRANCH * BRANCH)
        ends = _ints(r["ends"], np.int32)
        row = np.repeat(np.arange(len(self.terms)), np.diff(ends, prepend=0))
        # where the postings of each term and lowest range begin
        self.first = np.append(0, np.cumsum(np.bincount(row * (BLOCK // LEAF) + self.pos // LEAF, minlength=len(self.terms) * (BLOCK // LEAF))))

    def scores(self, leaf: int, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of the documents of a lowest range."""
        cell = rows * (BLOCK // LEAF) + leaf
        size = self.first[cell + 1] - self.first[cell]
        at = np.arange(size.sum()) + np.repeat(self.first[cell] - (np.cumsum(size) - size), size)
        out = np.zeros(LEAF, np.int64)
        np.add.at(out, self.pos[at] - leaf * LEAF, np.repeat(times, size) * self.score[at])
        return out

    def search(self, rows: np.ndarray, times: np.ndarray, best: list[tuple[int, int]], k: int, least: int) -> int:
        """Add to best, a heap of (score, -id), the documents of this block that may be among the k best; the least score that still may.

        Nodes are opened in order of the sums of their terms' largest scores, for as long as that sum isn't below the least score; equal ones are opened, too.
        """
        queue = [(-int(times @ self.root[rows]), 0, 0)]
        while queue and -queue[0][0] >= least:
            _, level, i = heapq.heappop(queue)
            if level == 2:
                got = self.scores(i, rows, times)
                for j in np.flatnonzero(got >= least).tolist():
                    entry = (int(got[j]), -int(self.ids[i * LEAF + j]))
                    if len(best) < k:
                        heapq.heappush(best, entry)
                    elif entry > best[0]:
                        heapq.heapreplace(best, entry)
                    if len(best) == k:
                        least = max(least, best[0][0])
                continue
            bounds = times @ (self.high[rows] if level == 0 else self.low[rows, i * BRANCH : (i + 1) * BRANCH])
            for j in np.flatnonzero(bounds >= least).tolist():
                heapq.heappush(queue, (-int(bounds[j]), level + 1, i * BRANCH + j))
        return least


def _searched(index: DataFrame, queries: _Queries, least: np.ndarray, k: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """(item, doc_id, score): of each item the k best documents of each task's blocks with at least its least score; only: the items of each block, if not all."""
    shared = index.sparkSession.sparkContext.broadcast((queries, least, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, least, only = shared.value
        least, best = least.copy(), {}
        for b in batches:
            for r in b.to_pylist():
                items = range(len(queries.terms)) if only is None else only.get(r["block"], ())
                if not len(r["terms"]) or not items:
                    continue
                block = _Block(r)
                for q in items:
                    rows, times = queries.rows(q, block.terms)
                    if len(rows):
                        least[q] = block.search(rows, times, best.setdefault(q, []), k, int(least[q]))
        rows = [(q, -d, s) for q, h in best.items() for s, d in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    return index.mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): of each row of items (item_id, text) the k documents (doc_id, text) with the highest score above 0, all if fewer; ties by ascending doc_id.

    Items go in tiles of about TILE_TERMS terms, which bounds what is sent to tasks. For a tile, documents become blocks of postings where they are
    stored: no posting is shuffled, only counts of documents by term. Trees of largest scores over each block's ranges of documents are written with
    the blocks. Of each item the block with the highest bound is searched first; its kth score then cuts off nodes of all blocks, which each task goes through best
    first, keeping k documents an item; the driver gets a number an item and term of the tile. Null and empty texts have no terms: such documents don't count, such items
    get no rows. Repeated rows are documents, or items, of their own; null doc_ids come last among ties; other columns are ignored; an empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tiles = stored(query_tiles(items), "lexical-tiles")
    out = None
    for tile in sorted(r[0] for r in tiles.select("tile").collect()):
        part = _search_tile(docs, tiles.filter(F.col("tile") == tile).first(), k)
        out = part if out is None or part is None else out.unionByName(part)
    drop_stored(tiles)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def _search_tile(docs: DataFrame, tile, k: int) -> DataFrame | None:
    spark = docs.sparkSession
    terms = sorted({bytes(t) for t in tile.terms})
    place = {t: i for i, t in enumerate(terms)}
    queries = _Queries(tile.sizes, [place[bytes(t)] for t in tile.terms], tile.times)
    blocks = stored(postings(docs, terms), "lexical-postings")
    n_docs, n_words = blocks.agg(F.sum("docs"), F.sum("words")).first()
    if not n_docs:
        drop_stored(blocks)
        return None
    df = document_counts(blocks)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(terms))], np.int64)
    index = stored(max_trees(blocks, weight, n_docs, n_words), "lexical-index")
    drop_stored(blocks)
    shared = spark.sparkContext.broadcast(queries)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for b in batches:
            for r in b.to_pylist():
                there, root = _ints(r["terms"], np.int32), _ints(r["root"])
                if len(there):
                    each = [int(times @ root[rows]) for rows, times in (queries.rows(q, there) for q in range(len(queries.terms)))]
                    yield pa.RecordBatch.from_arrays([pa.array(range(len(each)), pa.int32()), pa.array([r["block"]] * len(each), pa.int64()), pa.array(each, pa.int64())], ["item", "block", "bound"])

    first: dict[int, list[int]] = {}
    for q, block in index.select("block", "terms", "root").mapInArrow(bounds, "item int, block long, bound long").groupBy("item").agg(F.max_by("block", F.struct("bound", "block"))).collect():
        first.setdefault(block, []).append(q)
    least = np.ones(len(queries.terms), np.int64)
    probe = _searched(index.filter(F.col("block").isin(list(first))), queries, least, k, first).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    for q, n, score in probe.collect():
        if n >= k:
            least[q] = score
    found = _searched(index, queries, least, k)
    ids = spark.createDataFrame(list(enumerate(tile.item_ids)), "item int, item_id long")
    w = Window.partitionBy("item").orderBy(F.col("score").desc(), "doc_id")
    out = found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).join(F.broadcast(ids), "item")
    out = stored(out.select("item_id", "rank", F.when(F.col("doc_id") < int(_NO_ID), F.col("doc_id")).alias("doc_id"), "score"), "lexical-found")
    drop_stored(index)
    return out


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


_TERMS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLES = {
    "op12_lexical_search": f"""
WITH d0 AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, t, len(t) AS n FROM d0 WHERE len(t) > 0),
g AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM d),
p AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) GROUP BY 1, 2, 3),
w AS (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY 1), g),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark) GROUP BY 1, 2),
s AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score FROM q JOIN p USING (term) JOIN w USING (term), g GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
}
