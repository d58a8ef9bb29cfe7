"""Exact top-k inner-product search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import drop_stored, stored, table

#: Vector components of a block (at most BLOCK_ROWS vectors), and of the queries that are searched at once.
BLOCK_SIZE, BLOCK_ROWS, TILE_SIZE = 1 << 20, 2048, 1 << 22
#: Bins of one refinement of the histograms. A task reports a query's highest bins only, so their number costs nothing.
BINS = 1 << 16
_BLOCK = "dim int, n int, ids binary, vecs binary, largest double, tile long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, v array<bigint>) = floor(scale * x); rows with a null vector or id, or null or non-finite parts, go."""
    x = F.transform(F.col(vec_col), lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).filter(F.col("id").isNotNull() & F.col("x").isNotNull() & fine).select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors of one length in blocks of bounded size: ids in 64 bits, components in 32 where they fit, else in 64."""
    held: dict[int, tuple[list, list]] = {}

    def block(dim: int) -> pa.RecordBatch:
        ids, vecs = (np.concatenate(x) for x in held.pop(dim))
        large = int(max(abs(int(vecs.min())), abs(int(vecs.max())))) if len(vecs) else 0
        kind = np.int32 if large < 2**31 else np.int64
        return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": [ids.tobytes()], "vecs": [vecs.astype(kind).tobytes()], "largest": [float(large)], "tile": pa.array([0], pa.int64())})

    for b in batches:
        ids, v = b.column(0).to_numpy(zero_copy_only=False), b.column(1)
        at, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
        dims = np.diff(at)
        for dim in np.unique(dims).tolist():
            own, rows = np.flatnonzero(dims == dim), max(1, min(BLOCK_ROWS, BLOCK_SIZE // max(1, dim)))
            for a in range(0, len(own), rows):
                part = own[a : a + rows]
                x = held.setdefault(dim, ([], []))
                x[0].append(ids[part])
                x[1].append(flat[at[part][:, None] + np.arange(dim)].reshape(-1) if dim else np.empty(0, np.int64))
                if sum(map(len, x[0])) >= rows:
                    yield block(dim)
    for dim in list(held):
        yield block(dim)


def _unpacked(dim: int, n: int, ids: bytes, vecs: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vecs, np.int64 if len(vecs) == 8 * n * dim else np.int32).reshape(n, dim)


def _scores(q: np.ndarray, c: np.ndarray, exact_float: bool) -> np.ndarray:
    """Exact integer products: by BLAS while every sum stays below 2^53, else in 64-bit integers."""
    return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64) if exact_float else q.astype(np.int64) @ c.astype(np.int64).T


def _tiles(queries: DataFrame) -> DataFrame:
    """Blocks of queries with tile: runs of blocks of one vector length that hold at most TILE_SIZE components together. The driver adds up one number a block."""
    sizes = queries.withColumn("block", F.monotonically_increasing_id())
    sizes = stored(sizes, "topk-queries")
    at, tile, left = [], -1, 0
    for block, dim, n in sorted(sizes.select("block", "dim", "n").collect(), key=lambda r: (r[1], r[0])):
        if not at or at[-1][2] != dim or left < n * max(1, dim):
            tile, left = tile + 1, TILE_SIZE
        left -= n * max(1, dim)
        at.append((block, tile, dim))
    place = queries.sparkSession.createDataFrame([r[:2] for r in at], "b long, t long")
    return stored(sizes.join(F.broadcast(place), F.col("block") == F.col("b")).withColumn("tile", F.col("t")).select(*queries.columns), "topk-tiles")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k largest inner products with rows of another id.

    vectors, queries: (id, v) as of quantised(). Queries go in tiles of at most TILE_SIZE components, which bounds what is sent to every task; candidates
    stay where they are stored and are scored there, so no vector is shuffled. Each round adds up, per query, counts of scores by bin, and narrows the
    bin that holds the kth value, until bins are one value wide. A task reports only bins from its own kth value up
    (lower ones can't hold the global kth), so a round shuffles some k rows a query and task. Then scores from the kth value up are
    kept, and ties go to the smaller id. Fewer than k others: all. Rows with an equal id never answer each other; of query
    rows with one id the least vector counts; vectors of other lengths are not compared; other columns are ignored; an empty table, or one without queries,
    gives no rows. Raises if scores could exceed 62 bits.
    """
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    cand = stored(vectors.select("id", "v").mapInArrow(_packed, _BLOCK), "topk-candidates")
    query = _tiles(queries.groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_packed, _BLOCK))
    top = cand.groupBy("dim").agg(F.max("largest").alias("c")).join(query.groupBy("dim").agg(F.max("largest").alias("q"), F.collect_set("tile").alias("tiles")), "dim").collect()
    out = None
    for dim, c, q, tiles in sorted(top, key=lambda r: r[0]):
        bound = dim * int(c) * int(q)
        if bound >= 1 << 62:
            raise ValueError(f"inner products of {dim} components up to {c} and {q} may exceed 62 bits")
        own = cand.filter(F.col("dim") == dim)
        for tile in sorted(tiles):
            part = _search(spark, own, [tuple(r) for r in query.filter(F.col("tile") == tile).select("dim", "n", "ids", "vecs").collect()], bound, k)
            out = part if out is None else out.union(part)
    drop_stored(cand, query)
    return spark.createDataFrame([], empty) if out is None else out


def _search(spark: SparkSession, cand: DataFrame, tile: list[tuple], bound: int, k: int) -> DataFrame:
    """The k best of each query of one tile, stored."""
    each = [_unpacked(*r) for r in tile]
    ids, vecs = np.concatenate([x[0] for x in each]), np.concatenate([x[1] for x in each])
    order = np.argsort(ids, kind="stable")
    ids, exact = ids[order], bound < 2**53
    shared = spark.sparkContext.broadcast((ids, vecs[order]))
    base, step = np.full(len(ids), -bound - 1, np.int64), -(-(2 * bound + 3) // BINS)

    def pairs(batches):
        """Scores of all queries with some candidates at a time; a candidate of the query's own id is masked."""
        qi, q = shared.value
        for b in batches:
            for r in b.to_pylist():
                ci, c = _unpacked(r["dim"], r["n"], r["ids"], r["vecs"])
                for lo in range(0, len(qi), 1024):
                    for at in range(0, len(ci), 1024):
                        cj = ci[at : at + 1024]
                        yield lo, cj, _scores(q[lo : lo + 1024], c[at : at + 1024], exact), qi[lo : lo + 1024, None] != cj[None, :]

    def histogram(base: np.ndarray, step: int):
        def count(batches):
            qi, found = shared.value[0], {}
            for lo, _, s, other in pairs(batches):
                # bins of this round: [base + j * step, base + (j + 1) * step); above the window all counts as bin BINS
                j = np.clip((s - base[lo : lo + 1024, None]) // step, -1, BINS)
                j[~other] = -1
                if j.shape[1] > k:
                    j = -np.partition(-j, k - 1, axis=1)[:, :k]
                old = found.get(lo)
                found[lo] = j if old is None else -np.sort(-np.concatenate([old, j], axis=1), axis=1)[:, :k]
            for lo, j in found.items():
                at = np.nonzero(j >= 0)
                key, n = np.unique(at[0] * (BINS + 1) + j[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(qi[lo + key // (BINS + 1)]), pa.array(key % (BINS + 1)), pa.array(n)], ["query_id", "bin", "n"])

        return count

    while True:
        counts = cand.mapInArrow(histogram(base, step), "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        reach = counts.withColumn("above", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.col("bin").desc())))
        # the highest bin at which at least k scores are reached; all scores together may be fewer: then the lowest bin
        kth = reach.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("above") >= k, F.col("bin"))), F.min("bin")).alias("bin")).toArrow()
        at = np.searchsorted(ids, kth.column("query_id").to_numpy())
        base = base.copy()
        base[at] += kth.column("bin").to_numpy() * step
        if step == 1:
            break
        step = max(1, -(-step // BINS))
    least = base

    def keep(batches):
        qi = shared.value[0]
        for lo, cj, s, other in pairs(batches):
            a, b = np.nonzero(other & (s >= least[lo : lo + 1024, None]))
            # ties of one block beyond its k smallest ids can't be among the first k
            order = np.lexsort((cj[b], -s[a, b], a))
            a, b = a[order], b[order]
            own = np.arange(len(a)) - np.searchsorted(a, a) < k
            a, b = a[own], b[own]
            yield pa.RecordBatch.from_arrays([pa.array(qi[lo + a]), pa.array(cj[b]), pa.array(s[a, b])], ["query_id", "vec_id", "score"])

    best = cand.mapInArrow(keep, "query_id long, vec_id long, score long")
    first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    out = best.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    out = stored(out, "topk-found")
    shared.unpersist()
    return out


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = quantised(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id", "embedding")
    return top_k(v, v.filter(F.col("id") % 50 == 0), 5)


QUERIES = {"op10_topk_search": op10_topk_search}
ORACLES = {
    "op10_topk_search": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
