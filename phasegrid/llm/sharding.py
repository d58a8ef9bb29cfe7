"""Shards of near equal bytes: minimax contiguous partition of groups of equal texts."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import gapless_rank, stored, table

#: Texts are ordered by hash; so many ranges of it are the atomic groups, however many rows there are. Equal texts share one.
CELLS = 1 << 16


def capacity(sizes: list[int], shards: int) -> int:
    """Smallest capacity under which the sizes, in order, fill at most so many shards (binary search, greedy check)."""
    ends = [0, *accumulate(sizes)]

    def feasible(c: int) -> bool:
        at = 0
        for _ in range(shards):
            at = bisect_right(ends, ends[at] + c) - 1
            if at == len(sizes):
                return True
        return False

    low, high = max([0, *sizes]), ends[-1]
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if feasible(mid) else (mid + 1, high)
    return low


def cuts(sizes: list[int], shards: int) -> list[int]:
    """Where each shard starts, and len(sizes): no shard above the smallest feasible capacity; within it, cuts lie nearest to equal parts of what is left."""
    c, ends, n = capacity(sizes, shards), [0, *accumulate(sizes)], len(sizes)
    first = [n]  # first[k]: from where on k shards hold the rest
    for _ in range(shards):
        first.append(bisect_left(ends, ends[first[-1]] - c))
    out = [0]
    for k in range(shards, 1, -1):
        at = out[-1]
        most, least = bisect_right(ends, ends[at] + c) - 1, max(at, first[k - 1])
        goal = ends[at] + (ends[n] - ends[at]) / k
        i = bisect_left(ends, goal, least, most + 1)
        if i > most or (i > least and goal - ends[i - 1] <= ends[i] - goal):
            i -= 1
        out.append(max(least, min(i, most)))
    return [*out, n]


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row.

    Rows are ordered by a hash of the text; the driver sees the sizes of CELLS hash ranges, finds the smallest
    shard capacity and cuts between ranges, so equal texts stay together and no shard exceeds the minimax. slot
    counts rows of a shard without gaps; ranges with many rows are cut into slices for that, so a hot text burdens no
    task. Null and empty texts are one group of size 1 a row (crc32 0); repeated rows each get a slot; clashing or extra
    columns of docs are ignored; an empty table gives no rows.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 48).cast("int").alias("cell"), F.xxhash64(text).alias("th"),
    )
    rows = stored(rows, "shard-rows")
    sizes, count = [0] * CELLS, [0] * CELLS
    for c, s, n in rows.groupBy("cell").agg(F.sum("size"), F.count("*")).collect():
        sizes[c], count[c] = s, n
    starts = cuts(sizes, shards)
    where = []
    for shard in range(shards):
        at = 0
        for c in range(starts[shard], starts[shard + 1]):
            if count[c]:
                where.append((c, shard, at))
                at += count[c]
    place = F.broadcast(spark.createDataFrame(where, "cell int, shard int, before long"))
    ranked = gapless_rank(rows, "cell", ["th", "doc_id"], "_rank")
    return ranked.join(place, "cell").select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("_rank")).alias("slot"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op4_sharding": op4_sharding}
ORACLES: dict[str, str] = {}
