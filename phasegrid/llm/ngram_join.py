"""Near-duplicate join on word n-gram sets by vertical partitioning of the global n-gram order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import worker_memory
from phasegrid.llm.common import bloom_joins, drop_stored, release, small_batches, stored, table
from phasegrid.llm.text_hash import mix, shingle_sets

#: Words of an n-gram; percent of the union that two linked sets share at least.
WIDTH, PERCENT = 5, 75
#: n-grams of at least so many documents come last in the global order (more, if they would exceed MAX_COMMON).
COMMON = 12
MAX_COMMON = 1 << 20
#: The global order is cut into so many fragments of rare n-grams, then so many of common ones; overlaps in the first HEAD rule pairs out.
RARE_FRAGMENTS, COMMON_FRAGMENTS, HEAD = 4, 2, 2
#: A set in more pairs than this meets its partners in several tasks.
HOT = 64
#: Posting lists of at most so many sets compare all pairs at once; longer ones go by pivots first.
SHORT = 32
PIVOT_ROUNDS = 4
#: Long lists end in all pairs across components once these are at most so many times their rows.
PAIRS_A_ROW = 1024
_U = np.uint64


def _signed(x: np.ndarray) -> np.ndarray:
    """Hashes as signed integers in the same order."""
    return (x ^ _U(1 << 63)).view(np.int64)


def _flush(held: list[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Per fragment (top bits of the hash) the sorted next 32 bits, as differences: a few bytes an n-gram once compressed."""
    x = np.sort(np.concatenate(held))
    part = (x >> _U(64 - bits)).astype(np.int64)
    low = ((x >> _U(32 - bits)) & _U(0xFFFFFFFF)).astype(np.uint32)
    at = np.searchsorted(part, np.arange((1 << bits) + 1))
    codec = pa.Codec("zstd", compression_level=1)
    ids, blobs, sizes = [], [], []
    for f in range(1 << bits):
        own = low[at[f] : at[f + 1]]
        if len(own):
            d = np.diff(own, prepend=own[:1] * 0).astype("<u4")
            # bytes of equal weight lie together: the high ones are nearly all zero
            blobs.append(codec.compress(d.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True))
            ids.append(f)
            sizes.append(len(own))
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())], ["fragment", "n", "blob"])


def common_ngrams(docs: DataFrame, width: int, least: int, most: int) -> tuple[int, np.ndarray]:
    """Bits and sorted prefixes (bits + 32 bits of the hash) of n-grams that at least a bound of documents hold.

    All documents count. Each fragment of the order is counted on its own. The bound is `least`, or, if there are more than `most`
    such n-grams, the power of 2 from which there are not: the driver and the broadcast hold at most `most` numbers.
    """
    spark = docs.sparkSession
    bits = min(21, max(6, int(np.ceil(np.log2(2 * max(1, docs.rdd.getNumPartitions()))))))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_memory.start("ngrams")
        held, n = [], 0
        for b in batches:
            for x in shingle_sets(b.column(0), width):
                held.append(x)
                n += len(x)
                if n >= 1 << 21:
                    yield from _flush(held, bits)
                    held, n = [], 0
        if n:
            yield from _flush(held, bits)

    def count(t: pa.Table) -> pa.Table:
        codec, parts = pa.Codec("zstd"), []
        for n, blob in zip(t.column("n").to_pylist(), t.column("blob").to_pylist(), strict=True):
            d = np.frombuffer(codec.decompress(blob, 4 * n), np.uint8).reshape(4, n).T
            parts.append(np.cumsum(np.ascontiguousarray(d).view("<u4").reshape(-1), dtype=np.uint32))
        x = np.sort(np.concatenate(parts))
        edge = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        k = np.diff(edge)
        own = k >= least
        f = t.column("fragment")[0].as_py()
        key = (np.int64(f) << np.int64(32)) | x[edge[:-1]][own].astype(np.int64)
        return pa.table({"key": pa.array(key, pa.int64()), "k": pa.array(k[own].astype(np.int64))})

    found = stored(docs.select("text").mapInArrow(grams, "fragment int, n long, blob binary").groupBy("fragment").applyInArrow(count, "key long, k long"), "common-ngrams")
    by_size = sorted(found.groupBy(F.floor(F.log2("k")).cast("int").alias("p")).count().collect(), reverse=True)
    bound, n = least, sum(k for _, k in by_size)
    while n > most:
        p, k = by_size.pop()
        bound, n = 2 << p, n - k
    keys = np.sort(found.filter(F.col("k") >= bound).select("key").toArrow().column(0).to_numpy().astype(np.int64))
    drop_stored(found)
    release(spark)
    return bits, keys


class Order:
    """The global order of n-grams: rare ones by hash, then common ones by hash."""

    def __init__(self, docs: DataFrame, width: int, common: int) -> None:
        self.bits, keys = common_ngrams(docs, width, common, MAX_COMMON)
        self.keys = docs.sparkSession.sparkContext.broadcast(keys)

    def is_common(self, x: np.ndarray) -> np.ndarray:
        keys = self.keys.value
        if not len(keys):
            return np.zeros(len(x), bool)
        own = (x >> _U(32 - self.bits)).astype(np.int64)
        return keys[np.minimum(np.searchsorted(keys, own), len(keys) - 1)] == own

    def arranged(self, x: np.ndarray) -> tuple[np.ndarray, int]:
        """Sorted hashes in the order, and how many of them are rare."""
        hot = self.is_common(x)
        few = len(x) - int(hot.sum())
        return (x if few == len(x) else np.concatenate([x[~hot], x[hot]])), few

    def fragments(self, x: np.ndarray, few: int) -> np.ndarray:
        """Where each fragment of arranged hashes starts, and their number."""
        at = [np.searchsorted(part, np.arange(1, n, dtype=np.uint64) * _U(2**64 // n)) for part, n in ((x[:few], RARE_FRAGMENTS), (x[few:], COMMON_FRAGMENTS))]
        return np.concatenate([[0], at[0], [few], few + at[1], [len(x)]]).astype(np.int64)


def ngram_sets(docs: DataFrame, order: Order, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, n_shingles, set_id, rare, prefix, row) of each row, stored.

    th: hash of the text. set_id: hash of the whole n-gram set (null if empty); rows of one set_id hold equal sets. prefix: in
    the global order (rare n-grams by hash, then common ones), the first n - ceil(percent% of n) + 1: two linked
    sets share one of them. rare: how many n-grams of the set are rare.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                sizes, ids, rare, prefixes = [], [], [], []
                for x in shingle_sets(part.column(2), width):
                    n = len(x)
                    sizes.append(n)
                    if not n:
                        ids.append(None)
                        rare.append(0)
                        prefixes.append(np.empty(0, np.int64))
                        continue
                    ids.append(int(mix(np.array([mix(x).sum() + _U(n)], np.uint64)).view(np.int64)[0]))
                    most = n - -(-percent * n // 100) + 1
                    x, few = order.arranged(x)
                    rare.append(few)
                    prefixes.append(_signed(x[:most]))
                at = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
                flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(rare, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(flat))], ["doc_id", "th", "n_shingles", "set_id", "rare", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text").mapInArrow(make, "doc_id long, th long, n_shingles long, set_id long, rare int, prefix array<long>")
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "ngram-sets")


def _can_link(p: str, q: str, percent: int):
    """Whether this may be the first n-gram that two linked sets share: from its places on, both sets have enough left for the overlap that their sizes ask for."""
    left = F.least(F.col(f"{p}n") - F.col(f"{p}pos"), F.col(f"{q}n") - F.col(f"{q}pos"))
    return left * (100 + percent) >= percent * (F.col(f"{p}n") + F.col(f"{q}n"))


def _sets_of(pairs: DataFrame) -> DataFrame:
    return stored(pairs.select(F.col("a").alias("set_id"), F.col("an").alias("n")).union(pairs.select("b", "bn")).distinct(), "ngram-ids")


def _dealt(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs with sa and sb, and the sets (node, parts) in more than HOT pairs: their partners are dealt out over so many parts, so no task gets all of them."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).groupBy("node").count()
    hot = stored(ends.filter(F.col("count") > HOT).select("node", F.ceil(F.col("count") / HOT).cast("int").alias("parts")), "ngram-hot")
    # keys are wrapped, so that both sides are dealt out for the join alone and a hot key can be split
    side = lambda p: hot.select(F.concat(F.col("node").cast("string"), F.lit("")).alias(f"_{p}"), F.col("parts").alias(f"_p{p}"))
    out = pairs.join(side("a"), F.col("a").cast("string") == F.col("_a"), "left").join(side("b"), F.col("b").cast("string") == F.col("_b"), "left")
    salt = lambda p, other: F.pmod(F.xxhash64(other), F.coalesce(f"_p{p}", F.lit(1))).cast("int").alias(f"s{p}")
    return out.select("a", "an", "b", "bn", salt("a", "b"), salt("b", "a")), hot


def _copies(df: DataFrame, hot: DataFrame) -> DataFrame:
    """df (with set_id) with salt: rows of hot sets once for each part of their partners."""
    out = df.join(hot, F.col("set_id") == F.col("node"), "left")
    return out.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("node", "parts")


def _still_possible(pairs: DataFrame, firsts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, an, b, bn) those that their rare prefixes do not rule out; stored, with sa and sb.

    Up to the lesser of both prefixes' ends all shared n-grams are seen; beyond it at most as many as either set has left.
    """
    ids = _sets_of(pairs)
    dealt, hot = _dealt(pairs)
    with bloom_joins(pairs.sparkSession):
        own = stored(firsts.join(ids.filter("n > 0"), "set_id", "left_semi").select("set_id", "prefix", "rare"), "ngram-own")
    own = _copies(own, hot)
    side = lambda p, x: own.select(F.col("set_id").alias(p), F.col("salt").alias(f"s{p}"), F.col("prefix").alias(x), F.col("rare").alias(f"{x}r"))
    both = dealt.join(side("a", "x"), ["a", "sa"]).join(side("b", "y"), ["b", "sb"])

    @F.arrow_udf("int")
    def bound(x: pa.Array, xr: pa.Array, y: pa.Array, yr: pa.Array, an: pa.Array, bn: pa.Array) -> pa.Array:
        lists = []
        for v, r in ((x, xr), (y, yr)):
            at, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            lists.append((at[:-1], at[1:], flat, r.to_numpy(zero_copy_only=False)))
        an, bn, out = an.to_numpy(zero_copy_only=False), bn.to_numpy(zero_copy_only=False), np.empty(len(x), np.int32)
        (x0, x1, xs, xr), (y0, y1, ys, yr) = lists
        for i in range(len(out)):
            p, q = xs[x0[i] : min(x0[i] + xr[i], x1[i])], ys[y0[i] : min(y0[i] + yr[i], y1[i])]
            ends = [v[-1] for v, own in ((p, xr[i]), (q, yr[i])) if len(v) < own]
            if ends:
                p, q = (v[: np.searchsorted(v, min(ends), "right")] for v in (p, q))
            shared = np.count_nonzero(q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p) if len(p) and len(q) else 0
            out[i] = shared + min(an[i] - len(p), bn[i] - len(q))
        return pa.array(out)

    kept = both.withColumn("most", bound("x", "xr", "y", "yr", "an", "bn")).filter(F.col("most") * (100 + percent) >= percent * (F.col("an") + F.col("bn")))
    kept = stored(kept.select("a", "an", "b", "bn"), "ngram-possible")
    drop_stored(ids, hot)
    return kept


def _fragments(docs: DataFrame, rows: DataFrame, pairs: DataFrame, order: Order, width: int) -> DataFrame:
    """(set_id, front, back) of the sets in pairs: their n-grams, an array for each of the first HEAD fragments of the global order and for each of the others; read again from one text of each set; stored."""
    ids = _sets_of(pairs)
    first = rows.join(ids, "set_id", "left_semi").groupBy("set_id").agg(F.min(F.struct("doc_id", "th")).alias("r"), F.max("n_shingles").alias("_n"))
    first = stored(first.select("set_id", F.col("r.doc_id").alias("_id"), F.col("r.th").alias("_th"), "_n"), "ngram-first")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    own = own.join(first.filter("_n > 0"), (F.col("th") == F.col("_th")) & F.col("doc_id").eqNullSafe(F.col("_id"))).select("set_id", "text")

    last = RARE_FRAGMENTS + COMMON_FRAGMENTS

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                ids, ends, flat = part.column(0), [np.zeros(1, np.int64)], []
                for x in shingle_sets(part.column(1), width):
                    x, few = order.arranged(x)
                    ends.append(ends[-1][-1] + order.fragments(x, few)[1:])
                    flat.append(_signed(x))
                grams, at = pa.array(np.concatenate(flat)), np.concatenate(ends).astype(np.int32)
                inner = pa.ListArray.from_arrays(pa.array(at), grams)
                each = np.arange(part.num_rows, dtype=np.int32)[:, None] * last
                take = lambda lo, hi: pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * (hi - lo)), inner.take(pa.array((each + np.arange(lo, hi, dtype=np.int32)).reshape(-1))))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([ids, take(0, HEAD), take(HEAD, last)], ["set_id", "front", "back"])

    cuts = own.mapInArrow(cut, "set_id long, front array<array<long>>, back array<array<long>>")
    with bloom_joins(docs.sparkSession):  # few of the texts are wanted
        cuts = stored(cuts, "ngram-fragments")
    if cuts.count() > first.filter("_n > 0").count():  # rows repeated with id and text: one of each set stays
        every, cuts = cuts, stored(cuts.dropDuplicates(["set_id"]), "ngram-fragments")
        drop_stored(every)
    drop_stored(ids, first)
    return cuts


def _links(pairs: DataFrame, fragments: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, an, b, bn) those that link: partial overlaps counted in each fragment of the order, summed per pair.

    The first HEAD fragments are counted first; pairs that they rule out (what they show as shared, and all that either set holds after them, is too
    little) don't meet in the others.
    """
    pair = ["a", "an", "b", "bn"]
    enough = lambda overlap: overlap * (100 + percent) >= percent * (F.col("an") + F.col("bn"))
    size = lambda fragments: F.aggregate(fragments, F.lit(0), lambda n, f: n + F.size(f))

    def counted(pairs: DataFrame, some: str) -> DataFrame:
        dealt, hot = _dealt(pairs)
        own = _copies(fragments.select("set_id", some), hot)
        left = own.select(F.col("set_id").alias("a"), F.col("salt").alias("sa"), F.col(some).alias("x"))
        right = own.select(F.col("set_id").alias("b"), F.col("salt").alias("sb"), F.col(some).alias("y"))
        parts = F.zip_with("x", "y", lambda x, y: F.size(F.array_intersect(x, y)))
        return dealt.join(left, ["a", "sa"]).join(right, ["b", "sb"]).select(*pair, F.aggregate(parts, F.lit(0), lambda n, k: n + k).alias("overlap"), size(F.col("x")).alias("nx"), size(F.col("y")).alias("ny"))

    first = counted(pairs, "front").filter(enough(F.col("overlap") + F.least(F.col("an") - F.col("nx"), F.col("bn") - F.col("ny")))).select(*pair, "overlap")
    first = stored(first, "ngram-part")
    total = first.union(counted(first.select(*pair), "back").select(*pair, "overlap")).groupBy(*pair).agg(F.sum("overlap").alias("overlap"))
    return total.filter(enough(F.col("overlap"))).select("a", "b", "overlap")


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of the links (a, b): root is the least node of its component. Stored each round; ends when no root moves."""
    both = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links-both")
    root = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "roots")
    while True:
        near = both.join(root.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = root.join(near, "node").select("node", F.least("root", "near").alias("next"), "root")
        # the root's own root, too: chains halve
        jump = root.select(F.col("node").alias("next"), F.col("root").alias("jump"))
        new = stored(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("jump", "next")).alias("root"), (F.least("next", F.coalesce("jump", "next")) != F.col("root")).alias("moved")), "roots")
        moved = new.filter("moved").limit(1).count()
        drop_stored(root)
        root = new.drop("moved")
        if not moved:
            drop_stored(both)
            return root


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, common: int = COMMON) -> tuple[DataFrame, DataFrame]:
    """Membership and links of documents whose n-gram sets share at least percent of their union.

    Membership: (doc_id, th, n_shingles, set_id, component) for each row, th a hash of its text; component is the least
    set_id reachable by links (null for rows without words, linked with nothing). Links: (a, b, overlap) between set ids, enough
    of them to connect every component; equal sets share a set_id, so copies never form pairs.

    1. A sketch of the whole corpus finds common n-grams; they go last in the global n-gram order, so a passage that
       many documents share makes none of them candidates. 2. Prefixes in that order give posting lists; lists with one set
       go. 3. Pairs of short lists, and of long ones each set with a pivot, are bounded by the prefixes; the rest get partial overlaps in
       each fragment of the order, summed per pair. 4. Long lists whose sets are still in several components take new pivots, at last all pairs across components:
       exact, while a large group of near copies costs a few pairs a copy. Sets of n-grams are compared as 64-bit hashes.

    Null and empty texts have no n-grams; repeated rows share a set; null doc_ids are kept; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    order = Order(docs, width, common)
    sets = ngram_sets(docs, order, width, percent)
    rows = sets.drop("prefix", "rare")
    # one row of each set
    least = rows.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(F.min("row").alias("row")).select("row")
    firsts = stored(sets.join(least, "row").select("set_id", F.col("n_shingles").cast("int").alias("n"), (F.col("n_shingles") - F.col("rare")).cast("int").alias("c"), "rare", "prefix"), "ngram-firsts")
    grams = firsts.select("set_id", "n", "c", F.posexplode("prefix").alias("pos", "gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("k")).filter("k > 1").select(F.col("gram").alias("_g"), "k")
    shared = stored(shared, "ngram-shared")
    with bloom_joins(spark):  # most n-grams are in one set only, and go before they are shuffled
        posts = stored(grams.join(shared, F.col("gram") == F.col("_g")).drop("_g"), "ngram-posts")
    drop_stored(shared)
    rows = stored(rows.drop("row"), "ngram-rows")
    release(spark)

    def side(df: DataFrame, p: str, *more: str) -> DataFrame:
        return df.select("gram", *(F.col(c).alias(p + c) for c in ("set_id", "n", "c", "pos", *more)))

    def as_pairs(df: DataFrame) -> DataFrame:
        less = F.col("pset_id") < F.col("qset_id")
        first = lambda c: F.when(less, F.col("p" + c)).otherwise(F.col("q" + c))
        second = lambda c: F.when(less, F.col("q" + c)).otherwise(F.col("p" + c))
        return df.select(first("set_id").alias("a"), first("n").alias("an"), second("set_id").alias("b"), second("n").alias("bn")).distinct()

    def pivoted(posts: DataFrame, turn: int) -> DataFrame:
        """Each set of a list beside the list's pivot: the set with the largest share of common n-grams, which lies nearest to the others, at first; then by a hash of set and turn."""
        order = F.struct(F.col("c") / F.col("n") if turn == 0 else F.lit(0.0), F.xxhash64(F.lit(turn), "set_id").alias("o"), "set_id", "n", "c", "pos")
        pick = posts.groupBy("gram").agg(F.max(order).alias("m"))
        # the key is wrapped, so that both sides are dealt out for the join alone and a long list can be split
        pick = pick.select(F.concat(F.col("gram").cast("string"), F.lit("")).alias("_g"), *(F.col(f"m.{x}").alias(f"q{x}") for x in ("set_id", "n", "c", "pos")))
        return side(posts, "p").join(pick, F.col("gram").cast("string") == F.col("_g")).filter((F.col("pset_id") != F.col("qset_id")) & _can_link("p", "q", percent))

    few, many = posts.filter(F.col("k") <= SHORT), posts.filter(F.col("k") > SHORT)
    close = side(few, "p").join(side(few, "q"), "gram").filter((F.col("pset_id") < F.col("qset_id")) & _can_link("p", "q", percent))
    tried = [stored(as_pairs(close).union(as_pairs(pivoted(many, 0))).distinct(), "ngram-pairs")]
    # a row of each set in long lists, with its places in them
    held = stored(many.groupBy("set_id", "n", "c").agg(F.collect_list(F.struct("gram", "pos")).alias("l")), "ngram-long")
    links, turn, last = None, 0, False
    while True:
        turn += 1
        possible = _still_possible(tried[-1], firsts, percent)
        release(spark)
        more = stored(_links(possible, _fragments(docs, rows, possible, order, width), percent), "ngram-links")
        release(spark)
        links = more if links is None else links.union(more)
        if turn == 1 or more.limit(1).count():
            root = components(links)
        if last:
            break
        # lists whose sets are in several components; within a component nothing is left to find
        now = held.join(root.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
        now = now.select("set_id", "n", "c", "root", F.explode("l").alias("e")).select("set_id", "n", "c", "root", "e.gram", "e.pos")
        parts = now.groupBy("gram", "root").count().groupBy("gram").agg(F.sum("count").alias("m"), ((F.sum("count") ** 2 - F.sum(F.col("count") ** 2)) / 2).alias("across"))
        parts = stored(parts.filter("across > 0"), "ngram-open")
        size, across = parts.agg(F.sum("m"), F.sum("across")).first()
        if not size:
            break
        now = stored(now.join(parts.select("gram"), "gram", "left_semi"), "ngram-now")
        if turn <= PIVOT_ROUNDS and across > PAIRS_A_ROW * size:
            new = pivoted(now, turn)
        else:
            new = side(now, "p", "root").join(side(now, "q", "root"), "gram").filter((F.col("proot") < F.col("qroot")) & _can_link("p", "q", percent))
            last = True
        fresh = stored(as_pairs(new), "ngram-new")
        for old in tried:
            fresh = fresh.join(old.select("a", "b"), ["a", "b"], "left_anti")
        tried.append(stored(fresh, "ngram-pairs"))
    # the key is wrapped, so that both sides are dealt out for the join alone and a hot set can be split
    out = rows.join(root.select(F.concat(F.col("node").cast("string"), F.lit("")).alias("_n"), "root"), F.col("set_id").cast("string") == F.col("_n"), "left")
    out = out.withColumn("component", F.coalesce("root", "set_id")).drop("_n", "root")
    drop_stored(sets, firsts, posts, *tried)
    return out, links


def labelled(membership: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): the least doc_id of a component; of rows without words their own."""
    membership = stored(membership, "ngram-members")
    least = membership.groupBy("component").agg(F.min("doc_id").alias("first")).filter(F.col("component").isNotNull())
    least = stored(least.select(F.col("component").alias("_c"), "first"), "ngram-least")
    out = membership.join(least, F.col("component") == F.col("_c"), "left")
    return out.select("doc_id", "th", "n_shingles", F.coalesce("first", "doc_id").alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, _ = near_duplicates(table(spark, sf_dir, "documents"))
    return labelled(members).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op2_ngram_join": op2_ngram_join}
ORACLES: dict[str, str] = {}
