"""Best-fit packing of token sequences under several capacities, planned on a histogram of lengths."""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import worker_memory
from phasegrid.llm.common import gapless_rank, small_batches, stored, table

END_ID = 1
#: Words, and letter runs, whose ids a worker remembers in each of two generations; when the young one is full, it replaces the old one. About 200 bytes each.
CACHE = 130_000
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

_known: dict[str, _Known] = {}


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Memory:
    """A bounded dict."""

    def __init__(self, size: int = CACHE) -> None:
        self.size = size
        self.young: dict = {}
        self.old: dict = {}

    def turn(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def missing(self, wanted: set) -> set:
        """What of wanted isn't known; what is known is in young afterwards."""
        new = wanted.difference(self.young)
        again = [x for x in new if x in self.old]
        self.young.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new.difference_update(again)
        return new


class _Known:
    """Ids of words, as little-endian 32-bit integers.

    The vocabulary drops white space, never merges across it, lower-cases, and splits letters from punctuation. So ids of a text are
    those of its words, joined, and those of a word of letters and then ASCII punctuation are its two parts'. New letter
    runs are encoded as one text: each ends with its only piece that carries the end-of-word mark. Other words are encoded alone.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.runs = _Memory(), _Memory()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True

    def each(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]

    def learn_runs(self, runs: list[str]) -> None:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, "<u4")
        ends = ((np.flatnonzero(self.is_end[ids]) + 1) * 4).tolist()
        if len(ends) == len(runs) and ends[-1] == 4 * len(ids):
            raw = ids.tobytes()
            self.runs.young.update(zip(runs, [raw[a:b] for a, b in itertools.pairwise([0, *ends])], strict=True))
        else:
            self.runs.young.update(zip(runs, self.each(runs), strict=True))

    def learn(self, words: list[bytes]) -> None:
        text = b" ".join(words).decode()
        lower = text.lower().split(" ")
        # a capital sigma is lower-cased by its place here, but not by the vocabulary; special tokens have letters inside
        if "\u03a3" in text or len(lower) != len(words):
            self.words.young.update(zip(words, self.each([w.decode() for w in words]), strict=True))
            return
        cores = [w.rstrip(_PUNCTUATION) for w in lower]
        simple = [c.isalpha() for c in cores]
        marks = [w[len(c) :] for w, c in zip(lower, cores, strict=True)]
        self.runs.turn()
        if new := self.runs.missing(set(itertools.compress(cores, simple))):
            self.learn_runs(list(new))
        if new := self.runs.missing({m for m, s in zip(marks, simple, strict=True) if s and m}):
            self.runs.young.update(zip(new, self.each(list(new)), strict=True))
        find = self.runs.young.__getitem__
        self.words.young.update((w, find(c) + find(m) if m else find(c)) for w, c, m, s in zip(words, cores, marks, simple, strict=True) if s)
        rest = [w for w, s in zip(words, simple, strict=True) if not s]
        self.words.young.update(zip(rest, self.each([w.decode() for w in rest]), strict=True))

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        self.words.turn()
        # A-Z would be lower-cased anyhow; where special tokens may stand, spelling matters
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if new := self.words.missing(set().union(*split)):
            self.learn(list(new))
        find = self.words.young.__getitem__
        return [b"".join(map(find, words)) for words in split]


def _runs(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows with about `most` bytes of text; a longer text is alone."""
    size, lo = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if size and size + n > most:
            yield lo, i
            size, lo = 0, i
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def pieces(docs: DataFrame, limit: int = 4096, path: str | None = None, keep_ids: bool = False, remember: int = CACHE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each row's ids and END_ID, cut every `limit` ids.

    path: a vocabulary of kind "word ends, white space dropped", readable on every executor. Null and empty texts
    give one piece, END_ID alone; repeated rows give repeated pieces. remember: words a worker keeps in each generation; fewer
    take less memory and more time, and change no result.
    """
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from phasegrid.llm import packing as here  # the worker's own module, whose memory outlives a task

        worker_memory.start("packing", here._known.clear)
        if path not in here._known:
            here._known[path] = here._Known(path)
        known = here._known[path]
        known.words.size = known.runs.size = remember
        for b in batches:
            for lo, hi in _runs(b.column(1)):
                out: list[tuple] = []
                texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column(1)[lo:hi]]
                for i, ids in zip(b.column(0)[lo:hi].to_pylist(), known.encoded(texts), strict=True):
                    ids += end
                    for k, a in enumerate(range(0, len(ids), 4 * limit)):
                        x = ids[a : a + 4 * limit]
                        out.append((i, k, a // 4, len(x) // 4, zlib.crc32(x), x))
                cols = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([np.frombuffer(r[5], "<u4").astype(np.int32) for r in out], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, schema)


class Plan:
    """Where the r-th piece of each length goes: runs of equal bins, so its size depends on lengths and not on the number of pieces."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, pieces per bin, first bin, offset
        self.bins = 0


def best_fit_plan(count: dict[int, int], capacity: int, most_docs: int | None = None, most_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 0.05, 0.05), by: str = "norm", units: int = 64) -> Plan:
    """Vector best fit, longest pieces first, over bins with residual tokens, documents and attention cost (sum of squared lengths).

    count: pieces of each length up to capacity. A piece goes to the feasible bin with the least weighted norm of what would
    be left (by="norm") or the largest weighted dot product of its needs and the bin's residuals (by="dot"); to a new bin
    if none is feasible. Bins of equal residuals are treated at once. All three residuals select a bin, whether or not their capacity
    can bind. Documents and attention that tokens already bound (also if no limit is given) have the bound as capacity. Attention counts in
    `units` of its capacity: rounded up where it can bind, so a bin never exceeds it; else down, so it never keeps out what tokens let in.
    """
    docs = capacity if most_docs is None else min(most_docs, capacity)
    attention = capacity**2 if most_attention is None else min(most_attention, capacity**2)
    binds = attention < capacity**2
    caps = np.array([capacity, docs, units], np.int64)
    scale = np.array(weights)
    needs = lambda n: np.array([n, 1, -(-n * n * units // attention) if binds else n * n * units // attention], np.int64)
    plan = Plan()
    kinds: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residuals -> runs (first bin, bins)
    left = np.zeros((0, 3), np.int64)

    def put(residual: np.ndarray, run: tuple[int, int]) -> None:
        nonlocal left
        key = tuple(residual.tolist())
        if key not in kinds:
            kinds[key] = []
            left = np.vstack([left, residual])
        kinds[key].append(run)

    for n in sorted(count, reverse=True):
        need, todo, rank = needs(n), count[n], 0
        if n * n > attention:
            raise ValueError(f"a piece of {n} tokens exceeds the attention capacity")
        while todo:
            fits = np.flatnonzero((left >= need).all(1)) if len(left) else np.empty(0, np.int64)
            if len(fits):
                if by == "dot":
                    best = fits[np.argmax(((left[fits] / caps) * (need / caps) * scale).sum(1))]
                else:
                    best = fits[np.argmin((((left[fits] - need) / caps) ** 2 * scale).sum(1))]
                residual = left[best].copy()
                key = tuple(residual.tolist())
                first, bins = kinds[key].pop()
                if not kinds[key]:
                    del kinds[key]
                    left = np.delete(left, best, 0)
            else:
                residual, first, bins = caps.copy(), plan.bins, -1
            each = int(min(residual[i] // need[i] for i in range(3) if need[i] > 0))
            if bins < 0:
                bins = -(-todo // each)
                plan.bins += bins
            full = min(bins, todo // each)
            part = todo - full * each if full < bins else 0  # pieces of one more bin
            for take, run in ((each, full), (part, 1)):
                if take and run:
                    plan.rows.append((n, rank, take, first, capacity - int(residual[0])))
                    rank, todo = rank + take * run, todo - take * run
                    after = residual - take * need
                    if after[0] > 0:
                        put(after, (first, run))
                    first, bins = first + run, bins - run
            if bins:
                put(residual, (first, bins))
    return plan


def _placed(plan: Plan, length: Column, rank: Column) -> Column:
    """struct<sequence_id, offset> of the rank-th piece of a length."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 5)
    key = (rows[:, 0] << 44) + rows[:, 1]

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(n: pa.Array, r: pa.Array) -> pa.Array:
        n, r = n.to_numpy(zero_copy_only=False), r.to_numpy(zero_copy_only=False)
        x = rows[np.searchsorted(key, (n << 44) + r, "right") - 1]
        i = r - x[:, 1]
        return pa.StructArray.from_arrays([pa.array(x[:, 3] + i // x[:, 2]), pa.array(x[:, 4] + i % x[:, 2] * n)], ["sequence_id", "offset"])

    return place(length, rank)


def pack(cut: DataFrame, capacity: int = 4096, **limits) -> DataFrame:
    """cut (stored pieces with a length of at most capacity) with sequence_id and offset; an empty table stays empty.

    The plan needs the number of pieces of each length only (at most `capacity` rows at the driver); each piece then
    finds its place by its gapless rank among pieces of its length, counted in slices so that a common length burdens no task.
    """
    count = {int(n): int(k) for n, k in cut.groupBy("length").count().collect()}
    plan = best_fit_plan(count, capacity, **limits)
    ranked = gapless_rank(cut, "length", ["ids_crc32", "doc_id", "piece"], "_rank")
    if not count:
        return cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    out = ranked.withColumn("_place", _placed(plan, F.col("length"), F.col("_rank")))
    return out.withColumns({"sequence_id": F.col("_place.sequence_id"), "offset": F.col("_place.offset")}).drop("_place", "_rank")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = stored(pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), 4096), "pieces")
    return pack(cut, 4096).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


QUERIES = {"op6_packing": op6_packing}
ORACLES: dict[str, str] = {}
