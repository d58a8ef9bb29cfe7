"""Quality classifier from weak labels: expectation-maximisation over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm import worker_memory
from phasegrid.llm.common import drop_stored, small_batches, stored, table
from phasegrid.llm.text_hash import mix, text_chunks, word_hashes

#: Overlapping labellers; each votes good (1), bad (0) or abstains (2).
LABELLERS = ("symbols", "upper_case", "repetition", "separators", "word_length", "exclaiming", "lines", "variety", "plain_words")
#: Hash buckets of words (spelled as they are), of word ends and of word shapes.
BUCKETS = 1 << 14
#: The scorer is fitted on at most so many documents, those of the smallest hash of the text; all else covers every document.
FIT_ROWS = 4000
#: Prior shares of good votes on good texts, and of bad votes on bad ones, and the votes that each prior counts for.
PRECISION, RECALL, PRIOR_VOTES = 0.99, 0.2, 100.0
#: Words added to a text's length when its buckets are averaged: short texts say little, and stay near the prior.
DAMPING = 10
#: A document is rejected below this probability of being good.
THRESHOLD = 0.5

_CLASS = np.zeros(256, np.uint8)  # 1 lower, 2 upper, 3 digit, 4 symbol, 5 other punctuation, 6 beyond ASCII
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 6
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 5
_CLASS[[ord(c) for c in "#*$%&|<>~^=_@\\{}"]] = 4


def _vote(value: np.ndarray, good: float, bad: float, sure: np.ndarray) -> np.ndarray:
    """Good up to `good`, bad from `bad` on, else, and where the labeller isn't sure, no vote."""
    return np.where(~sure, 2, np.where(value <= good, 1, np.where(value >= bad, 0, 2))).astype(np.int64)


def _votes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Votes of each text, as digits of a number in base 3."""
    h, starts, ends, count = word_hashes(data, at, False)
    n = np.diff(count).astype(np.float64)
    kinds = _CLASS[data]
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[at]).astype(np.float64)
    chars = np.maximum(per_text(kinds > 0), 1)
    some = n >= 10
    # words that come again within the text
    order = np.lexsort((h, np.repeat(np.arange(len(n)), np.diff(count))))
    text_of = np.repeat(np.arange(len(n)), np.diff(count))
    s, t = h[order], text_of[order]
    again = np.zeros(len(h))
    again[1:] = (s[1:] == s[:-1]) & (t[1:] == t[:-1])
    follow = np.zeros(len(h))
    follow[1:] = (h[1:] == h[:-1]) & (text_of[1:] == text_of[:-1])
    words = np.maximum(n, 1)
    runs = np.bincount(text_of, follow, len(n)) / words
    size = np.bincount(text_of, ends - starts, len(n)) / words
    single = np.bincount(text_of, (ends - starts == 1) & (kinds[starts] >= 4), len(n)) / words if len(starts) else np.zeros(len(n))
    # letters, but for the last byte
    odd = np.concatenate([[0], np.cumsum((kinds != 1) & (kinds != 2) & (kinds != 6))])
    plain = np.bincount(text_of, (odd[np.maximum(ends - 1, starts + 1)] == odd[starts]), len(n)) / words if len(starts) else np.zeros(len(n))
    fresh = 1 - np.bincount(t, again, len(n)) / words
    marks = per_text((data == 33) | (data == 63))
    lines = per_text(data == 10) + 1
    letters = np.maximum(per_text((kinds == 1) | (kinds == 2)), 1)
    votes = [
        _vote(per_text(kinds == 4) / chars, 0.02, 0.08, some),
        _vote(per_text(kinds == 2) / letters, 0.15, 0.5, some),
        _vote(runs, 0.05, 0.3, some),
        _vote(single, 0.05, 0.2, some),
        _vote(np.abs(size - 6.5), 3.5, 12.0, some),
        _vote(marks / words, 0.1, 0.4, some),
        _vote(lines / words, 0.2, 0.7, some),
        _vote(1 - fresh, 0.65, 0.85, some & (n >= 30) & (n <= 5000)),
        _vote(1 - plain, 0.1, 0.4, some),
    ]
    return sum(v * 3**i for i, v in enumerate(votes))


def vote_pattern(text: Column) -> Column:
    """The labellers' votes on a text, digits of base 3; null text: all abstain."""

    @F.arrow_udf("int")
    def votes(texts: pa.Array) -> pa.Array:
        worker_memory.start("quality")
        out = [_votes(d, at) for _, d, at in text_chunks(texts)]
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.int32())

    return votes(text)


def posterior_of(votes: Column, post: dict[int, float]) -> Column:
    """A table of at most 3^labellers patterns, looked up within tasks."""
    patterns = np.array(sorted(post), np.int64)
    values = np.array([post[p] for p in patterns.tolist()])

    @F.arrow_udf("double")
    def find(votes: pa.Array) -> pa.Array:
        worker_memory.start("quality")
        return pa.array(values[np.searchsorted(patterns, votes.to_numpy(zero_copy_only=False))])

    return find(votes)


def estimate_accuracies(counts: dict[int, int], labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior probability of good for each pattern, each labeller's accuracy (P(vote good | good), P(vote bad | bad)) and the share of good documents.

    Expectation-maximisation of a two-class model in which labellers vote independently given the class; counts has at most 3^labellers patterns.
    Labellers look for different faults, so most say good of a bad text; what is known beforehand is that they
    seldom call a good text bad, and that each sees some share of bad ones. These priors weigh as much as PRIOR_VOTES votes: they decide
    on small corpora and of labellers that hardly vote, and vanish as votes come in.
    """
    patterns = np.array(sorted(counts), np.int64)
    weight = np.array([counts[p] for p in patterns.tolist()], np.float64)
    votes = patterns[:, None] // 3 ** np.arange(labellers) % 3
    good, bad = (votes == 1).astype(float), (votes == 0).astype(float)
    post = np.where(bad.sum(1) > 0, 0.02, 0.98)  # labellers look for different faults: at first one bad vote decides
    prior, accuracy = 0.5, np.full((labellers, 2), 0.7)
    for _ in range(rounds):
        wg, wb = weight * post, weight * (1 - post)
        prior = (wg.sum() + 1) / (weight.sum() + 2)
        accuracy[:, 0] = (wg @ good + PRECISION * PRIOR_VOTES) / (wg @ (good + bad) + PRIOR_VOTES)
        accuracy[:, 1] = (wb @ bad + RECALL * PRIOR_VOTES) / (wb @ (good + bad) + PRIOR_VOTES)
        log = np.log(prior / (1 - prior)) + good @ np.log(accuracy[:, 0] / (1 - accuracy[:, 1])) + bad @ np.log((1 - accuracy[:, 0]) / accuracy[:, 1])
        new = 1 / (1 + np.exp(-np.clip(log, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns.tolist(), post.tolist(), strict=True)), accuracy, float(prior)


_END_SALT, _SHAPE_SALT = np.uint64(0x51ED270B), np.uint64(0x2545F491)


def _buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three feature buckets of each word (n, 3): the word, its end, its shape with whether it repeats the word before; and the number of words before each text."""
    h, starts, ends, count = word_hashes(data, at, False)
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    same[count[:-1][count[:-1] < len(h)]] = False
    last, prior = data[ends - 1].astype(np.uint64), data[np.maximum(ends - 2, starts)].astype(np.uint64)
    shape = _CLASS[data[starts]].astype(np.uint64) * np.uint64(64) + _CLASS[data[ends - 1]] * np.uint64(8) + np.minimum(ends - starts, 15).astype(np.uint64) * np.uint64(512) + same.astype(np.uint64) * np.uint64(1 << 20)
    x = np.stack([h, mix(last * np.uint64(256) + prior + (_END_SALT << np.uint64(32))), mix(shape + (_SHAPE_SALT << np.uint64(32)))], 1)
    return (x % np.uint64(BUCKETS)).astype(np.int64), count


def bag(text: Column) -> Column:
    """A text's distinct buckets (32-bit integers), then their damped shares of its words (32-bit floats), as bytes."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        worker_memory.start("quality")
        out = []
        for _, data, at in text_chunks(texts):
            b, count = _buckets(data, at)
            for lo, hi in itertools.pairwise(count.tolist()):
                k, n = np.unique(b[lo:hi], return_counts=True)
                out.append(k.astype(np.int32).tobytes() + (n / (hi - lo + DAMPING)).astype(np.float32).tobytes())
        return pa.array(out, pa.binary())

    return pack(text)


def fit_scorer(bags: list[bytes], post: np.ndarray, rounds: int = 300, rate: float = 0.5, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic model (bias last) on bags, fitted to posterior labels by full-batch Adagrad; both classes weigh the same."""
    size = [len(x) // 8 for x in bags]
    r = np.repeat(np.arange(len(bags)), size)
    c = np.concatenate([np.frombuffer(x, np.int32, n) for x, n in zip(bags, size, strict=True)]).astype(np.int64)
    v = np.concatenate([np.frombuffer(x, np.float32, n, 4 * n) for x, n in zip(bags, size, strict=True)]).astype(np.float64)
    weight = post / (post.sum() + 1e-9) + (1 - post) / ((1 - post).sum() + 1e-9)
    weight /= weight.sum()
    w, bias, seen = np.zeros(BUCKETS), 0.0, np.full(BUCKETS + 1, 1e-8)
    for _ in range(rounds):
        z = np.bincount(r, v * w[c], len(post)) + bias
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - post) * weight
        grad = np.append(np.bincount(c, v * g[r], BUCKETS) + decay * w, g.sum())
        seen += grad**2
        step = rate * grad / np.sqrt(seen)
        w, bias = w - step[:-1], bias - step[-1]
    return np.append(w, bias)


def linear_score(text: Column, weights: np.ndarray) -> Column:
    """Probability of good by the fitted scorer; texts without words: 0."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        worker_memory.start("quality")
        out = []
        for _, data, at in text_chunks(texts):
            b, count = _buckets(data, at)
            n = np.diff(count)
            own = np.bincount(np.repeat(np.arange(len(n)), n), weights[:-1][b].sum(1), len(n)) / (n + DAMPING)
            out.append(np.where(n > 0, 1 / (1 + np.exp(-np.clip(own + weights[-1], -40, 40))), 0.0))
        return pa.array(np.concatenate(out) if out else np.empty(0), pa.float64())

    return score(text)


def classify(docs: DataFrame, fit_rows: int = FIT_ROWS, threshold: float = THRESHOLD) -> tuple[DataFrame, dict]:
    """docs with weak_votes, weak_posterior, quality_score and quality_kept; and what was learned.

    Vote patterns are counted by hash of the text, then over all documents (at most 3^labellers rows reach the driver), EM estimates the labellers'
    accuracies without any labels, and the posteriors of at most fit_rows distinct texts train the scorer, which then judges every row by
    itself: the text is never shuffled. Columns of docs named like a new one are replaced. A row is kept from `threshold` on. Texts that are null or have no words score 0 and
    go; texts too short for any labeller keep the corpus's prior as posterior and are judged by the scorer. Repeated
    rows are judged alike; an empty table gives no rows.
    """
    columns = [c for c in docs.columns if c not in ("weak_votes", "weak_posterior", "quality_score", "quality_kept")]
    small_batches(docs.sparkSession)
    base = docs.select(*columns)
    seen = base.select(F.xxhash64("text").alias("o"), vote_pattern(F.col("text")).alias("p")).groupBy("o", "p").agg(F.count("*").alias("n"))
    seen = stored(seen, "votes")
    counts = {int(p): int(n) for p, n in seen.groupBy("p").agg(F.sum("n")).collect()}
    if not counts:
        return base.withColumns({"weak_votes": F.lit(0), "weak_posterior": F.lit(0.0), "quality_score": F.lit(0.0), "quality_kept": F.lit(False)}), {}
    post, accuracy, prior = estimate_accuracies(counts)
    voted = [p for p in post if any(p // 3**i % 3 != 2 for i in range(len(LABELLERS)))]
    # half of them look bad, half good; of each side those with the smallest hashes, each text once
    sides = F.broadcast(docs.sparkSession.createDataFrame([(p, post[p] >= 0.5) for p in voted], "_p int, good boolean"))
    sided = seen.join(sides, F.col("p") == F.col("_p"))
    chosen = [(r.o, r.p) for side in (True, False) for r in sided.filter(F.col("good") == side).orderBy("o", "p").limit(fit_rows // 2).select("o", "p").collect()]
    picked: list[tuple] = []
    if chosen:
        wanted = F.broadcast(docs.sparkSession.createDataFrame([(o,) for o, _ in chosen], "_o long"))
        near = base.select("text", F.xxhash64("text").alias("o")).filter(F.col("text").isNotNull()).join(wanted, F.col("o") == F.col("_o"), "left_semi")
        bags = {r.o: r.bag for r in near.dropDuplicates(["o"]).select("o", bag(F.col("text")).alias("bag")).collect()}
        picked = [(bags[o], p) for o, p in chosen]
    weights = fit_scorer([bytes(r[0]) for r in picked], np.array([post[r[1]] for r in picked])) if picked else np.zeros(BUCKETS + 1)
    weights[-1] += np.log(prior / (1 - prior))  # the fit weighed both classes alike
    out = base.withColumn("weak_votes", vote_pattern(F.col("text")))
    out = out.withColumns({"weak_posterior": posterior_of(F.col("weak_votes"), post), "quality_score": linear_score(F.col("text"), weights)})
    drop_stored(seen)
    return out.withColumn("quality_kept", F.col("quality_score") >= threshold), {"accuracy": dict(zip(LABELLERS, accuracy.tolist(), strict=True)), "good_share": prior}


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("weak_votes").alias("votes"), F.col("weak_posterior").alias("posterior"), F.col("quality_score").alias("score"), F.col("quality_kept").alias("kept"))


QUERIES = {"op5_quality_classifier": op5_quality_classifier}
ORACLES: dict[str, str] = {}
