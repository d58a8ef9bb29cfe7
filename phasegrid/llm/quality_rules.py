"""Quality rules in built-in expressions: text statistics, then a hashed n-gram log-likelihood ratio of target to raw corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import SPACE, drop_stored, stored, table

#: Hash buckets of words, of word ends (the last END characters of a word) and of pairs of adjacent words, one block after the other.
WORD_BUCKETS, END_BUCKETS, PAIR_BUCKETS, END = 8192, 2048, 16384, 2
BLOCKS = ((0, WORD_BUCKETS), (WORD_BUCKETS, WORD_BUCKETS + END_BUCKETS), (WORD_BUCKETS + END_BUCKETS, WORD_BUCKETS + END_BUCKETS + PAIR_BUCKETS))
#: A document is dropped if its score lies so many standard deviations of trusted scores below their mean.
DEVIATIONS = 5.0
#: ... and at least so many nats a word below it, so that narrow trusted scores reject no document for rare words.
LEAST_GAP = 0.5
_TRIM = " \t\n\x0b\f\r"


def _trimmed(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))


def word_array(text: Column) -> Column:
    """Words of the text; null or blank: empty."""
    t = _trimmed(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE, -1))


def repeat_words(w: Column, h: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; w: words, h: hashes of the windows in order.

    Sorts (hash, place) and looks at neighbours: n log n for any text.
    """
    s = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twin = lambda k: (F.get(s, k)["h"] == F.get(s, k - 1)["h"]) | (F.get(s, k)["h"] == F.get(s, k + 1)["h"])
        own = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda k: F.coalesce(twin(k), F.lit(False)))
        at = F.transform(own, lambda k: F.get(s, k)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(at, lambda p: F.array(p, p + 1, p + 2)))))

    # a one-element array binds s, so that it is sorted once
    found = F.get(F.transform(F.array(s), places), F.lit(0))
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(found).cast("long")


def word_hashes(text: Column) -> Column:
    """array<struct<h, e>>: hash of each word, bucket of its end."""
    end = lambda w: (WORD_BUCKETS + F.pmod(F.xxhash64(F.lit(END), F.right(w, F.lit(END))), F.lit(END_BUCKETS))).cast("int")
    return F.transform(word_array(text), lambda w: F.struct(F.xxhash64(w).alias("h"), end(w).alias("e")))


def base_rules(text: Column, g: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a text with word hashes g (a column, not an expression)."""
    t = F.coalesce(text, F.lit(""))
    window = F.when(F.size(g) >= 3, F.transform(F.sequence(F.lit(0), F.size(g) - 3), lambda i: F.xxhash64(F.get(g, i)["h"], F.get(g, i + 1)["h"], F.get(g, i + 2)["h"]))).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(_TRIM)) != "")
    return {
        "n_words": F.size(g).cast("long"),
        "word_chars": F.length(F.regexp_replace(t, SPACE, "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]++", ""))).cast("long"),
        "n_dup_lines": F.get(F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x))), F.lit(0)).cast("long"),
        "n_repeat_words": F.get(F.transform(F.array(window), lambda h: repeat_words(g, h)), F.lit(0)),
    }


def _word(h: Column) -> Column:
    return F.pmod(h, F.lit(WORD_BUCKETS)).cast("int")


def _pair(h: Column, after: Column) -> Column:
    return (WORD_BUCKETS + END_BUCKETS + F.pmod(F.xxhash64(h, after), F.lit(PAIR_BUCKETS))).cast("int")


def grams(g: Column) -> Column:
    """Buckets of the words, their ends and the pairs of adjacent words."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(g) - 1), lambda i: _pair(F.get(g, i - 1)["h"], F.get(g, i)["h"]))
    return F.concat(F.transform(g, lambda x: _word(x["h"])), F.transform(g, lambda x: x["e"]), F.when(F.size(g) > 1, pairs).otherwise(F.array().cast("array<int>")))


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(target / raw) of each bucket: smoothed multinomials of words, of word ends and of word pairs, over the trusted and over all documents.

    trusted: distinct (doc_id), any number: texts are shuffled to them once, since ids that grow with the corpus are nothing to broadcast. The counts are summed within tasks before they are shuffled; the
    driver sees one row a bucket.
    """
    t = trusted.select(F.col("doc_id").alias("_id"), F.lit(1).alias("_t"))
    marked = docs.select("doc_id", "text").join(t.hint("merge"), F.col("doc_id") == F.col("_id"), "left")
    each = marked.select(word_hashes(F.col("text")).alias("g"), F.coalesce("_t", F.lit(0)).alias("t")).select("t", F.explode(grams(F.col("g"))).alias("k"))
    raw, goal = [0] * BLOCKS[-1][1], [0] * BLOCKS[-1][1]
    for k, n, m in each.groupBy("k").agg(F.count("*"), F.sum("t")).collect():
        raw[k], goal[k] = n, m
    out = []
    for lo, hi in BLOCKS:
        n, m = sum(raw[lo:hi]), sum(goal[lo:hi])
        # smoothing pulls a bucket of few target counts towards the raw share
        for k in range(lo, hi):
            share = (raw[k] + 1) / (n + hi - lo)
            out.append(math.log((goal[k] + 10 * share * (hi - lo)) / (m + 10 * (hi - lo)) / share) if m else 0.0)
    return out


def likelihood_score(g: Column, ratios: list[float]) -> Column:
    """Sum of the log ratios of a document's words, word ends and word pairs, over its number of words; no words: 0."""
    lit = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    start = F.struct(F.lit(None).cast("bigint").alias("h"), F.lit(0.0).alias("x"))

    def add(acc: Column, w: Column) -> Column:
        pair = F.when(acc["h"].isNotNull(), F.get(lit, _pair(acc["h"], w["h"]))).otherwise(0.0)
        return F.struct(w["h"].alias("h"), (acc["x"] + F.get(lit, _word(w["h"])) + F.get(lit, w["e"]) + pair).alias("x"))

    return F.when(F.size(g) > 0, F.aggregate(g, start, add)["x"] / F.size(g)).otherwise(0.0)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The ids of all documents labelled as good and not toxic."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    return good.select("doc_id").distinct()


def quality_rules(docs: DataFrame, labels: DataFrame, deviations: float = DEVIATIONS, keep: list[str] | None = None) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr_score and kept.

    kept is false if a base rule fails or the score lies more than `deviations` standard deviations, and more than
    LEAST_GAP, below the mean of the trusted documents; without trusted documents the base rules decide. Null and empty text: no words, so base_failed.
    Repeated rows are judged alike; docs' other columns (of them those in `keep`, if given) stay, but those named like a new one are replaced; an empty table
    gives no rows. Every text is counted once and scored once; the scored rows are stored, and the trusted ones' mean is taken from there.
    """
    trusted = stored(trusted_ids(labels), "trusted")
    ratios = log_ratios(docs, trusted)
    # the row goes along as a struct, so that no name of its columns can clash
    row = F.struct(*(docs.columns if keep is None else keep)).alias("row")
    boxed = docs.select(row, F.col("doc_id").alias("id"), "text", word_hashes(F.col("text")).alias("g"))
    out = boxed.select("row", "id", *(c.alias(n) for n, c in (base_rules(F.col("text"), F.col("g")) | {"llr_score": likelihood_score(F.col("g"), ratios)}).items()))
    out = stored(out, "scored")
    own = out.filter("n_words >= 50").select("id", "llr_score").join(trusted.select(F.col("doc_id").alias("id")).hint("merge"), "id", "left_semi")
    mean, sd = own.agg(F.avg("llr_score"), F.stddev_pop("llr_score")).first()
    drop_stored(trusted)
    least = mean - max(deviations * sd, LEAST_GAP) if mean is not None else -math.inf
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr_score") >= F.lit(least)))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr_score", "kept"]
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in (docs.columns if keep is None else keep) if c not in new), *new)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), keep=["doc_id"])
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr_score")


QUERIES = {"op3_quality_rules": op3_quality_rules}
ORACLES: dict[str, str] = {}
