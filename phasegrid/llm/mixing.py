"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.llm.common import drop_stored, stored, table

WEIGHTS = (5, 2, 1)
#: A document is taken at most so often.
MOST = 3
#: So many sources (totals of a few numbers) are joined by broadcast; of more, only those with many rows.
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    """Number of words; null: 0. Counts where words end, so no array is built."""
    t = F.coalesce(text, F.lit(""))
    return F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]++")).cast("long")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """totals (source, n, rows), a stored table with a row a source, with target: each source's share by weight of all sizes, at most `most` times its own.

    Weights repeat over sources in order of code points, null last. The excess is shared anew by weight until no source is above: then those
    are capped whose most * n / weight lies below the share a unit of weight gets, so a round is one aggregate and the driver holds its three sums,
    however many sources there are. Places in the order come from sorted partitions, counted, and gapless ranks within them.
    """
    spark = totals.sparkSession
    parts = stored(totals.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "mix-sources")
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in parts.groupBy("part").count().collect()):
        offsets.append((part, before))
        before += n
    offset = F.broadcast(spark.createDataFrame(offsets, "p int, before long"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int"))
    ranked = parts.join(offset, F.col("part") == F.col("p")).withColumn("place", place).select("source", "n", "rows", weight.alias("weight"))
    ranked = stored(ranked, "mix-weights")
    drop_stored(parts)
    share, whole = 0.0, None
    while True:
        over = F.lit(share) * F.col("weight") > most * F.col("n")
        total, capped, rest = ranked.agg(F.sum("n"), F.sum(F.when(over, most * F.col("n")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        whole = whole or float(total or 0)
        new = (whole - capped) / rest if rest else share
        if new <= share:
            break
        share = new
    over = F.lit(share) * F.col("weight") > most * F.col("n")
    return ranked.withColumn("target", F.when(over, most * F.col("n").cast("double")).otherwise(F.lit(share) * F.col("weight")))


def mix_rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 20260812) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies (how often each row is taken).

    Only totals per source are shuffled (partial sums first, so a hot source costs one row a task) and joined back
    to the rows. A row is taken floor(rate) times, and once more if a hash of seed, doc_id, text and source falls
    below the fraction: reruns agree. Null sources are one source, last; null or empty texts have size 0; a source
    without words has rate 0; repeated rows share their draw; columns of docs named like a new one are replaced, others stay;
    an empty table gives no rows.
    """
    new = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    # the row goes along as a struct, so that no name of its columns can clash
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source", n_words(F.col("text")).alias("mix_size"))
    totals = stored(boxed.groupBy("source").agg(F.sum("mix_size").alias("n"), F.count("*").alias("rows")), "mix-totals")
    goal = stored(source_targets(totals, weights, most).select(F.col("source").alias("_source"), F.col("n").alias("mix_source_size"), F.col("target").alias("mix_target"), "rows"), "mix-targets")
    drop_stored(totals)
    same = F.col("source").eqNullSafe(F.col("_source"))
    if goal.count() <= BROADCAST_SOURCES:
        out = boxed.join(F.broadcast(goal), same, "left")
    else:
        # at most so many sources can have more rows than this; the others are small, so a join by source has no hot key
        many = goal.agg(F.sum("rows")).first()[0] / BROADCAST_SOURCES
        hot = F.broadcast(goal.filter(F.col("rows") > many))
        out = boxed.join(hot, same).unionByName(boxed.join(hot.select("_source"), same, "left_anti").join(goal.filter(F.col("rows") <= many), same, "left"))
    rate = F.when(F.col("mix_source_size") > 0, F.least(F.col("mix_target") / F.col("mix_source_size"), F.lit(float(most)))).otherwise(0.0)
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"), F.col("source")), F.lit(1 << 40)) / float(1 << 40)
    out = out.withColumn("mix_copies", (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("int"))
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new), *new)


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each row as often as it is taken, with docs' columns, whatever their names; an empty table stays empty."""
    rated = mix_rates(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source"), **how)
    taken = rated.filter("mix_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    return taken.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_rates(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


QUERIES = {"op7_mixing": op7_mixing}
ORACLES: dict[str, str] = {}
