"""A training-data pipeline over documents: quality, near duplicates, personal data, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.llm.common import stored, table
from phasegrid.llm.mixing import mix
from phasegrid.llm.ngram_join import near_duplicates
from phasegrid.llm.packing import pack, pieces
from phasegrid.llm.pii import redact
from phasegrid.llm.quality_model import classify


#: Pieces in a packed sequence.
MOST_DOCS = 64
#: Words that a packing worker remembers in each generation: fewer than the operator's own choice, since earlier stages left executors' heaps large.
REMEMBER = 40_000


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on their weak labels, accepts; null and empty texts go, repeated rows are judged alike, an empty table stays empty."""
    return classify(docs)[0].filter("quality_kept").select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row that comes first by doc_id (nulls last), then by a hash of the text; rows without words all stay.

    Of rows repeated with id and text one stays.
    """
    members, _ = near_duplicates(docs)
    key = [F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("_i"), F.col("th").alias("_t")]
    members = stored(members.select(*key, "component"), "members")
    first = members.filter(F.col("component").isNotNull()).groupBy("component").agg(F.min(F.struct("_i", "_t")).alias("r")).select("r._i", "r._t")
    first = stored(first.union(members.filter(F.col("component").isNull()).select("_i", "_t")).distinct(), "first-of-groups")
    # the row goes along as a struct, so that no name of its columns can clash
    own = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).alias("id"), F.xxhash64("text").alias("th"))
    out = own.join(first, (F.col("id") == F.col("_i")) & (F.col("th") == F.col("_t")), "left_semi")
    if members.groupBy("_i", "_t").count().filter("count > 1").limit(1).count():
        out = out.dropDuplicates(["id", "th"])
    return out.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for; null sources are one source, an empty table stays empty."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Their token ids in sequences of at most 4096, and of at most MOST_DOCS pieces; null and empty texts are one end mark, repeated rows repeated pieces."""
    return pack(stored(pieces(docs.select("doc_id", "text"), 4096, remember=REMEMBER), "pieces"), 4096, most_docs=MOST_DOCS)


STAGES = [
    ("quality classifier", keep_good),
    ("near duplicates", keep_one_of_each),
    ("personal data", hide_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Hashed models and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
