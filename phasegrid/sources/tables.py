"""Sources: star-schema tables, daily bars from transactions, universes from CSV."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from phasegrid.config import MARKET
from phasegrid.functions.protocol import canonical_hash, tickers_hash
from phasegrid.sources.store import stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lead(seq: Column, first: str) -> Column:
    """The first, integer field of the struct seq, as a number whose order is seq's: a missing field comes first, a missing seq has none."""
    return F.when(seq.isNotNull(), F.coalesce(seq[first].cast("long"), F.lit(-(2**63))))


def _same(a: Column, b: Column) -> Column:
    """a and b are equal or both null: a condition beside a join's key, not a part of it."""
    return F.coalesce(a == b, a.isNull() & b.isNull())


def _near(rows: DataFrame, lead: Column, ends: DataFrame) -> DataFrame:
    """rows at a day and first field of ends, with its columns. One hash is the key, which keeps the table of a broadcast small."""
    return rows.join(ends, (F.xxhash64("date", lead) == F.col("_h")) & _same(F.col("date"), F.col("_d")) & _same(lead, F.col("_e")))


def transactions(spark: SparkSession, sf_dir: str, key: str = "p_brand", ends: DataFrame | None = None) -> DataFrame:
    """(ticker, date, price, volume, discount, and a total order seq) from lineitem, keyed by a column of part or lineitem.

    ends: only transactions at an order and a day of it, with its columns; the others go before part is joined.
    """
    seq = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    line = table(spark, sf_dir, "lineitem").withColumn("date", F.col("l_shipdate").cast("date"))
    if ends is not None:
        line = _near(line, _lead(seq, "l_orderkey"), ends)
    if key.startswith("p_"):
        line = line.join(table(spark, sf_dir, "part").select("p_partkey", key), F.col("l_partkey") == F.col("p_partkey"))
    return line.select(
        F.col(key).cast("string").alias("ticker"),
        "date",
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("volume"),
        F.col("l_discount").alias("discount"),
        seq.alias("seq"),
        *(ends.columns if ends is not None else ()),
    )


def trade_bars(trades: DataFrame, at_ends: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One OHLCV bar a (ticker, date): first, highest, lowest and last price in order of seq, a struct that starts with an integer, and the summed volume.

    An aggregate that holds a struct would sort all rows of a task. So one aggregate of numbers, which hashes, finds the sums and the least and greatest
    first field of seq; its bars are stored, and only trades at these two, a few a bar, are compared by all of seq. at_ends gives those
    trades beside the stored (ticker as _t, date as _d, first field as _e, hash _h, ...); by default they are joined with trades.
    """
    lead = _lead(F.col("seq"), trades.schema["seq"].dataType.names[0])
    sums = trades.groupBy("ticker", "date").agg(
        F.max("price").alias("_high"),
        F.min("price").alias("_low"),
        F.sum("volume").alias("_volume"),
        (F.avg("discount") - 0.05).alias("_drift"),
        F.min(lead).alias("_a"),
        F.max(lead).alias("_b"),
    )
    ends = stored(sums, "bars").select(F.col("ticker").alias("_t"), F.col("date").alias("_d"), "_high", "_low", "_volume", "_drift", F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_e"))
    ends = ends.withColumn("_h", F.xxhash64("_d", "_e"))
    near = _near(trades, lead, ends) if at_ends is None else at_ends(ends)
    return near.filter(_same(F.col("ticker"), F.col("_t"))).groupBy("ticker", "date").agg(
        F.min_by("price", "seq").alias("open"),
        F.max("_high").alias("high"),
        F.max("_low").alias("low"),
        F.max_by("price", "seq").alias("close"),
        F.max("_volume").alias("volume"),
        F.max("_drift").alias("drift"),
    )


def daily_bars(spark: SparkSession, sf_dir: str, key: str = "p_brand", ticker: str | None = None) -> DataFrame:
    """trade_bars of the transactions, all under one ticker if it is given."""
    named = lambda t: t if ticker is None else t.withColumn("ticker", F.lit(ticker))
    return trade_bars(named(transactions(spark, sf_dir, key)), lambda ends: named(transactions(spark, sf_dir, key, ends)))


def index_close(bars: DataFrame) -> DataFrame:
    """bars with close replaced by a causal index: exp of the running sum of the daily drift."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return bars.withColumn("close", F.exp(F.sum("drift").over(w)))


def asset_and_market_bars(spark: SparkSession, sf_dir: str, key: str = "p_brand") -> tuple[DataFrame, DataFrame]:
    assets, market = daily_bars(spark, sf_dir, key), daily_bars(spark, sf_dir, "l_returnflag", MARKET)
    return index_close(assets).drop("drift"), index_close(market).drop("drift")


def no_inf(x: Column) -> Column:
    """NaN and infinities become null."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def normalized_bars(raw: DataFrame, order: str = "seq") -> DataFrame:
    """Bars with one row a (ticker, date), the last by order; titles of columns in lower case, missing ones null, infinities null, null dates dropped."""
    out = raw.toDF(*(c.strip().lower() for c in raw.columns))
    for c in ("open", "high", "low", "close", "volume"):
        out = out.withColumn(c, no_inf(F.col(c).cast("double")) if c in out.columns else F.lit(None).cast("double"))
    w = Window.partitionBy("ticker", "date").orderBy(F.col(order).desc())
    out = out.withColumn("date", F.to_date("date")).filter(F.col("date").isNotNull())
    return out.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def enough_history(bars: DataFrame, least: int = 100) -> DataFrame:
    """Bars of tickers with at least so many closes. Counts are partial sums; the semi join keeps rows where they are if the kept tickers are few."""
    kept = bars.groupBy("ticker").agg(F.count("close").alias("n")).filter(F.col("n") >= least).select("ticker")
    return bars.join(kept, "ticker", "left_semi")


def read_universe(spark: SparkSession, path: str) -> DataFrame:
    """(ticker, asset_class) of a CSV with those columns: trimmed, tickers in upper case, nulls dropped, the first of each ticker by its place in the file kept."""
    raw = spark.read.option("header", True).csv(path)
    missing = {"ticker", "asset_class"} - set(raw.columns)
    if missing:
        raise ValueError(f"universe lacks {sorted(missing)}")
    at = F.monotonically_increasing_id().alias("_at")
    out = raw.select(F.upper(F.trim("ticker")).alias("ticker"), F.trim("asset_class").alias("asset_class"), at).dropna(subset=["ticker", "asset_class"])
    first = out.groupBy("ticker").agg(F.min(F.struct("_at", "asset_class")).alias("f"))
    return first.select("ticker", "f.asset_class")


def canonical_ticker(ticker: Column, dots_to_dashes: bool = True) -> Column:
    """Upper case and trimmed; share classes written with a dash, unless the exchange's own suffix must stay."""
    t = F.upper(F.trim(ticker))
    return F.regexp_replace(t, r"\.", "-") if dots_to_dashes else t


def read_panel(spark: SparkSession, path: str, columns: list[str], horizons: tuple[int, ...] | None = None, strict: bool = True) -> DataFrame:
    """A projection of a stored panel (Parquet, or CSV by its suffix) at some horizons; rows with nulls in it dropped if strict.

    Raises if a horizon that is asked for is missing.
    """
    csv = path.rstrip("/").endswith((".csv", ".csv.gz"))
    out = spark.read.option("header", True).option("inferSchema", True).csv(path) if csv else spark.read.parquet(path)
    if horizons is not None:
        out = out.filter(F.col("horizon").isin(*horizons))
        there = {r[0] for r in out.select("horizon").distinct().collect()}
        if set(horizons) - there:
            raise ValueError(f"panel lacks horizons {sorted(set(horizons) - there)}")
    out = out.select(*columns)
    return out.dropna() if strict else out


def write_panel(panel: DataFrame, path: str) -> None:
    """Parquet by mode and horizon, so that scans of one read no other."""
    panel.repartition("return_mode", "horizon", F.pmod(F.xxhash64("ticker"), F.lit(64))).sortWithinPartitions("date").write.mode("overwrite").partitionBy("return_mode", "horizon").parquet(path)


def html_rows(pages: DataFrame, pattern: str = r"<(?:p|li|td)[^>]*>([^<]+)</") -> DataFrame:
    """(page_id, place, cell): cells of web pages by pattern."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(1))).alias("place", "cell")).withColumn("cell", F.trim("cell")).filter("cell <> ''")


def with_metadata(panel: DataFrame, columns: list[str]) -> tuple[DataFrame, Observation]:
    """The columns of a panel, and its metadata, collected in the scan of the first job on them: rows, tickers, modes, horizons, first and last date.

    Sets of tickers, modes and horizons are small. audit_metadata() reads the observation after that job.
    """
    seen = Observation("panel")
    out = panel.observe(seen, F.count(F.lit(1)).alias("rows"), F.collect_set("ticker").alias("tickers"), F.collect_set("return_mode").alias("return_modes"), F.collect_set("horizon").alias("horizons"), F.min("date").alias("date_min"), F.max("date").alias("date_max"))
    return out.select(*columns), seen


def audit_metadata(seen: Observation) -> dict:
    """What with_metadata() saw, with sorted sets, hashes of the tickers and of the whole."""
    got = seen.get
    meta = {"rows": got["rows"], "tickers": sorted(got["tickers"]), "return_modes": sorted(got["return_modes"]), "horizons": sorted(got["horizons"]), "date_min": str(got["date_min"]), "date_max": str(got["date_max"])}
    meta |= {"ticker_count": len(meta["tickers"]), "ticker_set_sha256": tickers_hash(meta["tickers"])}
    return meta | {"metadata_sha256": canonical_hash({k: v for k, v in meta.items() if k != "tickers"}, "plain")}


def compact_panel(panel: DataFrame, horizons: tuple[int, ...] | None = None) -> DataFrame:
    """The five columns that analyses use, in their types; tickers in canonical form; rows with nulls in them dropped."""
    own = panel if horizons is None else panel.filter(F.col("horizon").isin(*horizons))
    out = own.select(F.to_date("date").alias("date"), canonical_ticker(F.col("ticker")).alias("ticker"), F.col("return_mode").cast("string").alias("return_mode"), F.col("horizon").cast("int").alias("horizon"), F.col("psi_primary").cast("double").alias("psi_primary"), F.col("phase_product").cast("double").alias("phase_product"))
    return out.dropna()


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header, or no rows of the schema where the file is missing, empty or only a header: no certified row is a result, too."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or fs.getContentSummary(p).getLength() == 0:
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path)


def write_document(spark: SparkSession, doc: dict, path: str) -> None:
    """A protocol or summary as JSON with sorted keys, at a path that Spark can reach; refuses to overwrite."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, False)
    out.write(bytearray(json.dumps(doc, sort_keys=True, indent=2, default=str).encode()))
    out.close()


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first().value)
