"""Exact ranks and quantiles of large groups: work is split by value, so no group of rows meets in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.sources.store import stored

#: Rank error of the sketch that brackets a quantile, as a share of its group: the values between are counted exactly.
BRACKET = 1e-3


def exact_quantiles(df: DataFrame, value: str, shares: Sequence[float] | dict[tuple, Sequence[float]], keys: Sequence[str], out: str = "q", bracket: float = BRACKET) -> DataFrame:
    """(keys, n, out): exact, linearly interpolated quantiles of value at shares (by keys, if each has its own), as an array; nulls aren't counted.

    A mergeable sketch brackets each order statistic that is asked for; then one scan counts what lies below each bracket, and one the distinct
    values inside, a few thousandths of a group. Counts say whether a bracket holds its statistic; where one doesn't, brackets widen, up to all values. df is
    scanned three times. Groups are few: the driver holds some numbers of each.
    """
    keys, spark = list(keys), df.sparkSession
    data = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.select(*keys).schema)
    every = sorted({float(p) for own in shares.values() for p in own}) if isinstance(shares, dict) else [float(p) for p in shares]
    of = (lambda k: [float(p) for p in shares.get(k, ())]) if isinstance(shares, dict) else (lambda k: every)
    while True:
        around = sorted({min(1.0, max(0.0, p + d)) for p in every for d in (-2 * bracket, 2 * bracket)}) or [0.5]
        sketch = data.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("_v", F.array(*map(F.lit, around)), F.lit(max(100, int(4 / bracket)))).alias("a")).collect()
        place = {p: i for i, p in enumerate(around)}
        marks, size = [], {}
        for r in sketch:
            k = tuple(r[x] for x in keys)
            size[k] = r["n"]
            few = r["n"] * bracket < 4  # a group of some thousand rows is counted whole
            low = [float("-inf") if few or p - 2 * bracket <= 0 else r["a"][place[p - 2 * bracket]] for p in of(k)]
            high = [float("inf") if few or p + 2 * bracket >= 1 else r["a"][place[p + 2 * bracket]] for p in of(k)]
            if low:
                marks.append((*k, [(i, lo, hi) for i, (lo, hi) in enumerate(zip(low, high, strict=True))]))
        most = max((len(m[-1]) for m in marks), default=0)
        found: dict[tuple, dict[int, list]] = {k: {} for k in size}
        below: dict[tuple, list] = {}
        if most:
            rows = data.join(F.broadcast(spark.createDataFrame(marks, f"{kinds}, _m array<struct<i: int, lo: double, hi: double>>")), keys)
            for r in rows.groupBy(*keys).agg(*(F.sum((F.col("_v") < F.get("_m", F.lit(i))["lo"]).cast("long")).alias(f"_b{i}") for i in range(most))).collect():
                below[tuple(r[x] for x in keys)] = [r[f"_b{i}"] for i in range(most)]
            starts = [(*k, i, b[i], (size[k] - 1) * p) for k, b in below.items() for i, p in enumerate(of(k))]
            inside = rows.select(*keys, "_v", F.explode(F.filter("_m", lambda m: F.col("_v").between(m["lo"], m["hi"]))).alias("m"))
            inside = inside.groupBy(*keys, F.col("m.i").alias("_i"), "_v").agg(F.count("*").alias("_k"))
            inside = inside.join(F.broadcast(spark.createDataFrame(starts, f"{kinds}, _i int, _from long, _at double")), [*keys, "_i"])
            w = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
            inside = inside.withColumn("_from", F.col("_from") + F.coalesce(F.sum("_k").over(w), F.lit(0)))
            has = lambda r: (F.col("_from") <= r) & (r < F.col("_from") + F.col("_k"))
            pick = inside.groupBy(*keys, "_i").agg(F.max(F.when(has(F.floor("_at")), F.col("_v"))).alias("l"), F.max(F.when(has(F.ceil("_at")), F.col("_v"))).alias("h"))
            for r in pick.collect():
                found[tuple(r[x] for x in keys)][r["_i"]] = (r["l"], r["h"])
        lines, missed = [], False
        for k, n in size.items():
            q = []
            for i, p in enumerate(of(k)):
                low, high = found[k].get(i, (None, None))
                missed |= low is None or high is None
                at = (n - 1) * p
                q.append(None if low is None or high is None else low + (high - low) * (at - int(at)))
            lines.append((*k, n, q))
        if not missed or bracket >= 1:
            return spark.createDataFrame(lines, f"{kinds}{', ' if keys else ''}n long, {out} array<double>")
        bracket *= 16


def running_sums(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column]) -> DataFrame:
    """(keys, value, each of sums, and before_<name>: the sum over smaller values of the same keys): a row for each distinct value.

    Rows are summed by value first, so a frequent value is one row; those are dealt out by ranges of (keys, value), and what lies in earlier ranges comes
    from one number a range.
    """
    keys = list(keys)
    each = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    each = stored(each.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranges")
    total = each.groupBy(*keys, "_range").agg(*(F.sum(n).alias(f"_t_{n}") for n in sums))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select(*keys, "_range", *(F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in sums))
    own = Window.partitionBy(*keys, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = each.join(F.broadcast(total), [*keys, "_range"])
    out = out.withColumns({f"before_{n}": F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(own), F.lit(0)) for n in sums})
    return out.select(*keys, value, *sums, *(f"before_{n}" for n in sums))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """(keys, value, out): each distinct value's rank in its group, ties averaged."""
    r = running_sums(df, keys, value, {"n": F.lit(1).cast("long")})
    return r.select(*keys, value, (F.col("before_n") + (F.col("n") + 1) / 2.0).alias(out))
