"""Zeros of curves, their certification on later rows, and the topology that certified ones make."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators import crosssection as xs
from phasegrid.operators import inference as inf
from phasegrid.operators.ranks import exact_quantiles
from phasegrid.sources.store import stored

TEST = ("return_mode", "fold", "horizon")


def _points(curve: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(keys, p): a curve's finite points in order of x. A curve is a grid of at most some thousand points."""
    ok = F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y) & (F.abs(x) < float("inf")) & (F.abs(y) < float("inf"))
    return curve.filter(ok).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))


def _roots(p: Column) -> Column:
    """Zeros of a list of points, in order, by linear interpolation; of zeros within two mean steps of the last one kept, none. A point at zero is a touch."""
    n = F.size(p)
    at = lambda i: F.get(p, i)

    def between(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        root = F.when(a["y"] == 0, a["x"]).when(a["y"] * b["y"] < 0, a["x"] - a["y"] * (b["x"] - a["x"]) / (b["y"] - a["y"]))
        way = F.when((a["y"] < 0) & (b["y"] >= 0), "R_to_M").when((a["y"] > 0) & (b["y"] <= 0), "M_to_R").otherwise("touch")
        return F.struct(root.alias("root"), way.alias("direction"), F.when(a["x"] != b["x"], (b["y"] - a["y"]) / (b["x"] - a["x"])).alias("slope"))

    found = F.when(n >= 2, F.filter(F.transform(F.sequence(F.lit(0), n - 2), between), lambda r: r["root"].isNotNull()))
    step = F.greatest(F.lit(1e-12), (at(n - 1)["x"] - at(F.lit(0))["x"]) / F.greatest(F.lit(2), n - 1))
    last = lambda acc: F.get(acc, F.size(acc) - 1)["root"]
    keep = lambda acc, r: F.when((F.size(acc) > 0) & (F.abs(r["root"] - last(acc)) <= 2 * step), acc).otherwise(F.concat(acc, F.array(r)))
    kind = "array<struct<root: double, direction: string, slope: double>>"
    return F.aggregate(F.coalesce(found, F.array().cast(kind)), F.array().cast(kind), keep)


def _path(p: Column, roots: Column) -> Column:
    """M, R or 0 in the middle of each stretch between the ends and roots, joined by arrows; values there by interpolation."""
    cuts = F.concat(F.array(F.get(p, F.lit(0))["x"]), F.transform(roots, lambda r: r["root"]), F.array(F.get(p, F.size(p) - 1)["x"]))

    def sign(i: Column) -> Column:
        mid = (F.get(cuts, i) + F.get(cuts, i + 1)) / 2
        k = F.greatest(F.size(F.filter(p, lambda q: q["x"] <= mid)), F.lit(1))
        a, b = F.get(p, k - 1), F.coalesce(F.get(p, k), F.get(p, k - 1))
        y = F.when(b["x"] == a["x"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (mid - a["x"]) / (b["x"] - a["x"]))
        return F.when(y > 0, "M").when(y < 0, "R").otherwise("0")

    return F.when(F.size(p) > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.size(roots)), sign), "→"))


def curve_topology(curve: DataFrame, x: str, y: str, keys: Sequence[str]) -> DataFrame:
    """(keys, n_roots, path, roots array<struct<root, direction, slope>>) of each curve."""
    out = _points(curve, x, y, keys).withColumn("roots", _roots(F.col("p")))
    return out.select(*keys, F.size("roots").cast("long").alias("n_roots"), _path(F.col("p"), F.col("roots")).alias("path"), "roots")


def root_rows(topology: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, root_index from 1, root, direction, slope)."""
    return topology.select(*keys, F.posexplode("roots").alias("_i", "r")).select(*keys, (F.col("_i") + 1).cast("long").alias("root_index"), "r.*")


def training_scale(train: DataFrame, keys: Sequence[str] = TEST) -> DataFrame:
    """(keys, train_scale, n_train): standard deviation of the response over training rows, dates weighing alike."""
    weighted = xs.with_date_weight(train, tuple(keys))
    sd = xs.weighted_moments(weighted, "phase_product", "weight", tuple(keys)).select(*keys, F.col("sd").alias("train_scale"))
    return sd.join(train.groupBy(*keys).agg(F.count("psi_primary").alias("n_train")), list(keys))


def certify_roots(rows: DataFrame, roots: DataFrame, reps: int, seed: Column, block: int, alpha: float = 0.05, width: float = 0.08, gap: float = 0.01, effect: float = 0.02, least_effect: float = 0.0, obs: int = 250, dates: int = 40, least_train: int = 200) -> DataFrame:
    """roots (return_mode, fold, horizon, root_index, root, direction) with what later rows say of each: root_quantile, reason, and on both sides
    the equal-date mean, its interval and directional p; epsilon, candidate_p (the larger of both p), candidate_p_holm within the curve, certified.

    rows: training and test rows of folds (part). Each side is a closed band of psi, between training quantiles `gap` and `width` away from the root. Both have to show
    their phase (R below M for R_to_M) by more than epsilon, `effect` weighted standard deviations of training rows, with an interval clear of zero. reason says
    why a root isn't eligible. seed: of each (return_mode, fold, horizon, root_index); the sides add 11 and 29. Roots are few: they are broadcast to the rows.
    """
    keys, roots = list(TEST), stored(roots, "roots")
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    few = F.broadcast(roots.select(*keys, "root_index", "root"))
    at = train.join(few, keys).groupBy(*keys, "root_index").agg(F.avg((F.col("psi_primary") <= F.col("root")).cast("double")).alias("root_quantile"))
    out = roots.select(*keys, "root_index", "root", "direction").join(at, [*keys, "root_index"], "left").join(F.broadcast(training_scale(train)), keys, "left")
    fits = (F.col("root_quantile") - width > 0) & (F.col("root_quantile") + width < 1)
    out = out.withColumn("reason", F.when(F.coalesce(F.col("n_train"), F.lit(0)) < least_train, "insufficient_train").when(~fits, "root_too_close_to_domain_edge"))
    out = stored(out, "root-places")
    # quantiles of each curve's training rows around each of its roots
    sides, wanted = ("left_lo", "left_hi", "right_lo", "right_hi"), {}
    for r in out.filter(F.col("reason").isNull()).select(*keys, "root_index", "root_quantile").orderBy("root_index").collect():
        wanted.setdefault(tuple(r[k] for k in keys), []).append(r)
    q = {tuple(r[k] for k in keys): r["q"] for r in exact_quantiles(train, "psi_primary", {k: [r["root_quantile"] + d for r in own for d in (-width, -gap, gap, width)] for k, own in wanted.items()}, keys).collect()} if wanted else {}
    edges = [(*k, r["root_index"], *q[k][4 * i : 4 * i + 4]) for k, own in wanted.items() for i, r in enumerate(own)]
    edges = out.sparkSession.createDataFrame(edges, "return_mode string, fold int, horizon int, root_index long, " + ", ".join(f"{c} double" for c in sides))
    out = out.join(F.broadcast(edges), [*keys, "root_index"], "left")
    bands = F.broadcast(out.filter(F.col("reason").isNull()).select(*keys, "root_index", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{n}_lo").alias("lo"), F.col(f"{n}_hi").alias("hi")) for s, n in ((0, "left"), (1, "right"))))).alias("b")).select(*keys, "root_index", "b.*"))
    inside = test.join(bands, keys).filter(F.col("psi_primary").between(F.col("lo"), F.col("hi")))
    days = xs.daily_means(inside, "phase_product", (*keys, "root_index", "side"))
    boot = inf.bootstrap(days.withColumn("_s", seed + F.when(F.col("side") == 0, 11).otherwise(29)), (*keys, "root_index", "side"), "day_mean", reps, F.col("_s"), block)
    n = days.groupBy(*keys, "root_index", "side").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_days"))
    both = boot.join(n, [*keys, "root_index", "side"])
    side = lambda c, s: F.max(F.when(F.col("side") == s, F.col(c)))
    made = both.groupBy(*keys, "root_index").agg(*(side(c, s).alias(f"{name}_{c}") for s, name in ((0, "left"), (1, "right")) for c in ("estimate", "ci_lo", "ci_hi", "p_gt0", "p_lt0", "n_rows", "n_days")))
    out = out.join(made, [*keys, "root_index"], "left")
    enough = lambda s: (F.coalesce(F.col(f"{s}_n_rows"), F.lit(0)) >= obs) & (F.coalesce(F.col(f"{s}_n_days"), F.lit(0)) >= dates)
    out = out.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(~(enough("left") & enough("right")), "insufficient_oos_support").when(F.col("direction") == "touch", "touch_not_transition").otherwise(""))
    out = out.withColumns({"eligible": F.col("reason") == "", "epsilon": F.greatest(F.lit(float(least_effect)), effect * F.coalesce("train_scale", F.lit(0.0)))})
    up = F.col("direction") == "R_to_M"
    p = F.greatest(F.when(up, F.col("left_p_lt0")).otherwise(F.col("left_p_gt0")), F.when(up, F.col("right_p_gt0")).otherwise(F.col("right_p_lt0")))
    known = F.col("left_p_lt0").isNotNull() & F.col("right_p_lt0").isNotNull()

    def passes(s: str, positive: Column) -> Column:
        e = F.col(f"{s}_estimate")
        return F.coalesce((F.abs(e) >= F.col("epsilon")) & F.when(positive, (e > 0) & (F.col(f"{s}_ci_lo") > 0)).otherwise((e < 0) & (F.col(f"{s}_ci_hi") < 0)), F.lit(False))

    out = out.withColumns({"effect_pass": F.col("eligible") & passes("left", ~up) & passes("right", up), "candidate_p": F.when(F.col("eligible") & known, p)})
    out = inf.holm_adjusted(out, TEST, "candidate_p", ("root_index",), "candidate_p_holm")
    return out.withColumn("certified", F.col("effect_pass") & F.coalesce(F.col("candidate_p_holm") <= alpha, F.lit(False)))


def certified_transitions(certified: DataFrame, attempts: DataFrame, width: float = 0.06, min_folds: int = 3, min_fraction: float = 0.75, most_iqr: float = 0.05) -> DataFrame:
    """Clusters of certified roots (return_mode, fold, horizon, direction, root, root_quantile), with their folds and whether enough of all attempts share them.

    attempts: (return_mode, horizon, fold) of all curves, with roots or without.
    """
    each = inf.cluster_roots(certified.filter("certified").select("return_mode", "fold", "horizon", "direction", "root", "root_quantile"), width)
    total = attempts.groupBy("return_mode", "horizon").agg(F.countDistinct("fold").alias("folds_total"))
    out = each.join(total, ["return_mode", "horizon"])
    out = out.withColumn("required", F.greatest(F.lit(min_folds), F.ceil(min_fraction * F.col("folds_total"))).cast("long"))
    return out.withColumn("certified_transition", (F.col("support") >= F.col("required")) & (F.col("iqr") <= most_iqr))


def certified_topology(transitions: DataFrame, keys: Sequence[str] = ("return_mode", "horizon"), place: str = "root_quantile") -> DataFrame:
    """(keys, n_transitions, directions, root_quantiles, consistent, path): certified transitions in order; directions have to take turns, else the path is INCONSISTENT."""
    order = F.array_sort(F.collect_list(F.struct(F.col(place).alias("q"), F.col("direction").alias("d"))))
    g = transitions.groupBy(*keys).agg(order.alias("o"))
    ways, n = F.transform("o", lambda r: r["d"]), F.size("o")
    starts_r = F.get(ways, F.lit(0)) == "R_to_M"
    expected = lambda i: F.when(starts_r == (i % 2 == 0), "R_to_M").otherwise("M_to_R")
    places = F.sequence(F.lit(0), n - 1)
    ok = F.forall(places, lambda i: F.get(ways, i) == expected(i))
    letters = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(starts_r == (i % 2 == 0), "R").otherwise("M"))
    return g.select(*keys, n.cast("long").alias("n_transitions"), F.array_join(ways, ",").alias("directions"), F.transform("o", lambda r: r["q"]).alias("root_quantiles"), ok.alias("consistent"), F.when(ok, F.array_join(letters, "→")).otherwise("INCONSISTENT").alias("path"))


def single_phase_folds(rows: DataFrame, n_roots: DataFrame, reps: int, seed: Column, block: int, alpha: float = 0.05, bands: int = 5, effect: float = 0.02, least_effect: float = 0.0, obs: int = 250, dates: int = 40) -> DataFrame:
    """(return_mode, fold, horizon, reason, eligible, phase, candidate_p, certified, epsilon, detail): whether each of `bands` bands of psi, of equal shares of training rows,
    has the same sign on test rows, by more than epsilon and with an interval clear of zero.

    n_roots: (return_mode, fold, horizon, n_roots) of the training curves; a curve with roots has no single phase. seed: of each fold and horizon; bands add 101, 202, ....
    """
    keys = list(TEST)
    train, test = rows.filter("part = 'train'"), rows.filter("part = 'test'")
    edges = exact_quantiles(train, "psi_primary", [i / bands for i in range(bands + 1)], keys, "_e").drop("n")
    whole = F.size(F.array_distinct("_e")) == bands + 1
    inner = F.slice("_e", 2, bands - 1)
    placed = test.join(F.broadcast(edges.filter(whole)), keys).withColumn("band", F.size(F.filter(inner, lambda e: e <= F.col("psi_primary"))))
    days = xs.daily_means(placed, "phase_product", (*keys, "band"))
    n = days.groupBy(*keys, "band").agg(F.sum("rows").alias("n_rows"), F.count("*").alias("n_days"))
    boot = inf.bootstrap(days.withColumn("_s", seed + 101 * (F.col("band") + 1)), (*keys, "band"), "day_mean", reps, F.col("_s"), block)
    each = boot.join(n, [*keys, "band"]).join(F.broadcast(training_scale(train)), keys)
    epsilon = F.greatest(F.lit(float(least_effect)), effect * F.coalesce("train_scale", F.lit(0.0)))
    sign = F.when((F.col("estimate") >= epsilon) & (F.col("ci_lo") > 0), 1).when((F.col("estimate") <= -epsilon) & (F.col("ci_hi") < 0), -1).otherwise(0)
    each = each.withColumns({"sign": sign, "epsilon": epsilon})
    each = each.withColumn("p", F.when(F.col("sign") > 0, F.col("p_gt0")).when(F.col("sign") < 0, F.col("p_lt0")))
    detail = F.sort_array(F.collect_list(F.struct("band", "estimate", "ci_lo", "ci_hi", "p", "n_rows", "n_days")))
    g = each.groupBy(*keys).agg(F.count("*").alias("_bands"), F.min((F.col("n_rows") >= obs) & (F.col("n_days") >= dates)).alias("_ok"), F.min(F.col("ci_lo").isNotNull()).alias("_ci"), F.min("sign").alias("_low"), F.max("sign").alias("_high"), F.count("p").alias("_np"), F.max("p").alias("_p"), F.max("epsilon").alias("epsilon"), detail.alias("detail"))
    out = n_roots.select(*keys, "n_roots").join(edges.select(*keys, whole.alias("_whole")), keys, "left").join(g, keys, "left")
    reason = F.when(F.col("n_roots") != 0, "train_surface_has_candidate_roots").when(~F.coalesce("_whole", F.lit(False)), "degenerate_psi_bins").when((F.coalesce("_bands", F.lit(0)) < bands) | ~F.coalesce("_ok", F.lit(False)), "insufficient_oos_band_support").when(~F.col("_ci"), "bootstrap_unavailable").otherwise("")
    out = out.withColumn("reason", reason).withColumn("eligible", F.col("reason") == "")
    one = F.col("eligible") & (F.col("_low") == F.col("_high")) & (F.col("_low") != 0)
    out = out.withColumns({"phase": F.when(one & (F.col("_low") > 0), "M").when(one, "R").otherwise(""), "candidate_p": F.when(F.col("eligible") & (F.col("_np") == bands), F.col("_p"))})
    out = out.withColumn("certified", one & F.coalesce(F.col("candidate_p") <= alpha, F.lit(False)))
    return out.select(*keys, "n_roots", "reason", "eligible", "phase", "candidate_p", "certified", "epsilon", "detail")


def single_phases(folds: DataFrame, min_folds: int = 3, min_fraction: float = 0.75) -> DataFrame:
    """(return_mode, horizon, folds_total, support, required, phase, certified_single_phase): the phase that most certified folds have, if enough of all do."""
    total = folds.groupBy("return_mode", "horizon").agg(F.countDistinct("fold").alias("folds_total"))
    out = total.join(inf.modal_phase(folds), ["return_mode", "horizon"], "left")
    out = out.withColumns({"required": F.greatest(F.lit(min_folds), F.ceil(min_fraction * F.col("folds_total"))).cast("long"), "support": F.coalesce("support", F.lit(0).cast("long")), "phase": F.coalesce("phase", F.lit(""))})
    return out.withColumn("certified_single_phase", F.col("support") >= F.col("required"))
