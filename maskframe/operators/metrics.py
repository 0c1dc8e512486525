"""Scores of predicted against true labels, calibration, and comparison of versions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S


def per_label(pairs: DataFrame, true: str = "y_true", pred: str = "y_pred", by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, label, tp, support, predicted, precision, recall, f1) over the union of labels seen on either side. Pairs are
    counted first, so only label combinations go on."""
    by, w = by or [], F.lit(1) if weight is None else weight
    cells = pairs.groupBy(*by, true, pred).agg(F.sum(w).alias("c"))
    sides = cells.select(*by, "c", F.explode(F.array(F.struct(F.col(true).alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(true) == F.col(pred)).cast("int").alias("h")), F.struct(F.col(pred).alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("s")).select(*by, "c", "s.*")
    g = sides.groupBy(*by, "label").agg(F.sum(F.col("c") * F.col("h")).alias("tp"), F.sum(F.col("c") * F.col("t")).alias("support"), F.sum(F.col("c") * F.col("p")).alias("predicted"))
    g = g.withColumn("precision", S.ratio(F.col("tp"), F.col("predicted"))).withColumn("recall", S.ratio(F.col("tp"), F.col("support")))
    return g.withColumn("f1", S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def macro(pairs: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    """Accuracy and macro precision, recall, F1; empty divisions count 0."""
    g = per_label(pairs, by=by, **names).groupBy(*(by or []))
    return g.agg(S.ratio(F.sum("tp"), F.sum("support")).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"))


def report(pairs: DataFrame, **names) -> DataFrame:
    """Per label, then macro and weighted averages: (label, precision, recall, f1, support)."""
    p = per_label(pairs, **names)
    cols = ("precision", "recall", "f1")
    total = F.sum("support").alias("support")
    avg = p.agg(*(F.avg(c).alias(c) for c in cols), total).select(F.lit("macro avg").alias("label"), *cols, "support")
    weighted = p.agg(*(S.ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in cols), total).select(F.lit("weighted avg").alias("label"), *cols, "support")
    return p.select("label", *cols, "support").unionByName(avg).unionByName(weighted)


def confusion(pairs: DataFrame, labels: list[str], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Rows true, columns n_<label>, in fixed order and zero filled."""
    spark = pairs.sparkSession
    counts = pairs.groupBy(true).agg(*(F.count_if(F.col(pred) == l).alias(f"n_{l}") for l in labels))
    frame = spark.createDataFrame([(l,) for l in labels], f"{true} string")
    return frame.join(counts, true, "left").fillna(0)


def confused_pairs(pairs: DataFrame, true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return pairs.filter(F.col(true) != F.col(pred)).groupBy(true, pred).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), true, pred)


def detection_scores(matches: DataFrame) -> DataFrame:
    """Precision, recall and F1 from match_type rows."""
    tp, fp, fn = F.count_if(F.col("match_type").isin("tooth_id", "centroid_proximity")), F.count_if(F.col("match_type") == "FP"), F.count_if(F.col("match_type") == "FN")
    c = matches.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    c = c.withColumn("precision", S.ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", S.ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return c.withColumn("f1", S.ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def shares(df: DataFrame, col: str) -> DataFrame:
    """Value counts with percentages."""
    g = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("pct", S.half_up(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 2))


def histogram(df: DataFrame, col: str, low: float, width: float) -> DataFrame:
    b = F.floor((F.col(col) - low) / width).cast("long")
    return df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibration(proba: DataFrame, bins: int = 10, label: str = "y_true") -> DataFrame:
    """Mean predicted and observed rate in uniform bins of p, for each label one against the rest; empty bins are left out."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    cells = proba.withColumn("bin", b).groupBy("bin", label).agg(F.count(F.lit(1)).alias("c"), F.sum("p").alias("sp"))
    total = cells.groupBy("bin").agg(F.sum("c").alias("n"), F.sum("sp").alias("sum_p"))
    return cells.join(total, "bin").select("bin", label, "n", (F.col("sum_p") / F.col("n")).alias("mean_p"), (F.col("c") / F.col("n")).alias("observed"))


def rejection_curve(pairs: DataFrame, confidence: str, thresholds: list[float], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Scores of what is left when rows below a confidence are rejected. Rows are counted once by (labels, number of
    thresholds passed); the few cells are then spread over the thresholds."""
    passed = sum((F.col(confidence) >= t).cast("int") for t in thresholds)
    cells = pairs.withColumn("passed", passed).groupBy(true, pred, "passed").agg(F.count(F.lit(1)).alias("c"))
    each = cells.select(true, pred, "passed", "c", F.posexplode(F.array(*map(F.lit, thresholds))).alias("i", "threshold"))
    total = each.groupBy("threshold").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("i") < F.col("passed"), F.col("c")).otherwise(0)).alias("remaining"))
    scored = macro(each.filter(F.col("i") < F.col("passed")), by=["threshold"], true=true, pred=pred, weight=F.col("c"))
    out = total.join(scored.select("threshold", "accuracy", "macro_f1"), "threshold", "left")
    return out.select("threshold", "remaining", (F.col("total") - F.col("remaining")).alias("rejected"), S.ratio(F.col("remaining"), F.col("total")).alias("coverage"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))


def duration_summary(df: DataFrame, col: str) -> DataFrame:
    """One row: mean, exact percentiles, ends and rate of a duration in milliseconds."""
    q = quantiles(df, col, [0.5, 0.95, 0.99]).agg(*(F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.5, "median"), (0.95, "p95"), (0.99, "p99"))))
    g = df.agg(F.avg(col).alias("mean"), F.min(col).alias("least"), F.max(col).alias("most"))
    return g.join(q, F.lit(True)).select("mean", "median", "p95", "p99", "least", "most", (1000 / F.col("mean")).alias("per_second"))  # two single rows


#: Ranges that a group's values are counted in.
RANGES = 4096


def quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, prob, value): exact quantiles with linear interpolation; nulls and NaN are left out.

    A first pass takes each group's ends; a second counts values in RANGES equal ranges between them, which merges before the
    shuffle; only values of ranges that hold a wanted rank are then counted one by one and ordered. So a task holds
    the distinct values of one range, not of a group. Infinite values are kept in ranges of their own.
    """
    if not by:
        return quantiles(df.withColumn("__all", F.lit(0)), col, probs, ["__all"]).drop("__all")
    d = df.select(*by, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    finite = F.abs("__v") < float("inf")
    ends = d.groupBy(*by).agg(F.min(F.when(finite, F.col("__v"))).alias("__lo"), F.max(F.when(finite, F.col("__v"))).alias("__hi"), F.count(F.lit(1)).alias("__n"))
    meets = F.lit(True)
    for k in by:
        meets = meets & F.col(f"d.{k}").eqNullSafe(F.col(f"e.{k}"))
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    # halves, as the distance of the ends may exceed what a double can hold
    place = F.least(F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * RANGES), F.lit(RANGES - 1))
    place = F.when(v == float("-inf"), -1).when(v == float("inf"), RANGES).when(hi > lo, place).otherwise(0).cast("int")
    in_range = d.alias("d").join(ends.alias("e"), meets).select(*(F.col(f"d.{k}").alias(k) for k in by), v, "__n", place.alias("__range"))
    counts = in_range.groupBy(*by, "__range").agg(F.count(F.lit(1)).alias("__c"), F.first("__n").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__c").over(before), F.lit(0)))
    at = F.col("p") * (F.col("__n") - 1)
    wanted = counts.select(*by, "__range", "__before", "__c", "__n", F.explode(F.array(*map(F.lit, probs))).alias("p"))
    wanted = wanted.select(*by, "__range", "__before", "__c", "p", F.inline(F.array(F.struct(F.floor(at).alias("rank"), (1 - (at - F.floor(at))).alias("share")), F.struct((F.floor(at) + 1).alias("rank"), (at - F.floor(at)).alias("share")))))
    wanted = wanted.filter((F.col("rank") >= F.col("__before")) & (F.col("rank") < F.col("__before") + F.col("__c")) & (F.col("share") > 0))
    same = F.col("d.__range") == F.col("w.__range")
    for k in by:
        same = same & F.col(f"d.{k}").eqNullSafe(F.col(f"w.{k}"))
    ranges = wanted.select(*by, "__range", "__before").distinct()
    few = in_range.alias("d").join(ranges.alias("w"), same).groupBy(*(F.col(f"d.{k}").alias(k) for k in by), F.col("d.__range").alias("__range"), F.col("w.__before").alias("__first"), "__v").agg(F.count(F.lit(1)).alias("__k"))
    upto = Window.partitionBy(*by, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    few = few.withColumn("__end", F.col("__first") + F.sum("__k").over(upto))
    hit = few.alias("d").join(wanted.alias("w"), same & (F.col("w.rank") < F.col("__end")) & (F.col("w.rank") >= F.col("__end") - F.col("__k")))
    return hit.groupBy(*(F.col(f"w.{k}").alias(k) for k in by), F.col("w.p").alias("prob")).agg(F.sum(F.col("w.share") * F.col("__v")).alias("value"))


def box_plot(df: DataFrame, col: str, by: list[str]) -> DataFrame:
    """(by, n, mean, least, q1, median, q3, most) of each group, with exact quartiles."""
    q = quantiles(df, col, [0.25, 0.5, 0.75], by)
    own = df.filter(F.col(col).isNotNull() & ~F.isnan(F.col(col).cast("double"))).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean"), F.min(col).alias("least"), F.max(col).alias("most"))
    at = lambda p, name: F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
    wide = q.groupBy(*by).agg(at(0.25, "q1"), at(0.5, "median"), at(0.75, "q3"))
    meets = F.lit(True)
    for k in by:
        meets = meets & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return own.alias("a").join(wide.alias("b"), meets).select(*(F.col(f"a.{k}").alias(k) for k in by), "n", "mean", "least", "q1", "median", "q3", "most")


def confidence_by_correctness(df: DataFrame, confidence: str, correct: Column) -> DataFrame:
    return box_plot(df.withColumn("correct", correct), confidence, ["correct"]).select("correct", "n", "mean", "median", "least", "most")


def fold_summary(folds: DataFrame, metrics: list[str]) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics))).alias("m")
    return folds.select(cells).groupBy("m.metric").agg(F.avg("m.value").alias("mean"), F.stddev_pop("m.value").alias("std"), F.min("m.value").alias("least"), F.max("m.value").alias("most"))


def f1_difference(pairs: DataFrame, a: str = "y_pred_a", b: str = "y_pred_b") -> DataFrame:
    """Macro F1 of two versions on the same rows, and their difference."""
    one, two = macro(pairs, pred=a).select(F.col("macro_f1").alias("f1_a")), macro(pairs, pred=b).select(F.col("macro_f1").alias("f1_b"))
    return one.join(two, F.lit(True)).withColumn("difference", F.col("f1_a") - F.col("f1_b"))  # two single rows


#: Label combinations that bootstrap() takes.
MOST_CELLS = 100_000


def bootstrap(pairs: DataFrame, replicates: int = 1000, seed: int = 42, a: str = "y_pred_a", b: str = "y_pred_b") -> DataFrame:
    """(replicate, difference): paired resampling. The counts of (true, a, b) are all that a replicate needs, so rows are collapsed to
    those cells and each replicate draws cell counts from a multinomial in its own task. The cells are held by the driver and
    each task: more than MOST_CELLS are an error, never dropped."""
    import numpy as np
    import pandas as pd

    cells = pairs.groupBy("y_true", a, b).agg(F.count(F.lit(1)).alias("c")).orderBy("y_true", a, b).limit(MOST_CELLS + 1).toPandas()  # label combinations
    if len(cells) > MOST_CELLS:
        raise ValueError(f"bootstrap: more than {MOST_CELLS} combinations of labels")
    counts = cells["c"].to_numpy()
    names = sorted({*cells["y_true"], *cells[a], *cells[b]})
    at = {n: i for i, n in enumerate(names)}
    codes = {c: cells[c].map(at).to_numpy(dtype=int) for c in ("y_true", a, b)}

    def f1(w: np.ndarray, col: str) -> float:
        k, hit = len(names), codes["y_true"] == codes[col]
        tp = np.bincount(codes["y_true"][hit], weights=w[hit], minlength=k)
        t, p = np.bincount(codes["y_true"], weights=w, minlength=k), np.bincount(codes[col], weights=w, minlength=k)
        seen = (t + p) > 0
        return float((2 * tp[seen] / (t + p)[seen]).mean())

    def run(batches):
        for r in batches:
            out = []
            for i in r["id"]:
                w = np.random.default_rng([seed, i]).multinomial(counts.sum(), counts / counts.sum())
                out.append(f1(w, a) - f1(w, b))
            yield pd.DataFrame({"replicate": r["id"], "difference": out})

    return pairs.sparkSession.range(replicates).mapInPandas(run, "replicate long, difference double")


def bootstrap_summary(draws: DataFrame) -> DataFrame:
    d = draws.agg(F.percentile("difference", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg((F.col("difference") <= 0).cast("double")).alias("lo"), F.avg((F.col("difference") >= 0).cast("double")).alias("hi"))
    return d.select(F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"), F.least(F.lit(1.0), 2 * F.least("lo", "hi")).alias("p_value"))


def two_proportions(pairs: DataFrame, a: str = "y_pred_a", b: str = "y_pred_b") -> DataFrame:
    """Pooled z of the accuracies of two versions."""
    c = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col("y_true")).alias("hits_a"), F.count_if(F.col(b) == F.col("y_true")).alias("hits_b"))
    pool = (F.col("hits_a") + F.col("hits_b")) / (2 * F.col("n"))
    return c.withColumn("z", S.ratio((F.col("hits_a") - F.col("hits_b")) / F.col("n"), F.sqrt(pool * (1 - pool) * 2 / F.col("n"))))


def two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


#: Coefficients of the exponent of Chebyshev's fit of erfc, whose relative error stays below 1.2e-7.
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def p_value(z: Column) -> Column:
    """Two-sided p of a standard normal z, as a column."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + x / 2)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    return t * F.exp(power - x * x)


def verdict(p: Column, alpha: float = 0.05) -> Column:
    return F.when(p < alpha, "significant").otherwise("not significant")
