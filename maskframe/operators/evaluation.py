"""The evaluation table: one row for each match, false find and miss, and the scores that are read from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MATCHED = ("tooth_id", "centroid_proximity")
#: What rows without a side hold.
DEFAULTS = {"gt_surface": "", "gt_surface_norm": "", "pred_surface": "", "pred_surface_norm": "", "distance": -1.0}


def only_caries(predictions: DataFrame, overlaps: DataFrame, keys: list[str]) -> DataFrame:
    """Predictions whose tooth has decay; teeth without a row have none."""
    return predictions.join(overlaps.filter("has_caries").select(*keys).distinct(), keys, "left_semi")


def evaluation_rows(matches: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(case_id, gt, pred, match_type, distance, surfaces, surface_match_strict, surface_match) from greedy_match() rows,
    truth (case_id, id, surface) and predicted (case_id, id, surface, frac_m, frac_c, frac_d)."""
    t = truth.select("case_id", F.col("id").alias("gt"), F.col("surface").alias("gt_surface"))
    p = predicted.select("case_id", F.col("id").alias("pred"), F.col("surface").alias("pred_surface"), "frac_m", "frac_c", "frac_d")
    j = matches.join(t, ["case_id", "gt"], "left").join(p, ["case_id", "pred"], "left")
    hit = F.col("match_type").isin(*MATCHED)
    strict = hit & (S.coarse_surface(F.col("gt_surface")) == S.coarse_surface(F.col("pred_surface")))
    soft = F.when(hit, S.soft_match(F.col("gt_surface"), F.col("pred_surface"), F.col("frac_m"), F.col("frac_c"), F.col("frac_d"))).otherwise("False")
    norm = lambda c, side: F.when(F.col(side).isNotNull(), S.coarse_surface(F.col(c)))
    out = j.select("case_id", "gt", "pred", "match_type", "distance", "gt_surface", norm("gt_surface", "gt").alias("gt_surface_norm"), "pred_surface", norm("pred_surface", "pred").alias("pred_surface_norm"), strict.alias("surface_match_strict"), soft.alias("surface_match"))
    return out.fillna(DEFAULTS)


def surface_accuracy(rows: DataFrame) -> DataFrame:
    """One row: strict and soft accuracy over matched rows, 0 without any."""
    m = rows.filter(F.col("match_type").isin(*MATCHED))
    soft = F.col("surface_match").isin("True", "Partial", "True_with_warning")
    return m.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.col("surface_match_strict").cast("int")), F.lit(0.0)).alias("strict"), F.coalesce(F.avg(soft.cast("int")), F.lit(0.0)).alias("soft"))


def leaderboard(rows: DataFrame, n: int, least: int = 5) -> DataFrame:
    """The n best cases of at least `least` matched rows, by soft rate, strict rate and rows."""
    m = rows.filter(F.col("match_type").isin(*MATCHED))
    soft = F.col("surface_match").isin("True", "Partial", "True_with_warning")
    g = m.groupBy("case_id").agg(F.count(F.lit(1)).alias("teeth"), F.avg(F.col("surface_match_strict").cast("int")).alias("strict_rate"), F.avg(soft.cast("int")).alias("soft_rate"))
    return g.filter(F.col("teeth") >= least).orderBy(F.desc("soft_rate"), F.desc("strict_rate"), F.desc("teeth"), "case_id").limit(n)


def run_summary(overlaps: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of counters: cases in all and processed, teeth, teeth with decay, their percentage."""
    done = overlaps.agg(F.countDistinct("case_id").alias("processed"), F.count(F.lit(1)).alias("teeth"), F.count_if(F.col("caries_pixels") > 0).alias("with_caries"))
    total = cases.agg(F.countDistinct("case_id").alias("cases"))
    return total.join(done, F.lit(True)).withColumn("failed", F.col("cases") - F.col("processed")).withColumn("pct", F.bround(S.ratio(F.col("with_caries") * 100, F.col("teeth")), 2))


def error_rows(scored: DataFrame, true: str = "y_true", pred: str = "y_pred", proba: str = "proba") -> DataFrame:
    """Misclassified rows with their largest probability."""
    return scored.filter(F.col(true) != F.col(pred)).withColumn("confidence", F.array_max(proba))
