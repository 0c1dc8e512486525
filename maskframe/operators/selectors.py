"""Showcases of the second kind, chosen from the evaluation table.

rows: (case_id, id, tooth_id, match_type, pca_clamped, surface_match, surface_match_strict, detail). Each selector keeps n rows;
ties go to the smaller case and id. Ranks are taken within cases or teeth, and only the last cut orders all that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import complexity
from .evaluation import MATCHED
from .selection import WISDOM, first_of, priority_first

#: The cases that are shown first.
CLAMP_CASE, SOFT_CASE = 33, 311
KEY = ["case_id", "id"]


def _key() -> list[Column]:
    return [F.col(k) for k in KEY]


def _hits(rows: DataFrame, *kinds: str) -> DataFrame:
    hits = rows.filter(F.col("match_type").isin(*MATCHED))
    return hits.filter(F.col("surface_match").isin(*kinds)) if kinds else hits


def clamp_wins(rows: DataFrame, n: int = 5) -> DataFrame:
    """Right surfaces of teeth whose angle was set to 0, one of a case, case 33 first."""
    one = first_of(_hits(rows, "True", "True_with_warning").filter("pca_clamped"), ["case_id"], _key())
    return priority_first(one, "case_id", [CLAMP_CASE], _key(), n)


def soft_rescues(rows: DataFrame, n: int = 5) -> DataFrame:
    """Surfaces that only the soft match accepts, one of a case, case 311 first, then the most complex."""
    pool = _hits(rows, "True_with_warning", "Partial").filter(~F.col("surface_match_strict"))
    order = [F.desc(complexity(F.col("detail"))), *_key()]
    return priority_first(first_of(pool, ["case_id"], order), "case_id", [SOFT_CASE], order, n)


def squarish_molars(rows: DataFrame, n: int = 5) -> DataFrame:
    """Right wisdom teeth: the first case of each, then further ones, one of a case, by case."""
    pool = _hits(rows, "True", "True_with_warning").filter(F.col("tooth_id").isin(*WISDOM))
    ranked = pool.withColumn("__tooth", F.row_number().over(Window.partitionBy("tooth_id").orderBy(*_key())))
    more = first_of(ranked.filter("__tooth > 1"), ["case_id"], _key())
    both = ranked.filter("__tooth = 1").withColumn("__tier", F.lit(1)).unionByName(more.withColumn("__tier", F.lit(2)))
    return both.orderBy("__tier", F.when(F.col("__tier") == 1, F.col("tooth_id")), *_key()).limit(n).drop("__tooth", "__tier")


def missing_upstream(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first miss of each case, cases with most misses first; adds fn_in_case."""
    missed = rows.filter("match_type = 'FN'").withColumn("fn_in_case", F.count(F.lit(1)).over(Window.partitionBy("case_id")))
    order = [F.desc("fn_in_case"), *_key()]
    return first_of(missed, ["case_id"], order).orderBy(*order).limit(n)


def dashboards(rows: DataFrame, n: int = 5, least: int = 5) -> DataFrame:
    """(case_id, n_teeth, soft_accuracy, strict_accuracy) of the best cases with at least `least` matched teeth."""
    soft = F.col("surface_match").isin("True", "True_with_warning").cast("int")
    g = _hits(rows).groupBy("case_id").agg(F.count(F.lit(1)).alias("n_teeth"), F.avg(soft).alias("soft_accuracy"), F.avg(F.col("surface_match_strict").cast("int")).alias("strict_accuracy"))
    return g.filter(F.col("n_teeth") >= least).orderBy(F.desc("soft_accuracy"), F.desc("strict_accuracy"), F.desc("n_teeth"), "case_id").limit(n)


SELECTORS = {"angle_clamp": clamp_wins, "soft_match": soft_rescues, "squarish_molar": squarish_molars, "missing_upstream": missing_upstream}


def showcases(rows: DataFrame, n: int = 5) -> DataFrame:
    """(category, case_id, id, tooth_id) of the selectors that choose teeth."""
    out = None
    for name, select in SELECTORS.items():
        one = select(rows, n).select(F.lit(name).alias("category"), *KEY, "tooth_id")
        out = one if out is None else out.unionByName(one)
    return out
