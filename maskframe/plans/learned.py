"""Queries on lesions: their features, labels, predicted surfaces and the folds of their cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..operators import learning, lesions, metrics, pixels, selection
from ..sources.shared import settled
from ..sources.views import view
from .registry import ORACLE_SQL, REL, query, r6
from .shapes import LESION, ON_TEETH, reachable

#: Labels of teeth: a few noisy ones for each, in the order pos. Both dialects.
TRUTH = """SELECT case_id, tooth_id, pos, CASE WHEN k % 5 = 0 THEN 'Distal' WHEN k % 3 = 0 THEN 'Occlusal' ELSE 'Mesial' END AS surface FROM (
  SELECT cast(floor(l_suppkey / 10) as int) AS case_id, cast(cast((1 + l_linenumber % 4) * 10 + 6 as int) as string) AS tooth_id, cast(round(l_tax * 100) as int) AS pos, min(l_partkey) AS k FROM {lineitem} GROUP BY 1, 2, 3) t"""


def tables(spark: SparkSession, sf: str, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """The lesion table of the masks, and the labels."""
    table = lesions.lesion_table(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi"), least)
    return settled(table), spark.sql(TRUTH, lineitem=spark.read.parquet(f"{sf}/lineitem.parquet"))


FEATURE_SQL = """SELECT rel.case_id, rel.tooth_id, lesion_idx, bool_or(whole) AS whole, round(avg(rel_x), 6) AS x_mean, round(stddev_pop(rel_y), 6) AS y_std, round(max(rel_x) - min(rel_x), 6) AS x_range, round(count(*) / (max(tooth_n) + 1e-6), 6) AS coverage,
  count(*) FILTER (rel_x BETWEEN 0.4 AND 0.6) AS o_, count(*) FILTER (CASE WHEN r THEN rel_x > 0.6 ELSE rel_x < 0.4 END) AS m_, count(*) FILTER (CASE WHEN r THEN rel_x < 0.4 ELSE rel_x > 0.6 END) AS d_
  FROM rel JOIN les ON rel.case_id = les.case_id AND rel.tooth_id = les.tooth_id AND rel.x = les.x AND rel.y = les.y GROUP BY ALL"""


@query("ml1_cls10_lesion_features", reachable(LESION.replace("p AS", "px AS"), 4, f""", sz AS (SELECT *, count(*) OVER (PARTITION BY case_id, tooth_id, comp) AS k FROM l), mx AS (SELECT *, max(k) OVER (PARTITION BY case_id, tooth_id) AS most FROM sz),
les AS (SELECT case_id, tooth_id, x, y, most < 3 AS whole, CASE WHEN most < 3 THEN 0 ELSE dense_rank() OVER (PARTITION BY case_id, tooth_id ORDER BY comp) - 1 END AS lesion_idx FROM mx WHERE k >= 3 OR most < 3), {REL[1:]}, z AS ({FEATURE_SQL})
SELECT case_id, tooth_id, CAST(lesion_idx AS INTEGER) AS lesion_idx, whole, x_mean, y_std, x_range, coverage, CASE WHEN m_ >= o_ AND m_ >= d_ THEN 'Mesial' WHEN o_ >= d_ THEN 'Occlusal' ELSE 'Distal' END AS zone FROM z""", *ON_TEETH, name="px"))
def _(spark, sf):
    table, _truth = tables(spark, sf)
    return table.filter("x_mean is not null").select(*lesions.LESION, "whole", *r6("x_mean", "y_std", "x_range", "coverage"), "zone")


@query("ml1_labelled_lesions")
def _(spark, sf):
    """The training table: lesions with features, their zone, and the label that they took from their tooth."""
    return lesions.labelled_lesions(*tables(spark, sf)).select(*lesions.LESION, "zone", "label", *r6("x_mean", "coverage"))


@query("cls9_10_predicted_lesions")
def _(spark, sf):
    """A forest of four fifths of the cases predicts the surface of every lesion."""
    table, truth = tables(spark, sf)
    known = settled(selection.with_split(lesions.labelled_lesions(table, truth), "case_id").filter("split = 'train'"))
    model = learning.train_forest(known, lesions.FEATURES, trees=20) if known.head(1) else None
    return lesions.predicted_lesions(table, model).select(*lesions.LESION, "whole", "surface", F.round("score", 4).alias("score"), "method")


@query("ml7_scores_by_fold_and_class")
def _(spark, sf):
    """Figures of five folds of cases, for each class."""
    d = lesions.labelled_lesions(*tables(spark, sf))
    seen = learning.cross_predictions(d, lesions.FEATURES, "case_id", trees=10)
    return metrics.per_label(seen, true="label", pred="y_pred", by=["fold"]).select("fold", "label", *r6("precision", "recall", "f1"), "support")


@query("ml7_fold_balance", "SELECT 5 AS folds, count(*) AS n, count(DISTINCT group_id) AS groups, true AS whole, true AS balanced FROM v_label_pairs", "v_label_pairs")
def _(spark, sf):
    """Folds of the label pairs: every row is in one, no group is cut, sizes differ by one group at most."""
    d = learning.with_folds(view(spark, sf, "v_label_pairs").select("sample_id", "group_id"), "group_id")
    g = d.groupBy("group_id").agg(F.min("fold").alias("fold"), F.max("fold").alias("last"), F.count(F.lit(1)).alias("size"))
    f = g.groupBy("fold").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("groups"), F.max("size").alias("size"), F.max(F.col("last") - F.col("fold")).alias("cut"))
    return f.agg(F.count(F.lit(1)).cast("int").alias("folds"), F.sum("n").alias("n"), F.sum("groups").alias("groups"), (F.max("cut") == 0).alias("whole"), (F.max("n") - F.min("n") <= F.max("size")).alias("balanced"))



# the same through SQL functions


@query("udf2_lesions_in_sql", ORACLE_SQL["win9_lesion_index"])
def _(spark, sf):
    sql.register(spark)
    decay = pixels.lesion_pixels(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi"))
    return spark.sql("SELECT case_id, tooth_id, lesion_idx, count(*) AS n FROM lesions(TABLE(SELECT case_id, tooth_id, x, y FROM {d}) PARTITION BY (case_id, tooth_id)) GROUP BY ALL", d=decay)


@query("udf3_hull_in_sql", "SELECT case_id, tooth_id, min(x) AS least_x, max(x) AS most_x, min(y) AS least_y, max(y) AS most_y FROM v_pixels GROUP BY ALL", "v_pixels")
def _(spark, sf):
    """The ends of each mask, read from the corners of its hull."""
    sql.register(spark)
    corners = spark.sql("SELECT case_id, tooth_id, hull(x, y) AS corners FROM {p} GROUP BY ALL", p=view(spark, sf, "v_pixels"))
    return corners.selectExpr("case_id", "tooth_id", "array_min(corners.x) AS least_x", "array_max(corners.x) AS most_x", "array_min(corners.y) AS least_y", "array_max(corners.y) AS most_y")
