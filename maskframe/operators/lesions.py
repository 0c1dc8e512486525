"""Lesions of teeth: their features, labels and predicted surfaces, each step a join or an aggregation on (case, tooth, lesion)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from . import learning, matching, pixels, zones
from .pixels import KEYS

LESION = [*KEYS, "lesion_idx"]
#: The surfaces that a forest may choose, in the order in which ties are broken; its features.
SURFACES = ("Occlusal", "Mesial", "Distal")
FEATURES = ["is_upper", "x_mean", "y_mean", "x_std", "y_std", "x_min", "x_max", "y_min", "x_range", "y_range", "x_centroid_dist", "aspect_ratio", "coverage"]


def lesions(decay: DataFrame, least: int = 15, radius2: int = 4) -> DataFrame:
    """(keys, lesion_idx, x, y, whole): decay pixels of teeth in clusters of at least `least` pixels, numbered from 0 in the order
    of their first pixels. A tooth without such a cluster is one lesion, number 0, of all its pixels (whole)."""
    sized = pixels.labelled(decay, radius2).withColumn("size", F.count(F.lit(1)).over(Window.partitionBy(*KEYS, "comp")))
    sized = sized.withColumn("most", F.max("size").over(Window.partitionBy(*KEYS)))
    kept = sized.filter((F.col("size") >= least) | (F.col("most") < least)).withColumn("whole", F.col("most") < least)
    number = F.dense_rank().over(Window.partitionBy(*KEYS).orderBy("comp")) - 1
    return kept.withColumn("lesion_idx", F.when(F.col("whole"), 0).otherwise(number)).select(*LESION, "x", "y", "whole")


def lesion_table(tooth: DataFrame, decay: DataFrame, least: int = 15, least_tooth: int = 10) -> DataFrame:
    """(keys, lesion_idx, whole, features, zone) of the lesions of teeth with at least least_tooth pixels; zone is the x-thirds
    surface. Lesions of teeth whose box has no area have no features and the zone Other. Masks, lesions and their places are
    made once, and read by each step."""
    tooth = settled(tooth)
    big = tooth.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_tooth).select(*KEYS)
    own = settled(lesions(pixels.lesion_pixels(tooth, decay), least).join(big, KEYS, "left_semi"))
    r = settled(pixels.relative(tooth, own))
    known = pixels.features(r, LESION).join(zones.x_thirds(r, LESION).select(*LESION, F.col("surface").alias("zone")), LESION)
    named = own.groupBy(*LESION).agg(F.first("whole").alias("whole"))
    return named.join(known, LESION, "left").withColumn("zone", F.coalesce("zone", F.lit("Other")))


def labelled_lesions(table: DataFrame, truth: DataFrame) -> DataFrame:
    """lesion_table() rows with label: each lesion takes the label of its tooth that equals its zone, else the first one that is left; lesions
    beyond the labels of their tooth are left out, as are whole blobs. truth: (keys, pos, surface)."""
    open_ = table.filter("not whole").select(*KEYS, F.col("lesion_idx").alias("pos"), F.col("zone").alias("surface"))
    given = matching.assign_labels(open_, truth.select(*KEYS, "pos", "surface"), KEYS)
    return table.join(given.select(*KEYS, F.col("pos").alias("lesion_idx"), "label"), LESION)


def predicted_lesions(table: DataFrame, model: PipelineModel | None, features: list[str] = FEATURES) -> DataFrame:
    """(keys, lesion_idx, whole, surface, score, method): the likeliest of SURFACES by the forest, or the zone where there is no
    model, no feature, or no surface that the model knows."""
    if model is None:
        return table.select(*LESION, "whole", F.col("zone").alias("surface"), F.lit(None).cast("double").alias("score"), F.lit("x_thirds").alias("method"))
    known = F.lit(True)
    for f in features:
        known = known & F.col(f).isNotNull()
    s = learning.surface_scores(model, table.withColumn("known", known).fillna(0.0, features), SURFACES)
    by_model = F.col("known") & F.col("best").isNotNull()
    return s.select(*LESION, "whole", F.when(by_model, F.col("best")).otherwise(F.col("zone")).alias("surface"), F.when(by_model, F.array_max("scores")).alias("score"), F.when(by_model, "forest").otherwise("x_thirds").alias("method"))


def documents(predictions: DataFrame, confidence: DataFrame, version: str) -> DataFrame:
    """One row for each case (case_number, teeth_data) as predictions are exchanged. confidence: (keys, confidence)."""
    p = predictions.join(confidence, KEYS, "left")
    tooth = F.struct("tooth_id", "lesion_idx", F.lit(version).alias("version"), F.lit(True).alias("has_caries"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("surface").alias("caries_position_detail"), F.col("surface").alias("predicted_surface_fine"))
    return p.groupBy(F.col("case_id").alias("case_number")).agg(F.array_sort(F.collect_list(tooth)).alias("teeth_data"))
