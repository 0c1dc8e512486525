"""Conversion of detections to tables for each tooth, and statistics of labelled sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .matching import BOX


def grouped_by_tooth(teeth: DataFrame, lesions: DataFrame) -> DataFrame:
    """One row for each tooth (case_id, tooth, box): estimated pixels, lesions, their surfaces in the order in which they come
    (pos), percentage of the tooth. Teeth without lesions stay. lesions: (case_id, tooth, pos, surface, confidence, box)."""
    box = tuple(F.col(c) for c in BOX)
    l = lesions.withColumn("pixels", S.lesion_area(box, F.col("confidence")))
    g = l.groupBy("case_id", "tooth").agg(F.sum("pixels").alias("caries_pixels"), F.count(F.lit(1)).alias("lesions"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("s"))
    g = g.select("case_id", "tooth", "caries_pixels", "lesions", "confidence", F.array_distinct("s.surface").alias("surfaces"))
    t = teeth.select("case_id", "tooth", S.tooth_area(box).alias("total_pixels")).join(g, ["case_id", "tooth"], "left")
    t = t.withColumn("caries_pixels", F.coalesce("caries_pixels", F.lit(0))).withColumn("lesions", F.coalesce("lesions", F.lit(0)))
    return t.withColumn("pct", F.bround(S.ratio(F.col("caries_pixels") * 100, F.col("total_pixels")), 2)).withColumn("surfaces", F.coalesce("surfaces", F.array().cast("array<string>")))


def conversion_totals(converted: DataFrame) -> DataFrame:
    with_caries = F.countDistinct(F.when(F.col("lesions") > 0, F.col("case_id")))
    return converted.agg(F.countDistinct("case_id").alias("cases"), with_caries.alias("cases_with_caries"), F.count(F.lit(1)).alias("teeth"), F.sum("lesions").alias("lesions"))


def label_statistics(labels: DataFrame, split: str = "split", label: str = "label", case: str = "case_id") -> DataFrame:
    """(split, label, annotations, cases), with null for all splits or labels. Each row is shuffled once, to its case, which holds its
    pairs of split and label once; only sums go on."""
    d = labels.select(F.col(case).alias("case"), F.col(split).alias("split"), F.col(label).alias("label"))
    none = {c: F.lit(None).cast(d.schema[c].dataType) for c in ("split", "label")}
    cell = lambda k, **c: F.struct(F.lit(k).alias("k"), *({**none, **c}[x].alias(x) for x in none))
    a, b = F.col("split"), F.col("label")
    n = d.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))
    n = n.select("n", F.inline(F.array(cell(0, split=a, label=b), cell(1, split=a), cell(2, label=b), cell(3)))).groupBy("k", "split", "label").agg(F.sum("n").alias("annotations"))
    held = d.filter("case is not null").select("case", F.struct("split", "label").alias("v")).repartition("case").groupBy("case").agg(F.collect_set("v").alias("v"))
    each = lambda f: F.array_distinct(F.transform("v", f))
    sets = F.concat(each(lambda v: cell(0, split=v["split"], label=v["label"])), each(lambda v: cell(1, split=v["split"])), each(lambda v: cell(2, label=v["label"])), F.array(cell(3)))
    cases = held.select(F.inline(sets)).groupBy("k", "split", "label").agg(F.count(F.lit(1)).alias("cases"))
    same = n["k"].eqNullSafe(cases["k"]) & n["split"].eqNullSafe(cases["split"]) & n["label"].eqNullSafe(cases["label"])
    return n.join(cases, same, "left").select(n["split"].alias(split), n["label"].alias(label), "annotations", F.coalesce("cases", F.lit(0)).alias("cases"))


def conformance(df: DataFrame, expected: list[str], required: list[str]) -> DataFrame:
    """(field, state, nulls): fields that df shares with the expected ones, lacks, or has beyond them, and the nulls of the
    required ones. One aggregation."""
    spark = df.sparkSession
    state = {**{f: "common" if f in df.columns else "missing" for f in expected}, **{f: "extra" for f in df.columns if f not in expected}}
    counts = df.agg(*(F.count_if(F.col(f).isNull()).alias(f) for f in required if f in df.columns), F.lit(0).alias("__none"))
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("long").alias("nulls")) for f in required if f in df.columns), F.struct(F.lit("").alias("field"), F.lit(0).cast("long").alias("nulls")))).alias("c")
    return spark.createDataFrame(sorted(state.items()), "field string, state string").join(counts.select(cells).select("c.*"), "field", "left")


def common_fields(a: DataFrame, b: DataFrame) -> list[str]:
    return sorted(set(a.columns) & set(b.columns))
