"""Matching detections, predictions and expert labels."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

BOX = ("x1", "y1", "x2", "y2")


def _box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(prefix + c) for c in BOX)


def detections_to_teeth(detections: DataFrame, teeth: DataFrame, least_iou: float = 0.1) -> DataFrame:
    """(case_id, det_id, tooth, method): the best tooth of the same case for each detection.

    First teeth whose box holds the detection's centre (best overlap), then overlaps above least_iou, then the nearest centre;
    ties go to the smaller tooth id. Boxes meet by case only.
    """
    t = teeth.select("case_id", F.col("det_id").alias("tooth"), *(F.col(c).alias(f"t_{c}") for c in BOX))
    j = detections.join(t, "case_id")
    cx, cy = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    tx, ty = (F.col("t_x1") + F.col("t_x2")) / 2, (F.col("t_y1") + F.col("t_y2")) / 2
    j = j.withColumn("iou", S.box_iou(_box(), _box("t_"))).withColumn("dist", F.hypot(cx - tx, cy - ty))
    tier = F.when(S.in_box(cx, cy, _box("t_")), 0).when(F.col("iou") > least_iou, 1).otherwise(2)
    j = j.withColumn("tier", tier).withColumn("rank_by", F.when(tier < 2, -F.col("iou")).otherwise(F.col("dist")))
    best = j.groupBy("case_id", "det_id").agg(F.min(F.struct("tier", "rank_by", "tooth")).alias("b"))
    names = F.element_at(F.array(F.lit("center_inside"), F.lit("overlap"), F.lit("nearest")), F.col("b.tier") + 1)
    return best.select("case_id", "det_id", "b.tooth", names.alias("method"))


def nearest_reference(points: DataFrame, reference: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest of all reference centres (tooth_id, center_x, center_y; a few dozen, one array that goes to every task) for
    each point. Points are not shuffled."""
    centres = reference.agg(F.collect_list(F.struct("tooth_id", "center_x", "center_y")).alias("centres"))
    d = lambda c: F.hypot(F.col("x") - c["center_x"], F.col("y") - c["center_y"])
    best = F.array_min(F.transform("centres", lambda c: F.struct(d(c).alias("d"), c["tooth_id"].alias("t"))))
    return points.join(F.broadcast(centres), F.lit(True)).withColumn("b", best).select(*keys, F.col("b.t").alias("tooth_id"), F.col("b.d").alias("distance"))


def without_duplicates(boxes: DataFrame, most_iou: float = 0.5) -> DataFrame:
    """Boxes that no more confident box of their case overlaps by more than most_iou (ties: the smaller det_id wins)."""
    o = boxes.select("case_id", F.col("det_id").alias("o_id"), F.col("confidence").alias("o_conf"), *(F.col(c).alias(f"o_{c}") for c in BOX))
    better = (F.col("o_conf") > F.col("confidence")) | ((F.col("o_conf") == F.col("confidence")) & (F.col("o_id") < F.col("det_id")))
    beaten = boxes.join(o, "case_id").filter(better & (S.box_iou(_box(), _box("o_")) > most_iou)).select("case_id", "det_id").distinct()
    return boxes.join(beaten, ["case_id", "det_id"], "left_anti")


def greedy_first(boxes: DataFrame, most_iou: float = 0.5) -> DataFrame:
    """In order of confidence, a box is dropped if the first kept box that it touches overlaps it by more than most_iou: one fold
    over the few dozen boxes of an image."""
    rows = boxes.groupBy("case_id").agg(F.collect_list(F.struct(*(c for c in boxes.columns if c != "case_id"))).alias("rows"))
    low = lambda x: F.struct((-x["confidence"]).alias("low"), x["det_id"].alias("det_id"), *(x[c].alias(c) for c in BOX))
    of = lambda x: tuple(x[c] for c in BOX)

    def meet(x: Column, k: Column) -> Column:
        """The boxes share some area, as box_iou() > 0."""
        return (F.least(x["x2"], k["x2"]) > F.greatest(x["x1"], k["x1"])) & (F.least(x["y2"], k["y2"]) > F.greatest(x["y1"], k["y1"]))

    def step(kept: Column, x: Column) -> Column:
        first = F.get(F.filter(kept, lambda k: meet(x, k)), 0)
        return F.when(S.box_iou(of(x), of(first)) > most_iou, kept).otherwise(F.concat(kept, F.array(x)))

    sorted_ = rows.withColumn("b", F.array_sort(F.transform("rows", low)))
    kept = F.transform(F.aggregate("b", F.filter("b", lambda x: F.lit(False)), step), lambda k: k["det_id"])
    many = sorted_.withColumn("kept", F.when(F.size("b") > 1, kept))
    stay = F.when(F.col("kept").isNull(), F.col("rows")).otherwise(F.filter("rows", lambda x: F.array_contains("kept", x["det_id"])))
    return many.select("case_id", F.inline(stay)).select(*boxes.columns)


def match_labels(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y_true, y_pred): labels of a group are multisets. Equal labels pair off first, then what is left by position;
    truths without a partner get Other. truth and predicted: (keys, pos, surface)."""
    t = truth.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "surface").orderBy("pos")))
    p = predicted.withColumn("k", F.row_number().over(Window.partitionBy(*keys, "surface").orderBy("pos")))
    exact = t.join(p.select(*keys, "surface", "k"), [*keys, "surface", "k"], "left_semi")
    rest = Window.partitionBy(*keys).orderBy("pos")
    t_left = t.join(p.select(*keys, "surface", "k"), [*keys, "surface", "k"], "left_anti").withColumn("r", F.row_number().over(rest))
    p_left = p.join(t.select(*keys, "surface", "k"), [*keys, "surface", "k"], "left_anti").withColumn("r", F.row_number().over(rest))
    second = t_left.join(p_left.select(*keys, "r", F.col("surface").alias("y_pred")), [*keys, "r"], "left")
    return exact.select(*keys, "pos", F.col("surface").alias("y_true"), F.col("surface").alias("y_pred")).unionByName(second.select(*keys, "pos", F.col("surface").alias("y_true"), F.coalesce("y_pred", F.lit("Other")).alias("y_pred")))


def match_labels_interleaved(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One fold over a group's truths in order: an equal leftover label is used up, else the first leftover one, else Other."""
    t = truth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("t"))
    p = predicted.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "surface"))).alias("p")).select(*keys, F.col("p.surface").alias("p"))
    j = t.join(p, keys, "left").withColumn("p", F.coalesce("p", F.array().cast("array<string>")))

    def step(a: Column, x: Column) -> Column:
        at = F.array_position(a["left"], x["surface"]).cast("int")
        use = F.when(at > 0, at).when(F.size(a["left"]) > 0, 1).otherwise(0)
        took = F.when(use > 0, F.get(a["left"], use - 1)).otherwise("Other")
        left = F.when(use > 0, F.concat(F.slice(a["left"], F.lit(1), F.greatest(use - 1, F.lit(0))), F.slice(a["left"], F.greatest(use + 1, F.lit(1)), F.size(a["left"])))).otherwise(a["left"])
        return F.struct(left.alias("left"), F.concat(a["out"], F.array(F.struct(x["pos"].alias("pos"), x["surface"].alias("y_true"), took.alias("y_pred")))).alias("out"))

    start = F.struct(F.col("p").alias("left"), F.array().cast("array<struct<pos:bigint,y_true:string,y_pred:string>>").alias("out"))
    t_long = F.transform("t", lambda x: F.struct(x["pos"].cast("bigint").alias("pos"), x["surface"].alias("surface")))
    return j.withColumn("o", F.aggregate(t_long, start, step, lambda a: a["out"])).select(*keys, F.inline("o"))


def last_wins(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Every truth gets the last prediction of its key, else Other."""
    last = predicted.groupBy(*keys).agg(F.max_by("surface", F.struct("pos", "surface")).alias("y_pred"))
    return truth.join(last, keys, "left").select(*keys, "pos", F.col("surface").alias("y_true"), F.coalesce("y_pred", F.lit("Other")).alias("y_pred"))


def greedy_match(truth: DataFrame, predicted: DataFrame, within: float = 60.0) -> DataFrame:
    """(case_id, gt, pred, match_type, distance) with TP, FP and FN rows.

    truth and predicted: (case_id, id, tooth_id, cx, cy). In the order of truths: first the nearest unused prediction of the same tooth
    (a missing centre is at distance 0), then any unused one nearer than `within`. A case's few dozen rows are held together.
    """
    import pandas as pd

    def case(truths: list, preds: list) -> list[tuple]:
        rows, open_, left = [], [], {p["id"]: p for p in sorted(preds, key=lambda p: p["id"])}
        known = lambda a, b: None not in (a["cx"], a["cy"], b["cx"], b["cy"])
        dist = lambda a, b: math.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"]) if known(a, b) else 0.0
        for t in sorted(truths, key=lambda t: t["id"]):
            best = min(((dist(t, p), i) for i, p in left.items() if p["tooth_id"] == t["tooth_id"]), default=None)
            if best:
                del left[best[1]]
                rows.append((t["id"], best[1], "tooth_id", best[0]))
            else:
                open_.append(t)
        for t in open_:
            near = min(((dist(t, p), i) for i, p in left.items() if known(t, p) and dist(t, p) < within), default=None)
            if near:
                del left[near[1]]
            rows.append((t["id"], near[1], "centroid_proximity", near[0]) if near else (t["id"], None, "FN", None))
        return rows + [(None, i, "FP", None) for i in left]

    def run(batches):
        for b in batches:
            rows = [(c, *r) for c, t, p in zip(b["case_id"], b["t"], b["p"], strict=True) for r in case(t if t is not None else [], p if p is not None else [])]
            out = pd.DataFrame(rows, columns=["case_id", "gt", "pred", "match_type", "distance"])
            yield out.astype({"gt": "Int64", "pred": "Int64"})

    gather = lambda df, name: df.groupBy("case_id").agg(F.collect_list(F.struct("id", "tooth_id", "cx", "cy")).alias(name))
    both = gather(truth, "t").join(gather(predicted, "p"), "case_id", "full")
    return both.mapInPandas(run, "case_id long, gt long, pred long, match_type string, distance double")


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has."""
    a, b = left.select(key).distinct(), right.select(key).distinct()
    return a.join(b, key, "left_anti").select(key, F.lit("left").alias("only_in")).unionByName(b.join(a, key, "left_anti").select(key, F.lit("right").alias("only_in")))


def remaining(cases: DataFrame, done: DataFrame, key: str = "case_id") -> DataFrame:
    return cases.join(done.select(key).distinct(), key, "left_anti")


def with_fallback(rows: DataFrame, detections: DataFrame, keys: list[str], case: str, value: str) -> DataFrame:
    """rows with value: the best of detections with the same keys, else the case's best."""
    own = detections.groupBy(*keys).agg(F.max(value).alias("__own"))
    any_ = detections.groupBy(case).agg(F.max(value).alias("__any"))
    return rows.join(own, keys, "left").join(any_, case, "left").withColumn(value, F.coalesce("__own", "__any")).drop("__own", "__any")


def match_status(matches: DataFrame, keys: list[str], kind: str = "match_type") -> DataFrame:
    """One status for each key: TP before FP before FN."""
    rank = F.when(F.col(kind).isin("tooth_id", "centroid_proximity", "TP"), 0).when(F.col(kind) == "FP", 1).otherwise(2)
    best = matches.groupBy(*keys).agg(F.min(rank).alias("r"))
    return best.select(*keys, F.element_at(F.array(F.lit("TP"), F.lit("FP"), F.lit("FN")), F.col("r") + 1).alias("status"))


def with_first(rows: DataFrame, results: DataFrame, keys: list[str], order: list[str], value: str, fallback: str) -> DataFrame:
    """rows with value of the first result with their keys; `fallback`, a column of rows, where there is none or it is Unknown."""
    first = results.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias("__first"))
    return rows.join(first, keys, "left").withColumn(value, F.coalesce(F.when(F.col("__first") != "Unknown", F.col("__first")), F.col(fallback))).drop("__first")


def assign_labels(lesions: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, zone, label): in lesion order an equal open label is used up, else the first open one; lesions without any are
    left out. lesions: (keys, pos, surface); truth: (keys, pos, surface)."""
    m = match_labels_interleaved(lesions, truth, keys)
    p = truth.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    ranked = m.join(p, keys).withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy("pos")))
    return ranked.filter("__r <= __n").select(*keys, "pos", F.col("y_true").alias("zone"), F.col("y_pred").alias("label"))
