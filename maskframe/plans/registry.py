
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import matching, metrics, pixels, selection, zones
from ..sources.views import view, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql, *views) if views else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(*cols: str) -> list:
    return [S.half_up(F.col(c), 6).alias(c) for c in cols]


def lesions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tooth = view(spark, sf_dir, "v_pixels")
    return tooth, pixels.lesion_pixels(tooth, view(spark, sf_dir, "v_roi"))


def rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.relative(*lesions(spark, sf_dir))


K = ["case_id", "tooth_id"]
PCA = """~m AS (SELECT case_id, tooth_id, avg(x) AS cx, avg(y) AS cy, var_samp(x) AS cxx, var_samp(y) AS cyy, covar_samp(x, y) AS cxy, count(*) AS n FROM v_pixels GROUP BY ALL),
p AS (SELECT *, 0.5 * atan2(2 * cxy, cxx - cyy) AS theta, (cxx + cyy) / 2 + sqrt(((cxx - cyy) / 2) ** 2 + cxy ** 2) AS lambda1, (cxx + cyy) / 2 - sqrt(((cxx - cyy) / 2) ** 2 + cxy ** 2) AS lambda2 FROM m)"""
TURN = PCA + """, a AS (SELECT *, left(tooth_id, 1) IN ('1', '2') AS up, left(tooth_id, 1) IN ('1', '4') AS r, CASE WHEN abs(sin(theta)) >= abs(cos(theta)) THEN theta ELSE theta + pi() / 2 END AS ax FROM p),
b AS (SELECT *, CASE WHEN up THEN pi() / 2 ELSE -pi() / 2 END - CASE WHEN (sin(ax) < 0) = up THEN atan2(sin(ax + pi()), cos(ax + pi())) ELSE atan2(sin(ax), cos(ax)) END AS raw FROM a),
c AS (SELECT *, CASE WHEN raw > pi() THEN raw - 2 * pi() WHEN raw < -pi() THEN raw + 2 * pi() ELSE raw END AS w FROM b),
o AS (SELECT *, abs(degrees(w)) > 45 AS clamped, CASE WHEN abs(degrees(w)) > 45 THEN 0 ELSE w END AS angle FROM c)"""
REL = TURN + """, q AS (SELECT v.case_id, v.tooth_id, x, y, o.up, o.r, cx + (x - cx) * cos(angle) - (y - cy) * sin(angle) AS rx, cy + (x - cx) * sin(angle) + (y - cy) * cos(angle) AS ry FROM v_pixels v JOIN o USING (case_id, tooth_id)),
bx AS (SELECT case_id, tooth_id, min(rx) AS bx, min(ry) AS by_, max(rx) - min(rx) AS bw, max(ry) - min(ry) AS bh, count(*) AS tooth_n FROM q GROUP BY ALL),
u AS (SELECT q.*, tooth_n, (rx - bx) / bw AS ux, (ry - by_) / bh AS uy FROM q JOIN bx USING (case_id, tooth_id) SEMI JOIN v_roi ON q.case_id = v_roi.case_id AND q.x = v_roi.x AND q.y = v_roi.y WHERE bw > 0 AND bh > 0),
rel AS (SELECT *, greatest(0, least(1, ux)) AS rel_x, greatest(0, least(1, uy)) AS rel_y FROM u)"""
PICK = "CASE WHEN mesial >= occlusal AND mesial >= distal THEN 'Mesial' WHEN occlusal >= distal THEN 'Occlusal' ELSE 'Distal' END AS surface"


def sides(left: str, centre: str, right: str, extra: str = "") -> str:
    return REL + f""", g AS (SELECT case_id, tooth_id, count(*) AS n, bool_or(r) AS r, sum({left}) AS l_, sum({centre}) AS occlusal, sum({right}) AS r_{extra} FROM rel GROUP BY ALL),
h AS (SELECT *, CASE WHEN r THEN r_ ELSE l_ END AS mesial, CASE WHEN r THEN l_ ELSE r_ END AS distal FROM g)"""


COUNTS = "SELECT case_id, tooth_id, n, CAST(mesial AS BIGINT) AS mesial, CAST(occlusal AS BIGINT) AS occlusal, CAST(distal AS BIGINT) AS distal, " + PICK + " FROM h"
THIRDS = ("(rel_x < 0.4)::INT", "(rel_x BETWEEN 0.4 AND 0.6)::INT", "(rel_x > 0.6)::INT")


@query("geo1_centroid", "SELECT case_id, tooth_id, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS n FROM v_pixels GROUP BY ALL", "v_pixels")
def _(spark, sf):
    return pixels.centroid(view(spark, sf, "v_pixels")).select(*K, *r6("cx", "cy"), "n")


@query("geo2_bbox", "SELECT case_id, tooth_id, min(x) AS bx, min(y) AS by, max(x) - min(x) AS bw, max(y) - min(y) AS bh FROM v_pixels GROUP BY ALL", "v_pixels")
def _(spark, sf):
    return pixels.bbox(view(spark, sf, "v_pixels"))


@query("geo3_pca", PCA + " SELECT case_id, tooth_id, n, round(lambda1, 6) AS lambda1, round(lambda2, 6) AS lambda2, round(theta, 6) AS theta FROM p", "v_pixels")
def _(spark, sf):
    return pixels.pca(view(spark, sf, "v_pixels")).select(*K, "n", *r6("lambda1", "lambda2", "theta"))


LARGER = "CASE WHEN abs(sin(theta)) >= abs(cos(theta)) THEN theta ELSE theta + pi() / 2 END"
AXES = {
    "largest_variance": PCA + " SELECT case_id, tooth_id, round(theta, 6) AS axis FROM p",
    "conditional_ratio": PCA + f" SELECT case_id, tooth_id, round(CASE WHEN lambda1 / (lambda2 + 1e-6) < 2 THEN {LARGER} ELSE theta END, 6) AS axis FROM p",
    "max_span": PCA + """, s AS (SELECT case_id, tooth_id, max((x - cx) * cos(theta) + (y - cy) * sin(theta)) - min((x - cx) * cos(theta) + (y - cy) * sin(theta)) AS s1,
max((y - cy) * cos(theta) - (x - cx) * sin(theta)) - min((y - cy) * cos(theta) - (x - cx) * sin(theta)) AS s2 FROM v_pixels JOIN p USING (case_id, tooth_id) GROUP BY ALL)
SELECT case_id, tooth_id, round(CASE WHEN s1 >= s2 THEN theta ELSE theta + pi() / 2 END, 6) AS axis FROM p JOIN s USING (case_id, tooth_id)""",
    "split_centroid": PCA + """, s AS (SELECT case_id, tooth_id, count(*) FILTER (y < cy) AS a, count(*) FILTER (y >= cy) AS b, avg(x) FILTER (y >= cy) - avg(x) FILTER (y < cy) AS vx, avg(y) FILTER (y >= cy) - avg(y) FILTER (y < cy) AS vy
FROM v_pixels JOIN p USING (case_id, tooth_id) GROUP BY ALL)
SELECT case_id, tooth_id, round(CASE WHEN a < 2 OR b < 2 OR abs(vx * cos(theta) + vy * sin(theta)) >= abs(vy * cos(theta) - vx * sin(theta)) THEN theta ELSE theta + pi() / 2 END, 6) AS axis FROM p JOIN s USING (case_id, tooth_id)""",
    "vertical_prior": PCA + f" SELECT case_id, tooth_id, round({LARGER}, 6) AS axis FROM p",
}
for _i, (_m, _sql) in enumerate(AXES.items()):
    query(f"geo{4 + _i}_axis_{_m}", _sql, "v_pixels")(lambda spark, sf, m=_m: pixels.axis(view(spark, sf, "v_pixels"), m).select(*K, *r6("axis")))


@query("geo9_orientation", TURN + " SELECT case_id, tooth_id, round(angle, 6) AS angle, clamped FROM o", "v_pixels")
def _(spark, sf):
    return pixels.orientation(view(spark, sf, "v_pixels")).select(*K, *r6("angle"), "clamped")


@query("geo11_rotated_bbox", REL + " SELECT case_id, tooth_id, round(bw, 5) AS bw, round(bh, 5) AS bh FROM bx", "v_pixels", "v_roi")
def _(spark, sf):
    p = view(spark, sf, "v_pixels")
    r = pixels.rotated(p, pixels.orientation(p))
    return r.groupBy(*K).agg(S.half_up(F.max("rx") - F.min("rx"), 5).alias("bw"), S.half_up(F.max("ry") - F.min("ry"), 5).alias("bh"))


@query("geo12_pixel_overlap", "SELECT case_id, tooth_id, count(*) AS total_pixels, count(h) AS caries_pixels, round(100.0 * count(h) / count(*), 4) AS pct FROM v_pixels LEFT JOIN (SELECT *, 1 AS h FROM v_roi) USING (case_id, x, y) GROUP BY ALL", "v_pixels", "v_roi")
def _(spark, sf):
    return pixels.overlap(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi")).withColumn("pct", S.half_up(F.col("pct"), 4))


ERODED = "~e AS (SELECT v.case_id, v.tooth_id, v.x, v.y FROM v_pixels v, range(-2, 3) i(i), range(-2, 3) j(j) JOIN v_pixels w ON w.case_id = v.case_id AND w.tooth_id = v.tooth_id AND w.x = v.x + i AND w.y = v.y + j GROUP BY ALL HAVING count(*) = 25)"


@query("geo13_erode", ERODED + " SELECT * FROM e", "v_pixels")
def _(spark, sf):
    return pixels.erode(view(spark, sf, "v_pixels"))


@query("geo14_protected_overlap", ERODED + """, g AS (SELECT case_id, tooth_id, count(*) AS total_pixels, count(h) AS caries_pixels FROM e LEFT JOIN (SELECT *, 1 AS h FROM v_roi) USING (case_id, x, y) GROUP BY ALL)
SELECT case_id, tooth_id, total_pixels, caries_pixels, CASE WHEN caries_pixels <= 100 AND 100.0 * caries_pixels / total_pixels <= 1.0 THEN 0 ELSE caries_pixels END AS kept_pixels,
  NOT (caries_pixels <= 100 AND 100.0 * caries_pixels / total_pixels <= 1.0) AND caries_pixels > 0 AS has_caries FROM g""", "v_pixels", "v_roi")
def _(spark, sf):
    return pixels.protected_overlap(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi")).drop("pct")


ONE_TOOTH = "SELECT r.* FROM v_roi r ANTI JOIN (SELECT * FROM v_pixels WHERE tooth_id = '16') v ON r.case_id = v.case_id AND r.x = v.x AND r.y = v.y"


@query("geo15_unassigned", ONE_TOOTH, "v_pixels", "v_roi")
def _(spark, sf):
    return pixels.unassigned(view(spark, sf, "v_pixels").filter("tooth_id = '16'"), view(spark, sf, "v_roi"))


@query("geo15_unassigned_every_tooth", "SELECT r.* FROM v_decay r ANTI JOIN v_pixels v ON r.case_id = v.case_id AND r.x = v.x AND r.y = v.y", "v_pixels", "v_decay")
def _(spark, sf):
    return pixels.unassigned(view(spark, sf, "v_pixels"), view(spark, sf, "v_decay"))


@query("geo16_connected_components")
def _(spark, sf):
    _, lesion = lesions(spark, sf)
    return pixels.component_sizes(lesion).select(*K, "area", *r6("cx", "cy"))


@query("geo17_radius_clusters")
def _(spark, sf):
    _, lesion = lesions(spark, sf)
    return pixels.component_sizes(lesion, radius2=4).select(*K, "area", *r6("cx", "cy"))


@query("geo18_without_small_clusters")
def _(spark, sf):
    _, lesion = lesions(spark, sf)
    return pixels.without_small(lesion).groupBy(*K).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("comp").alias("components"))


@query("geo19_unassigned_blobs")
def _(spark, sf):
    return pixels.unassigned_blobs(view(spark, sf, "v_pixels"), view(spark, sf, "v_decay"), least=3)


@query("geo21_convex_hull")
def _(spark, sf):
    return pixels.hull(view(spark, sf, "v_pixels"))


@query("geo22_mask_iou", """SELECT coalesce(a.case_id, b.case_id) AS case_id, round(count(*) FILTER (a.x IS NOT NULL AND b.x IS NOT NULL) / count(*), 6) AS iou
FROM (SELECT DISTINCT case_id, x, y FROM v_pixels) a FULL JOIN v_roi b ON a.case_id = b.case_id AND a.x = b.x AND a.y = b.y GROUP BY ALL""", "v_pixels", "v_roi")
def _(spark, sf):
    a = view(spark, sf, "v_pixels").select("case_id", "x", "y").distinct()
    return pixels.mask_iou(a, view(spark, sf, "v_roi"), ["case_id"]).select("case_id", *r6("iou"))


@query("geo23_lesion_features", REL + """ SELECT case_id, tooth_id, max(up::INT) AS is_upper, round(avg(rel_x), 6) AS x_mean, round(avg(rel_y), 6) AS y_mean, round(stddev_pop(rel_x), 6) AS x_std, round(max(rel_x) - min(rel_x), 6) AS x_range,
round(abs(avg(rel_x) - 0.5), 6) AS x_centroid_dist, round(count(*) / (max(tooth_n) + 1e-6), 6) AS coverage FROM rel GROUP BY ALL""", "v_pixels", "v_roi")
def _(spark, sf):
    return pixels.features(rel(spark, sf)).select(*K, "is_upper", *r6("x_mean", "y_mean", "x_std", "x_range", "x_centroid_dist", "coverage"))


@query("cls4_x_thirds", sides(*THIRDS) + " " + COUNTS, "v_pixels", "v_roi")
def _(spark, sf):
    return zones.x_thirds(rel(spark, sf))


@query("cls5_diagonal", sides("(abs(ux - 0.5) > abs(uy - 0.5) AND ux <= 0.5)::INT", "(abs(ux - 0.5) <= abs(uy - 0.5))::INT", "(abs(ux - 0.5) > abs(uy - 0.5) AND ux > 0.5)::INT") + " " + COUNTS, "v_pixels", "v_roi")
def _(spark, sf):
    return zones.diagonal(rel(spark, sf))


@query("cls6_biaxial", sides(*THIRDS, ", sum((CASE WHEN up THEN rel_y >= 0.7 ELSE rel_y <= 0.3 END)::INT) AS crown").replace("sum((rel_x BETWEEN 0.4 AND 0.6)::INT) AS occlusal", "sum((rel_x BETWEEN 0.4 AND 0.6)::INT) + CASE WHEN sum((CASE WHEN up THEN rel_y >= 0.7 ELSE rel_y <= 0.3 END)::INT) > count(*) * 0.5 THEN sum((CASE WHEN up THEN rel_y >= 0.7 ELSE rel_y <= 0.3 END)::INT) ELSE 0 END AS occlusal") + " " + COUNTS, "v_pixels", "v_roi")
def _(spark, sf):
    return zones.biaxial(rel(spark, sf))


@query("cls7_fuzzy", sides("1 / (rel_x ** 2 + (rel_y - 0.5) ** 2 + 0.05)", "1 / ((rel_x - 0.5) ** 2 + (rel_y - CASE WHEN up THEN 0.85 ELSE 0.15 END) ** 2 + 0.05)", "1 / ((rel_x - 1) ** 2 + (rel_y - 0.5) ** 2 + 0.05)") + " SELECT case_id, tooth_id, n, round(mesial, 3) AS mesial, round(occlusal, 3) AS occlusal, round(distal, 3) AS distal, " + PICK + " FROM h", "v_pixels", "v_roi")
def _(spark, sf):
    return zones.fuzzy(rel(spark, sf)).select(*K, "n", *(S.half_up(F.col(c), 3).alias(c) for c in ("mesial", "occlusal", "distal")), "surface")


@query("cls8_lesion_zone", REL + " SELECT case_id, tooth_id, CASE WHEN avg(ux) < 0.4 THEN CASE WHEN bool_or(r) THEN 'Distal' ELSE 'Mesial' END WHEN avg(ux) > 0.6 THEN CASE WHEN bool_or(r) THEN 'Mesial' ELSE 'Distal' END ELSE 'Occlusal' END AS surface FROM rel GROUP BY ALL", "v_pixels", "v_roi")
def _(spark, sf):
    return zones.lesion_zone(rel(spark, sf))


CENTRE = """ SELECT case_id, tooth_id, CASE WHEN CASE WHEN bool_or(up) THEN avg(uy) >= {lo} ELSE avg(uy) <= {o} END THEN 'Occlusal' WHEN avg(ux) <= {s} THEN CASE WHEN bool_or(r) THEN 'Distal' ELSE 'Mesial' END
WHEN avg(ux) >= {hi} THEN CASE WHEN bool_or(r) THEN 'Mesial' ELSE 'Distal' END ELSE 'Other' END AS surface FROM rel GROUP BY ALL"""


@query("cls1_centroid_rule_20", REL + CENTRE.format(lo=0.8, o=0.2, s=0.2, hi=0.8), "v_pixels", "v_roi")
def _(spark, sf):
    return zones.centroid_rule(*lesions(spark, sf), occlusal=0.20, side=0.20)


@query("cls2_centroid_rule_30_25", REL + CENTRE.format(lo=0.7, o=0.3, s=0.25, hi=0.75), "v_pixels", "v_roi")
def _(spark, sf):
    return zones.centroid_rule(*lesions(spark, sf))


@query("cls3_multi_zone", REL + """, z AS (SELECT *, CASE WHEN up THEN rel_y >= 0.8 ELSE rel_y <= 0.2 END AS occ, CASE WHEN (rel_x < 1.0 / 3) THEN CASE WHEN r THEN 'd' ELSE 'm' END WHEN rel_x > 2.0 / 3 THEN CASE WHEN r THEN 'm' ELSE 'd' END ELSE 'c' END AS t FROM rel),
g AS (SELECT case_id, tooth_id, count(*) AS n, count(*) FILTER (occ AND t = 'm') AS n_m, count(*) FILTER (occ AND t = 'c') AS n_c, count(*) FILTER (occ AND t = 'd') AS n_d, count(*) FILTER (NOT occ AND rel_x <= 0.2) AS p_l, count(*) FILTER (NOT occ AND rel_x >= 0.8) AS p_r,
  count(*) FILTER (t = 'm') AS a_m, count(*) FILTER (t = 'c') AS a_c, count(*) FILTER (t = 'd') AS a_d, count(*) FILTER (occ) AS o FROM z GROUP BY ALL),
f AS (SELECT *, n - o - p_l - p_r AS other, o > 0 AND n_m >= 0.05 * o AS hm, o > 0 AND n_c >= 0.05 * o AS hc, o > 0 AND n_d >= 0.05 * o AS hd FROM g)
SELECT case_id, tooth_id, n, n_m, n_c, n_d, p_l, p_r, other, CASE WHEN o >= p_l + p_r AND o >= other THEN 'Occlusal' WHEN p_l + p_r >= other THEN 'Proximal' ELSE 'Other' END AS primary_surface,
  CASE WHEN hm AND hd THEN 'MOD' WHEN hm AND hc THEN 'MO' WHEN hd AND hc THEN 'DO' WHEN hm THEN 'M' WHEN hd THEN 'D' WHEN hc THEN 'O' ELSE 'Unknown' END AS zone_label,
  CASE WHEN a_m >= a_c AND a_m >= a_d THEN 'Mesial' WHEN a_c >= a_d THEN 'Occlusal' ELSE 'Distal' END AS fine_surface FROM f""", "v_pixels", "v_roi")
def _(spark, sf):
    return zones.multi_zone(rel(spark, sf))


@query("cls11_version_sweep")
def _(spark, sf):
    return zones.sweep(rel(spark, sf))


@query("cls12_long_votes", sides(*THIRDS) + " SELECT case_id, tooth_id, n, unnest(['Mesial', 'Occlusal', 'Distal']) AS zone, unnest([CAST(mesial AS BIGINT), CAST(occlusal AS BIGINT), CAST(distal AS BIGINT)]) AS votes, round(unnest([mesial, occlusal, distal]) / n, 4) AS share FROM h", "v_pixels", "v_roi")
def _(spark, sf):
    return zones.long_votes(zones.x_thirds(rel(spark, sf)))


IOU = "CASE WHEN {u} > 0 THEN {b} / {u} ELSE 0 END"
BOTH = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
UNION = f"((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {BOTH})"
BOX_IOU = IOU.format(b=BOTH, u=UNION)


@query("jn5_detections_to_teeth", f"""~j AS (SELECT a.case_id, a.det_id, b.det_id AS tooth, {BOX_IOU} AS iou, sqrt(((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2) ** 2 + ((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2) ** 2) AS dist,
  (a.x1 + a.x2) / 2 BETWEEN b.x1 AND b.x2 AND (a.y1 + a.y2) / 2 BETWEEN b.y1 AND b.y2 AS inside FROM v_boxes a JOIN v_boxes b ON a.case_id = b.case_id AND a.kind = 'lesion' AND b.kind = 'tooth'),
k AS (SELECT *, CASE WHEN inside THEN 0 WHEN iou > 0.1 THEN 1 ELSE 2 END AS tier FROM j),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, det_id ORDER BY tier, CASE WHEN tier < 2 THEN -iou ELSE dist END, tooth) AS rn FROM k)
SELECT case_id, det_id, tooth, ['center_inside', 'overlap', 'nearest'][tier + 1] AS method FROM r WHERE rn = 1""", "v_boxes")
def _(spark, sf):
    b = view(spark, sf, "v_boxes")
    return matching.detections_to_teeth(b.filter("kind = 'lesion'"), b.filter("kind = 'tooth'"))


@query("jn6_nearest_reference", """~ref AS (SELECT CAST(i AS VARCHAR) AS tooth_id, i * 3.0 AS center_x, (i % 8) * 7.0 AS center_y FROM range(32) t(i))
SELECT case_id, det_id, tooth_id, round(sqrt((x1 - center_x) ** 2 + (y1 - center_y) ** 2), 6) AS distance FROM v_boxes, ref
QUALIFY row_number() OVER (PARTITION BY case_id, det_id ORDER BY sqrt((x1 - center_x) ** 2 + (y1 - center_y) ** 2), tooth_id) = 1""", "v_boxes")
def _(spark, sf):
    ref = spark.range(32).select(F.col("id").cast("string").alias("tooth_id"), (F.col("id") * 3.0).alias("center_x"), (F.col("id") % 8 * 7.0).alias("center_y"))
    points = view(spark, sf, "v_boxes").select("case_id", "det_id", F.col("x1").alias("x"), F.col("y1").alias("y"))
    near = matching.nearest_reference(points, ref, ["case_id", "det_id"])
    best = near.groupBy("case_id", "det_id").agg(F.min(F.struct("distance", "tooth_id")).alias("b"))
    return best.select("case_id", "det_id", "b.tooth_id", S.half_up(F.col("b.distance"), 6).alias("distance"))


@query("jn11_box_deduplication", f"""SELECT case_id, det_id FROM v_boxes a WHERE NOT EXISTS (SELECT 1 FROM v_boxes b WHERE a.case_id = b.case_id AND (b.confidence > a.confidence OR b.confidence = a.confidence AND b.det_id < a.det_id) AND {BOX_IOU} > 0.5)""", "v_boxes")
def _(spark, sf):
    return matching.without_duplicates(view(spark, sf, "v_boxes")).select("case_id", "det_id")


@query("jn11_greedy_first")
def _(spark, sf):
    return matching.greedy_first(view(spark, sf, "v_boxes")).select("case_id", "det_id")


THIRD_LEFT_OUT = " WHERE sample_id % 3 <> 0"


def _labels(spark, sf, every=True):
    p = view(spark, sf, "v_label_pairs")
    return p.select("group_id", F.col("sample_id").alias("pos"), F.col("y_true").alias("surface")), (p if every else p.filter("sample_id % 3 <> 0")).select("group_id", F.col("sample_id").alias("pos"), F.col("y_pred_a").alias("surface"))


@query("jn8_match_labels", """~t AS (SELECT group_id, sample_id AS pos, y_true AS s, row_number() OVER (PARTITION BY group_id, y_true ORDER BY sample_id) AS k FROM v_label_pairs),
p AS (SELECT group_id, sample_id AS pos, y_pred_a AS s, row_number() OVER (PARTITION BY group_id, y_pred_a ORDER BY sample_id) AS k FROM v_label_pairs WHERE sample_id % 3 <> 0),
tl AS (SELECT t.*, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS r FROM t ANTI JOIN p USING (group_id, s, k)),
pl AS (SELECT p.*, row_number() OVER (PARTITION BY group_id ORDER BY pos) AS r FROM p ANTI JOIN t USING (group_id, s, k))
SELECT t.group_id, t.pos, t.s AS y_true, t.s AS y_pred FROM t SEMI JOIN p USING (group_id, s, k) UNION ALL SELECT tl.group_id, tl.pos, tl.s, coalesce(pl.s, 'Other') FROM tl LEFT JOIN pl USING (group_id, r)""", "v_label_pairs")
def _(spark, sf):
    return matching.match_labels(*_labels(spark, sf, every=False), ["group_id"])


@query("jn8_match_every_label", ORACLE_SQL["jn8_match_labels"].replace(THIRD_LEFT_OUT, ""))
def _(spark, sf):
    return matching.match_labels(*_labels(spark, sf), ["group_id"])


@query("jn8_match_labels_interleaved")
def _(spark, sf):
    return matching.match_labels_interleaved(*_labels(spark, sf), ["group_id"])


@query("jn9_last_wins", """~l AS (SELECT group_id, y_pred_a AS y_pred FROM v_label_pairs WHERE sample_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY sample_id DESC, y_pred_a DESC) = 1)
SELECT v.group_id, sample_id AS pos, y_true, coalesce(y_pred, 'Other') AS y_pred FROM v_label_pairs v LEFT JOIN l USING (group_id)""", "v_label_pairs")
def _(spark, sf):
    return matching.last_wins(*_labels(spark, sf, every=False), ["group_id"])


@query("jn9_last_of_all_wins", ORACLE_SQL["jn9_last_wins"].replace(THIRD_LEFT_OUT, ""))
def _(spark, sf):
    return matching.last_wins(*_labels(spark, sf), ["group_id"])


def _centres(spark, sf):
    b = view(spark, sf, "v_boxes").select("case_id", F.col("det_id").cast("long").alias("id"), (F.col("x1") % 3).cast("string").alias("tooth_id"), F.col("x1").cast("double").alias("cx"), F.col("y1").cast("double").alias("cy"), "kind")
    return b.filter("kind = 'lesion'").drop("kind"), b.filter("kind = 'tooth'").drop("kind")


@query("jn7_greedy_match")
def _(spark, sf):
    return matching.greedy_match(*_centres(spark, sf)).withColumn("distance", F.round("distance", 6))


@query("agg4_detection_scores")
def _(spark, sf):
    return metrics.detection_scores(matching.greedy_match(*_centres(spark, sf)))


@query("jn13_orphans", "SELECT doc_id, 'left' AS only_in FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT doc_id, 'right' FROM labels ANTI JOIN documents USING (doc_id)")
def _(spark, sf):
    return matching.orphans(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("src16_remaining_cases", "SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def _(spark, sf):
    return matching.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("agg1_case_summary", "~g AS (SELECT case_id, tooth_id, count(*) AS t, count(h) AS c FROM v_pixels LEFT JOIN (SELECT *, 1 AS h FROM v_roi) USING (case_id, x, y) GROUP BY ALL) SELECT case_id, count(*) AS teeth, CAST(sum(t) AS BIGINT) AS pixels, CAST(sum((c > 0)::INT) AS BIGINT) AS with_caries, round(avg(100.0 * c / t), 4) AS mean_pct FROM g GROUP BY ALL", "v_pixels", "v_roi")
def _(spark, sf):
    o = pixels.overlap(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi"))
    return o.groupBy("case_id").agg(F.count(F.lit(1)).alias("teeth"), F.sum("total_pixels").alias("pixels"), F.count_if(F.col("caries_pixels") > 0).alias("with_caries"), S.half_up(F.avg("pct"), 4).alias("mean_pct"))


@query("agg3_value_shares", "SELECT y_pred_a, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM v_label_pairs GROUP BY ALL", "v_label_pairs")
def _(spark, sf):
    return metrics.shares(view(spark, sf, "v_label_pairs"), "y_pred_a")


@query("agg7_confusion_matrix", "~l AS (SELECT unnest(['A', 'N', 'R', 'X']) AS y_true) SELECT y_true, " + ", ".join(f"count(*) FILTER (y_pred_b = '{c}') AS \"n_{c}\"" for c in "ANRX") + " FROM l LEFT JOIN v_label_pairs USING (y_true) GROUP BY ALL", "v_label_pairs")
def _(spark, sf):
    return metrics.confusion(view(spark, sf, "v_label_pairs"), list("ANRX"), pred="y_pred_b")


def scores(pred: str) -> str:
    return f"""~u AS (SELECT y_true AS label FROM v_label_pairs UNION SELECT {pred} FROM v_label_pairs),
s AS (SELECT label, count(*) FILTER (y_true = label AND {pred} = label) AS tp, count(*) FILTER (y_true = label) AS support, count(*) FILTER ({pred} = label) AS predicted FROM u, v_label_pairs GROUP BY ALL),
m AS (SELECT label, support, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall, CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1, tp FROM s)"""


@query("agg8_label_metrics", scores("y_pred_b") + " SELECT round(sum(tp) / sum(support), 6) AS accuracy, round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1 FROM m", "v_label_pairs")
def _(spark, sf):
    return metrics.macro(view(spark, sf, "v_label_pairs"), pred="y_pred_b").select(*r6("accuracy", "macro_precision", "macro_recall", "macro_f1"))


@query("agg9_classification_report", scores("y_pred_a") + """ SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM m
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""", "v_label_pairs")
def _(spark, sf):
    return metrics.report(view(spark, sf, "v_label_pairs"), pred="y_pred_a").select("label", *r6("precision", "recall", "f1"), F.col("support").cast("long").alias("support"))


@query("agg10_confused_pairs", "SELECT y_true, y_pred_a, count(*) AS n FROM v_label_pairs WHERE y_true <> y_pred_a GROUP BY ALL", "v_label_pairs")
def _(spark, sf):
    return metrics.confused_pairs(view(spark, sf, "v_label_pairs"), pred="y_pred_a")


@query("agg12_confidence_by_correctness", "SELECT y_true = 'click' AS correct, count(*) AS n, round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, min(p) AS least, max(p) AS most FROM v_proba GROUP BY ALL", "v_proba")
def _(spark, sf):
    return metrics.confidence_by_correctness(view(spark, sf, "v_proba"), "p", F.col("y_true") == "click").select("correct", "n", *r6("mean", "median"), "least", "most")


@query("agg13_histogram", "SELECT CAST(floor((p - 0.05) / 0.03) AS BIGINT) AS bin, count(*) AS n FROM v_proba GROUP BY ALL", "v_proba")
def _(spark, sf):
    return metrics.histogram(view(spark, sf, "v_proba"), "p", 0.05, 0.03)


@query("agg14_calibration", """~b AS (SELECT *, CAST(least(floor(p * 10), 9) AS BIGINT) AS bin FROM v_proba), t AS (SELECT bin, count(*) AS n, avg(p) AS mean_p FROM b GROUP BY ALL)
SELECT bin, y_true, n, round(mean_p, 6) AS mean_p, round(count(*) / n, 6) AS observed FROM b JOIN t USING (bin) GROUP BY bin, y_true, n, mean_p""", "v_proba")
def _(spark, sf):
    return metrics.calibration(view(spark, sf, "v_proba")).select("bin", "y_true", "n", *r6("mean_p", "observed"))


@query("agg15_rejection_curve")
def _(spark, sf):
    p = view(spark, sf, "v_proba").withColumn("y_pred", F.when(F.col("p") > 0.4, F.lit("click")).otherwise(F.col("y_true")))
    return metrics.rejection_curve(p, "p", [0.3 + 0.05 * i for i in range(13)]).select(F.round("threshold", 2).alias("threshold"), "remaining", "rejected", *r6("coverage", "accuracy", "macro_f1"))


@query("agg16_duration_summary", "SELECT round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most, round(1000 / avg(value), 6) AS per_second FROM events")
def _(spark, sf):
    return metrics.duration_summary(table(spark, sf, "events"), "value").select(*r6("mean", "median", "p95", "p99"), "least", "most", *r6("per_second"))


@query("agg22_fold_summary", "~f AS (SELECT group_id % 5 AS fold, avg((y_true = y_pred_a)::INT) AS acc_a, avg((y_true = y_pred_b)::INT) AS acc_b FROM v_label_pairs GROUP BY ALL), l AS (SELECT 'acc_a' AS metric, acc_a AS v FROM f UNION ALL SELECT 'acc_b', acc_b FROM f) SELECT metric, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS least, round(max(v), 6) AS most FROM l GROUP BY ALL", "v_label_pairs")
def _(spark, sf):
    p = view(spark, sf, "v_label_pairs").groupBy((F.col("group_id") % 5).alias("fold")).agg(F.avg((F.col("y_true") == F.col("y_pred_a")).cast("int")).alias("acc_a"), F.avg((F.col("y_true") == F.col("y_pred_b")).cast("int")).alias("acc_b"))
    return metrics.fold_summary(p, ["acc_a", "acc_b"]).select("metric", *r6("mean", "std", "least", "most"))


@query("agg23_best_per_key", "SELECT case_id, kind, max(confidence) AS confidence, count(*) AS n FROM v_boxes GROUP BY ALL", "v_boxes")
def _(spark, sf):
    return view(spark, sf, "v_boxes").groupBy("case_id", "kind").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"))


@query("sta1_f1_difference", scores("y_pred_a").replace("u AS", "u1 AS", 1).replace("FROM u,", "FROM u1,").replace("s AS (SELECT", "s1 AS (SELECT").replace("FROM s)", "FROM s1)").replace("m AS (SELECT", "m1 AS (SELECT") + ", " + scores("y_pred_b")[1:] + " SELECT round((SELECT avg(f1) FROM m1), 6) AS f1_a, round((SELECT avg(f1) FROM m), 6) AS f1_b, round((SELECT avg(f1) FROM m1) - (SELECT avg(f1) FROM m), 6) AS difference", "v_label_pairs")
def _(spark, sf):
    return metrics.f1_difference(view(spark, sf, "v_label_pairs")).select(*r6("f1_a", "f1_b", "difference"))


@query("sta2_paired_bootstrap")
def _(spark, sf):
    return metrics.bootstrap_summary(metrics.bootstrap(view(spark, sf, "v_label_pairs")))


@query("sta3_two_proportions", "~c AS (SELECT count(*) AS n, count(*) FILTER (y_true = y_pred_a) AS hits_a, count(*) FILTER (y_true = y_pred_b) AS hits_b FROM v_label_pairs) SELECT n, hits_a, hits_b, round(((hits_a - hits_b) / n) / sqrt((hits_a + hits_b) / (2 * n) * (1 - (hits_a + hits_b) / (2 * n)) * 2 / n), 6) AS z FROM c", "v_label_pairs")
def _(spark, sf):
    return metrics.two_proportions(view(spark, sf, "v_label_pairs")).select("n", "hits_a", "hits_b", *r6("z"))


@query("win1_first_of_case", "SELECT case_id, det_id, kind, confidence FROM v_boxes QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, det_id) = 1", "v_boxes")
def _(spark, sf):
    return selection.first_of(view(spark, sf, "v_boxes"), ["case_id"], [F.desc("confidence"), F.col("det_id")]).select("case_id", "det_id", "kind", "confidence")


@query("win3_group_size", "SELECT case_id, det_id, count(*) OVER (PARTITION BY case_id) AS group_size FROM v_boxes", "v_boxes")
def _(spark, sf):
    return selection.group_sizes(view(spark, sf, "v_boxes"), "case_id").select("case_id", "det_id", "group_size")


@query("win5_diversified_top", """~r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, case_id, det_id) AS rk FROM v_boxes), one AS (SELECT *, 1 AS tier FROM r WHERE rk = 1),
more AS (SELECT *, 2 AS tier FROM r WHERE rk > 1 AND case_id NOT IN (SELECT case_id FROM one) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, case_id, det_id) = 1)
SELECT case_id, det_id, tier FROM (SELECT * FROM one UNION ALL SELECT * FROM more) ORDER BY tier, confidence DESC, case_id, det_id LIMIT 50""", "v_boxes")
def _(spark, sf):
    return selection.diversified(view(spark, sf, "v_boxes"), "kind", "case_id", [F.desc("confidence"), F.col("case_id"), F.col("det_id")], 50).select("case_id", "det_id", "tier")


@query("win6_top_errors_per_pair", "SELECT sample_id, y_true, y_pred_a FROM v_label_pairs WHERE y_true <> y_pred_a QUALIFY row_number() OVER (PARTITION BY y_true, y_pred_a ORDER BY sample_id) <= 20", "v_label_pairs")
def _(spark, sf):
    e = view(spark, sf, "v_label_pairs").filter("y_true <> y_pred_a")
    return selection.first_of(e, ["y_true", "y_pred_a"], [F.col("sample_id")], 20).select("sample_id", "y_true", "y_pred_a")


@query("win7_seeded_sample", "SELECT sample_id FROM v_label_pairs ORDER BY md5('42:' || sample_id), sample_id LIMIT 100", "v_label_pairs")
def _(spark, sf):
    return selection.sample(view(spark, sf, "v_label_pairs"), "sample_id", 100).select("sample_id")


@query("ml2_group_split", """~g AS (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM v_label_pairs))
SELECT sample_id, group_id, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM v_label_pairs JOIN g USING (group_id)""", "v_label_pairs")
def _(spark, sf):
    return selection.with_split(view(spark, sf, "v_label_pairs"), "group_id").select("sample_id", "group_id", "split")


@query("prj4_coarse_surface", "SELECT p_type, CASE WHEN lower(trim(p_type)) LIKE '%occlusal%' THEN 'Occlusal' WHEN lower(p_type) LIKE '%mesial%' OR lower(p_type) LIKE '%distal%' OR lower(p_type) LIKE '%proximal%' THEN 'Proximal' ELSE 'Other' END AS surface, count(*) AS n FROM part GROUP BY ALL")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_type", S.coarse_surface(F.col("p_type")).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


@query("prj12_box_iou", f"SELECT a.case_id, a.det_id, b.det_id AS other, round({BOX_IOU}, 6) AS iou FROM v_boxes a JOIN v_boxes b ON a.case_id = b.case_id AND a.det_id < b.det_id", "v_boxes")
def _(spark, sf):
    b = view(spark, sf, "v_boxes")
    o = b.select("case_id", F.col("det_id").alias("other"), *(F.col(c).alias(f"o_{c}") for c in matching.BOX))
    iou = S.box_iou(tuple(F.col(c) for c in matching.BOX), tuple(F.col(f"o_{c}") for c in matching.BOX))
    return b.join(o, "case_id").filter("det_id < other").select("case_id", "det_id", "other", S.half_up(iou, 6).alias("iou"))


@query("set1_union_of_versions", "SELECT 'a' AS version, y_pred_a AS label, count(*) AS n FROM v_label_pairs GROUP BY ALL UNION ALL SELECT 'b', y_pred_b, count(*) FROM v_label_pairs GROUP BY ALL", "v_label_pairs")
def _(spark, sf):
    p = view(spark, sf, "v_label_pairs")
    both = p.select(F.lit("a").alias("version"), F.col("y_pred_a").alias("label")).unionByName(p.select(F.lit("b").alias("version"), F.col("y_pred_b").alias("label")))
    return both.groupBy("version", "label").agg(F.count(F.lit(1)).alias("n"))
