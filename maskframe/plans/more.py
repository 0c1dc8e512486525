"""Further named queries: scalar functions, filters, evaluation, conversion, selections, learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dataset, evaluation, learning, matching, metrics, pixels, selection, zones
from ..sources import readers
from ..sources.views import view
from .registry import BOX_IOU, IOU, K, ORACLE_SQL, REL, TURN, lesions, query, r6, rel, table

_ = (BOX_IOU, IOU, ORACLE_SQL)
V = "v_findings"


def finds(spark, sf):
    return view(spark, sf, V)


def counted(name: str, column: str, expression, sql: str, by: str = "name", more: str = ""):
    """A query that counts the values of one column function, and its SQL."""

    @query(name, f"SELECT {by}, {sql} AS {column}, count(*) AS n FROM {V} {more} GROUP BY ALL", V)
    def _(spark, sf):
        return finds(spark, sf).groupBy(*[c.strip() for c in by.split(",")], expression().alias(column)).agg(F.count(F.lit(1)).alias("n"))


c = F.col
QUAD = "CASE WHEN lower(name) LIKE '%upper%' AND lower(name) LIKE '%right%' THEN '1' WHEN lower(name) LIKE '%upper%' THEN '2' WHEN lower(name) LIKE '%left%' THEN '3' ELSE '4' END"
POS = "CASE WHEN name LIKE '%central%' THEN '1' WHEN name LIKE '%lateral%' THEN '2' WHEN name LIKE '%canine%' THEN '3' WHEN name LIKE '%first premolar%' THEN '4' WHEN name LIKE '%second premolar%' THEN '5' WHEN name LIKE '%third molar%' THEN '8' WHEN name LIKE '%second molar%' THEN '7' WHEN name LIKE '%first molar%' THEN '6' END"
FDI = f"coalesce({QUAD} || {POS}, '')"
FINE = "CASE WHEN lower({0}) LIKE '%occlusal%' THEN 'Occlusal' WHEN lower({0}) LIKE '%mesial%' THEN 'Mesial' WHEN lower({0}) LIKE '%distal%' THEN 'Distal' WHEN lower({0}) LIKE '%proximal%' THEN 'Proximal' WHEN lower({0}) LIKE '%buccal%' THEN 'Buccal' WHEN lower({0}) LIKE '%lingual%' THEN 'Lingual' ELSE 'Other' END"
COARSE = "CASE WHEN lower({0}) LIKE '%occlusal%' THEN 'Occlusal' WHEN lower({0}) LIKE '%mesial%' OR lower({0}) LIKE '%distal%' OR lower({0}) LIKE '%proximal%' THEN 'Proximal' ELSE 'Other' END"
CLASSES = {"occlusal": 0, "mesial": 1, "distal": 1, "proximal": 1, "lingual": 2}
ZONES = "CASE WHEN {m} AND {d} THEN 'MOD' WHEN {m} AND {c} THEN 'MO' WHEN {d} AND {c} THEN 'DO' WHEN {m} THEN 'M' WHEN {d} THEN 'D' WHEN {c} THEN 'O' ELSE 'Unknown' END"

counted("prj1_jaw", "jaw", lambda: S.jaw(c("tooth_id")), "CASE WHEN left(tooth_id, 1) IN ('1', '2') THEN 'upper' ELSE 'lower' END", "tooth_id")
counted("prj2_tooth_of_name", "fdi", lambda: S.tooth_of_name(c("name")), FDI)
counted("prj5_fine_surface", "fine", lambda: S.fine_surface(c("surface")), FINE.format("surface"), "surface")
counted("prj6_first_keyword", "class_id", lambda: S.first_hit(F.lower("surface"), CLASSES), "CASE WHEN lower(surface) LIKE '%occlusal%' THEN 0 WHEN lower(surface) LIKE '%mesial%' OR lower(surface) LIKE '%distal%' OR lower(surface) LIKE '%proximal%' THEN 1 WHEN lower(surface) LIKE '%lingual%' THEN 2 END", "surface")
counted("prj7_two_way_containment", "class_id", lambda: S.matched_either_way(c("surface"), {"occlusal surface": 0, "mesial": 1, "distal surface": 2, "lingual": 3}),
    "CASE WHEN trim(lower(surface)) = 'occlusal surface' THEN 0 WHEN trim(lower(surface)) LIKE '%mesial%' THEN 1 WHEN trim(lower(surface)) = 'distal' THEN 2 WHEN trim(lower(surface)) = 'lingual' THEN 3 END", "surface")
counted("prj8_label_clamp", "label", lambda: S.clamp_label(c("predicted"), ("Occlusal", "Mesial", "Distal")), "CASE WHEN predicted IN ('Occlusal', 'Mesial', 'Distal') THEN predicted ELSE 'Other' END", "predicted")
counted("prj20_position_detail", "detail", lambda: S.position_detail(c("tooth_id"), c("frac_m")), "CASE WHEN frac_m = 0.5 THEN 'Center' WHEN (frac_m > 0.5) = (left(tooth_id, 1) IN ('1', '4')) THEN 'Mesial' ELSE 'Distal' END", "tooth_id")
counted("prj21_combined_zone", "zone", lambda: S.combined_zone(c("frac_m") > 0.3, c("frac_c") > 0.2, c("frac_d") > 0.6), ZONES.format(m="frac_m > 0.3", c="frac_c > 0.2", d="frac_d > 0.6"), "flag")
counted("prj22_extension_text", "detail", lambda: S.extension_text(c("frac_m"), c("frac_c"), c("frac_d")),
    "concat(concat_ws(' + ', CASE WHEN frac_m >= frac_c AND frac_m >= frac_d THEN 'Mesial' WHEN frac_c >= frac_d THEN 'Occlusal' ELSE 'Distal' END || ' (Dominant)', CASE WHEN frac_m >= 0.05 AND NOT (frac_m >= frac_c AND frac_m >= frac_d) THEN 'Mesial (Extension)' END, "
    "CASE WHEN frac_c >= 0.05 AND NOT (NOT (frac_m >= frac_c AND frac_m >= frac_d) AND frac_c >= frac_d) THEN 'Occlusal (Extension)' END, CASE WHEN frac_d >= 0.05 AND ((frac_m >= frac_c AND frac_m >= frac_d) OR frac_c >= frac_d) THEN 'Distal (Extension)' END), ' -> ', " + ZONES.format(m="frac_m >= 0.05", c="frac_c >= 0.05", d="frac_d >= 0.05") + ")", "flag")
SOFT = f"""CASE WHEN coalesce(predicted, '') <> '' AND (({FINE.format('surface')}) = ({FINE.format('predicted')}) OR ({COARSE.format('surface')}) = ({COARSE.format('predicted')})) THEN 'True'
WHEN CASE {FINE.format('surface')} WHEN 'Mesial' THEN frac_m WHEN 'Distal' THEN frac_d WHEN 'Occlusal' THEN frac_c WHEN 'Proximal' THEN greatest(frac_m, frac_d) ELSE 0 END >= 0.3 THEN 'Partial'
WHEN CASE {FINE.format('surface')} WHEN 'Occlusal' THEN greatest(frac_m, frac_d) WHEN 'Mesial' THEN frac_c WHEN 'Distal' THEN frac_c WHEN 'Proximal' THEN greatest(frac_m, frac_c, frac_d) ELSE 0 END >= 0.3 THEN 'True_with_warning' ELSE 'False' END"""
counted("prj23_soft_match", "match", lambda: S.soft_match(c("surface"), c("predicted"), c("frac_m"), c("frac_c"), c("frac_d")), SOFT, "surface, predicted")
counted("prj24_best_label", "label", lambda: S.best_label(c("predicted"), c("surface")), "CASE WHEN predicted IS NOT NULL THEN predicted WHEN trim(surface) NOT IN ('', 'nan') THEN surface ELSE 'Unknown' END", "predicted, surface")
counted("prj31_digits_token", "tooth", lambda: S.tooth_in_text(F.concat(F.lit("tooth #"), c("tooth_id"), F.lit(" 99 21"))), "tooth_id", "flag")
counted("flt5_decay_finding", "decay", lambda: c("surface").contains("Surface") | (c("code") == "160770D"), "surface LIKE '%Surface%' OR code = '160770D'", "flag")
counted("flt12_wisdom", "wisdom", lambda: c("tooth_id").isin(*selection.WISDOM), "tooth_id IN ('18', '28', '38', '48')", "tooth_id")

CODES = [("160770D", "16", True), ("160770D", "46", True), ("161006D", "11", False), ("161166D", "37", False)]
CODE_SQL = "CASE code WHEN '160770D' THEN '46' WHEN '161006D' THEN '11' WHEN '161166D' THEN '37' END"


@query("prj3_lookup_precedence", f"SELECT coalesce(nullif({FDI}, ''), {CODE_SQL}, '') AS by_name, coalesce({CODE_SQL}, {FDI}) AS by_code, count(*) AS n FROM {V} GROUP BY ALL", V)
def _(spark, sf):
    ref = spark.createDataFrame(CODES, "code string, fdi string, is_ambiguous boolean").groupBy("code").agg(F.max("fdi").alias("of_code"))
    named = F.when(S.tooth_of_name(c("name")) != "", S.tooth_of_name(c("name")))
    j = finds(spark, sf).join(F.broadcast(ref), "code", "left")
    return j.groupBy(F.coalesce(named, "of_code", F.lit("")).alias("by_name"), F.coalesce("of_code", named, F.lit("")).alias("by_code")).agg(F.count(F.lit(1)).alias("n"))


@query("prj9_to_16_boxes", """SELECT case_id, det_id, greatest(0.0, least(1.0, x1 / 40.0)) AS nx, (x1 + x2) / 2.0 AS cx, (y1 + y2) / 2.0 AS cy, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2.0 / 40.0 AS ncx, CAST(floor((x1 + x2) / 2.0) AS BIGINT) AS px, CAST(floor((y1 + y2) / 2.0) AS BIGINT) AS py,
  30 BETWEEN x1 AND x2 AND 20 BETWEEN y1 AND y2 AS holds, round(sqrt((x1 - 30) ** 2 + (y1 - 20) ** 2), 6) AS distance, CAST(trunc((x2 - x1) * (y2 - y1) * (0.6 + 0.2 * confidence)) AS BIGINT) AS lesion_area, CAST(trunc((x2 - x1) * (y2 - y1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS tooth_area FROM v_boxes""", "v_boxes")
def _(spark, sf):
    b = tuple(c(x) for x in matching.BOX)
    v = view(spark, sf, "v_boxes")
    v = v.withColumn("p", S.polygon_box(F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in ((b[0], b[1]), (b[2], b[1]), (b[2], b[3]), (b[0], b[3]))))))
    v = v.withColumn("n", S.corners_box((b[2], b[3]), (b[0], b[1]), 40.0, 60.0)).withColumn("k", S.key_points(b))
    return v.select("case_id", "det_id", S.normalised(b[0], 40.0).alias("nx"), "p.cx", "p.cy", "p.w", "p.h", c("n.cx").alias("ncx"), c("k")[4][0].alias("px"), c("k")[4][1].alias("py"), S.in_box(F.lit(30), F.lit(20), b).alias("holds"),
        S.half_up(F.hypot(b[0] - 30, b[1] - 20), 6).alias("distance"), S.lesion_area(b, c("confidence")).alias("lesion_area"), S.tooth_area(b).alias("tooth_area"))


@query("prj18_19_names", "SELECT CASE p_size % 3 WHEN 0 THEN 'Occlusal' WHEN 1 THEN p_brand ELSE 'Unknown' END AS class_name, p_size % 50 AS case_id, count(*) AS n FROM part GROUP BY ALL")
def _(spark, sf):
    p = table(spark, sf, "part").select((c("p_size") % 3).alias("k"), F.when(c("p_size") % 3 == 1, c("p_brand")).otherwise("Class_7").alias("name"), F.concat(F.lit("/data/case%20"), (c("p_size") % 50).cast("string"), F.lit("/a.png")).alias("path"))
    return p.groupBy(S.class_name(c("k"), c("name"), {0: "Occlusal"}).alias("class_name"), S.case_of_file(c("path")).alias("case_id")).agg(F.count(F.lit(1)).alias("n"))


@query("prj25_complexity", f"SELECT zone, CASE WHEN zone LIKE '%MOD%' THEN 3 WHEN zone LIKE '%MO%' OR zone LIKE '%DO%' THEN 2 ELSE 1 END AS score, count(*) AS n FROM (SELECT {ZONES.format(m='frac_m > 0.3', c='frac_c > 0.2', d='frac_d > 0.6')} AS zone FROM {V}) GROUP BY ALL", V)
def _(spark, sf):
    z = finds(spark, sf).select(S.combined_zone(c("frac_m") > 0.3, c("frac_c") > 0.2, c("frac_d") > 0.6).alias("zone"))
    return z.groupBy("zone", S.complexity(c("zone")).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("prj26_to_29_angles", f"SELECT id, round(CASE WHEN abs(a) * 180 / pi() > 45 THEN 0 ELSE a END, 6) AS angle, abs(a) * 180 / pi() > 45 AS clamped, round(x * cos(frac_m) - y * sin(frac_m), 6) AS tx, greatest(0, least(1, (x - 10) / 30)) AS rel FROM (SELECT *, frac_c * 1.5 - 0.7 AS a FROM {V})", V)
def _(spark, sf):
    a, far = S.clamp_angle(c("frac_c") * 1.5 - 0.7)
    tx, _y = S.turned(c("x"), c("y"), F.lit(0.0), F.lit(0.0), c("frac_m"))
    return finds(spark, sf).select("id", S.half_up(a, 6).alias("angle"), far.alias("clamped"), S.half_up(tx, 6).alias("tx"), S.normalised(c("x") - 10, 30.0).alias("rel"))


@query("prj30_prediction_fallback", "SELECT event_type, CASE WHEN value > 100 THEN CASE WHEN event_type = 'click' THEN 'Mesial' ELSE 'Center' END ELSE 'Other' END AS surface, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    doc = F.when(c("value") > 100, F.when(c("event_type") == "click", F.lit('{"predicted_surface_fine": "Mesial"}')).otherwise(F.lit('{"caries_position_detail": "Center"}'))).otherwise(c("props"))
    return table(spark, sf, "events").groupBy("event_type", S.predicted_surface(doc).alias("surface")).agg(F.count(F.lit(1)).alias("n"))


IN_IMAGE = "~p AS (SELECT * FROM v_pixels WHERE x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 40)"


@query("flt4_in_image", IN_IMAGE + " SELECT case_id, tooth_id, count(*) AS n FROM p GROUP BY ALL", "v_pixels")
def _(spark, sf):
    return pixels.in_image(view(spark, sf, "v_pixels"), 41, 41).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))


@query("geo13_erode_in_image", IN_IMAGE + """ SELECT a.case_id, a.tooth_id, a.x, a.y FROM p a, range(-2, 3) i(i), range(-2, 3) j(j) JOIN p w ON w.case_id = a.case_id AND w.tooth_id = a.tooth_id AND w.x = a.x + i AND w.y = a.y + j GROUP BY ALL
HAVING count(*) = (least(a.x + 2, 40) - greatest(a.x - 2, 0) + 1) * (least(a.y + 2, 40) - greatest(a.y - 2, 0) + 1)""", "v_pixels")
def _(spark, sf):
    return pixels.erode(view(spark, sf, "v_pixels"), size=(41, 41))


@query("flt2_usable_teeth", "~g AS (SELECT case_id, tooth_id, count(*) AS total_pixels, count(h) AS caries_pixels FROM v_pixels LEFT JOIN (SELECT *, 1 AS h FROM v_roi) USING (case_id, x, y) GROUP BY ALL) SELECT * FROM g WHERE total_pixels >= 10 AND caries_pixels > 0", "v_pixels", "v_roi")
def _(spark, sf):
    return pixels.usable(pixels.overlap(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi"))).drop("pct")


@query("geo10_turn_without_clamp", TURN + " SELECT case_id, tooth_id, round(w, 6) AS angle FROM o", "v_pixels")
def _(spark, sf):
    return pixels.orientation(view(spark, sf, "v_pixels"), most_tilt=360.0).select(*K, *r6("angle"))


@query("geo20_noise_ranking")
def _(spark, sf):
    _tooth, lesion = lesions(spark, sf)
    l = pixels.labelled(lesion, 2).withColumn("size", F.count(F.lit(1)).over(pixels.Window.partitionBy(*K, "comp")))
    return pixels.noise_ranking(lesion, l.filter("size >= 3"))


@query("geo23_24_all_features", REL + """ SELECT case_id, tooth_id, max(up::INT) AS is_upper, round(avg(rel_x), 6) AS x_mean, round(avg(rel_y), 6) AS y_mean, round(stddev_pop(rel_x), 6) AS x_std, round(stddev_pop(rel_y), 6) AS y_std, round(min(rel_x), 6) AS x_min, round(max(rel_x), 6) AS x_max, round(min(rel_y), 6) AS y_min,
round(max(rel_x) - min(rel_x), 6) AS x_range, round(max(rel_y) - min(rel_y), 6) AS y_range, round(abs(avg(rel_x) - 0.5), 6) AS x_centroid_dist, round((max(rel_x) - min(rel_x)) / (max(rel_y) - min(rel_y) + 1e-6), 4) AS aspect_ratio, round(count(*) / (max(tooth_n) + 1e-6), 6) AS coverage FROM rel GROUP BY ALL""", "v_pixels", "v_roi")
def _(spark, sf):
    f = pixels.features(rel(spark, sf))
    return f.select(*K, "is_upper", *r6("x_mean", "y_mean", "x_std", "y_std", "x_min", "x_max", "y_min", "x_range", "y_range", "x_centroid_dist"), S.half_up(F.col("aspect_ratio"), 4).alias("aspect_ratio"), *r6("coverage"))


@query("geo25_cover_statistics", """~u AS (SELECT DISTINCT case_id, x, y FROM v_pixels WHERE x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 40), d AS (SELECT DISTINCT case_id, x, y FROM v_decay WHERE x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 40)
SELECT (SELECT count(*) FROM v_pixels) AS drawn, (SELECT count(*) FROM v_pixels WHERE NOT (x BETWEEN 0 AND 40 AND y BETWEEN 0 AND 40)) AS out_of_bounds, (SELECT count(*) FROM u) AS tooth_pixels, (SELECT count(*) FROM d) AS decay_pixels, (SELECT count(*) FROM u JOIN d USING (case_id, x, y)) AS on_teeth""", "v_pixels", "v_decay")
def _(spark, sf):
    return pixels.cover_statistics(view(spark, sf, "v_pixels"), view(spark, sf, "v_decay"), 41, 41)


@query("jn1_2_3_masks_of_lesions", "SELECT v.case_id, v.tooth_id, count(*) AS pixels, coalesce(max(l.n), 0) AS lesion_pixels FROM v_pixels v LEFT JOIN (SELECT case_id, tooth_id, count(*) AS n FROM v_pixels SEMI JOIN v_roi USING (case_id, x, y) GROUP BY ALL) l ON v.case_id = l.case_id AND v.tooth_id = l.tooth_id GROUP BY ALL", "v_pixels", "v_roi")
def _(spark, sf):
    tooth, lesion = lesions(spark, sf)
    own = lesion.groupBy(*K).agg(F.count(F.lit(1)).alias("lesion_pixels"))
    return tooth.groupBy(*K).agg(F.count(F.lit(1)).alias("pixels")).join(own, K, "left").fillna(0)


@query("jn4_confidence_fallback", """~b AS (SELECT case_id, tooth_id, max(confidence) AS own FROM v_findings WHERE flag = 'R' GROUP BY ALL), a AS (SELECT case_id, max(confidence) AS any_ FROM v_findings WHERE flag = 'R' GROUP BY ALL)
SELECT id, coalesce(own, any_) AS best FROM v_findings LEFT JOIN b USING (case_id, tooth_id) LEFT JOIN a USING (case_id)""", V)
def _(spark, sf):
    f = finds(spark, sf)
    return matching.with_fallback(f.select("id", "case_id", "tooth_id"), f.filter("flag = 'R'").select("case_id", "tooth_id", c("confidence").alias("best")), ["case_id", "tooth_id"], "case_id", "best").select("id", "best")


@query("jn10_labels_for_lesions")
def _(spark, sf):
    f = finds(spark, sf)
    zone = S.clamp_label(c("predicted"), ("Occlusal", "Mesial", "Distal"))
    return matching.assign_labels(f.select("case_id", "pos", zone.alias("surface")), f.filter("pos <= 4").select("case_id", "pos", S.fine_surface(c("surface")).alias("surface")), ["case_id"])


STATUS = "CASE flag WHEN 'R' THEN 'TP' WHEN 'A' THEN 'FP' ELSE 'FN' END"


@query("jn12_match_status", f"SELECT case_id, tooth_id, ['TP', 'FP', 'FN'][min(CASE flag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END)] AS status FROM {V} GROUP BY ALL", V)
def _(spark, sf):
    kind = F.when(c("flag") == "R", "TP").when(c("flag") == "A", "FP").otherwise("FN")
    return matching.match_status(finds(spark, sf).withColumn("match_type", kind), ["case_id", "tooth_id"])


@query("jn14_first_zone_result", f"""~z AS (SELECT case_id, tooth_id, arg_min(predicted, (pos, id)) AS p FROM {V} WHERE predicted IS NOT NULL GROUP BY ALL)
SELECT id, coalesce(CASE WHEN p <> 'Unknown' THEN p END, surface) AS zone FROM {V} LEFT JOIN z USING (case_id, tooth_id)""", V)
def _(spark, sf):
    f = finds(spark, sf)
    z = f.filter("predicted is not null").select("case_id", "tooth_id", "pos", "id", c("predicted").alias("zone"))
    return matching.with_first(f.select("id", "case_id", "tooth_id", "surface"), z, ["case_id", "tooth_id"], ["pos", "id"], "zone", "surface").select("id", "zone")


def evaluated(spark, sf):
    f = finds(spark, sf)
    t = f.filter("flag <> 'A'").select("case_id", "id", "surface")
    p = f.filter("flag <> 'N'").select("case_id", "id", c("predicted").alias("surface"), "frac_m", "frac_c", "frac_d")
    m = f.select("case_id", F.when(c("flag") != "A", c("id")).alias("gt"), F.when(c("flag") != "N", c("id")).alias("pred"), F.when(c("flag") == "R", "tooth_id").when(c("flag") == "A", "FP").otherwise("FN").alias("match_type"), F.when(c("flag") == "R", c("x")).alias("distance"))
    return evaluation.evaluation_rows(m, t, p)


EVAL = f"""~e AS (SELECT case_id, CASE WHEN flag <> 'A' THEN id END AS gt, CASE WHEN flag <> 'N' THEN id END AS pred, CASE flag WHEN 'R' THEN 'tooth_id' WHEN 'A' THEN 'FP' ELSE 'FN' END AS match_type, CASE WHEN flag = 'R' THEN x ELSE -1 END AS distance,
  CASE WHEN flag <> 'A' THEN surface ELSE '' END AS gt_surface, CASE WHEN flag <> 'A' THEN {COARSE.format('surface')} ELSE '' END AS gt_surface_norm, CASE WHEN flag <> 'N' THEN coalesce(predicted, '') ELSE '' END AS pred_surface, CASE WHEN flag <> 'N' THEN {COARSE.format('predicted')} ELSE '' END AS pred_surface_norm,
  flag = 'R' AND ({COARSE.format('surface')}) = ({COARSE.format('predicted')}) AS surface_match_strict, CASE WHEN flag = 'R' THEN {SOFT} ELSE 'False' END AS surface_match FROM {V})"""


@query("agg6_evaluation_rows", EVAL + " SELECT * FROM e", V)
def _(spark, sf):
    return evaluated(spark, sf)


@query("agg5_surface_accuracy", EVAL + " SELECT count(*) AS n, round(avg(surface_match_strict::INT), 6) AS strict, round(avg((surface_match <> 'False')::INT), 6) AS soft FROM e WHERE match_type = 'tooth_id'", V)
def _(spark, sf):
    return evaluation.surface_accuracy(evaluated(spark, sf)).select("n", *r6("strict", "soft"))


@query("agg20_leaderboard", EVAL + " SELECT case_id, count(*) AS teeth, round(avg(surface_match_strict::INT), 6) AS strict_rate, round(avg((surface_match <> 'False')::INT), 6) AS soft_rate FROM e WHERE match_type = 'tooth_id' GROUP BY ALL HAVING count(*) >= 2 ORDER BY avg((surface_match <> 'False')::INT) DESC, avg(surface_match_strict::INT) DESC, teeth DESC, case_id LIMIT 20", V)
def _(spark, sf):
    return evaluation.leaderboard(evaluated(spark, sf), 20, least=2).select("case_id", "teeth", *r6("strict_rate", "soft_rate"))


@query("flt1_only_caries", f"SELECT id FROM {V} v SEMI JOIN (SELECT * FROM {V} WHERE flag = 'R') r ON v.case_id = r.case_id AND v.tooth_id = r.tooth_id", V)
def _(spark, sf):
    f = finds(spark, sf)
    return evaluation.only_caries(f, f.select("case_id", "tooth_id", (c("flag") == "R").alias("has_caries")), ["case_id", "tooth_id"]).select("id")


@query("agg2_run_summary", "~g AS (SELECT case_id, tooth_id, count(h) AS n FROM v_pixels LEFT JOIN (SELECT *, 1 AS h FROM v_roi) USING (case_id, x, y) GROUP BY ALL) SELECT (SELECT count(DISTINCT floor(s_suppkey / 9)) FROM supplier) AS cases, count(DISTINCT case_id) AS processed, count(*) AS teeth, count(*) FILTER (n > 0) AS with_caries, (SELECT count(DISTINCT floor(s_suppkey / 9)) FROM supplier) - count(DISTINCT case_id) AS failed, round(100.0 * count(*) FILTER (n > 0) / count(*), 2) AS pct FROM g", "v_pixels", "v_roi")
def _(spark, sf):
    return evaluation.run_summary(pixels.overlap(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi")), table(spark, sf, "supplier").select(F.floor(c("s_suppkey") / 9).alias("case_id")))  # more cases are planned than lineitem has


@query("agg11_error_rows", f"SELECT id, greatest(frac_m, frac_c, frac_d) AS confidence FROM {V} WHERE predicted <> {FINE.format('surface')}", V)
def _(spark, sf):
    f = finds(spark, sf).select("id", S.fine_surface(c("surface")).alias("y_true"), c("predicted").alias("y_pred"), F.array("frac_m", "frac_c", "frac_d").alias("proba"))
    return evaluation.error_rows(f).select("id", "confidence")


BY_TOOTH = """~t AS (SELECT case_id, det_id AS tooth, CAST(trunc((x2 - x1) * (y2 - y1) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS total_pixels FROM v_boxes WHERE kind = 'tooth'), l AS (SELECT case_id, det_id - det_id % 10 + 1 AS tooth, CAST(trunc((x2 - x1) * (y2 - y1) * (0.6 + 0.2 * confidence)) AS BIGINT) AS px, confidence FROM v_boxes),
g AS (SELECT case_id, tooth, sum(px) AS px, count(*) AS n, max(confidence) AS confidence FROM l GROUP BY ALL), c AS (SELECT case_id, tooth, total_pixels, CAST(coalesce(px, 0) AS BIGINT) AS caries_pixels, coalesce(n, 0) AS lesions, g.confidence FROM t LEFT JOIN g USING (case_id, tooth))"""


def by_tooth(spark, sf):
    b = view(spark, sf, "v_boxes")
    l = b.select("case_id", (c("det_id") - c("det_id") % 10 + 1).alias("tooth"), c("det_id").alias("pos"), c("kind").alias("surface"), "confidence", *matching.BOX)
    return dataset.grouped_by_tooth(b.filter("kind = 'tooth'").withColumn("tooth", c("det_id")), l)


@query("agg18_by_tooth", BY_TOOTH + """, k AS (SELECT case_id, det_id - det_id % 10 + 1 AS tooth, kind, min(det_id) AS p FROM v_boxes GROUP BY ALL), s AS (SELECT case_id, tooth, string_agg(kind, ',' ORDER BY p) AS surfaces FROM k GROUP BY ALL)
SELECT c.*, coalesce(surfaces, '') AS surfaces, CASE WHEN total_pixels > 0 THEN round_even(100.0 * caries_pixels / total_pixels, 2) ELSE 0 END AS pct FROM c LEFT JOIN s USING (case_id, tooth)""", "v_boxes")
def _(spark, sf):
    return by_tooth(spark, sf).select("case_id", "tooth", "total_pixels", "caries_pixels", "lesions", "confidence", F.array_join("surfaces", ",").alias("surfaces"), "pct")


@query("agg19_conversion_totals", BY_TOOTH + " SELECT count(DISTINCT case_id) AS cases, count(DISTINCT CASE WHEN lesions > 0 THEN case_id END) AS cases_with_caries, count(*) AS teeth, CAST(sum(lesions) AS BIGINT) AS lesions FROM c", "v_boxes")
def _(spark, sf):
    return dataset.conversion_totals(by_tooth(spark, sf))


@query("agg17_label_statistics", "SELECT y_pred_a AS split, y_true AS label, count(*) AS annotations, count(DISTINCT group_id) AS cases FROM v_label_pairs GROUP BY GROUPING SETS ((y_pred_a, y_true), (y_pred_a), (y_true), ())", "v_label_pairs")
def _(spark, sf):
    return dataset.label_statistics(view(spark, sf, "v_label_pairs").select(c("y_pred_a").alias("split"), c("y_true").alias("label"), c("group_id").alias("case_id")))


@query("agg21_set3_conformance", "SELECT 'doc_id' AS field, 'common' AS state, (SELECT count(*) FILTER (doc_id IS NULL) FROM documents) AS nulls UNION ALL SELECT 'source', 'common', (SELECT count(*) FILTER (source IS NULL) FROM documents) UNION ALL SELECT 'severity', 'missing', NULL UNION ALL SELECT 'lang', 'extra', NULL UNION ALL SELECT 'n_chars', 'extra', NULL UNION ALL SELECT 'text', 'extra', NULL")
def _(spark, sf):
    return dataset.conformance(table(spark, sf, "documents"), ["doc_id", "source", "severity"], ["doc_id", "source"])


@query("win2_top_after_dedupe", "SELECT case_id, det_id FROM (SELECT * FROM v_boxes QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, case_id, det_id) = 1) ORDER BY confidence DESC, case_id, det_id LIMIT 30", "v_boxes")
def _(spark, sf):
    return selection.top(view(spark, sf, "v_boxes"), ["case_id"], [F.desc("confidence"), c("case_id"), c("det_id")], 30).select("case_id", "det_id")


@query("win4_priority_first", "SELECT case_id, det_id FROM v_boxes ORDER BY CASE case_id WHEN 33 THEN 1 WHEN 311 THEN 2 ELSE 3 END, confidence DESC, case_id, det_id LIMIT 40", "v_boxes")
def _(spark, sf):
    return selection.priority_first(view(spark, sf, "v_boxes"), "case_id", [33, 311], [F.desc("confidence"), c("case_id"), c("det_id")], 40).select("case_id", "det_id")


@query("win8_three_splits", """~g AS (SELECT group_id, row_number() OVER (ORDER BY md5('42:' || group_id), group_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT group_id FROM v_label_pairs))
SELECT sample_id, CASE WHEN r <= ceil(n * 0.7::DOUBLE) THEN 'train' WHEN r <= ceil(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM v_label_pairs JOIN g USING (group_id)""", "v_label_pairs")
def _(spark, sf):
    return selection.with_splits(view(spark, sf, "v_label_pairs"), "group_id", {"train": 7, "val": 2, "test": 1}).select("sample_id", "split")


@query("win9_lesion_index")
def _(spark, sf):
    return pixels.lesion_index(pixels.labelled(lesions(spark, sf)[1], 4)).groupBy(*K, "lesion_idx").agg(F.count(F.lit(1)).alias("n"))


SHOW = f"""~f AS (SELECT *, predicted IS NOT NULL AND predicted = {FINE.format('surface')} AS matched, confidence * 8 AS conf, {ZONES.format(m='frac_m > 0.3', c='frac_c > 0.2', d='frac_d > 0.6')} AS label, CASE WHEN {ZONES.format(m='frac_m > 0.3', c='frac_c > 0.2', d='frac_d > 0.6')} LIKE '%MOD%' THEN 3 WHEN {ZONES.format(m='frac_m > 0.3', c='frac_c > 0.2', d='frac_d > 0.6')} LIKE '%MO%' OR {ZONES.format(m='frac_m > 0.3', c='frac_c > 0.2', d='frac_d > 0.6')} LIKE '%DO%' THEN 2 ELSE 1 END AS score FROM {V})"""
PICKS = {"perfect": ("matched AND conf > 0.85", "conf DESC"), "complex": ("regexp_matches(label, 'MO|DO|MOD')", "score DESC, conf DESC"), "second_opinion": ("NOT matched AND conf > 0.85", "conf DESC"), "honest_mistake": ("NOT matched AND conf < 0.6", "md5('42:' || id)"), "wisdom": ("tooth_id IN ('18', '28', '38', '48')", "conf DESC")}


@query("win10_11_showcases", SHOW + " " + " UNION ALL ".join(f"(SELECT '{k}' AS category, case_id, id FROM (SELECT * FROM f WHERE {w} QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY {o}, case_id, id) = 1) ORDER BY {o}, case_id, id LIMIT 25)" for k, (w, o) in PICKS.items()), V)
def _(spark, sf):
    f = finds(spark, sf)
    matched = F.coalesce(c("predicted") == S.fine_surface(c("surface")), F.lit(False))
    rows = f.select("case_id", "id", "tooth_id", matched.alias("matched"), (c("confidence") * 8).alias("confidence"), S.combined_zone(c("frac_m") > 0.3, c("frac_c") > 0.2, c("frac_d") > 0.6).alias("label"))
    return selection.showcases(rows, 25).select("category", "case_id", "id")


@query("set4_without_chosen", "SELECT case_id, count(*) AS n FROM v_boxes ANTI JOIN (SELECT case_id FROM v_boxes WHERE kind = 'lesion') USING (case_id) GROUP BY ALL", "v_boxes")
def _(spark, sf):
    b = view(spark, sf, "v_boxes")
    return selection.without(b, b.filter("kind = 'lesion'"), ["case_id"]).groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))


@query("src7_scraped_pages", r"SELECT page_id, regexp_extract(html, 'lang=\"(\w+)\"', 1) AS tooth_name, regexp_extract(html, '<title>([^<]*)<', 1) AS surface, len(regexp_extract_all(html, 'href=\"/(\w+)\"', 1)) AS n FROM pages")
def _(spark, sf):
    p = readers.scraped(table(spark, sf, "pages"), "html", r'lang="(\w+)"', "<title>([^<]*)<", r'href="/(\w+)"', r'href="/(\w+)"')
    return p.select("page_id", "tooth_name", "surface", F.size("polygon").cast("long").alias("n"))


@query("sta4_verdict", "~c AS (SELECT count(*) AS n, count(*) FILTER (y_true = y_pred_a) AS a, count(*) FILTER (y_true = y_pred_b) AS b FROM v_label_pairs) SELECT CASE WHEN abs(((a - b) / n) / sqrt((a + b) / (2 * n) * (1 - (a + b) / (2 * n)) * 2 / n)) > 1.959963984540054 THEN 'significant' ELSE 'not significant' END AS verdict FROM c", "v_label_pairs")
def _(spark, sf):
    return metrics.two_proportions(view(spark, sf, "v_label_pairs")).select(metrics.verdict(metrics.p_value(c("z"))).alias("verdict"))


FEATURES = ["x", "y", "frac_m", "frac_c"]


def learned(spark, sf):
    return finds(spark, sf).select("id", c("case_id").alias("group"), *FEATURES, F.when(c("frac_m") > 0.4, "Mesial").when(c("x") > 30, "Occlusal").otherwise("Distal").alias("label"))


@query("ml7_group_folds")
def _(spark, sf):
    return learning.with_folds(learned(spark, sf), "group").groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("groups"))


@query("ml3_balanced_weights", f"~l AS (SELECT id, CASE WHEN frac_m > 0.4 THEN 'Mesial' WHEN x > 30 THEN 'Occlusal' ELSE 'Distal' END AS label FROM {V}), n AS (SELECT label, count(*) AS k FROM l GROUP BY ALL) SELECT id, label, round((SELECT sum(k) FROM n) / ((SELECT count(*) FROM n) * k), 6) AS weight FROM l JOIN n USING (label)", V)
def _(spark, sf):
    return learning.weighted(learned(spark, sf)).select("id", "label", *r6("weight"))


@query("ml4_cls9_forest_report")
def _(spark, sf):
    # a fifth of the labels is wrong, so that scores say something
    noisy = F.when(F.pmod(F.xxhash64("id"), F.lit(5)) == 0, "Mesial").otherwise(c("label"))
    d = selection.with_split(learned(spark, sf).withColumn("label", noisy), "group")
    model = learning.train_forest(d.filter("split = 'train'"), FEATURES, trees=20)
    return metrics.report(learning.scored(model, d.filter("split = 'test'")), true="label", pred="y_pred")


@query("ml1_cls10_lesion_table")
def _(spark, sf):
    tooth, lesion = lesions(spark, sf)
    one = pixels.lesion_index(pixels.labelled(lesion, 4))
    r = pixels.relative(tooth, one.select(*K, "x", "y", "lesion_idx"))
    keys = [*K, "lesion_idx"]
    return pixels.features(r, keys).join(zones.x_thirds(r, keys).select(*keys, c("surface").alias("zone")), keys).select(*keys, *r6("x_mean", "coverage"), "zone")
