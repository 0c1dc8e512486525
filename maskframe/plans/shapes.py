"""Queries on runs, polygons, components, quantiles, lists, running counters and showcases, with SQL by point-in-polygon and by
recursive search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import metrics, pixels, runs, selectors
from ..sources import scans
from ..sources.shared import shared_folder
from ..sources.views import view, with_views
from ..streaming import incremental
from .registry import ORACLE_SQL, K, lesions, query, r6

# polygons: five corners with a notch for each order, and the same shape shifted and bent

CORNERS = {
    "v_outlines": ["o_custkey % 17", "o_orderkey % 7", "o_custkey % 17 + 9", "o_orderkey % 5 - 2", "o_custkey % 17 + 4", "6 + o_custkey % 3", "o_custkey % 17 + 10", "13", "o_custkey % 17 - 2", "9 + o_orderkey % 4"],
    "v_drawn": ["o_custkey % 17 + 1", "o_orderkey % 7 + 1", "o_custkey % 17 + 8", "o_orderkey % 5", "o_custkey % 17 + 4", "4 + o_custkey % 5", "o_custkey % 17 + 10", "12", "o_custkey % 17 - 1", "9 + o_orderkey % 4"],
}


def outline(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """(id, polygon)."""
    c = [F.expr(f"CAST({e} AS INT)") for e in CORNERS[name]]
    corners = F.array(*(F.struct(x.alias("x"), y.alias("y")) for x, y in zip(c[::2], c[1::2], strict=True)))
    return spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), corners.alias("polygon"))


def covered(name: str) -> str:
    """SQL for (id, x, y): grid points inside (odd number of edges to the right) or on an edge."""
    c = CORNERS[name]
    edges = " UNION ALL ".join(f"SELECT o_orderkey AS id, CAST({c[2 * i]} AS INT) AS ax, CAST({c[2 * i + 1]} AS INT) AS ay, CAST({c[2 * (i + 1) % 10]} AS INT) AS bx, CAST({c[(2 * (i + 1) + 1) % 10]} AS INT) AS by_ FROM orders" for i in range(5))
    return f"""(WITH e AS ({edges}), b AS (SELECT id, min(ax) AS x1, max(ax) AS x2, min(ay) AS y1, max(ay) AS y2 FROM e GROUP BY ALL),
g AS (SELECT id, x, unnest(range(y1, y2 + 1)) AS y FROM (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM b)),
s AS (SELECT g.id, x, y, count(*) FILTER (y >= least(ay, by_) AND y < greatest(ay, by_) AND (y - ay) * (bx - ax) * sign(by_ - ay) > (x - ax) * (by_ - ay) * sign(by_ - ay)) AS n,
  bool_or((y - ay) * (bx - ax) = (x - ax) * (by_ - ay) AND x BETWEEN least(ax, bx) AND greatest(ax, bx) AND y BETWEEN least(ay, by_) AND greatest(ay, by_)) AS edge FROM g JOIN e USING (id) GROUP BY ALL)
SELECT id, x, y FROM s WHERE n % 2 = 1 OR edge)"""


@query("geo22_polygon_iou", f"WITH a AS {covered('v_outlines')}, b AS {covered('v_drawn')}, n AS (SELECT id, count(*) AS n FROM a GROUP BY ALL), m AS (SELECT id, count(*) AS m FROM b GROUP BY ALL), c AS (SELECT id, count(*) AS shared FROM a JOIN b USING (id, x, y) GROUP BY ALL) SELECT id, shared, n + m - shared AS total, round(shared / (n + m - shared), 6) AS iou FROM n JOIN m USING (id) JOIN c USING (id)")
def _(spark, sf):
    return runs.polygon_iou(outline(spark, sf, "v_outlines"), outline(spark, sf, "v_drawn"), ["id"]).select("id", "shared", "total", *r6("iou"))


@query("geo22_polygon_rows", f"SELECT id, y, min(x) AS first_x, max(x) AS last_x, count(*) AS pixels FROM {covered('v_outlines')} GROUP BY ALL")
def _(spark, sf):
    return runs.covered_rows(outline(spark, sf, "v_outlines"), ["id"])


# erosion that knows the image's border

SIZE = 41
IN_IMAGE = f"p AS (SELECT * FROM v_pixels WHERE x BETWEEN 0 AND {SIZE - 1} AND y BETWEEN 0 AND {SIZE - 1})"


@query("geo14_protected_in_image", f"""~{IN_IMAGE}, e AS (SELECT a.case_id, a.tooth_id, a.x, a.y FROM p a, range(-2, 3) i(i), range(-2, 3) j(j) JOIN p w ON w.case_id = a.case_id AND w.tooth_id = a.tooth_id AND w.x = a.x + i AND w.y = a.y + j GROUP BY ALL
HAVING count(*) = (least(a.x + 2, {SIZE - 1}) - greatest(a.x - 2, 0) + 1) * (least(a.y + 2, {SIZE - 1}) - greatest(a.y - 2, 0) + 1)),
g AS (SELECT case_id, tooth_id, count(*) AS total_pixels, count(h) AS caries_pixels FROM e LEFT JOIN (SELECT *, 1 AS h FROM v_roi) USING (case_id, x, y) GROUP BY ALL)
SELECT *, CASE WHEN caries_pixels <= 100 AND 100.0 * caries_pixels / total_pixels <= 1.0 THEN 0 ELSE caries_pixels END AS kept_pixels, NOT (caries_pixels <= 100 AND 100.0 * caries_pixels / total_pixels <= 1.0) AND caries_pixels > 0 AS has_caries FROM g""", "v_pixels", "v_roi")
def _(spark, sf):
    return pixels.protected_overlap(view(spark, sf, "v_pixels"), view(spark, sf, "v_roi"), size=(SIZE, SIZE)).drop("pct")


# components

LESION = "p AS (SELECT v.case_id, v.tooth_id, v.x, v.y FROM v_pixels v SEMI JOIN v_roi USING (case_id, x, y))"
BLOB = "p AS (SELECT case_id, 0 AS tooth_id, x, y FROM v_decay d ANTI JOIN v_pixels v USING (case_id, x, y))"


def reachable(source: str, radius2: int, then: str, *views: str, name: str = "p") -> str:
    """SQL with l (case_id, tooth_id, x, y, comp) by recursive search from every pixel."""
    r = int(radius2**0.5)
    search = f"""~{source}, s AS (SELECT case_id, tooth_id, x, y, x AS rx, y AS ry FROM {name} UNION SELECT s.case_id, s.tooth_id, s.x, s.y, p.x, p.y FROM s JOIN {name} p ON p.case_id = s.case_id AND p.tooth_id = s.tooth_id
  AND p.x BETWEEN s.rx - {r} AND s.rx + {r} AND p.y BETWEEN s.ry - {r} AND s.ry + {r} AND (p.x - s.rx) ** 2 + (p.y - s.ry) ** 2 <= {radius2}),
l AS (SELECT case_id, tooth_id, x, y, min(CAST(ry AS BIGINT) * 2147483648 + rx) AS comp FROM s GROUP BY ALL) {then}"""
    return with_views(search, *views).replace("WITH ", "WITH RECURSIVE ", 1)


SIZES = "SELECT case_id, tooth_id, count(*) AS area, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM l GROUP BY case_id, tooth_id, comp"
ON_TEETH = ("v_pixels", "v_roi")
BLOBS = "SELECT case_id, count(*) AS area, round_even(avg(x), 2) AS cx, round_even(avg(y), 2) AS cy FROM l GROUP BY case_id, comp HAVING count(*) > 3"

#: SQL for queries of the registry that had none.
ORACLE_SQL.update({
    "geo16_connected_components": reachable(LESION, 2, SIZES, *ON_TEETH),
    "geo17_radius_clusters": reachable(LESION, 4, SIZES, *ON_TEETH),
    "geo18_without_small_clusters": reachable(LESION, 4, ", c AS (SELECT case_id, tooth_id, comp, count(*) AS k FROM l GROUP BY ALL), m AS (SELECT *, max(k) OVER (PARTITION BY case_id, tooth_id) AS most FROM c) SELECT case_id, tooth_id, CAST(sum(k) AS BIGINT) AS n, count(*) AS components FROM m WHERE k >= 15 OR most < 15 GROUP BY ALL", *ON_TEETH),
    "geo20_noise_ranking": reachable(LESION, 2, ", z AS (SELECT *, count(*) OVER (PARTITION BY case_id, tooth_id, comp) AS k FROM l), g AS (SELECT case_id, tooth_id, count(*) AS raw, count(*) FILTER (k >= 3) AS cleaned FROM z GROUP BY ALL) SELECT case_id, tooth_id, raw, cleaned, raw - cleaned AS removed, (raw - cleaned) / raw AS ratio FROM g WHERE (raw - cleaned) / raw > 0.05 AND (raw - cleaned) / raw < 0.5 AND cleaned > 0 ORDER BY removed DESC, case_id, tooth_id LIMIT 10", *ON_TEETH),
    "geo19_unassigned_blobs": reachable(BLOB, 2, BLOBS, "v_pixels", "v_decay"),
    "win9_lesion_index": reachable(LESION, 4, ", i AS (SELECT *, dense_rank() OVER (PARTITION BY case_id, tooth_id ORDER BY comp) - 1 AS lesion_idx FROM l) SELECT case_id, tooth_id, CAST(lesion_idx AS INTEGER) AS lesion_idx, count(*) AS n FROM i GROUP BY ALL", *ON_TEETH),
})


@query("geo16_run_components", ORACLE_SQL["geo16_connected_components"])
def _(spark, sf):
    return runs.component_sizes(runs.runs(lesions(spark, sf)[1])).select(*K, "area", *r6("cx", "cy"))


@query("geo17_run_clusters", ORACLE_SQL["geo17_radius_clusters"])
def _(spark, sf):
    return runs.component_sizes(runs.runs(lesions(spark, sf)[1]), radius2=4).select(*K, "area", *r6("cx", "cy"))


@query("geo19_run_blobs", ORACLE_SQL["geo19_unassigned_blobs"])
def _(spark, sf):
    left = pixels.unassigned(view(spark, sf, "v_pixels"), view(spark, sf, "v_decay"))
    sizes = runs.component_sizes(runs.runs(left, ["case_id"]), ["case_id"]).filter("area > 3")
    return sizes.select("case_id", "area", F.bround("cx", 2).alias("cx"), F.bround("cy", 2).alias("cy"))


@query("agg12_box_plots", """SELECT y_true, p > 0.5 AS correct, count(*) AS n, round(avg(p), 6) AS mean, min(p) AS least, round(quantile_cont(p, 0.25), 6) AS q1, round(quantile_cont(p, 0.5), 6) AS median, round(quantile_cont(p, 0.75), 6) AS q3, max(p) AS most FROM v_proba GROUP BY ALL""", "v_proba")
def _(spark, sf):
    d = view(spark, sf, "v_proba").withColumn("correct", F.col("p") > 0.5)
    return metrics.box_plot(d, "p", ["y_true", "correct"]).select("y_true", "correct", "n", *r6("mean"), "least", *r6("q1", "median", "q3"), "most")


@query("agg16_length_quantiles", " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS prob, round(quantile_cont(CAST(length(text) AS DOUBLE), {p}), 6) AS value FROM documents WHERE text IS NOT NULL" for p in (0.0, 0.01, 0.5, 0.95, 0.999, 1.0)))
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select(F.length("text").alias("n"))
    return metrics.quantiles(d, "n", [0.0, 0.01, 0.5, 0.95, 0.999, 1.0]).select("prob", *r6("value"))


# lists and streams that are derived from the tables


@query("src13_aligned_lists", "SELECT row_number() OVER (ORDER BY sample_id) - 1 AS pos, y_true, y_pred_a, y_pred_b FROM v_label_pairs", "v_label_pairs")
def _(spark, sf):
    """The labels as three text lists in the order of their samples, read back line by line."""
    out, names = f"{shared_folder(spark)}/lists-{uuid.uuid4().hex}", ["y_true", "y_pred_a", "y_pred_b"]
    rows = view(spark, sf, "v_label_pairs")
    for name in names:
        rows.select("sample_id", name).orderBy("sample_id").select(F.concat(F.lit(" "), name, F.lit("\n")).alias("value")).write.text(f"{out}/{name}")
    return scans.read_aligned(spark, {name: f"{out}/{name}" for name in names})


@query("agg2_running_counters", "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY ALL")
def _(spark, sf):
    """The events as a stream of files, three batches, and the table of counters after them."""
    out, events = f"{shared_folder(spark)}/counters-{uuid.uuid4().hex}", spark.read.parquet(f"{sf}/events.parquet").select("event_id", "event_type", "value")
    events.repartition(12, "event_id").write.parquet(f"{out}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(f"{out}/in")
    counted = [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), F.max("value").alias("most")]
    incremental.run_counters(stream, ["event_type"], counted, f"{out}/out", f"{out}/checkpoint").awaitTermination()
    return incremental.counters(spark, f"{out}/out", ["event_type"]).select("event_type", "n", S.half_up(F.col("total"), 4).alias("total"), "most")


# showcases

EVALUATED = """SELECT case_id, id, concat(cast(1 + id % 4 as int), right(tooth_id, 1)) AS tooth_id, CASE flag WHEN 'R' THEN 'tooth_id' WHEN 'A' THEN 'centroid_proximity' ELSE 'FN' END AS match_type, x > 40 AS pca_clamped,
  CASE pos % 4 WHEN 0 THEN 'True' WHEN 1 THEN 'True_with_warning' WHEN 2 THEN 'Partial' ELSE 'False' END AS surface_match, pos % 4 = 0 AND y < 8 AS surface_match_strict,
  CASE pos % 3 WHEN 0 THEN 'MOD' WHEN 1 THEN 'MO' ELSE 'D' END AS detail FROM v_findings"""
RIGHT = "match_type <> 'FN' AND surface_match IN ('True', 'True_with_warning')"
PICKED = f"""~e AS ({EVALUATED}), s AS (SELECT *, CASE detail WHEN 'MOD' THEN 3 WHEN 'MO' THEN 2 ELSE 1 END AS score FROM e),
a AS (SELECT * FROM e WHERE {RIGHT} AND pca_clamped QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id) = 1),
b AS (SELECT * FROM s WHERE match_type <> 'FN' AND surface_match IN ('True_with_warning', 'Partial') AND NOT surface_match_strict QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY score DESC, id) = 1),
w AS (SELECT *, row_number() OVER (PARTITION BY tooth_id ORDER BY case_id, id) AS r FROM e WHERE {RIGHT} AND tooth_id IN ('18', '28', '38', '48')),
x AS (SELECT *, 1 AS tier, tooth_id AS t FROM w WHERE r = 1 UNION ALL SELECT *, 2, NULL FROM (SELECT * FROM w WHERE r > 1 QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id) = 1)),
m AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS k FROM e WHERE match_type = 'FN'), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY id) = 1)
(SELECT 'angle_clamp' AS category, case_id, id, tooth_id FROM a ORDER BY case_id <> 33, case_id, id LIMIT 20) UNION ALL (SELECT 'soft_match', case_id, id, tooth_id FROM b ORDER BY case_id <> 311, score DESC, case_id, id LIMIT 20)
UNION ALL (SELECT 'squarish_molar', case_id, id, tooth_id FROM x ORDER BY tier, t, case_id, id LIMIT 20) UNION ALL (SELECT 'missing_upstream', case_id, id, tooth_id FROM f ORDER BY k DESC, case_id, id LIMIT 20)"""


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    return spark.sql(EVALUATED.replace("v_findings", "{findings}"), findings=view(spark, sf, "v_findings"))


@query("win11_selectors", PICKED, "v_findings")
def _(spark, sf):
    return selectors.showcases(evaluated(spark, sf), 20)


@query("win11_dashboards", f"~e AS ({EVALUATED}) SELECT case_id, count(*) AS n_teeth, round(avg((surface_match IN ('True', 'True_with_warning'))::INT), 6) AS soft_accuracy, round(avg(surface_match_strict::INT), 6) AS strict_accuracy FROM e WHERE match_type <> 'FN' GROUP BY ALL HAVING count(*) >= 5 ORDER BY avg((surface_match IN ('True', 'True_with_warning'))::INT) DESC, avg(surface_match_strict::INT) DESC, n_teeth DESC, case_id LIMIT 25", "v_findings")
def _(spark, sf):
    return selectors.dashboards(evaluated(spark, sf), 25).select("case_id", "n_teeth", *r6("soft_accuracy", "strict_accuracy"))
