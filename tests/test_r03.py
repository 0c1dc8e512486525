"""Cases of the third round: borders of zones, rounding, and work that stays bounded when a table grows."""

import math

from maskframe.functions import scalars as S
from maskframe.operators import dataset, learning, matching, pixels, runs, selection, zones
from maskframe.sources import scans
from pyspark.sql import functions as F


def test_moments_do_not_depend_on_partitions(spark):
    points = [(1, "16", 21 + (7 * i) % 41 - 2 * (i % 11), i % 11) for i in range(505)]
    d = spark.createDataFrame(sorted(set(points)), "case_id int, tooth_id string, x int, y int")
    n, sx, sxx = len(set(points)), sum(p[2] for p in set(points)), sum(p[2] ** 2 for p in set(points))
    want = (n * sxx - sx * sx) / (n * (n - 1))
    assert {pixels.pca(d.repartition(k)).first().cxx for k in (1, 2, 3, 5, 7)} == {want}
    one = pixels.pca(d.limit(1)).first()
    assert (one.cxx, one.cyy, one.cxy) == (0.0, 0.0, 0.0)
    far = spark.createDataFrame([(1, "16", x, 0) for x in (4_000_000_000, 4_000_000_002)], "case_id int, tooth_id string, x long, y long")
    assert pixels.pca(far).first().cxx == 2.0


def test_angles_are_the_nearest_doubles(spark):
    rows = [(math.sin(a / 7), math.cos(a / 7)) for a in range(-22, 22)]
    got = spark.createDataFrame(rows, "y double, x double").select("y", "x", S.atan2("y", "x").alias("a")).collect()
    assert [r.a for r in got] == [math.atan2(r.y, r.x) for r in got]


def test_halves_are_rounded_up(spark):
    got = spark.createDataFrame([(0.8606374999999999,), (-0.8606374999999999,), (None,)], "v double").select(S.half_up(F.col("v"), 6).alias("v")).collect()
    assert [r.v for r in got] == [0.860638, -0.860638, None]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_best_of_a_kind_are_cut_before_the_shuffle(spark):
    rows = [("a", 1, 9), ("a", 2, 8), ("b", 2, 7), ("b", 3, 6), ("b", None, 5), ("a", None, 4), ("a", 3, 1)]
    d = spark.createDataFrame(rows, "kind string, case_id int, v int")
    out = selection.diversified(d, "kind", "case_id", [F.desc("v")], 10)
    assert [tuple(r) for r in out.select("case_id", "v", "tier").collect()] == [(1, 9, 1), (2, 7, 1), (3, 6, 2), (None, 5, 2)]
    assert plan(out).count("WindowGroupLimit") >= 4  # partial and final, of kinds and of cases


def test_greedy_first_keeps_repeated_boxes_without_a_join(spark):
    rows = [(1, 1, 0.9, 0, 0, 10, 10), (1, 2, 0.8, 1, 1, 11, 11), (1, 3, 0.7, 20, 0, 30, 10), (1, 3, 0.7, 20, 0, 30, 10), (2, 9, 0.5, 5, 5, 5, 5)]
    d = spark.createDataFrame(rows, "case_id long, det_id long, confidence double, x1 int, y1 int, x2 int, y2 int")
    out = matching.greedy_first(d)
    assert sorted((r.case_id, r.det_id) for r in out.collect()) == [(1, 1), (1, 3), (1, 3), (2, 9)]
    assert "Join" not in plan(out)


def test_a_sweep_reads_the_pixels_once(spark):
    body = spark.createDataFrame([(1, "16", x, y) for x in range(10) for y in range(30)], "case_id int, tooth_id string, x int, y int")
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda x: made.add(1) or x, "int", useArrow=False).asNondeterministic()
    rel = pixels.relative(body, body.filter("x > 7")).withColumn("x", seen("x"))
    assert zones.sweep(rel).count() == 5 and made.value == 60


def test_polygons_shuffle_only_their_corners(spark):
    """one shuffle, of polygons; a key's polygons are one mask; large masks are filled piece by piece."""
    shape = "id int, polygon array<struct<x: int, y: int>>"
    rows = [(1, [(0, 0), (5, 0), (5, 5), (0, 5)]), (1, [(2, 2), (3, 2), (3, 3), (2, 3)]), (2, [(0, 0), (3, 3)]), (3, [(0, -300_000), (9, -300_000), (9, 300_000)]), (None, [(7, 7)])]
    a, b = spark.createDataFrame(rows, shape), spark.createDataFrame([(1, [(4, 4), (9, 4), (9, 9), (4, 9)]), (4, [(1, 1)]), (3, rows[3][1])], shape)
    iou, spans = runs.polygon_iou(a, b, ["id"]), runs.covered_rows(a, ["id"])
    assert plan(iou).count("Exchange") == 1 and plan(spans).count("Exchange") == 1 and plan(runs.filled(a, ["id"])).count("Exchange") == 1
    want = runs.shares(runs.filled(a, ["id"]), runs.filled(b, ["id"]), ["id"])
    assert {tuple(r) for r in iou.collect()} == {tuple(r) for r in want.collect()} and iou.filter("id = 3 and iou = 1").count() == 1
    counted = runs.filled(a, ["id"]).groupBy("id", "y").agg(F.min("x1"), F.max("x2"), F.sum(F.col("x2") - F.col("x1") + 1))
    assert spans.exceptAll(counted).count() == counted.exceptAll(spans).count() == 0 and spans.filter("id = 3").count() == 600_001


def test_links_are_contracted_in_their_tasks(spark):
    """small masks need no rounds; masks in several pieces end the same, with masks beside them."""
    rows = [(k, a, a + 1) for k in (1, 2, 5) for a in range(40) if a % 10 != 9] + [(3, 5, 2), (3, 9, 5), (3, 8, 7)] + [(4, i, i + 50) for i in range(50)]
    edges = spark.createDataFrame(rows, "k int, a long, b long").repartition(3)
    want = {(k, a, a // 10 * 10) for k in (1, 2, 5) for a in range(40)} | {(3, x, 2) for x in (2, 5, 9)} | {(3, 7, 7), (3, 8, 7)} | {(4, i, i % 50) for i in range(100)}
    assert runs.contracted(edges, ["k"]).filter("open").count() == 0
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        for most in (1, 2, 7, 20, 60, 1000):
            got = runs.smallest_reachable(edges, ["k"], most=most).collect()
            assert len(got) == len(want) and {tuple(r) for r in got} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_label_statistics_shuffle_each_row_once(spark):
    """rows are not multiplied before the shuffle; nulls that are values stay beside those that mean all."""
    rows = [("t", "a", 1), ("t", "a", 1), ("t", "b", 1), ("v", "a", 1), (None, "a", 2), ("t", None, None), ("v", "b", 3)]
    d = spark.createDataFrame(rows, "split string, label string, case_id int")
    got = dataset.label_statistics(d)
    sets = d.groupingSets([["split", "label"], ["split"], ["label"], []], "split", "label").agg(F.count(F.lit(1)), F.countDistinct("case_id"))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, sets.collect())))
    assert "Expand" not in plan(got) and dataset.label_statistics(d.limit(0)).count() == d.limit(0).groupingSets([["split"], []], "split").count().count()


def test_list_numbers_need_no_sort_of_a_split(spark, tmp_path):
    """F18."""
    (tmp_path / "l").mkdir()
    for k in range(3):
        (tmp_path / "l" / f"{k}.txt").write_text("".join(f" {k}-{i}\n\n" for i in range(k * 50)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 200)
    try:
        rows = scans.read_list(spark, str(tmp_path / "l"))
        assert [r.value for r in sorted(rows.collect())] == [f"{k}-{i}" for k in range(3) for i in range(k * 50)]
        assert [r.pos for r in sorted(rows.collect())] == list(range(150))
        assert "file" not in "".join(x for x in plan(rows).splitlines() if "Window" in x and "partition" in x) and "row_number" not in plan(rows)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_training_makes_its_rows_once(spark):
    """F11."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    d = spark.createDataFrame([(float(i % 7), "ab"[i % 7 > 3]) for i in range(40)], "x double, label string").mapInPandas(count, "x double, label string")
    model = learning.train_forest(d, ["x"], trees=2)
    assert seen.value == 40 and learning.scored(model, d).filter("y_pred = label").count() == 40
