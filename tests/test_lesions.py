"""The lesion chain, folds, importances and SQL functions on small tables."""

import pytest
from maskframe.functions import sql
from maskframe.operators import learning, lesions, pixels, selection
from pyspark.sql import functions as F

PIXELS = "case_id int, tooth_id string, x int, y int"


def square(case, tooth, x0, y0, w, h):
    return [(case, tooth, x, y) for x in range(x0, x0 + w) for y in range(y0, y0 + h)]


@pytest.fixture(scope="module")
def teeth(spark):
    tooth = square(1, "16", 0, 0, 20, 40) + square(1, "17", 30, 0, 20, 40) + square(1, "46", 0, 60, 20, 40) + square(2, "11", 0, 0, 3, 3) + square(2, "12", 50, 0, 1, 30)
    decay = square(1, "", 0, 5, 4, 5) + square(1, "", 8, 20, 4, 4) + square(1, "", 15, 30, 2, 2) + square(1, "", 31, 3, 2, 2) + square(1, "", 45, 30, 2, 1) + square(1, "", 1, 62, 5, 5) + square(2, "", 1, 1, 1, 1) + square(2, "", 50, 3, 1, 20)
    return spark.createDataFrame(tooth, PIXELS), spark.createDataFrame([(c, x, y) for c, _, x, y in decay], "case_id int, x int, y int")


def test_lesions_and_whole_blobs(spark, teeth):
    own = lesions.lesions(pixels.lesion_pixels(*teeth)).groupBy(*lesions.LESION, "whole").count()
    got = {(r.tooth_id, r.lesion_idx): (r.whole, r["count"]) for r in own.collect()}
    # 16: two clusters, a third is too small; 17: two small ones are one blob; 11: one pixel
    assert got == {("16", 0): (False, 20), ("16", 1): (False, 16), ("17", 0): (True, 6), ("46", 0): (False, 25), ("11", 0): (True, 1), ("12", 0): (False, 20)}


def test_labels_and_predictions(spark, teeth):
    table = lesions.lesion_table(*teeth)
    rows = {(r.tooth_id, r.lesion_idx): r for r in table.collect()}
    assert set(rows) == {("16", 0), ("16", 1), ("17", 0), ("46", 0), ("12", 0)}  # 11 has too few pixels
    assert rows["12", 0].x_mean is None and rows["12", 0].zone == "Other"  # a line has no box
    zone = rows["16", 0].zone
    other = next(s for s in lesions.SURFACES if s not in (zone, rows["16", 1].zone))
    truth = spark.createDataFrame([(1, "16", 0, other), (1, "16", 1, zone), (1, "17", 0, "Mesial"), (1, "46", 0, "Distal")], "case_id int, tooth_id string, pos int, surface string")
    given = {(r.tooth_id, r.lesion_idx): r.label for r in lesions.labelled_lesions(table, truth).collect()}
    assert given == {("16", 0): zone, ("16", 1): other, ("46", 0): "Distal"}  # the blob of 17 gets none
    plain = {(r.tooth_id, r.lesion_idx): (r.surface, r.method) for r in lesions.predicted_lesions(table, None).collect()}
    assert plain == {k: (r.zone, "x_thirds") for k, r in rows.items()}
    d = spark.range(300).select(*((F.col("id") * (i + 3) % 17 / 17.0).alias(f) for i, f in enumerate(lesions.FEATURES)), F.when(F.col("id") % 3 == 0, "Buccal").when(F.col("id") % 2 == 0, "Distal").otherwise("Mesial").alias("label"))
    model = learning.train_forest(d, lesions.FEATURES, trees=5)
    got = {(r.tooth_id, r.lesion_idx): r for r in lesions.predicted_lesions(table, model).collect()}
    assert got["12", 0].method == "x_thirds" and got["12", 0].surface == "Other" and got["12", 0].score is None
    assert all(got[k].method == "forest" and got[k].surface in ("Mesial", "Distal") and 0.5 <= got[k].score <= 1 for k in rows if k != ("12", 0))
    s = learning.surface_scores(model, d, lesions.SURFACES).select("scores").collect()
    assert all(len(r.scores) == 3 and r.scores[0] == 0 and sum(r.scores) == pytest.approx(1) for r in s)
    only = learning.train_forest(d.withColumn("label", F.lit("Buccal")), lesions.FEATURES, trees=2)
    assert {r.method for r in lesions.predicted_lesions(table, only).collect()} == {"x_thirds"}
    docs = lesions.documents(lesions.predicted_lesions(table, model), spark.createDataFrame([(1, "16", 0.75)], "case_id int, tooth_id string, confidence double"), "v").collect()
    assert {r.case_number: [(t.tooth_id, t.lesion_idx, t.confidence) for t in r.teeth_data] for r in docs} == {1: [("16", 0, 0.75), ("16", 1, 0.75), ("17", 0, 0.0), ("46", 0, 0.0)], 2: [("12", 0, 0.0)]}


@pytest.mark.parametrize("sizes", [[(100, 1), (1, 50)], [(7, 3), (5, 4), (2, 9), (1, 3)], [(3, 2)], [(1, 100)], []])
def test_quotas_level_the_folds(sizes):
    q = learning.quotas(sizes, 4)
    load = [sum(s * (b - a + 1) for s, k, a, b in q if k == f) for f in range(4)]
    assert sum(load) == sum(s * n for s, n in sizes) and max(load) - min(load) <= max((s for s, _ in sizes), default=0)
    for size, n in sizes:
        assert sorted(r for s, _, a, b in q if s == size for r in range(a, b + 1)) == list(range(1, n + 1))


def test_folds_keep_groups_and_null_groups(spark):
    d = spark.createDataFrame([(g, i) for g in [*range(40), None] for i in range(1 + (g or 50) % 6)] + [(0, 9)] * 30, "g int, i int")
    f = learning.with_folds(d, "g", folds=3)
    assert f.columns == [*d.columns, "fold"] and f.count() == d.count()
    assert f.groupBy("g").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0
    n = [r["count"] for r in f.groupBy("fold").count().collect()]
    assert len(n) == 3 and max(n) - min(n) <= 31


def test_folds_scored_by_class(spark):
    d = spark.range(400).select((F.col("id") % 40).alias("g"), (F.col("id") * 7919 % 100 / 100).alias("a"))
    d = d.withColumn("label", F.when(F.col("a") > 0.6, "M").when(F.col("a") > 0.3, "D").otherwise("O"))
    by_fold, by_class = learning.cross_validation(d, ["a"], "g", folds=2, trees=5)
    assert sorted((r.fold, r.test_size) for r in by_fold.collect()) == [(0, 200), (1, 200)] and all(r.accuracy > 0.9 for r in by_fold.collect())
    rows = by_class.collect()
    assert {(r.fold, r.label) for r in rows} == {(k, x) for k in (0, 1) for x in "MDO"} and sum(r.support for r in rows) == 400


def test_importances_deal_every_value_once(spark):
    d = spark.createDataFrame([(i // 2 if i < 20 else None, float(i), i * 0.5) for i in range(30)], "id int, a double, b double")
    rows = learning.dealt(d, ["a", "b"], "id", [0, 1, 2]).collect()
    for k in range(3):
        own = [r for r in rows if r.seed == k]
        assert sorted(r.a for r in own) == sorted(r.given.a for r in own) == [float(i) for i in range(30)]
        assert any(r.a != r.given.a for r in own) and all(r.given.b == r.given.a * 0.5 for r in own)
    p = learning.permuted(d, "a", "id", 1)
    assert p.columns == d.columns and sorted(r.b for r in p.collect()) == [i * 0.5 for i in range(30)]


def test_null_groups_stay(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), (1, 3), (2, 4)], "g int, v int")
    for f in (lambda: selection.with_split(d, "g"), lambda: selection.group_sizes(d, "g"), lambda: selection.with_splits(d, "g", {"a": 1, "b": 1, "c": 1}), lambda: learning.weighted(d, "g")):
        assert f().count() == 4
    assert {r.v: r.group_size for r in selection.group_sizes(d, "g").collect()} == {1: 2, 2: 2, 3: 1, 4: 1}
    assert selection.with_splits(d, "g", {"all": 1}).filter("split = 'all'").count() == 4


def test_sql_functions(spark):
    rows = [*square(1, "16", 0, 0, 3, 2), *square(1, "16", 0, 0, 1, 1), *square(1, "16", 9, 9, 1, 1), (1, "17", 4, 4), (1, "17", None, 4), (2, "16", 0, 0)]
    spark.createDataFrame(rows, PIXELS).createOrReplaceTempView("some_pixels")

    def taller(tooth, points, ill):
        if tooth == "17":
            raise KeyError("no rule")
        return "Mesial", len(points) / 10, {"ill": len(ill)}

    sql.register(spark, {"taller": taller})
    got = spark.sql("SELECT case_id, tooth_id, lesion_idx, size, count(*) AS n FROM lesions(TABLE(SELECT case_id, tooth_id, x, y FROM some_pixels) PARTITION BY (case_id, tooth_id)) GROUP BY ALL").collect()
    assert sorted(map(tuple, got)) == [(1, "16", 0, 6, 6), (1, "16", 1, 1, 1), (1, "17", 0, 1, 1), (2, "16", 0, 1, 1)]
    corners = {(r.case_id, r.tooth_id): [(p.x, p.y) for p in r.h] for r in spark.sql("SELECT case_id, tooth_id, hull(x, y) AS h FROM some_pixels GROUP BY ALL").collect()}
    assert corners[1, "17"] == [(4, 4)] and corners[1, "16"][0] == (0, 0) and set(corners[1, "16"]) == {(0, 0), (2, 0), (9, 9), (0, 1)}
    same = {(r.case_id, r.tooth_id, r.pos): (r.x, r.y) for r in pixels.hull(spark.table("some_pixels").filter("x is not null")).collect()}
    assert same == {(*k, i): p for k, h in corners.items() for i, p in enumerate(h)}
    out = spark.sql("SELECT * FROM taller(TABLE(SELECT *, x > 1 AS decay FROM some_pixels WHERE x IS NOT NULL) PARTITION BY (case_id, tooth_id))").collect()
    assert sorted((r.case_id, r.tooth_id, r.surface, r.angle) for r in out) == [(1, "16", "Mesial", 0.8), (1, "17", "Other", 0.0)]
    assert next(r.details for r in out if r.tooth_id == "17")["error"].startswith("KeyError")
