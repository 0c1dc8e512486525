"""Operators against DuckDB on the small tables, and against hand-checked cases."""

import duckdb
import pandas as pd
import pytest
from maskframe.operators import matching, metrics, pixels, zones
from maskframe.plans import more  # noqa: F401
from maskframe.plans.registry import ORACLE_SQL, QUERIES
from maskframe.sources.views import view

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_no_blob_lies_on_a_tooth(spark, duck):
    got = pd.DataFrame(QUERIES["geo19_unassigned_blobs"](spark, SF).collect())
    free = duck.execute(ORACLE_SQL["geo15_unassigned_every_tooth"]).df().groupby("case_id").size()
    assert len(got) and (got.groupby(0)[1].sum() <= free).all(), got.head()


def test_every_prediction_takes_part(spark):
    got = QUERIES["jn8_match_labels_interleaved"](spark, SF).toPandas()
    want = view(spark, SF, "v_label_pairs").toPandas()
    count = lambda d, c: d.groupby(["group_id", c]).size().to_dict()
    assert count(got, "y_pred") == count(want, "y_pred_a")


def tooth(spark, points, tooth_id="16", case=1):
    return spark.createDataFrame([(case, tooth_id, x, y) for x, y in points], "case_id int, tooth_id string, x int, y int")


def test_components(spark):
    p = tooth(spark, [(0, 0), (1, 1), (2, 2), (4, 2), (9, 9)])
    eight = {(r.area) for r in pixels.component_sizes(p).collect()}
    assert sorted(r.area for r in pixels.component_sizes(p).collect()) == [1, 1, 3] and eight == {1, 3}
    assert sorted(r.area for r in pixels.component_sizes(p, radius2=4).collect()) == [1, 4]


def test_small_clusters_fall_back_to_raw(spark):
    assert pixels.without_small(tooth(spark, [(0, 0), (1, 0), (2, 0)])).count() == 3
    big = [(x, y) for x in range(5) for y in range(3)]
    assert pixels.without_small(tooth(spark, [*big, (50, 50)])).count() == 15
    fourteen = big[:14]
    assert pixels.without_small(tooth(spark, [*fourteen, (50, 50)])).count() == 15


def test_erosion_keeps_the_inner_square(spark):
    p = tooth(spark, [(x, y) for x in range(7) for y in range(7)])
    assert {(r.x, r.y) for r in pixels.erode(p).collect()} == {(x, y) for x in (2, 3, 4) for y in (2, 3, 4)}


def test_hull(spark):
    p = tooth(spark, [(x, y) for x in range(4) for y in range(4)])
    assert {(r.x, r.y) for r in pixels.hull(p).collect()} == {(0, 0), (3, 0), (0, 3), (3, 3)}


def test_zones_of_an_upright_tooth(spark):
    body = [(x, y) for x in range(10) for y in range(30)]
    for tooth_id, spot, want in (("16", [(9, 10), (9, 11)], "Mesial"), ("16", [(0, 10)], "Distal"), ("26", [(9, 10)], "Distal"), ("46", [(5, 3)], "Occlusal")):
        t = tooth(spark, body, tooth_id)
        r = pixels.relative(t, tooth(spark, spot, tooth_id))
        assert zones.x_thirds(r).first().surface == want


def test_label_matching_modes(spark):
    t = spark.createDataFrame([(1, 0, "Occlusal"), (1, 1, "Mesial")], "g int, pos long, surface string")
    p = spark.createDataFrame([(1, 0, "Mesial")], "g int, pos long, surface string")
    of = lambda d: [r.y_pred for r in d.orderBy("pos").collect()]
    assert of(matching.match_labels_interleaved(t, p, ["g"])) == ["Mesial", "Other"]
    assert of(matching.match_labels(t, p, ["g"])) == ["Other", "Mesial"]


def test_greedy_match(spark):
    schema = "case_id long, id long, tooth_id string, cx double, cy double"
    t = spark.createDataFrame([(1, 1, "16", 0.0, 0.0), (1, 2, "17", 0.0, 0.0), (2, 3, "11", None, None)], schema)
    p = spark.createDataFrame([(1, 1, "16", 90.0, 0.0), (1, 2, "18", 59.9, 0.0), (1, 3, "21", 60.0, 0.0)], schema)
    got = {(r.gt, r.pred, r.match_type) for r in matching.greedy_match(t, p).collect()}
    assert got == {(1, 1, "tooth_id"), (2, 2, "centroid_proximity"), (None, 3, "FP"), (3, None, "FN")}


def test_nearest_of_many_references(spark):
    ref = spark.range(3000, numPartitions=3).selectExpr("cast(id as string) as tooth_id", "cast(id as double) as center_x", "0.0D as center_y")
    points = spark.createDataFrame([(1, 2900.2, 0.0), (2, 3.1, 0.0)], "id long, x double, y double")
    assert {r.id: r.tooth_id for r in matching.nearest_reference(points, ref, ["id"]).collect()} == {1: "2900", 2: "3"}


def test_bootstrap_drops_no_cell(spark):
    d = spark.range(100_001).selectExpr("cast(id as string) as y_true", "'a' as y_pred_a", "'b' as y_pred_b")
    with pytest.raises(ValueError, match="combinations"):
        metrics.bootstrap(d, 1)


#: Published label counts (true, version a, version b, n).
TRIPLES = """D D D 532,D D M 1,D D O 230,D M D 6,D M M 28,D M O 46,D O O 31,D X X 47,M D D 37,M D M 1,M D O 42,M M D 6,M M M 385,M M O 164,
M O O 5,M X X 30,O D D 39,O D O 113,O M M 42,O M O 79,O O M 1,O O O 77,O X X 37"""


def test_published_scores(spark):
    rows = [(*t.split()[:3],) for t in TRIPLES.split(",") for _ in range(int(t.split()[3]))]
    d = spark.createDataFrame(rows, "y_true string, y_pred_a string, y_pred_b string")
    a, b = metrics.macro(d, pred="y_pred_a").first(), metrics.macro(d, pred="y_pred_b").first()
    assert [round(x, 4) for x in a] == [0.7054, 0.5463, 0.4645, 0.4714]
    assert [round(x, 4) for x in b] == [0.6028, 0.5131, 0.4634, 0.4601]
    z = metrics.two_proportions(d).first().z
    assert round(z, 4) == 6.7837 and abs(metrics.two_sided_p(z) - 1.1714e-11) < 1e-14
    s = metrics.bootstrap_summary(metrics.bootstrap(d, 300)).first()
    assert -0.02 < s.ci_low < 0 < s.ci_high < 0.05 and 0.1 < s.p_value < 0.6
