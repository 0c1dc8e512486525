"""Runs, polygons and components against brute force."""

import random

import pytest
from maskframe.operators import pixels, runs
from pyspark.sql import functions as F

POLYGON = "k int, polygon array<struct<x: double, y: double>>"


def inside(p, x, y):
    """Even-odd with the border."""
    odd = False
    for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
        if (y - ay) * (bx - ax) == (x - ax) * (by - ay) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if min(ay, by) <= y < max(ay, by) and ax + (y - ay) * (bx - ax) / (by - ay) > x:
            odd = not odd
    return odd


def points(p):
    xs, ys = [c[0] for c in p], [c[1] for c in p]
    return {(x, y) for x in range(min(xs), max(xs) + 1) for y in range(min(ys), max(ys) + 1) if inside(p, x, y)} if p else set()


@pytest.fixture(scope="module")
def polygons():
    rng = random.Random(4)
    named = [[], [(3, 3)], [(1, 1), (5, 3)], [(0, 0), (4, 0)], [(0, 0), (6, 0), (6, 6), (3, 2), (0, 6)],  # a notch
             [(0, 0), (6, 6), (6, 0), (0, 6)], [(0, 0), (4, 4), (8, 0), (8, 8), (4, 4), (0, 8)],  # crossing itself, touching itself
             [(0, 0), (9, 0), (9, 9), (0, 9), (0, 3), (3, 3), (3, 6), (6, 6), (6, 3), (0, 3)], [(2, 2)] * 4]
    return named + [[(rng.randrange(-6, 12), rng.randrange(-6, 12)) for _ in range(rng.randrange(3, 9))] for _ in range(80)]


def table(spark, polygons):
    return spark.createDataFrame([(k, [(float(x), float(y)) for x, y in p]) for k, p in enumerate(polygons)] + [(1000, None)], POLYGON)


def test_polygons_fill_even_odd(spark, polygons):
    got = {}
    r = runs.filled(table(spark, polygons), ["k"])
    for x in runs.pixels_of(r, ["k"]).collect():
        assert (x.x, x.y) not in got.setdefault(x.k, set())
        got[x.k].add((x.x, x.y))
    assert all(got.get(k, set()) == points(p) for k, p in enumerate(polygons)) and 1000 not in got


def test_corners_are_truncated_and_null_corners_skipped(spark):
    df = spark.createDataFrame([(1, [(-0.9, 0.9), (3.9, 0.1), (None, 2.0), (3.2, 3.7), (0.5, 3.0)])], POLYGON)
    assert {(r.y, r.x1, r.x2) for r in runs.filled(df, ["k"]).collect()} == {(y, 0, 3) for y in range(4)}


def test_outlines_are_closed_lines(spark, polygons):
    got = runs.pixels_of(runs.filled(table(spark, polygons), ["k"], outline=True), ["k"]).collect()
    have = {}
    for r in got:
        have.setdefault(r.k, set()).add((r.x, r.y))
    for k, p in enumerate(polygons):
        if not p:
            continue
        line = set()
        for (ax, ay), (bx, by) in zip(p, p[1:] + p[:1], strict=True):
            n = max(abs(bx - ax), abs(by - ay))
            for i in range(n + 1):  # the longer side moves by one
                x, y = (ax + (bx - ax) * i / n, ay + (by - ay) * i / n) if n else (ax, ay)
                line.add((int((x + 0.5) // 1), int((y + 0.5) // 1)))
        assert have[k] == points(p) | line


def test_shares_equal_pixel_sets(spark, polygons):
    half = len(polygons) // 2
    a, b = polygons[:half], polygons[half : 2 * half]
    got = {r.k: (r.shared, r.total, r.iou) for r in runs.polygon_iou(table(spark, a), table(spark, b), ["k"]).collect()}
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        x, y = points(p), points(q)
        if x | y:
            assert got[k] == (len(x & y), len(x | y), len(x & y) / len(x | y))
        else:
            assert k not in got


def masks(seed, share, size=14, n=5):
    rng = random.Random(seed)
    return [(c, "16", x, y) for c in range(n) for x in range(size) for y in range(size) if rng.random() < share]


@pytest.mark.parametrize("radius2, share", [(2, 0.4), (8, 0.12)])
def test_components_equal_those_of_pixels(spark, radius2, share):
    snake = [(9, "16", x, y) for y in range(0, 20, 2) for x in range(20)] + [(9, "16", 19 if y % 4 == 1 else 0, y) for y in range(1, 20, 2)]
    df = spark.createDataFrame(masks(radius2, share) + snake + [(8, "17", 3, 3)], "case_id int, tooth_id string, x int, y int").repartition(3)
    want = sorted(tuple(r) for r in pixels.labelled(df, radius2).select("case_id", "x", "y", "comp").collect())
    r = runs.components(runs.runs(df), radius2=radius2)
    assert sorted(tuple(x) for x in runs.pixels_of(r, more=("comp",)).select("case_id", "x", "y", "comp").collect()) == want
    sizes = {(r.case_id, r.comp): (r.area, r.cx, r.cy) for r in runs.component_sizes(runs.runs(df), radius2=radius2).collect()}
    for r in pixels.component_sizes(df, radius2=radius2).collect():
        assert sizes[r.case_id, r.comp] == pytest.approx((r.area, r.cx, r.cy))


def test_runs_links_stay_few(spark):
    """A comb: one long run above many short ones makes one link for each, not pairs of all."""
    df = spark.createDataFrame([(1, "16", x, 0) for x in range(101)] + [(1, "16", x, 1) for x in range(0, 101, 2)], "case_id int, tooth_id string, x int, y int")
    r = runs.runs(df.unionByName(df))
    assert r.count() == 52 and runs.links(r, pixels.KEYS).count() == 51
    assert runs.component_sizes(r).select("area").first()[0] == 152


def test_empty_masks(spark):
    none = spark.createDataFrame([], "case_id int, tooth_id string, x int, y int")
    assert runs.component_sizes(runs.runs(none)).count() == 0
    assert runs.filled(table(spark, []).filter("k < 0"), ["k"]).count() == 0
    one = runs.runs(none.unionByName(spark.createDataFrame([(1, "16", 2, 2)], none.schema)))
    assert runs.shares(one, runs.runs(none), pixels.KEYS).select("shared", "total").first() == (0, 1)
    assert runs.area(one).filter(F.col("area") == 1).count() == 1
