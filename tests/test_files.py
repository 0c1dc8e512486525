"""Readers, writers, streaming and the forest on small files and tables."""

import json

import numpy as np
import pytest
from maskframe.functions import scalars as S
from maskframe.operators import learning, matching, pixels, selection
from maskframe.sources import readers
from maskframe.streaming import incremental
from pyspark.sql import functions as F


@pytest.mark.parametrize("path, want", [("/d/case 20/a.png", 20), ("/d/case%20207/x.xml", 207), ("case_7.json", 7), ("/d/case2/x", 2), ("/d/other/x", None)])
def test_case_of_file(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(S.case_of_file(F.col("p"))).first()[0] == want


def test_segmentation_files(spark, tmp_path):
    teeth = [{"tooth_id": "16", "confidence": 0.9, "bbox": [0, 0, 1, 1], "pixel_coordinates": [[1, 2], [3, 4]]}, {"tooth_id": None, "pixel_coordinates": [[1, 1]]}, {"tooth_id": "17", "pixel_coordinates": []}]
    (tmp_path / "a.json").write_text(json.dumps({"case_number": "case 12", "teeth_data": teeth}))
    (tmp_path / "b.json").write_text("{broken")
    got = readers.read_segmentation(spark, str(tmp_path)).collect()
    assert sorted((r.case_id, r.tooth_id, r.x, r.y) for r in got) == [(12, "16", 1, 2), (12, "16", 3, 4)]
    assert readers.read_segmentation(spark, str(tmp_path), most_bytes=10).count() == 0


def test_aim_file(spark, tmp_path):
    def point(i, x, y):
        return f'<TwoDimensionSpatialCoordinate><coordinateIndex value="{i}"/><x value="{x}"/><y value="{y}"/></TwoDimensionSpatialCoordinate>'

    def asked(q, code, name):
        return f'<ImagingPhysicalEntityCharacteristic><questionIndex value="{q}"/><typeCode code="{code}"><iso:displayName xmlns:iso="u:iso" value="{name}"/></typeCode></ImagingPhysicalEntityCharacteristic>'

    d = tmp_path / "case 33"
    d.mkdir()
    (d / "a.xml").write_text(f"""<?xml version="1.0"?><ImageAnnotationCollection xmlns="u:aim"><imageAnnotations><ImageAnnotation><typeCode code="1"><iso:displayName xmlns:iso="u:iso" value="Caries"/></typeCode>
<imagingPhysicalEntityCollection><ImagingPhysicalEntity><imagingPhysicalEntityCharacteristicCollection>{asked(0, "161286D", "Permanent upper right first premolar tooth")}{asked(1, "145374D", "Mesial Surface")}</imagingPhysicalEntityCharacteristicCollection></ImagingPhysicalEntity></imagingPhysicalEntityCollection>
<calculationEntityCollection><CalculationEntity><description value="Area"/><calculationResultCollection><CalculationResult><calculationDataCollection><CalculationData><value value="2.5"/></CalculationData></calculationDataCollection></CalculationResult></calculationResultCollection></CalculationEntity></calculationEntityCollection>
<markupEntityCollection><MarkupEntity><twoDimensionSpatialCoordinateCollection>{point(1, 3, 4)}{point(0, 1, 2)}</twoDimensionSpatialCoordinateCollection></MarkupEntity></markupEntityCollection></ImageAnnotation></imageAnnotations></ImageAnnotationCollection>""")
    r = readers.read_aim(spark, str(d)).first()
    assert (r.case_id, r.tooth_code, r.surface_name, r.caries_type, r.area_mm, r.mean_intensity) == (33, "161286D", "Mesial Surface", "Caries", 2.5, 0.0)
    assert [(p.x, p.y) for p in r.polygon] == [(1.0, 2.0), (3.0, 4.0)] and (r.cx, r.cy) == (2.0, 3.0)


def test_attribute_xml_and_scraped(spark, tmp_path):
    d = tmp_path / "case 20"
    d.mkdir()
    (d / "a.xml").write_text('<Document><Image Width="10" Height="10"/><Annotation Text="tooth 36"><Coordinate X="1" Y="2"/><Coordinate X="3" Y="4"/><Coordinate X="5" Y="6"/></Annotation></Document>')
    r = readers.read_annotations(spark, str(d)).first()
    assert (r.case_id, r.text, len(r.polygon)) == (20, "tooth 36", 3)
    s = readers.read_scraped(spark, str(d), name='Text="([^"]*)"', surface="(none)", x='X="([^"]*)"', y='Y="([^"]*)"').first()
    assert (s.case_id, s.tooth_name, [(p.x, p.y) for p in s.polygon]) == (20, "tooth 36", [(1.0, 2.0), (3.0, 4.0), (5.0, 6.0)])


def test_json_annotation_dialects(spark, tmp_path):
    (tmp_path / "case 1.json").write_text(json.dumps({"shapes": [{"label": "a", "points": [[5, 6], [1, 2]]}]}))
    (tmp_path / "case 2.json").write_text(json.dumps({"annotations": [{"category": "b", "bbox": [1, 2, 3, 4]}, {"class_name": "c"}]}))
    got = sorted(tuple(r) for r in readers.read_json_annotations(spark, str(tmp_path)).collect())
    assert got == [(1, "a", 1.0, 2.0, 5.0, 6.0), (2, "b", 1.0, 2.0, 4.0, 6.0)]


def test_label_lines_and_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("train", 1, 0.5, 0.25, 0.1, 0.2), ("val", 0, 0.1, 0.2, 0.3, 0.4)], "split string, class_id int, cx double, cy double, w double, h double")
    readers.write_labels(rows, str(tmp_path / "l"))
    assert [(r.class_id, r.cy) for r in readers.read_label_lines(spark, str(tmp_path / "l/split=train")).collect()] == [(1, 0.25)]
    readers.write_table(rows.withColumn("a", F.array("cx")), str(tmp_path / "t"))
    assert readers.read_table(spark, str(tmp_path / "t"), rows.drop("a").schema.simpleString()[7:-1].replace(":", " ")).count() == 2
    readers.write_summary(rows.agg(F.count(F.lit(1)).alias("n")), str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).first().n == 2
    readers.write_manifest(rows.withColumnRenamed("split", "category"), str(tmp_path / "m"))
    readers.write_cases(rows.withColumnRenamed("class_id", "case_id"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "m/selections")).count() == spark.read.json(str(tmp_path / "c")).count() == 2


def test_masks(spark, tmp_path):
    import struct
    import zlib

    def png(a):
        chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
        raw = b"".join(b"\0" + bytes(r.tolist()) for r in a)
        return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")

    a = np.zeros((60, 90), dtype=np.uint8)
    a[3, 80], a[59, 0] = 255, 7
    (tmp_path / "m.png").write_bytes(png(a))
    assert sorted((r.x, r.y) for r in readers.read_masks(spark, str(tmp_path)).collect()) == [(0, 59), (80, 3)]


def test_cases_and_fallback(spark):
    files = spark.createDataFrame([("/d/case 2/b.png",), ("/d/case 2/a.jpg",), ("/d/case 10/a.bmp",), ("/d/x.png",), ("/d/case 3/a.txt",)], "path string")
    assert sorted(tuple(r) for r in readers.discovered_cases(files).collect()) == [(2, "/d/case 2/a.jpg"), (10, "/d/case 10/a.bmp")]
    new, old = spark.createDataFrame([(1, "n")], "case_id int, v string"), spark.createDataFrame([(1, "o"), (2, "o")], "case_id int, v string")
    assert sorted(tuple(r) for r in readers.read_with_fallback(new, old).collect()) == [(1, "n"), (2, "o")]


def test_new_files_run_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: incremental.run_new_files(spark, str(tmp_path / "in"), "a int", lambda d: d.withColumn("b", F.col("a") + 1), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    (tmp_path / "in/1.json").write_text('{"a": 1}')
    run()
    (tmp_path / "in/2.json").write_text('{"a": 5}')
    run()
    run()
    assert sorted(r.b for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [2, 6]


def test_erosion_at_the_border(spark):
    p = spark.createDataFrame([(1, "16", x, y) for x in range(5) for y in range(5)], "case_id int, tooth_id string, x int, y int")
    assert {(r.x, r.y) for r in pixels.erode(p, size=(5, 5)).collect()} == {(x, y) for x in range(5) for y in range(5)}
    assert {(r.x, r.y) for r in pixels.erode(p, size=(9, 9)).collect()} == {(x, y) for x in range(3) for y in range(3)}


def test_labels_go_to_lesions_in_order(spark):
    l = spark.createDataFrame([(1, 0, "Distal"), (1, 1, "Mesial"), (1, 2, "Mesial")], "g int, pos long, surface string")
    t = spark.createDataFrame([(1, 0, "Mesial"), (1, 1, "Occlusal")], "g int, pos long, surface string")
    assert [(r.pos, r.label) for r in matching.assign_labels(l, t, ["g"]).orderBy("pos").collect()] == [(0, "Mesial"), (1, "Occlusal")]


def test_forest(spark, tmp_path):
    d = spark.range(600).select("id", (F.col("id") % 60).alias("g"), ((F.col("id") * 7919) % 100 / 100).alias("a"), ((F.col("id") * 31) % 17 / 17).alias("b"))
    d = d.withColumn("label", F.when(F.col("a") > 0.6, "Mesial").otherwise("Distal"))
    m = learning.train_forest(d, ["a", "b"], trees=10)
    learning.save(m, str(tmp_path / "m"))
    back = learning.load(str(tmp_path / "m"))
    s = learning.scored(back, d)
    assert s.filter("label = y_pred").count() > 590 and len(s.first().proba) == 2
    assert learning.importances(m, ["a", "b"])[0][0] == "a"
    imp = {r.feature: r["mean"] for r in learning.permutation_importance(m, d, ["a", "b"], "id", repeats=2).collect()}
    assert imp["a"] > 0.3 > abs(imp["b"])
    p = learning.permuted(d, "a", "id", 1)
    assert sorted(r.a for r in p.collect()) == sorted(r.a for r in d.collect())
    folds = learning.cross_validated(d, ["a", "b"], "g", folds=2, trees=5).collect()
    assert len(folds) == 2 and all(r.accuracy > 0.95 for r in folds)
    half = d.withColumn("a", F.when(F.col("id") >= 300, F.col("a"))).withColumn("zone", F.lit("Other"))
    got = learning.predict_with_fallback(m, half, "zone", ["a", "b"])
    assert got.filter("not by_model and predicted = 'Other'").count() == 300 and learning.predict_with_fallback(None, half, "zone", []).filter("by_model").count() == 0


def test_three_splits_keep_groups(spark):
    d = spark.range(1000).select("id", (F.col("id") % 100).alias("g"))
    s = selection.with_splits(d, "g", {"train": 7, "val": 2, "test": 1})
    assert {r.split: r.n for r in s.groupBy("split").agg(F.countDistinct("g").alias("n")).collect()} == {"train": 70, "val": 20, "test": 10}
