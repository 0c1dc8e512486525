"""Rejected files, aligned lists, generations, manifests and running counters."""

import json

import pytest
from maskframe.sources import readers, scans
from maskframe.streaming import incremental
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def tooth(name, *points):
    return {"tooth_id": name, "confidence": 0.5, "bbox": [], "pixel_coordinates": [list(p) for p in points]}


def test_rejected_files_are_listed_with_reasons(spark, tmp_path):
    docs = {"good": {"case_number": "case 4", "teeth_data": [tooth("16", (1, 2), (3, 4)), tooth(None, (1, 1)), tooth("17")]}, "no_case": {"case_number": "none", "teeth_data": [tooth("16", (1, 1))]}, "no_teeth": {"case_number": "case 5", "teeth_data": []}, "null_teeth": {"case_number": "case 6"}}
    for name, d in docs.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(d, indent=1))
    (tmp_path / "broken.json").write_text('{"case_number": "case 7", ')
    (tmp_path / "huge.json").write_text(json.dumps({"case_number": "case 8", "teeth_data": [tooth("16", *[(i, i) for i in range(500)])]}))
    pixels, rejected, counters = scans.scan_segmentation(spark, str(tmp_path), most_bytes=3000)
    assert sorted((r.case_id, r.tooth_id, r.x, r.y) for r in pixels.collect()) == [(4, "16", 1, 2), (4, "16", 3, 4)]
    got = {r.file.rsplit("/", 1)[-1]: (r.reason, r.bytes > 0) for r in rejected.collect()}
    assert got == {"broken.json": ("malformed", True), "no_case.json": ("no case", True), "no_teeth.json": ("no teeth", True), "null_teeth.json": ("no teeth", True), "huge.json": ("too large", True)}
    assert counters == {"read": 5, "accepted": 1, "malformed": 1, "no case": 1, "no teeth": 2}


def test_nothing_rejected(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"case_number": "1", "teeth_data": [tooth("16", (0, 0))]}))
    pixels, rejected, counters = scans.scan_segmentation(spark, str(tmp_path))
    assert pixels.count() == 1 and rejected.count() == 0 and counters["accepted"] == counters["read"] == 1


def test_lists_are_numbered_across_splits(spark, tmp_path):
    values = [f"label {i}" for i in range(3000)]
    (tmp_path / "a.txt").write_text("\n \n" + "\n".join(f" {v}\t\r" if i % 5 else f"{v}\n\n" for i, v in enumerate(values)) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
        rows = scans.read_list(spark, str(tmp_path / "a.txt"))
        assert spark.read.text(str(tmp_path / "a.txt")).rdd.getNumPartitions() > 4
        assert [r.value for r in rows.orderBy("pos").collect()] == values and {r.pos for r in rows.collect()} == set(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_folders_are_one_list(spark, tmp_path):
    d = spark.range(100).repartitionByRange(4, "id").sortWithinPartitions("id").select(F.col("id").cast("string").alias("value"))
    d.write.text(str(tmp_path / "l"))
    assert [r.value for r in scans.read_list(spark, str(tmp_path / "l")).orderBy("pos").collect()] == [str(i) for i in range(100)]


def test_lists_must_have_one_length(spark, tmp_path):
    for name, text in (("a", "x\n\ny\nz\n"), ("b", "\n1\n 2 \n3"), ("c", "1\n2\n")):
        (tmp_path / name).write_text(text)
    rows = scans.read_aligned(spark, {"t": str(tmp_path / "a"), "p": str(tmp_path / "b")})
    assert [tuple(r) for r in rows.orderBy("pos").collect()] == [(0, "x", "1"), (1, "y", "2"), (2, "z", "3")]
    for wrong in ({"t": "a", "p": "c"}, {"p": "c", "t": "a"}):
        with pytest.raises(PySparkException, match="different lengths"):
            scans.read_aligned(spark, {k: str(tmp_path / v) for k, v in wrong.items()}).collect()


def test_generations(spark):
    schema = scans.OVERLAPS
    entry = lambda name, n=1: (name, 0.5, 10, n, 1.0, n > 0, [])
    new = spark.createDataFrame([(1, [entry("16"), entry("16", 7), entry("UNASSIGNED")], [("UNASSIGNED", 200, [1.0, 2.0])]), (2, [], None)], schema)
    old = spark.createDataFrame([(1, [entry("11")], None), (2, [entry("21")], None), (3, [entry("31"), entry(""), entry(None), entry("UNASSIGNED", 9)], None)], schema)
    teeth, blobs = scans.overlap_tables(scans.latest_generation([new, old]))
    assert sorted((r.case_id, r.tooth_id, r.caries_pixels) for r in teeth.collect()) == [(1, "16", 7), (3, "31", 1)]
    assert [tuple(r) for r in blobs.collect()] == [(1, 200, 1.0, 2.0)]


def test_manifest_has_its_total(spark, tmp_path):
    readers.write_manifest(spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "category string, case_id int"), str(tmp_path / "m"))
    r = spark.read.json(str(tmp_path / "m/total")).first()
    assert (r.total_images, r.images.a, r.images.b) == (3, 2, 1) and spark.read.json(str(tmp_path / "m/selections")).count() == 3
    readers.write_manifest(spark.createDataFrame([], "category string, case_id int"), str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n/total")).first().total_images == 0


def test_running_counters(spark, tmp_path):
    """Two runs, and a batch that is written again: totals equal those of one batch over all files."""
    (tmp_path / "in").mkdir()
    put = lambda name, *cases: (tmp_path / f"in/{name}.json").write_text("\n".join(json.dumps({"case_number": c, "teeth_caries_data": [{"tooth_id": str(i), "has_caries": i % 2 == 0} for i in range(n)]}) for c, n in cases))
    out, schema = str(tmp_path / "out"), "case_number int, teeth_caries_data array<struct<tooth_id: string, has_caries: boolean>>"

    def rows(d):
        return incremental.case_rows(d).withColumn("run", F.lit("r"))

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        incremental.run_counters(rows(stream), ["run"], incremental.run_totals(), out, str(tmp_path / "cp")).awaitTermination()

    put("1", (1, 3), (2, 0))
    put("2", (3, 4))
    run()
    first = incremental.counters(spark, out, ["run"]).first()
    assert (first.cases, first.processed, first.teeth, first.with_caries) == (3, 2, 7, 4)
    put("3", (4, 1), (5, 5))
    run()
    run()
    want = rows(spark.read.schema(schema).json(str(tmp_path / "in"))).groupBy("run").agg(*incremental.run_totals()).first()
    assert incremental.counters(spark, out, ["run"]).select(*want.asDict()).first() == want
    last = spark.read.parquet(out).agg(F.max("batch")).first()[0]
    again = spark.createDataFrame([tuple(want)], "run string, cases long, processed long, teeth long, with_caries long")
    incremental.upsert_into(out)(again, last)
    assert incremental.counters(spark, out, ["run"]).select(*want.asDict()).first() == want
