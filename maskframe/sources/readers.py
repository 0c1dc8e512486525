"""Readers of segmentation, annotation and label files, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

SEGMENTATION = "case_number STRING, num_teeth_detected INT, teeth_data ARRAY<STRUCT<tooth_id: STRING, confidence: DOUBLE, bbox: ARRAY<DOUBLE>, pixel_coordinates: ARRAY<ARRAY<INT>>>>"
ANNOTATION = "Image STRUCT<_Width: INT, _Height: INT>, Annotation ARRAY<STRUCT<_Text: STRING, Coordinate: ARRAY<STRUCT<_X: DOUBLE, _Y: DOUBLE>>>>"


def read_segmentation(spark: SparkSession, path: str, most_bytes: int = 500_000_000) -> DataFrame:
    """(case_id, tooth_id, confidence, x, y) from one JSON document for each case. Larger files are skipped; broken ones give no rows."""
    raw = spark.read.schema(SEGMENTATION + ", _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    ok = raw.filter((F.col("_metadata.file_size") <= most_bytes) & F.col("_corrupt").isNull())
    teeth = ok.select(F.regexp_extract("case_number", r"(\d+)", 1).cast("int").alias("case_id"), F.explode("teeth_data").alias("t")).filter("t.tooth_id is not null and size(t.pixel_coordinates) > 0")
    return teeth.select("case_id", "t.tooth_id", "t.confidence", F.explode("t.pixel_coordinates").alias("p")).select("case_id", "tooth_id", "confidence", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, text, polygon) from XML files with Image/@Width, Annotation/@Text and Coordinate/@X, @Y."""
    raw = spark.read.format("xml").option("rowTag", "Document").schema(ANNOTATION).load(path).withColumn("file", F.col("_metadata.file_path"))
    a = raw.select(S.case_of_file(F.col("file")).alias("case_id"), F.explode("Annotation").alias("a"))
    return a.select("case_id", F.col("a._Text").alias("text"), F.transform("a.Coordinate", lambda c: F.struct(c["_X"].alias("x"), c["_Y"].alias("y"))).alias("polygon")).filter(F.size("polygon") >= 3)


def read_label_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, class_id, cx, cy, w, h) from lines of numbers; further numbers are ignored, short lines skipped."""
    v = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.split(F.trim("value"), r"\s+").alias("v")).filter(F.size("v") >= 5)
    return v.select("file", F.col("v")[0].cast("int").alias("class_id"), *(F.col("v")[i].cast("double").alias(n) for i, n in enumerate(("cx", "cy", "w", "h"), 1)))


def label_line(class_id: str = "class_id", box: tuple[str, ...] = ("cx", "cy", "w", "h")):
    return F.format_string("%d " + " ".join(["%.6f"] * len(box)), F.col(class_id), *map(F.col, box))


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, x, y) of pixels above 0 in grey images, decoded by Spark's image source."""
    import numpy as np
    import pandas as pd

    def lit(batches):
        for b in batches:
            for origin, width, channels, data in zip(b["origin"], b["width"], b["nChannels"], b["data"], strict=True):
                at = np.flatnonzero(np.frombuffer(data, dtype=np.uint8)[::channels])
                yield pd.DataFrame({"path": origin, "x": (at % width).astype("int32"), "y": (at // width).astype("int32")})

    return spark.read.format("image").load(path).select("image.*").mapInPandas(lit, "path string, x int, y int")


def read_with_fallback(new: DataFrame, old: DataFrame, key: str = "case_id") -> DataFrame:
    """Rows of the newer generation; of the older one only cases that the newer one lacks."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def write_cases(df: DataFrame, path: str, key: str = "case_id") -> None:
    """One JSON folder for each case."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


AIM = """typeCode STRUCT<displayName: STRUCT<_value: STRING>>,
imagingPhysicalEntityCollection STRUCT<ImagingPhysicalEntity: ARRAY<STRUCT<imagingPhysicalEntityCharacteristicCollection: STRUCT<ImagingPhysicalEntityCharacteristic: ARRAY<STRUCT<questionIndex: STRUCT<_value: STRING>, typeCode: STRUCT<_code: STRING, displayName: STRUCT<_value: STRING>>>>>>>>,
calculationEntityCollection STRUCT<CalculationEntity: ARRAY<STRUCT<description: STRUCT<_value: STRING>, calculationResultCollection: STRUCT<CalculationResult: ARRAY<STRUCT<calculationDataCollection: STRUCT<CalculationData: ARRAY<STRUCT<value: STRUCT<_value: STRING>>>>>>>>>>,
markupEntityCollection STRUCT<MarkupEntity: ARRAY<STRUCT<twoDimensionSpatialCoordinateCollection: STRUCT<TwoDimensionSpatialCoordinate: ARRAY<STRUCT<coordinateIndex: STRUCT<_value: INT>, x: STRUCT<_value: DOUBLE>, y: STRUCT<_value: DOUBLE>>>>>>>"""


def read_aim(spark: SparkSession, path: str) -> DataFrame:
    """One row for each namespaced annotation: case_id, code and name of the tooth and the surface, type, area, mean, sd,
    polygon in the order of its indices, its centroid."""
    raw = spark.read.format("xml").option("rowTag", "ImageAnnotation").option("ignoreNamespace", True).schema(AIM).load(path).withColumn("file", F.col("_metadata.file_path"))
    entity = F.get("imagingPhysicalEntityCollection.ImagingPhysicalEntity", F.lit(0))["imagingPhysicalEntityCharacteristicCollection"]["ImagingPhysicalEntityCharacteristic"]
    asked = lambda q: F.get(F.filter(entity, lambda e: e["questionIndex"]["_value"] == q), F.lit(0))["typeCode"]
    calc = F.col("calculationEntityCollection.CalculationEntity")

    def measure(name: str):
        found = F.get(F.filter(calc, lambda e: e["description"]["_value"] == name), F.lit(0))
        value = F.get(F.get(found["calculationResultCollection"]["CalculationResult"], F.lit(0))["calculationDataCollection"]["CalculationData"], F.lit(0))["value"]["_value"]
        return F.coalesce(value.try_cast("double"), F.lit(0.0))

    points = F.get("markupEntityCollection.MarkupEntity", F.lit(0))["twoDimensionSpatialCoordinateCollection"]["TwoDimensionSpatialCoordinate"]
    polygon = F.array_sort(F.transform(points, lambda c: F.struct(c["coordinateIndex"]["_value"].alias("idx"), c["x"]["_value"].alias("x"), c["y"]["_value"].alias("y"))))
    mean = lambda c: F.aggregate("polygon", F.lit(0.0), lambda a, p: a + p[c]) / F.size("polygon")
    out = raw.select(S.case_of_file(F.col("file")).alias("case_id"), asked("0")["_code"].alias("tooth_code"), asked("0")["displayName"]["_value"].alias("tooth_name"), asked("1")["_code"].alias("surface_code"), asked("1")["displayName"]["_value"].alias("surface_name"),
        F.col("typeCode.displayName._value").alias("caries_type"), measure("Area").alias("area_mm"), measure("Mean").alias("mean_intensity"), measure("Standard Deviation").alias("std_intensity"), F.coalesce(polygon, F.array().cast("array<struct<idx:int,x:double,y:double>>")).alias("polygon"))
    return out.withColumn("cx", F.when(F.size("polygon") > 0, mean("x")).otherwise(0.0)).withColumn("cy", F.when(F.size("polygon") > 0, mean("y")).otherwise(0.0))


def scraped(df: DataFrame, text: str, name: str, surface: str, x: str, y: str) -> DataFrame:
    """df with tooth_name, surface and polygon taken from raw text by patterns, each with one group."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(x), F.lit(1)).alias("x"), F.regexp_extract_all(text, F.lit(y), F.lit(1)).alias("y"))
    return df.select("*", F.regexp_extract(text, name, 1).alias("tooth_name"), F.regexp_extract(text, surface, 1).alias("surface"), F.transform(found, lambda p: F.struct(p["x"].try_cast("double").alias("x"), p["y"].try_cast("double").alias("y"))).alias("polygon"))


def read_scraped(spark: SparkSession, path: str, **patterns: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(S.case_of_file(F.col("_metadata.file_path")).alias("case_id"), "value")
    return scraped(raw, "value", **patterns).drop("value")


SHAPES = "ARRAY<STRUCT<label: STRING, category: STRING, class_name: STRING, points: ARRAY<ARRAY<DOUBLE>>, bbox: ARRAY<DOUBLE>>>"


def read_json_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, label, x1, y1, x2, y2) from JSON files of several dialects: shapes or annotations; label, category or class_name;
    points (two corners or a polygon) or bbox (x, y, width, height)."""
    raw = spark.read.schema(f"shapes {SHAPES}, annotations {SHAPES}").json(path, multiLine=True)
    a = raw.select(S.case_of_file(F.col("_metadata.file_path")).alias("case_id"), F.explode(F.coalesce("shapes", "annotations")).alias("a"))
    at = lambda i: F.transform("a.points", lambda p: p[i])
    box = lambda i: F.get("a.bbox", F.lit(i))
    has = F.size("a.points") > 0
    return a.select("case_id", F.coalesce("a.label", "a.category", "a.class_name").alias("label"), F.when(has, F.array_min(at(0))).otherwise(box(0)).alias("x1"), F.when(has, F.array_min(at(1))).otherwise(box(1)).alias("y1"),
        F.when(has, F.array_max(at(0))).otherwise(box(0) + box(2)).alias("x2"), F.when(has, F.array_max(at(1))).otherwise(box(1) + box(3)).alias("y2")).filter("x1 is not null and y1 is not null and x2 is not null and y2 is not null")


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def discovered_cases(files: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")) -> DataFrame:
    """(case_id, path): of each case folder in files (path) the first image in the order of extensions."""
    ext = F.array_position(F.array(*map(F.lit, extensions)), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)))
    f = files.select(S.case_of_file(F.col("path")).alias("case_id"), "path", ext.alias("rank")).filter("case_id is not null and rank > 0")
    return f.groupBy("case_id").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def write_table(df: DataFrame, path: str) -> None:
    """CSV with a header, without nested columns."""
    flat = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("array", "struct", "map"))]
    df.select(*flat).write.mode("overwrite").csv(path, header=True)


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON object from a table of one row."""
    df.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_labels(df: DataFrame, path: str) -> None:
    """Label lines (class_id, cx, cy, w, h) in one folder for each value of split."""
    df.select("split", label_line().alias("value")).write.mode("overwrite").partitionBy("split").text(path)


def write_manifest(selections: DataFrame, path: str) -> None:
    """Selections in one JSON folder for each category, and their numbers: by category and total_images, in the folder total."""
    selections.write.mode("overwrite").partitionBy("category").json(f"{path}/selections")
    n = selections.groupBy(F.coalesce("category", F.lit("")).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    write_summary(n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_images"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "n")))).alias("images")), f"{path}/total")
