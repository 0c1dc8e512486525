"""Scans that also say what they left out, label lists that belong together line by line, and generations of results."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .readers import SEGMENTATION
from .shared import settled, shared_folder

REJECTED = "file string, bytes long, reason string"


def scan_cases(spark: SparkSession, path: str, schema: str, checks: dict[str, Column], most_bytes: int = 500_000_000) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """One JSON document for each case in path: (accepted documents with file and bytes, rejected files, counters).

    Files above most_bytes are listed, not opened. All others are parsed once; the documents are written to the shared folder,
    apart by outcome, and the counters are observed by that very write. Reasons: "too large", "malformed", or the name of
    the first of checks (conditions on a document) that does not hold. Counters: read, accepted, one for each reason.
    """
    names = ["malformed", *checks]
    sized = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes")).filter(F.col("bytes") > most_bytes)
    raw = spark.read.schema(f"{schema}, _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes")).filter(F.col("bytes") <= most_bytes)
    reason = F.when(F.col("_corrupt").isNotNull(), "malformed")
    for name, holds in checks.items():
        reason = reason.when(~F.coalesce(holds, F.lit(False)), name)
    counted = Observation("scan")
    tagged = raw.withColumn("reason", F.coalesce(reason, F.lit("accepted"))).drop("_corrupt")
    tagged = tagged.observe(counted, F.count(F.lit(1)).alias("read"), F.count_if(F.col("reason") == "accepted").alias("accepted"), *(F.count_if(F.col("reason") == n).alias(n) for n in names))
    out = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    tagged.write.partitionBy("reason").parquet(out)
    back = spark.read.schema(tagged.schema).parquet(out)
    rejected = sized.withColumn("reason", F.lit("too large")).unionByName(back.filter("reason <> 'accepted'").select("file", "bytes", "reason"))
    return back.filter("reason = 'accepted'").drop("reason"), rejected, counted.get


def scan_segmentation(spark: SparkSession, path: str, most_bytes: int = 500_000_000) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(pixels as of readers.read_segmentation(), rejected files, counters). Documents need a case number and teeth."""
    case = F.regexp_extract("case_number", r"(\d+)", 1)
    docs, rejected, counters = scan_cases(spark, path, SEGMENTATION, {"no case": case != "", "no teeth": F.size("teeth_data") > 0}, most_bytes)
    teeth = docs.select(case.cast("int").alias("case_id"), F.explode("teeth_data").alias("t")).filter("t.tooth_id is not null and size(t.pixel_coordinates) > 0")
    pixels = teeth.select("case_id", "t.tooth_id", "t.confidence", F.explode("t.pixel_coordinates").alias("p")).select("case_id", "tooth_id", "confidence", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    return pixels, rejected, counters


# lists


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of a text file, or of a folder's files in the order of their names, without blanks around them;
    blank lines are skipped, the others numbered from 0.

    A file may be read in splits. Their lines are written once with numbers that ascend within a split, without gaps, so a line's
    place is its distance from its split's first line, after the counts of the splits before; no task holds a split.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", r"(?U)^\s+|\s+$", "").alias("value"))
    lines = settled(raw.filter("value <> ''").withColumn("at", F.monotonically_increasing_id()))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(splits.select("file", "block", (before - F.col("first")).alias("shift")))
    return lines.join(starts, ["file", "block"]).select((F.col("at") + F.col("shift")).alias("pos"), "value")


def aligned(lists: dict[str, DataFrame]) -> DataFrame:
    """(pos, one column for each list), by position. Lists of different lengths fail when the rows are read."""
    out = None
    for name, rows in lists.items():
        one = rows.select("pos", F.col("value").alias(name))
        out = one if out is None else out.join(one, "pos", "full")
    whole = F.lit(True)
    for name in lists:
        whole = whole & F.col(name).isNotNull()
    checked = lambda name: F.when(whole, F.col(name)).otherwise(F.raise_error(F.lit("lists of different lengths: " + ", ".join(lists)))).alias(name)
    return out.select("pos", *map(checked, lists))


def read_aligned(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    return aligned({name: read_list(spark, path) for name, path in paths.items()})


# generations


OVERLAPS = "case_number INT, teeth_caries_data ARRAY<STRUCT<tooth_id: STRING, confidence: DOUBLE, total_pixels: INT, caries_pixels: INT, caries_percentage: DOUBLE, has_caries: BOOLEAN, caries_coordinates: ARRAY<ARRAY<INT>>>>, unassigned_caries ARRAY<STRUCT<tooth_id: STRING, caries_pixels: INT, unassigned_centroid: ARRAY<DOUBLE>>>"


def latest_generation(generations: list[DataFrame], key: str = "case_number") -> DataFrame:
    """Documents by case: of several generations (newest first) the first that has the case, even if it found nothing there."""
    ranked = None
    for k, g in enumerate(generations):
        one = g.withColumn("__generation", F.lit(k))
        ranked = one if ranked is None else ranked.unionByName(one, allowMissingColumns=True)
    best = F.min("__generation").over(Window.partitionBy(key))
    return ranked.withColumn("__best", best).filter("__generation = __best").drop("__generation", "__best")


def overlap_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(teeth, blobs) of overlap documents. Entries without a tooth, or named UNASSIGNED as older generations write them, are no
    teeth; of repeated teeth the last entry stays."""
    entries = documents.select(F.col("case_number").alias("case_id"), F.posexplode("teeth_caries_data").alias("pos", "t")).select("case_id", "pos", "t.*")
    named = entries.filter(F.coalesce(F.col("tooth_id"), F.lit("")).isin("", "UNASSIGNED") == F.lit(False))
    last = F.max("pos").over(Window.partitionBy("case_id", "tooth_id"))
    teeth = named.withColumn("__last", last).filter("pos = __last").drop("pos", "__last")
    blobs = documents.select(F.col("case_number").alias("case_id"), F.explode("unassigned_caries").alias("b"))
    return teeth, blobs.select("case_id", F.col("b.caries_pixels").alias("area"), F.col("b.unassigned_centroid")[0].alias("cx"), F.col("b.unassigned_centroid")[1].alias("cy"))
