"""Mixing sources to target weights by Efraimidis-Spirakis sampling, with DataFrame functions only.

Targets: the sources in code point order (null last) weigh 1, 2, 3, repeating, and share the size of the whole corpus;
a target stops at `most_epochs` times its source's size and the excess goes to the others by weight. That is water
filling, solved in closed form over one row for each source.

Sampling: a source takes every document floor(target / size) times (complete epochs). What then remains of the target
is filled in the order of exponential keys -ln(u) / quality weight, u from a hash of the row's id, up to the word at
which the budget is met: the last document enters with the part of its words that is still needed.

Scale: keys fall into buckets that are monotone in the key (1024 for each doubling). Sizes are summed by (source,
bucket) before anything is ordered, running sums over buckets give each bucket its start, and only rows inside one
bucket are sorted together. So a source that holds a third of all rows is spread over thousands of groups.

Edge cases: null texts and texts without words have size 0 and are never taken; a null source is a source of its own;
a source without words has target 0; rows that are equal in every column are interchangeable; very long texts count by their words and are cut like
others; an empty table gives an
empty result; the id, text and source columns are named by parameters and further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, stored, table, text_of, words_of

SYMBOLS = "#*$%&|<>"


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def quality_weight(col: str = "text") -> Column:
    """1 for plain prose, falling to 1/11 as symbols fill the text."""
    t = text_of(col)
    share = (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))) / F.greatest(F.length(t), F.lit(1))
    return F.lit(1.0) / (F.lit(1.0) + F.lit(10.0) * share)


def source_targets(sizes: DataFrame, most_epochs: int = 3) -> DataFrame:
    """From (src, source_size), one row for each source, adds target."""
    by_name, by_fill = Window.orderBy(F.col("src").asc_nulls_last()), Window.orderBy("ratio", "rank")
    everything = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("weight", (F.col("rank") - 1) % 3 + 1).withColumn("cap", F.col("source_size") * most_epochs)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = ranked.withColumn("level", left / open_weight)
    level = level.withColumn("level", F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(everything))
    return level.select("src", "source_size", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, weight: Column | None = None, most_epochs: int = 3, seed: int = 0, carry: bool = False) -> DataFrame:
    """(id_col, src, size, source_size, target, taken) for every row of df; carry adds the whole row as struct `row`."""
    size = word_count(text_col) if size is None else size
    weight = quality_weight(text_col) if weight is None else weight
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)
    row = [F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")] if carry else []
    rows = df.select(F.col(id_col), F.col(source_col).alias("src"), size.alias("size"), (-F.log(u) / weight).alias("key"), *row)
    rows = rows.withColumn("bucket", F.floor(F.log2("key") * 1024).cast("int")).withColumn("no_src", F.col("src").isNull()).withColumn("src_key", F.coalesce("src", F.lit("")))
    rows = rows if carry else stored(rows, "mix")  # ids, sizes and keys only: words are counted once
    group = ["src_key", "no_src", "bucket"]
    slim = rows.drop("row") if carry else rows
    buckets = slim.groupBy(*group).agg(F.sum("size").alias("in_bucket"))
    name = F.when(~F.col("no_src"), F.col("src_key")).alias("src")
    sizes = buckets.groupBy("src_key", "no_src").agg(F.sum("in_bucket").alias("source_size")).select(name, "source_size")
    targets = source_targets(sizes, most_epochs).withColumn("no_src", F.col("src").isNull()).withColumn("src_key", F.coalesce("src", F.lit(""))).drop("src")
    before = Window.partitionBy("src_key", "no_src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select(*group, F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("start")).join(targets, ["src_key", "no_src"])
    inside = Window.partitionBy(*group).orderBy("key", id_col, "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, group)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    budget = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), budget - F.col("start") - F.col("inside")))
    return placed.select(id_col, F.when(~F.col("no_src"), F.col("src_key")).alias("src"), "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), *(["row"] if carry else []))


def mixed(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix itself, in df's columns: every row as often as it is taken whole, and the row that a budget ends in with
    its first words, joined by blanks (length_col, if there, follows). Rows that are not taken go."""
    got = mix(df, text_col=text_col, carry=True, **options)
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    rest = (F.col("taken") - whole * F.col("size")).cast("int")
    times = got.withColumn("whole", whole).withColumn("rest", rest).filter("taken > 0")
    copy = times.select("row", "rest", F.explode(F.expr("sequence(1, whole + if(rest > 0, 1, 0))")).alias("i"), "whole")
    cut = F.col("i") > F.col("whole")
    text = F.when(cut, F.array_join(F.slice(words_of(f"row.{text_col}"), 1, F.greatest(F.col("rest"), F.lit(0))), " ")).otherwise(F.col(f"row.{text_col}"))
    out = copy.withColumn("text_now", text)
    kinds = dict(zip(df.columns, (f.dataType for f in df.schema.fields), strict=True))
    new = {text_col: F.col("text_now")}
    if length_col in df.columns:
        new[length_col] = F.when(cut, F.length("text_now")).otherwise(F.col(f"row.{length_col}")).cast(kinds[length_col])
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    * (1 + 10 * ((length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(length(coalesce(text, '')), 1))) AS key
  FROM documents),
s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
r AS (SELECT *, (row_number() OVER (ORDER BY src NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER f, 0) AS cap_before, coalesce(sum(w) OVER f, 0) AS w_before
  FROM r WINDOW f AS (ORDER BY cap / w, src NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min_by((total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE, ratio) AS level FROM o
  WHERE (total - cap_before)::DOUBLE / (all_w - w_before)::DOUBLE <= ratio),
t AS (SELECT src, source_size, least(cap::DOUBLE, level * w) AS target FROM r, l),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    coalesce(sum(size) OVER (PARTITION BY d.src ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.src IS NOT DISTINCT FROM t.src)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, CAST(round(target - epochs * source_size) AS BIGINT) - before)) AS BIGINT) AS taken
FROM e
"""
