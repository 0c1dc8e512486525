"""What the corpus operators share: word pattern, table access, shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than blank, tab, and the line breaks up to \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, a null one as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def words_of(col: str = "text") -> Column:
    return F.regexp_extract_all(text_of(col), F.lit(WORD), F.lit(0))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a local session gets a temporary one (tests); a
    cluster has none that all its machines see, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read back: later steps reread it instead of recomputing,
    and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: At most so many rows of ids and numbers are broadcast; more meet the texts by a shuffle.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= rows else df
