"""Incremental runs: new case files as a stream, each batch through an ordinary batch operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def run_new_files(spark: SparkSession, path: str, schema: str, operator: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies operator to every file that arrives in path and appends the result to out as Parquet. Files done before are in the checkpoint.
    A batch that is repeated after a failure writes its own folder again."""

    def batch(df: DataFrame, epoch: int) -> None:
        operator(df).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return spark.readStream.schema(schema).json(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_into(out: str) -> Callable[[DataFrame, int], None]:
    """A sink for update mode: each batch's changed rows replace the folder of that batch, so a repeated batch changes nothing."""

    def batch(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return batch


def run_counters(rows: DataFrame, keys: list[str], counters: list[Column], out: str, checkpoint: str) -> StreamingQuery:
    """Running counters of a stream: what has arrived since the last run is added to the state in the checkpoint, and the keys
    whose counters changed go to out. counters are aggregates, such as F.count(...).alias("teeth").

    The state store holds one row for each key and its version; a batch that failed is repeated with the same input and the same number,
    and so writes the same folder: counters() sees each input once.
    """
    totals = rows.groupBy(*keys).agg(*counters)
    return totals.writeStream.outputMode("update").foreachBatch(upsert_into(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    """The table of counters: of each key the row of its last batch."""
    kept = spark.read.parquet(out)
    values = [c for c in kept.columns if c not in (*keys, "batch")]
    last = kept.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*")


def case_rows(documents: DataFrame) -> DataFrame:
    """Overlap documents (case_number, teeth_caries_data) of a stream or table as one row of counts for each case."""
    teeth = F.col("teeth_caries_data")
    ill = F.size(F.filter(teeth, lambda t: F.coalesce(t["has_caries"], F.lit(False))))
    done = F.size(teeth) > 0
    return documents.select(done.cast("long").alias("processed"), F.greatest(F.size(teeth), F.lit(0)).cast("long").alias("teeth"), F.greatest(ill, F.lit(0)).cast("long").alias("with_caries"))


def run_totals() -> list[Column]:
    """Counters of case_rows()."""
    return [F.count(F.lit(1)).alias("cases"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("processed", "teeth", "with_caries"))]
