"""Streaming forms of two batch operators; batch and stream give the same rows once a window is closed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def tumbling_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, key, n, total) per window; rows later than ``late`` are left out of closed windows."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start, end, n): activity of a key without a pause of ``gap``."""
    e = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return e.groupBy(key, F.session_window("_t", gap).alias("w")).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def accumulate_edges(edges: DataFrame, keys: list[str], target: str, checkpoint: str) -> object:
    """Start a query that keeps mass and count per key as edge files arrive (M7). Each batch's sums replace the table at ``target``."""
    total = edges.groupBy(*keys).agg(F.sum("p").alias("mass"), F.count("*").alias("n"))

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    return total.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(put).start()
