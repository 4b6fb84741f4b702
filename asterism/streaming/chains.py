"""Follow a sampler's chain while it is being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def follow_chain(spark: SparkSession, path: str, schema: str = "walker long, step int, theta0 double, log_prob double, ts timestamp") -> DataFrame:
    """A stream of the steps that are appended to a Parquet chain."""
    return spark.readStream.schema(schema).parquet(path)


def progress(chain: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """``start, n, mean, best`` for each window of writing time; steps later than ``late`` are left out, repeated ones count once."""
    once = chain.withWatermark("ts", late).dropDuplicatesWithinWatermark(["walker", "step"])
    found = once.groupBy(F.window("ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg("theta0").alias("mean"), F.max("log_prob").alias("best"))
    return found.select(F.col("w.start").alias("start"), "n", "mean", "best")


def write_progress(summary: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows to a Parquet table, then stop; a restart goes on from ``checkpoint``."""
    return summary.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
