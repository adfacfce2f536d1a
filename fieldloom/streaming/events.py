"""Streaming twins of the batch statistics: windowed aggregation with a watermark, upsert by batch. An extension, as the field's tools are batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_stats(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and sum by event type and tumbling window; works on streams and tables."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "mean", "total")


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def upsert_stream(stream: DataFrame, path: str, key: list[str], checkpoint: str) -> StreamingQuery:
    """Keep the newest row of each key in a table, batch by batch."""
    from fieldloom.sources.sinks import append_upsert

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: append_upsert(df.sparkSession, df, path, key)).start()
