"""Streams over landing folders. Beyond batch parity: the same operators, fed by Structured Streaming.

State is bounded by watermarks where a delay is given; without one it grows with the keys, no row is late, and the
result is the batch's, however many files there are. Checkpoints and outputs lie in folders that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import orders


def table_stream(spark: SparkSession, sf_dir: str, name: str, per_trigger: int = 64) -> DataFrame:
    """A stream of a table's files, with the schema that its files have now."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}*")


def first_orders(extractions: DataFrame, delay: str | None = "30 days") -> DataFrame:
    """Orders of a stream (order columns, extracted_at), equal ones within the watermark once; without a delay, once ever."""
    t = extractions.withColumn("at", F.col("extracted_at").cast("timestamp"))
    keys = [f"i_{c}" for c in orders.OUTPUT]
    if delay is not None:
        t = t.withWatermark("at", delay)
    out = orders.output_identity(orders.output_form(t.select("order_id", "at", *orders.OUTPUT)))
    out = out.dropDuplicates(keys) if delay is None else out.dropDuplicatesWithinWatermark(keys)
    return out.select("order_id", "at", *orders.OUTPUT)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", delay: str | None = "1 day") -> DataFrame:
    """Rows per key and tumbling window; a window is put out when the watermark has passed it.

    Without a delay every window stays open: drain it with `drain_whole`.
    """
    e = events.withColumn("_t", F.col(time).cast("timestamp"))
    if delay is not None:
        e = e.withWatermark("_t", delay)
    return e.groupBy(F.window("_t", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def drain(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Everything that has arrived, appended to a folder of parquet files; ends when it is done."""
    q = df.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def drain_whole(df: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """An aggregation over everything that has arrived, open windows too: each batch writes the folder anew."""

    def write(result: DataFrame, _: int) -> None:
        result.write.mode("overwrite").parquet(out)

    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
