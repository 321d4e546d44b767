"""An extension: metric facts kept up to date from a stream of events.

The reference has no streams; its nearest thing is a full run with stable ids.
Here events that arrive late by up to a bound still count in their window, and
what is counted equals a batch run over the same rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators.graphs import checkpoint_folder


def counts(events: DataFrame, window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """begin, event_type, n and total of each window; events: ts, event_type, value. Works on streams and tables alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    by = timed.groupBy(F.window("ts", window).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("begin"), "event_type", "n", "total")


def run_once(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The counts of all files of that name in a folder, read as a stream to its end.

    Each batch writes the windows that it changed to the shared folder under its
    number, so a batch that is run again replaces what it wrote; of a window the
    last batch's counts hold. State of windows that the watermark has passed is
    dropped, and nothing is gathered in the driver.
    """
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    place = f"{checkpoint_folder(spark)}/codeloom_{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/out/batch={number}")

    query = counts(stream).writeStream.option("checkpointLocation", f"{place}/state").outputMode("update").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    told = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in counts(spark.createDataFrame([], schema)).schema)}, batch long").parquet(f"{place}/out")
    last = told.groupBy("begin", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("last"))
    return last.select("begin", "event_type", "last.n", "last.total")
