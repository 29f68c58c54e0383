"""Observations as a stream: running quality statistics, and detection again for the pixels that a micro-batch touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terrapulse.operators.detection import detect_changes
from terrapulse.operators.quality import statistics
from terrapulse.options import HarmonicOptions


def running_statistics(stream: DataFrame, o: HarmonicOptions = HarmonicOptions()) -> DataFrame:
    """The batch operator as it stands: its aggregate is incremental (output mode update or complete)."""
    return statistics(stream, o)


def detect_touched(stream: DataFrame, store: str, out: str, checkpoint: str, o: HarmonicOptions = HarmonicOptions()) -> StreamingQuery:
    """Append each micro-batch to the observation table ``store``, partitioned by its number, and write the models of
    the pixels it touches to ``out``, one folder a batch.

    A batch that runs again overwrites its own folders, so a restart neither doubles observations nor results. Readers
    take each pixel's models from its latest batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        known = spark.read.option("basePath", store).parquet(store).where(F.col("batch") <= number)
        pixels = spark.read.parquet(f"{store}/batch={number}").select("pixel_id").distinct()
        detect_changes(known.join(pixels, "pixel_id", "left_semi").drop("batch"), o=o).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(out: DataFrame) -> DataFrame:
    """Of the results of all batches, each pixel's last."""
    last = out.groupBy("pixel_id").agg(F.max("batch").alias("batch"))
    return out.join(last, ["pixel_id", "batch"])
