"""Streams: scoring without state, running statistics by label, and sums that a replayed batch doesn't change."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators.segment import score_texts


def read_documents(spark: SparkSession, path: str, files_at_once: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def score_stream(lines: DataFrame, model: DataFrame, out: str, checkpoint: str):
    """Predictions of a stream of lines (line_idx, text), appended to a Parquet folder until the input ends."""
    return score_texts(lines, model).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_stats(stats: DataFrame, out: str, checkpoint: str):
    """A stream's running table, as it stands after each batch, in a Parquet folder."""
    return stats.writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_stats(lines: DataFrame) -> DataFrame:
    """n, mean and deviation of lengths by label; the state is a few sums a label."""
    size = F.length("text")
    return lines.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(size), 6).alias("mean_length"), F.round(F.coalesce(F.stddev_pop(size), F.lit(0.0)), 6).alias("std_length"))


def merge_sums(folder: str):
    """A foreachBatch function that keeps a batch's sums by label (lines, lengths, squared lengths) under the batch's own id.

    A batch that is replayed after a failure overwrites its own sums, so it counts once.
    """

    def merge(rows: DataFrame, batch: int) -> None:
        size = F.length("text").cast("long")
        sums = rows.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("total"), F.sum(size * size).alias("squares"))
        sums.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return merge


def write_sums(lines: DataFrame, folder: str, checkpoint: str, merge=None):
    """The sums of a stream of lines (y, text) by batch, until its input ends; `merge` takes the place of merge_sums(folder)."""
    return lines.writeStream.foreachBatch(merge or merge_sums(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_sums(spark: SparkSession, folder: str) -> DataFrame:
    """n, mean and population deviation of lengths by label (0 under two lines) over all batches so far, each of them once."""
    rows = spark.read.schema("y string, n long, total long, squares long, batch long").parquet(folder)
    sums = rows.groupBy("y").agg(*(F.sum(c).alias(c) for c in ("n", "total", "squares")))
    mean = F.col("total") / F.col("n")
    spread = F.sqrt(F.greatest(F.col("squares") / F.col("n") - mean * mean, F.lit(0.0)))
    return sums.select("y", "n", F.round(mean, 6).alias("mean_length"), F.round(spread, 6).alias("std_length"))
