"""Resumable location of transects: path points as a stream, the transects of each batch summarised from all their points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def locate_stream(points: DataFrame, results_path: str, state_path: str, summarise, key: str = "tid"):
    """Start a query that keeps all points under state_path and, for every batch, summarises anew the transects it touches.

    A transect may come in any number of batches: its summary of the last one is that of all its points.  Results are
    appended with their batch_id; latest() has the last row of each transect.  A batch that runs again after a failure
    overwrites its own points and its own rows, so that nothing counts twice.  Returns the query.
    """

    def batch(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{state_path}/points/batch_id={batch_id}")
        own = spark.read.schema(rows.schema).parquet(f"{state_path}/points/batch_id={batch_id}")
        every = spark.read.schema(rows.schema.add("batch_id", "long")).parquet(f"{state_path}/points").where(F.col("batch_id") <= batch_id)
        touched = every.drop("batch_id").join(own.select(key).distinct(), key, "left_semi")
        summarise(touched).write.mode("overwrite").parquet(f"{results_path}/batch_id={batch_id}")

    return points.writeStream.foreachBatch(batch).option("checkpointLocation", f"{state_path}/offsets").trigger(availableNow=True).start()


def latest(results: DataFrame, key: str = "tid") -> DataFrame:
    """The row of each transect's last batch; a transect without a key is one too."""
    columns = [c for c in results.columns if c not in (key, "batch_id")]
    return results.groupBy(key).agg(F.max_by(F.struct(*columns), "batch_id").alias("row")).select(key, "row.*")


def windowed_counts(events: DataFrame, late: str = "1 hour", size: str = "1 day") -> DataFrame:
    """Events per type and window with a watermark; an extension, the reference has no streams."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def stream_paths(spark: SparkSession, sf_dir: str, work_dir: str, summarise) -> DataFrame:
    """Read the events table as a stream of files, locate all transects, and return the table of results."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    points = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    points = points.select(F.col("user_id").alias("tid"), "ts", "event_id", F.col("value").alias("elev"), F.col("event_type").alias("veg_class"))
    locate_stream(points, f"{work_dir}/results", f"{work_dir}/state", summarise).awaitTermination()
    return latest(spark.read.parquet(f"{work_dir}/results"))
