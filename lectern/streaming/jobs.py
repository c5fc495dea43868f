"""Streams over the event and rating logs.  State and output live in the shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.cluster import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base}/streams-{uuid.uuid4().hex}"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of Parquet files as a stream, with the schema of what is there; ``path`` is a folder or one file."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return spark.readStream.schema(schema).parquet(path)
    return spark.readStream.schema(schema).option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())


def windowed(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Counts and sums by kind of event in tumbling or sliding windows; time without a zone is read as UTC."""
    timed = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    window = F.window("at", length, slide) if slide else F.window("at", length)
    return timed.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """Runs of a user's events with no silence longer than ``gap``."""
    timed = events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_of_each(events: DataFrame, key: str, late: str = "1 day", at: str = "ts") -> DataFrame:
    """Each key once while its repeats arrive within the watermark."""
    return events.withColumn("at", F.col(at).cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key])


def run_to_end(stream: DataFrame, mode: str, keys: list[str]) -> DataFrame:
    """Runs what is there, each batch written under its number, and returns for each key the row of its last batch."""
    folder = shared_folder(stream.sparkSession)

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/batch={number:08d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    schema = StructType([*stream.schema.fields, StructField("batch", LongType())])
    rows = stream.sparkSession.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def latest_ratings(ratings: DataFrame) -> DataFrame:
    """The last rating of each answer as a running aggregate."""
    return ratings.groupBy("answer_id").agg(F.max_by("rating", "line_no").alias("rating"), F.max("line_no").alias("line_no"))
