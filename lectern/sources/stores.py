"""Stores of processed documents, vectors with a checksum, experiments and ratings."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .index_store import _folder

DOCUMENT_VERSION = 2
RESULTS = "variant string, qid string, recall double, ndcg double, latency_ms double, refusal string, error string"
RATINGS = "answer_id string, line_no bigint, saved_at timestamp, rating string, note string, question string, answer string, refusal string"


def save_documents(documents: DataFrame, folder: str) -> None:
    """Adds or replaces documents by ``doc_id``: every document lies in a folder of its own, and only those written change."""
    documents.withColumn("version", F.lit(DOCUMENT_VERSION)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("doc_id").parquet(folder)


def load_documents(spark: SparkSession, folder: str, ids: list[str] | None = None) -> DataFrame:
    """Stored documents, those named or all; fails on one of another version."""
    rows = spark.read.option("recursiveFileLookup", "false").parquet(folder).withColumn("doc_id", F.col("doc_id").cast("string"))
    rows = rows if ids is None else rows.filter(F.col("doc_id").isin(ids))
    wrong = F.raise_error(F.concat(F.lit("stored with another version: "), "doc_id")).cast("int")
    return rows.withColumn("version", F.when(F.col("version") == DOCUMENT_VERSION, F.col("version")).otherwise(wrong)).drop("version")


def list_documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(folder).select(F.col("doc_id").cast("string").alias("doc_id")).distinct().orderBy("doc_id")


def _checksum(vectors: DataFrame) -> DataFrame:
    """One row: rows, ids, the least and largest length and an order-free sum of row hashes."""
    row = F.xxhash64("chunk_id", "vector").cast("decimal(38,0)")
    return vectors.agg(F.count("*").alias("rows"), F.countDistinct("chunk_id").alias("ids"), F.coalesce(F.min(F.size("vector")), F.lit(0)).alias("least"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("most"), F.coalesce(F.sum(row), F.lit(0).cast("decimal(38,0)")).cast("string").alias("sum"))


def save_vectors(vectors: DataFrame, folder: str, dim: int) -> None:
    """Vectors ``chunk_id, vector`` in float32 with a checksum beside them, which is written last."""
    spark = vectors.sparkSession
    data = f"{folder}/data-{uuid.uuid4().hex}"
    vectors.select("chunk_id", F.col("vector").cast("array<float>").alias("vector")).write.mode("error").parquet(data)
    told = _checksum(spark.read.parquet(data)).first()
    if (told["rows"] and {told["least"], told["most"]} != {dim}) or told["rows"] != told["ids"]:
        raise ValueError("vectors of one length and of distinct ids are needed")
    side = spark.createDataFrame([(dim, told["rows"], told["sum"], data)], "dim int, rows bigint, sum string, data string")
    side.coalesce(1).write.mode("overwrite").json(f"{folder}/checksum")


def load_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The vectors, after their checksum was found right."""
    side = spark.read.schema("dim int, rows bigint, sum string, data string").json(f"{folder}/checksum").first()
    rows = spark.read.parquet(side["data"])
    now = _checksum(rows).first()
    if (now["rows"], now["sum"]) != (side["rows"], side["sum"]) or now["rows"] != now["ids"]:
        raise ValueError("the vectors do not fit their checksum")
    return rows


def valid_batch(records: DataFrame, dim: int) -> DataFrame:
    """Records ``chunk_id, vector`` as they are; the whole batch fails if one has no id, another length, a value that is no number, or an
    id that occurs twice."""
    bad = F.col("chunk_id").isNull() | (F.col("chunk_id") == "") | F.col("vector").isNull() | (F.size("vector") != dim) | F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if records.filter(bad).limit(1).count() or records.groupBy("chunk_id").count().filter("count > 1").limit(1).count():
        raise ValueError("the batch holds a record that cannot be stored; nothing was changed")
    return records


def append_results(results: DataFrame, folder: str) -> None:
    results.write.mode("append").json(f"{folder}/results")


def finish_experiment(summary: DataFrame, folder: str) -> None:
    """Writes the summary, a row for each variant, which makes the experiment whole."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def read_results(spark: SparkSession, folder: str, schema: str = RESULTS) -> DataFrame:
    """Results of an experiment; fails on a line that does not fit or that names no variant or question."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/results")
    whole = F.col("variant").isNotNull() & F.col("qid").isNotNull()
    return rows.withColumn("variant", F.when(whole, F.col("variant")).otherwise(F.raise_error(F.lit("a result names no variant or question")).cast("string")))


def read_summary(spark: SparkSession, folder: str) -> DataFrame:
    system, path = _folder(spark, f"{folder}/summary")
    if not system.exists(path):
        raise ValueError("the experiment was never finished")
    return spark.read.json(f"{folder}/summary")


def append_ratings(ratings: DataFrame, folder: str) -> None:
    """Adds rated answers to the log; nothing that is there changes."""
    ratings.write.mode("append").json(folder)


def read_ratings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(RATINGS).json(folder)


def trace_rows(events: DataFrame) -> DataFrame:
    """``qid, stage, start_ms, duration_ms, status, summary`` with the summary as a map of texts, from rows whose summary is JSON."""
    return events.withColumn("summary", F.from_json("summary", "map<string,string>"))
