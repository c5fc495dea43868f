"""An index as four Parquet tables and a manifest in one folder, and the stores around it."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("chunks", "postings", "lengths", "vectors")
MANIFEST_VERSION = 1
MANIFEST = "version int, fingerprint string, counts string, tables string"


def fingerprint(settings: dict) -> str:
    """SHA-256 of the settings in canonical JSON."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _folder(spark: SparkSession, path: str):
    """The file system of a path and the path itself."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_index(folder: str, tables: dict[str, DataFrame], settings: dict) -> None:
    """Writes the tables into a fresh folder, then the manifest that names it, whose presence makes the index whole.

    An index that is there stays readable until the new manifest replaces its own; its tables are removed last."""
    missing = set(TABLES) - set(tables)
    if missing:
        raise ValueError(f"missing tables: {', '.join(sorted(missing))}")
    spark = next(iter(tables.values())).sparkSession
    old = read_manifest(spark, folder)
    fresh = f"tables-{uuid.uuid4().hex}"
    for name in TABLES:
        tables[name].write.mode("error").parquet(f"{folder}/{fresh}/{name}")
    counts = {name: spark.read.parquet(f"{folder}/{fresh}/{name}").count() for name in TABLES}
    row = [(MANIFEST_VERSION, fingerprint(settings), json.dumps(counts, sort_keys=True), fresh)]
    spark.createDataFrame(row, MANIFEST).coalesce(1).write.mode("error").json(f"{folder}/{fresh}/manifest")
    system, final = _folder(spark, f"{folder}/manifest")
    system.delete(final, True)
    if not system.rename(_folder(spark, f"{folder}/{fresh}/manifest")[1], final):
        raise OSError(f"the manifest could not be put in place: {folder}")
    if old:
        system.delete(_folder(spark, f"{folder}/{old['tables']}")[1], True)


def read_manifest(spark: SparkSession, folder: str) -> dict | None:
    """The manifest, or none where no index was ever finished; a folder that cannot be read is an error."""
    system, path = _folder(spark, f"{folder}/manifest")
    if not system.exists(path):
        return None
    row = spark.read.schema(MANIFEST).json(f"{folder}/manifest").first()
    return {"version": row.version, "fingerprint": row.fingerprint, "counts": json.loads(row.counts), "tables": row.tables} if row else None


def is_current(spark: SparkSession, folder: str, settings: dict) -> bool:
    manifest = read_manifest(spark, folder)
    return bool(manifest) and manifest["fingerprint"] == fingerprint(settings)


def read_index(spark: SparkSession, folder: str, dim: int | None = None) -> dict[str, DataFrame]:
    """The tables, after their counts, ids and vector lengths are found sound; ``ValueError`` names the first fault."""
    manifest = read_manifest(spark, folder)
    if not manifest or manifest["version"] != MANIFEST_VERSION:
        raise ValueError("the index has no usable manifest")
    tables = {name: spark.read.parquet(f"{folder}/{manifest['tables']}/{name}") for name in TABLES}
    for name, df in tables.items():
        if df.count() != manifest["counts"][name]:
            raise ValueError(f"{name}: the number of rows differs from the manifest")
    for name in ("chunks", "lengths", "vectors"):
        if tables[name].groupBy("chunk_id").count().filter("count > 1").limit(1).count():
            raise ValueError(f"{name}: an id occurs twice")
    if dim is not None and tables["vectors"].filter(F.size("vector") != dim).limit(1).count():
        raise ValueError("vectors: a vector has another length")
    sums = tables["postings"].groupBy("chunk_id").agg(F.sum("tf").alias("n"))
    if tables["lengths"].join(sums, "chunk_id", "left").filter(F.coalesce("n", F.lit(0)) != F.col("len")).limit(1).count():
        raise ValueError("postings: counts do not add up to a chunk's length")
    return tables


def embed_with_cache(texts: DataFrame, cache: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """Vectors of ``id, text`` and the grown cache ``key, vector``: each distinct text once, and only what the cache lacks is
    embedded (``embed`` maps ``key, text`` to ``key, vector``)."""
    keyed = texts.withColumn("key", F.sha2("text", 256))
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    grown = cache.unionByName(embed(missing))
    return keyed.join(grown, "key").select("id", "vector"), grown


def chunks_by_id(ids: DataFrame, chunks: DataFrame, strict: bool = False) -> DataFrame:
    """``position, chunk_id`` resolved in order; unknown ids stay, with nulls, or are an error if ``strict``."""
    found = ids.join(chunks.withColumn("known", F.lit(True)), "chunk_id", "left")
    if strict:
        found = found.withColumn("chunk_id", F.when(F.col("known"), F.col("chunk_id")).otherwise(F.raise_error(F.concat(F.lit("unknown chunk "), "chunk_id")).cast("string")))
    return found.drop("known").orderBy("position")
