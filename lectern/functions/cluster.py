"""Session helpers that hold on a cluster: durable cuts of lineage and broadcasts behind a size check."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast; larger sides are joined by shuffle.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's ``spark.checkpoint.dir``; set a directory of our own only where it names none and all runs in one
    process (tests).  On a cluster a folder of one machine is none of the others', so there it is an error."""
    if spark.conf.get("spark.checkpoint.dir", None):
        return
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-checkpoint-"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialized side for a join: broadcast if a count of its rows is within ``limit``, else left to a shuffle.

    ``df`` should be narrow (keys and a few scalars), as the limit counts rows."""
    df = materialize(df)
    return F.broadcast(df) if df.count() <= limit else df.hint("shuffle_hash")


def utf16_units(column):
    """Length in UTF-16 code units: code points and one more for each beyond the basic plane."""
    beyond = F.length(F.regexp_replace(column, "[^\\x{10000}-\\x{10FFFF}]+", ""))
    return F.length(column) + F.when(F.octet_length(column) == F.length(column), F.lit(0)).otherwise(beyond)


def approx_tokens(column):
    """Tokens of the ``approx`` tokenizer: a quarter of the UTF-16 units, rounded up."""
    return F.ceil(utf16_units(column) / 4).cast("bigint")
