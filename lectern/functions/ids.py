"""Content ids."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Namespace of document ids (fixed value).
DOCUMENT_NAMESPACE = uuid.UUID("3f2b8a1e-7c4d-4e9a-b5d6-1a2c3e4f5a6b")


def content_hash(*parts):
    """SHA-256 over length-prefixed parts, so that no two lists of parts read the same."""
    return F.sha2(F.concat(*[F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string"), F.lit("|")) for p in parts]), 256)


def chunk_id(doc_id, strategy, start, end, text):
    return content_hash(F.lit("chunk"), doc_id, strategy, start, end, text)


@F.pandas_udf(StringType())
def document_id(sha256: pd.Series) -> pd.Series:
    """Document id of a file's SHA-256: a name-based UUID of version 5."""
    return sha256.map(lambda s: None if s is None else str(uuid.uuid5(DOCUMENT_NAMESPACE, s)))
