"""Tokenizers with a vocabulary file, which stays where it is: its path is a parameter and executors read it there."""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F

#: How a text is parted before merging, where the vocabulary's own rule is not given (a public, fixed pattern).
PARTS = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]++[\r\n]*|\s*[\r\n]|\s+(?!\S)|\s+"""


@lru_cache(maxsize=4)
def encoding(path: str, parts: str = PARTS):
    """A byte-pair encoding from a file of ranks, once in each process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(path, pat_str=parts, mergeable_ranks=ranks, special_tokens={})


def token_count(column, path: str, parts: str = PARTS):
    """Tokens of a text; the names of special tokens in it are ordinary text.  Null for null."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        known = encoding(path, parts)
        return pd.Series([None if t is None else len(known.encode_ordinary(t)) for t in texts], dtype="Int64")

    return count(column)


def token_spans(column, path: str, parts: str = PARTS):
    """``array<struct<id,start,end>>`` of a text's tokens, spans in code points; a token that ends within a character ends after it."""

    @F.pandas_udf("array<struct<id:int,start:int,end:int>>")
    def spans(texts: pd.Series) -> pd.Series:
        known, out = encoding(path, parts), []
        for t in texts:
            if t is None:
                out.append(None)
                continue
            rows, seen, at = [], 0, 0
            for token in known.encode_ordinary(t):
                raw = known.decode_single_token_bytes(token)
                start = at
                at += sum((b & 0xC0) != 0x80 for b in raw)  # bytes that begin a character
                rows.append({"id": token, "start": start if (raw[0] & 0xC0) != 0x80 else max(0, start - 1), "end": at})
                seen += len(raw)
            out.append(rows)
        return pd.Series(out)

    return spans(column)
