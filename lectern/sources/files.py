"""JSON lines, strict or lenient, and PDF files."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUESTIONS = "qid string, question string, kind string, answer string, gold array<struct<page:int,quote:string>>"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fails on the first line that does not fit."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Rows that fit, and ``line_no, value`` of the lines that do not, numbered from 1 within their file."""
    lines = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("at", F.monotonically_increasing_id())
    numbered = lines.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("at"))).filter(F.rlike("value", F.lit(r"\S")))
    parsed = numbered.withColumn("r", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = parsed.filter("r._corrupt IS NULL AND r IS NOT NULL").select("line_no", "r.*").drop("_corrupt")
    return good, parsed.filter("r._corrupt IS NOT NULL OR r IS NULL").select("line_no", "value")


_OBJECT = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|[-+]?\d*\.?\d+|/[^\s/\[\]()<>]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> str:
    if token[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode()).decode("latin-1")
    plain = re.sub(rb"\\([nrtbf]|[0-7]{1,3}|.)", lambda m: _ESCAPES.get(m[1]) or (bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1], flags=re.S)
    return plain.decode("cp1252", "replace")


def page_items(content: bytes) -> list[dict]:
    """Text items of one page's content stream: text, place, font and its size."""
    items, stack, x, y, lx, ly, size, font, leading = [], [], 0.0, 0.0, 0.0, 0.0, 12.0, "", 0.0
    for token in _TOKEN.findall(content):
        if token[:1] in b"(<[]/" or re.fullmatch(rb"[-+]?\d*\.?\d+", token):
            stack.append(token)
            continue
        number = lambda i: float(stack[i])
        if token == b"Tf" and len(stack) >= 2:
            font, size = stack[-2][1:].decode("latin-1"), number(-1)
        elif token in (b"Td", b"TD") and len(stack) >= 2:
            lx, ly = lx + number(-2), ly + number(-1)
            leading = -number(-1) if token == b"TD" else leading
            x, y = lx, ly
        elif token == b"Tm" and len(stack) >= 6:
            lx, ly = number(-2), number(-1)
            size *= abs(number(-3)) or 1
            x, y = lx, ly
        elif token == b"T*":
            ly -= leading
            x, y = lx, ly
        elif token == b"TL" and stack:
            leading = number(-1)
        elif token in (b"Tj", b"'", b"TJ", b'"'):
            text = "".join(_literal(t) for t in stack if t[:1] in b"(<")
            if text:
                items.append({"text": text, "x": x, "y": y, "font_size": round(size, 2), "font_name": font, "is_bold": bool(re.search(r"bold|black|heavy", re.sub(r"^[A-Z]{6}\+", "", font), re.I))})
        elif token == b"BT":
            lx = ly = 0.0
        stack = []
    return items


def pdf_pages(data: bytes) -> list[str]:
    """Texts of the content streams with text, in file order; lines are parted where the height changes."""
    out = []
    for raw in _OBJECT.findall(data):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        if b"BT" not in raw:
            continue
        text, last = "", None
        for item in page_items(raw):
            text += ("\n" if last is not None and abs(item["y"] - last) > item["font_size"] / 3 else "") + item["text"]
            last = item["y"]
        out.append(text)
    return out


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, page_no, text`` of simple PDF files, each parsed whole by one task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", F.sha2("content", 256).alias("sha256"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, s, n, t) for p, s, c in zip(b["path"], b["sha256"], b["content"]) for n, t in enumerate(pdf_pages(bytes(c)), 1)]
            yield pd.DataFrame(rows, columns=["path", "sha256", "page_no", "text"])

    return files.mapInPandas(run, "path string, sha256 string, page_no int, text string")


def source_file_of(files: DataFrame, documents: DataFrame) -> DataFrame:
    """The file whose hash a document names."""
    return documents.join(files.select("path", "sha256").distinct(), "sha256")
