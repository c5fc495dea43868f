"""Reports as text: sizes of chunks, a repeatable sample of them, experiments, regressions, usage and outlines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .evaluation import Mulberry

BAR = 30


def seed_of(text: str) -> int:
    """A number from a text (the hash FNV-1a over UTF-16 units; its constants are fixed values)."""
    value = 0x811C9DC5
    for unit in np.frombuffer(text.encode("utf-16-le", "surrogatepass"), dtype="<u2").tolist():
        value = ((value ^ unit) * 0x01000193) & 0xFFFFFFFF
    return value


def picked_places(total: int, count: int, seed: int) -> list[int]:
    """``count`` of the places 0 to ``total`` - 1, without repeats, the same for the same seed, in order: a shuffle that stops early and
    remembers only the places it moved."""
    if count < 0:
        raise ValueError("a sample cannot be smaller than nothing")
    source, moved, out = Mulberry(seed), {}, []
    for i in range(min(count, total)):
        j = i + int(source.take(1)[0] * (total - i))
        out.append(moved.get(j, j))
        moved[j] = moved.get(i, i)
    return sorted(out)


def sample_chunks(chunks: DataFrame, count: int, seed: int, order: tuple[str, ...] = ("char_start", "char_end", "chunk_id")) -> DataFrame:
    """A repeatable sample of one document's chunks, in order."""
    places = picked_places(chunks.count(), count, seed)
    numbered = chunks.withColumn("place", F.row_number().over(Window.orderBy(*order)) - 1)  # one document
    return numbered.filter(F.col("place").isin(places)).orderBy("place").drop("place")


def histogram_lines(histogram: DataFrame) -> DataFrame:
    """``from_tokens, line`` of a histogram ``from_tokens, to_tokens, chunks``, at most a few buckets: range, bar and count."""
    label = F.when(F.col("to_tokens") - F.col("from_tokens") <= 1, F.col("from_tokens").cast("string")).otherwise(F.concat_ws("-", F.col("from_tokens").cast("string"), (F.col("to_tokens") - 1).cast("string")))
    ends = histogram.agg(F.max("chunks").alias("most"), F.max(F.length(label)).alias("wide"))
    width = F.greatest(F.lit(1), F.floor(F.col("chunks") / F.col("most") * BAR + 0.5)).cast("int")
    bar = F.when(F.col("chunks") == 0, "").otherwise(F.repeat(F.lit("█"), width))
    rows = histogram.crossJoin(F.broadcast(ends))  # one row
    return rows.select("from_tokens", F.concat(F.lpad(label, F.col("wide"), F.lit(" ")), F.lit(" | "), bar, F.lit(" "), F.col("chunks").cast("string")).alias("line"))


def _cell(value, digits: int = 3) -> str:
    return "–" if value is None else f"{value:.{digits}f}" if isinstance(value, float) else str(value)


def table_lines(head: list[str], rows: list[list[str]]) -> list[str]:
    return [f"| {' | '.join(r)} |" for r in (head, ["---"] * len(head), *rows)]


def best_of(summaries: DataFrame, columns: dict[str, bool]) -> DataFrame:
    """For each column whether a variant's value is the best of all; ``columns`` says where more is better."""
    bests = summaries.agg(*[(F.max if more else F.min)(c).alias(f"_{c}") for c, more in columns.items()])
    marked = summaries.crossJoin(F.broadcast(bests))  # one row
    return marked.select("variant", *columns, *[(F.col(c) == F.col(f"_{c}")).alias(f"{c}_best") for c in columns])


def experiment_report(summaries: DataFrame, comparisons: DataFrame | None = None, title: str = "Experiment") -> str:
    """A Markdown report of variants, one row each, best values set bold, and of their comparison with the baseline.

    ``summaries`` holds ``variant, questions, failed, refused, recall, p50_ms, p95_ms``, a row for each of at most 200 variants."""
    better = {"recall": True, "p50_ms": False, "p95_ms": False}
    marked = best_of(summaries, better).drop(*better).join(summaries, "variant").orderBy("variant").limit(201).collect()
    if len(marked) > 200:
        raise ValueError("more than 200 variants")
    bold = lambda r, c: f"**{_cell(r[c])}**" if r[f"{c}_best"] and len(marked) > 1 else _cell(r[c])
    out = [f"# {title}", "", *table_lines(["variant", "questions", "failed", "refused", *better], [[r["variant"], *[_cell(r[c]) for c in ("questions", "failed", "refused")], *[bold(r, c) for c in better]] for r in marked])]
    if any(r["failed"] for r in marked):
        out += ["", "Failed questions are left out of the means."]
    if comparisons is not None:
        rows = comparisons.orderBy("variant").limit(200).collect()
        out += ["", "## Against the baseline", "", *table_lines(["variant", "wins", "losses", "ties", "mean difference"], [[r["variant"], _cell(r["wins"]), _cell(r["losses"]), _cell(r["ties"]), _cell(r["mean_difference"])] for r in rows])]
    return "\n".join(out) + "\n"


def regression_report(verdict: DataFrame, margin: float) -> str:
    """The verdict of a regression check, one row, in words."""
    r = verdict.first()
    if r["verdict"] == "invalid":
        return f"invalid: {r['missing']} questions of the baseline are missing and {r['extra']} are new"
    word = "fell" if r["recall"] < r["baseline_recall"] else "rose" if r["recall"] > r["baseline_recall"] else "stayed"
    return f"{r['verdict']}: recall {word} from {_cell(r['baseline_recall'])} to {_cell(r['recall'])} (allowed fall {margin:g}); {r['better']} questions better, {r['worse']} worse"


def usage_lines(totals: DataFrame) -> DataFrame:
    """``kind, line``: the totals of calls in words."""
    plural = lambda c, one: F.concat(c.cast("string"), F.lit(f" {one}"), F.when(c == 1, "").otherwise("s"))
    failed = F.when(F.col("failed") > 0, F.concat(F.lit(", "), F.col("failed").cast("string"), F.lit(" failed"))).otherwise("")
    return totals.select("kind", F.concat(plural(F.col("calls"), "call"), failed, F.lit(", "), F.col("prompt_tokens").cast("string"), F.lit(" prompt tokens, "), F.col("output_tokens").cast("string"), F.lit(" answer tokens")).alias("line"))


def models_needed(purposes: DataFrame) -> DataFrame:
    """``model, purposes`` of rows ``model, purpose``: each model once, a missing tag read as ``:latest``."""
    full = F.when(F.contains("model", F.lit(":")), F.col("model")).otherwise(F.concat("model", F.lit(":latest")))
    return purposes.groupBy(full.alias("model")).agg(F.array_join(F.array_sort(F.collect_set("purpose")), ", ").alias("purposes"))
