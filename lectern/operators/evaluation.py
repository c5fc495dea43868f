"""Judging retrieval against gold passages, summaries of variants, paired comparison and regression gates."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import utf16_units

TIE = 1e-9


def judge(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds ``relevant`` and ``newly_covered`` to hits ``qid, rank, doc_id, start, end`` given ``qid, gold_ix, doc_id, start, end``.

    A hit is relevant where it overlaps a gold passage of its document, and newly covers one if no better hit did."""
    h, g = hits.alias("h"), gold.alias("g")
    overlap = (F.col("h.qid") == F.col("g.qid")) & (F.col("h.doc_id") == F.col("g.doc_id")) & (F.col("h.start") < F.col("g.end")) & (F.col("g.start") < F.col("h.end"))
    real = (F.col("h.end") > F.col("h.start")) & (F.col("g.end") > F.col("g.start"))
    met = h.join(g, overlap & real).select("h.qid", "h.rank", "g.gold_ix")
    first = met.groupBy("qid", "gold_ix").agg(F.min("rank").alias("rank")).select("qid", "rank").distinct().withColumn("newly_covered", F.lit(True))
    relevant = met.select("qid", "rank").distinct().withColumn("relevant", F.lit(True))
    return hits.join(relevant, ["qid", "rank"], "left").join(first, ["qid", "rank"], "left").na.fill(False, ["relevant", "newly_covered"])


def retrieval_metrics(judged: DataFrame, gold_counts: DataFrame, k: int) -> DataFrame:
    """hit, precision, recall, reciprocal rank and nDCG at k of each question that has gold (``qid, golds``)."""
    cut = judged.filter(F.col("rank") <= k)
    own = cut.groupBy("qid").agg(
        F.max(F.col("relevant").cast("int")).alias("hit"), F.sum(F.col("relevant").cast("int")).alias("rel"),
        F.sum(F.col("newly_covered").cast("int")).alias("new"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("newly_covered"), 1.0 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
    )
    joined = gold_counts.filter(F.col("golds") > 0).join(own, "qid", "left").na.fill(0, ["hit", "rel", "new", "dcg"])
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("golds").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
    return joined.select(
        "qid", F.col("hit").cast("double").alias("hit"), (F.col("rel") / F.lit(float(k))).alias("precision"), F.least(F.lit(1.0), F.col("new") / F.col("golds")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("dcg") / ideal).alias("ndcg"),
    )


def macro_means(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(c).alias(c) for c in ("hit", "precision", "recall", "mrr", "ndcg")], F.count("*").alias("questions"))


def variant_summary(results: DataFrame) -> DataFrame:
    """Counts, refusals and nearest-rank latency percentiles of each ``variant``; failed questions stay out of the means."""
    ok = F.col("error").isNull()
    return results.groupBy("variant").agg(
        F.count("*").alias("questions"), F.count_if(~ok).alias("failed"), F.count_if(ok & F.col("refusal").isNotNull()).alias("refused"),
        F.avg(F.when(ok, F.col("recall"))).alias("recall"),
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL THEN latency_ms END)").alias("p50_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN error IS NULL THEN latency_ms END)").alias("p95_ms"),
    )


def _paired(results: DataFrame, baseline: str, metric: str) -> DataFrame:
    """``variant, qid, before, after`` of the questions that both sides answered without ``error`` (where there is such a column) and
    have the metric for."""
    sound = results.filter(F.col("error").isNull()) if "error" in results.columns else results
    base = sound.filter(F.col("variant") == baseline).select("qid", F.col(metric).alias("before"))
    other = sound.filter(F.col("variant") != baseline).select("variant", "qid", F.col(metric).alias("after"))
    return other.join(base, "qid").filter(F.col("before").isNotNull() & F.col("after").isNotNull())


def compare(results: DataFrame, baseline: str, metric: str) -> DataFrame:
    """Wins, losses, ties and the mean difference of every other variant over the questions that both answered."""
    d = F.col("after") - F.col("before")
    return _paired(results, baseline, metric).groupBy("variant").agg(
        F.count_if(d > TIE).alias("wins"), F.count_if(d < -TIE).alias("losses"), F.count_if(F.abs(d) <= TIE).alias("ties"), F.avg(d).alias("mean_difference")
    )


class Mulberry:
    """The generator mulberry32 (public domain; its constants are fixed values), many numbers at a time: the state only counts up."""

    def __init__(self, seed: int):
        self.state = seed & 0xFFFFFFFF

    def take(self, n: int) -> np.ndarray:
        """The next ``n`` numbers in [0, 1)."""
        mask, step = np.uint64(0xFFFFFFFF), 0x6D2B79F5
        a = (np.uint64(self.state) + np.uint64(step) * np.arange(1, n + 1, dtype=np.uint64)) & mask
        self.state = (self.state + step * n) & 0xFFFFFFFF
        mixed = ((a ^ (a >> np.uint64(15))) * (a | np.uint64(1))) & mask
        mixed ^= (mixed + (((mixed ^ (mixed >> np.uint64(7))) * (mixed | np.uint64(61))) & mask)) & mask
        return ((mixed ^ (mixed >> np.uint64(14))) & mask).astype(np.float64) / 4294967296.0


def bootstrap_interval(differences: np.ndarray, seed: int = 1, resamples: int = 2000) -> tuple[float, float] | None:
    """The 2.5th and 97.5th percentile of the means of ``resamples`` draws with replacement; none for under two differences."""
    n = len(differences)
    if n < 2:
        return None
    source, means = Mulberry(seed), np.empty(resamples)
    for r in range(resamples):
        means[r] = differences[np.floor(source.take(n) * n).astype(np.int64)].sum() / n
    means.sort()
    return float(means[int(0.025 * resamples)]), float(means[min(resamples - 1, int(np.ceil(0.975 * resamples)) - 1)])


def bootstrap_intervals(results: DataFrame, baseline: str, metric: str, resamples: int = 2000, seed: int = 1) -> DataFrame:
    """95 % intervals of the mean difference and the verdict, ``variant, low, high, verdict``.

    One task holds the differences of one variant, in the order of the questions' ids: eight bytes for each labelled question."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found = bootstrap_interval(group.sort_values("qid")["d"].to_numpy(dtype=np.float64), seed, resamples)
        low, high = found or (None, None)
        verdict = "unclear" if low is None or low <= 0 <= high else "better" if low > 0 else "worse"
        return pd.DataFrame({"variant": [group["variant"].iloc[0]], "low": [low], "high": [high], "verdict": [verdict]}).astype({"low": "float64", "high": "float64"})

    rows = _paired(results, baseline, metric).select("variant", F.col("qid").cast("string").alias("qid"), (F.col("after") - F.col("before")).alias("d"))
    return rows.groupBy("variant").applyInPandas(run, "variant string, low double, high double, verdict string")


def regression_verdict(baseline: DataFrame, observed: DataFrame, margin: float) -> DataFrame:
    """One row: invalid where the question sets (``qid, recall``) differ, regression where the mean fell by more than the margin."""
    both = baseline.select("qid", F.col("recall").alias("before")).join(observed.select("qid", F.col("recall").alias("after")), "qid", "full_outer")
    sums = both.agg(
        F.count_if(F.col("after").isNull()).alias("missing"), F.count_if(F.col("before").isNull()).alias("extra"),
        F.count_if(F.col("after") < F.col("before") - TIE).alias("worse"), F.count_if(F.col("after") > F.col("before") + TIE).alias("better"),
        F.avg("before").alias("baseline_recall"), F.avg("after").alias("recall"),
    )
    fell = F.col("baseline_recall") - F.col("recall")
    return sums.withColumn("verdict", F.when((F.col("missing") + F.col("extra")) > 0, "invalid").when(fell > margin + TIE, "regression").otherwise("pass"))


def expand_matrix(spark, axes: dict[str, list[str]]) -> DataFrame:
    """Every combination of the axes' values, the first axis slowest; at most 200."""
    from itertools import product

    rows = list(product(*axes.values()))
    if len(rows) > 200:
        raise ValueError("more than 200 variants")
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "variant_no int, " + ", ".join(f"{a} string" for a in axes))


def nearest_rank(values: Iterator[float], p: float) -> float:
    ordered = sorted(values)
    return ordered[min(len(ordered) - 1, max(0, int(np.ceil(p * len(ordered))) - 1))] if ordered else 0.0


def resolve_gold(gold: DataFrame, pages: DataFrame) -> DataFrame:
    """Where each quote of ``doc_id, qid, gold_ix, page_no, quote`` stands in its document: ``start, end`` in the document's text and
    ``code``, null where it stands there once.  White space is matched loosely.

    ``pages`` are ``doc_id, page_no, text, char_start``, their texts in UTF-16 units within the document.  The codes are
    ``page-missing``, ``quote-not-found`` (a blank quote too) and ``quote-ambiguous``.  Quotes and pages meet by document and page, so
    a document's pages spread over tasks."""
    own = pages.select("doc_id", "page_no", "text", F.col("char_start").alias("page_start")).dropDuplicates(["doc_id", "page_no"])
    joined = gold.join(own.withColumn("there", F.lit(True)), ["doc_id", "page_no"], "left")
    words = F.filter(F.split(F.trim(F.regexp_replace("quote", r"\s+", " ")), " "), lambda w: w != "")
    escaped = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), F.replace(w, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    pattern = F.array_join(escaped, r"\s+")
    asked = joined.withColumn("pattern", F.when(F.size(words) > 0, pattern))
    hits = F.when(F.col("there") & F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0)))
    found = asked.withColumn("hits", hits)
    times = F.coalesce(F.size("hits"), F.lit(0))
    code = F.when(F.col("there").isNull(), "page-missing").when(F.col("hits").isNull() | (times == 0), "quote-not-found").when(times > 1, "quote-ambiguous")
    first = F.get("hits", F.lit(0))
    before = utf16_units(F.substring("text", F.lit(1), F.instr("text", first) - 1))
    start = F.when(code.isNull(), F.col("page_start") + before)
    out = found.withColumn("code", code).withColumn("start", start.cast("int"))
    return out.select("doc_id", "qid", "gold_ix", "page_no", "quote", "start", (F.col("start") + utf16_units(first)).cast("int").alias("end"), "code")


def dataset_violations(questions: DataFrame, pages: DataFrame | None = None, page_count: int | None = None, least: int = 40, least_unanswerable: int = 5) -> DataFrame:
    """``code, qid`` of every rule that a labelled set ``qid, question, kind, gold`` breaks.

    ``pages`` are the pages of the one document that the labels were written for, ``page_count`` its length; without them only the set
    itself is judged."""
    only = lambda df, code: df.select(F.lit(code).alias("code"), "qid")
    none = lambda df, code: df.select(F.lit(code).alias("code"), F.lit(None).cast("string").alias("qid"))
    kinds = ("factual", "multi-part", "unanswerable")
    sizes = questions.agg(F.count("*").alias("n"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds])
    missing = sizes.select(F.explode(F.array(*[F.when(F.col(k) == 0, k) for k in kinds])).alias("k")).filter("k IS NOT NULL")
    nth = lambda by: F.row_number().over(Window.partitionBy(by).orderBy("qid", "question"))
    parts = [
        none(sizes.filter(F.col("n") < least), "too-few-questions"), none(missing, "missing-kind"), none(sizes.filter(F.col("unanswerable") < least_unanswerable), "too-few-unanswerable"),
        only(questions.withColumn("nth", nth(F.col("qid"))).filter("nth > 1"), "duplicate-id"), only(questions.withColumn("nth", nth(F.lower(F.trim("question")))).filter("nth > 1"), "duplicate-question"),
    ]
    gold = questions.select("qid", F.posexplode("gold").alias("gold_ix", "g")).select("qid", "gold_ix", F.col("g.page").alias("page_no"), F.col("g.quote").alias("quote"))
    if page_count is not None:
        parts.append(only(gold.filter(F.col("page_no") > page_count), "page-out-of-range"))
    if pages is not None:
        resolved = resolve_gold(gold.withColumn("doc_id", F.lit("")), pages.withColumn("doc_id", F.lit("")))
        parts.append(resolved.filter("code IS NOT NULL").select("code", "qid"))
    return reduce(DataFrame.unionByName, parts)
