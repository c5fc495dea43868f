"""Usage, cost, traces, rate windows and the log of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X


def usage_totals(calls: DataFrame) -> DataFrame:
    """Totals by kind of call: ``kind, calls, failed, prompt_tokens, output_tokens, without_tokens, latency_ms``."""
    return calls.groupBy("kind").agg(
        F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("prompt_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"),
        F.count_if((F.col("kind") == "model") & F.col("prompt_tokens").isNull() & F.col("output_tokens").isNull()).alias("without_tokens"),
        F.sum("latency_ms").alias("latency_ms"),
    )


def usage_cost(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by model, ``model_id, cost, unpriced_tokens``; models without a price keep their tokens apart."""
    tokens = F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    cost = (F.coalesce("prompt_tokens", F.lit(0)) * F.col("input_per_million") + F.coalesce("output_tokens", F.lit(0)) * F.col("output_per_million")) / 1e6
    # sums of whole tokens first, so that the cost of a model is one product
    sums = calls.groupBy("model_id").agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("output_tokens").alias("output_tokens"))
    priced = sums.join(prices, "model_id", "left")
    return priced.select("model_id", F.coalesce(cost, F.lit(0.0)).alias("cost"), F.when(F.col("input_per_million").isNull(), tokens).otherwise(F.lit(0)).alias("unpriced_tokens"))


def trace_totals(trace: DataFrame) -> DataFrame:
    """How long each traced question took: the latest end of its stages."""
    return trace.groupBy("qid").agg(F.max(F.col("start_ms") + F.col("duration_ms")).alias("total_ms"), F.count_if(F.col("status") != "ok").alias("errors"))


def rate_window(calls: DataFrame, key: str, at: str, window_s: int, limit: int) -> DataFrame:
    """Starts within the rolling window up to each call, ``in_window``, and whether it is over the limit."""
    micros = F.unix_micros(at)
    frame = Window.partitionBy(key).orderBy(micros).rangeBetween(-(window_s * 1_000_000 - 1), 0)
    return calls.withColumn("in_window", F.count("*").over(frame)).withColumn("over_limit", F.col("in_window") > limit)


def latest_per_answer(ratings: DataFrame, key: str = "answer_id", order: str = "line_no") -> DataFrame:
    """The last rating of each answer in the log; partial maxima come before the shuffle."""
    rest = [c for c in ratings.columns if c not in (key, order)]
    best = ratings.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"), F.max(order).alias(order))
    return best.select(key, order, *[F.col(f"r.{c}").alias(c) for c in rest])


def question_groups(ratings: DataFrame) -> DataFrame:
    """Ratings by what makes questions the same: ``question_key, answers, up, down``."""
    return ratings.groupBy(X.question_key(F.col("question")).alias("question_key")).agg(
        F.count("*").alias("answers"), F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down")
    )


def known_questions(ratings: DataFrame, dataset: DataFrame) -> DataFrame:
    """Ratings whose question the dataset lacks."""
    known = dataset.select(X.question_key(F.col("question")).alias("k")).distinct()
    return ratings.withColumn("k", X.question_key(F.col("question"))).join(known, "k", "left_anti").drop("k")


def last_turns(turns: DataFrame, conversation: str, order: str, n: int = 4) -> DataFrame:
    """The turns before each turn that a follow-up may look back on, oldest first."""
    frame = Window.partitionBy(conversation).orderBy(order).rowsBetween(-n, -1)
    return turns.withColumn("history", F.collect_list("text").over(frame))
