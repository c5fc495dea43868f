"""Rated answers become labelled questions: which are added, which go to a person, which are left, and why.

Only the data steps: latest rating of an answer, first answer of a question, cited passages that are found once on one page, and ids that
go on after the highest."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .accounting import latest_per_answer
from .evaluation import resolve_gold

#: The reference answer of a question that the book does not answer (fixed value).
NOT_COVERED = "The book does not cover this."


def next_version(column):
    """The version after ``v<N>``; null for other names."""
    number = F.regexp_extract(column, r"^v([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("v"), (number.cast("bigint") + 1).cast("string")))


def classify(ratings: DataFrame, questions: DataFrame, pages: DataFrame, doc_id: str) -> DataFrame:
    """``answer_id, question, outcome, reason, answer, gold``: each rated answer as ``add``, ``review`` or ``skip``.

    ``ratings`` hold ``answer_id, line_no, doc_id, question, rating, answer, refusal`` and ``citations``, an array of ``number,
    page_start, page_end, quote``; ``pages`` are those of the labelled document ``doc_id``.  Of a question that several answers ask
    the one that is first in the log settles it, and the others are known."""
    last = latest_per_answer(ratings.select("answer_id", "line_no", "doc_id", "question", "rating", "answer", "refusal", "citations"))
    rows = last.withColumn("key", X.question_key(F.col("question")))
    known = questions.select(X.question_key(F.col("question")).alias("key")).distinct().withColumn("known", F.lit(True))
    rows = rows.join(known, "key", "left")
    # quotes of the numbers that the answer cites, each on one page and found there once
    cited = rows.select("answer_id", F.col("answer"), F.explode("citations").alias("c")).filter(F.array_contains(X.cited_numbers(F.col("answer")), F.col("c.number").cast("bigint")))
    gold = cited.select(F.lit(doc_id).alias("doc_id"), F.col("answer_id").alias("qid"), F.col("c.number").alias("gold_ix"), F.col("c.page_start").alias("page_no"), F.trim("c.quote").alias("quote"), (F.col("c.page_start") == F.col("c.page_end")).alias("one"))
    found = resolve_gold(gold.filter("one"), pages.withColumn("doc_id", F.lit(doc_id))).filter("code IS NULL")
    labels = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("gold_ix", "page_no", "quote"))).alias("gold")).withColumnRenamed("qid", "answer_id")
    counts = cited.groupBy("answer_id").agg(F.count("*").alias("cited"))
    rows = rows.join(labels, "answer_id", "left").join(counts, "answer_id", "left").na.fill(0, ["cited"])
    bare = F.trim(F.regexp_replace(X.without_marks(F.coalesce("answer", F.lit(""))), r"\s+", " "))
    declined = F.col("refusal").isNotNull() & (F.trim(F.coalesce("answer", F.lit(""))) == "") & (F.coalesce(F.size("citations"), F.lit(0)) == 0)
    why = (
        F.when(F.col("doc_id").isNull(), "no document").when(F.col("doc_id") != doc_id, "another document").when(F.col("known"), "known question").when(F.col("rating") == "down", "rated down")
        .when(declined, "declined").when(bare == "", "no answer").when(F.col("cited") == 0, "no source").when(F.col("gold").isNull(), "no passage found").otherwise("labelled")
    )
    judged = rows.withColumn("reason", why).withColumn("answer", bare)
    settles = F.col("reason").isin("rated down", "declined", "no passage found", "labelled")
    order = Window.partitionBy("key").orderBy(F.when(settles, 0).otherwise(1), "line_no")
    judged = judged.withColumn("nth", F.row_number().over(order)).withColumn("reason", F.when(settles & (F.col("nth") > 1), "known question").otherwise(F.col("reason")))
    outcome = F.when(F.col("reason").isin("labelled", "declined"), "add").when(F.col("reason").isin("rated down", "no passage found"), "review").otherwise("skip")
    return judged.withColumn("outcome", outcome).select("answer_id", "line_no", "question", "outcome", "reason", "answer", "gold")


def promote(classified: DataFrame, questions: DataFrame, last_id: int | None = None) -> DataFrame:
    """The next version of a labelled set ``qid, question, kind, answer, gold``: the questions it has, and the added ones under ids that go
    on after the highest, in the order of the log.

    Ids have three digits and more of them beyond q999.  With ``last_id`` they stop there by an error, as the reference's do at 999.  An id
    without a number, which no new id can equal, does not count.  Added questions are few (a person rated each), so one task numbers them."""
    last = questions.agg(F.coalesce(F.max(F.substring("qid", 2, 20).try_cast("bigint")), F.lit(0).cast("bigint")).alias("last"))
    added = classified.filter("outcome = 'add'").crossJoin(F.broadcast(last)).withColumn("n", F.col("last") + F.row_number().over(Window.orderBy("line_no", "answer_id")))
    gold = F.transform(F.coalesce("gold", F.array().cast("array<struct<gold_ix:int,page_no:int,quote:string>>")), lambda g: F.struct(g["page_no"].cast("int").alias("page"), g["quote"].alias("quote")))
    declined = F.col("reason") == "declined"
    pages = F.size(F.array_distinct(F.transform(gold, lambda g: g["page"])))
    kind = F.when(declined, "unanswerable").when(pages > 1, "multi-part").otherwise("factual")
    qid = F.format_string("q%03d", "n")
    if last_id is not None:
        qid = F.when(F.col("n") > last_id, F.raise_error(F.lit(f"question ids stop at q{last_id}")).cast("string")).otherwise(qid)
    fresh = added.select(
        qid.alias("qid"), F.trim("question").alias("question"), kind.alias("kind"),
        F.when(declined, F.lit(NOT_COVERED)).otherwise(F.col("answer")).alias("answer"), gold.alias("gold"),
    )
    return questions.select("qid", "question", "kind", "answer", "gold").unionByName(fresh)
