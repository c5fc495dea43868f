"""Mixing sources to target shares (problem 7).

Weighted fair queueing: the documents of each source are shuffled by a hash, and each gets a virtual finish time, the
tokens of its source up to and with it divided by the source's target share; repeats go on where the last pass ended.
Sorted by finish time, every prefix holds the sources near their shares, and the mix is the prefix of the budget.

Running sums never gather a source: its documents are dealt by their hash into bins of about BIN documents, a running
sum over the few bin totals gives each bin its start, and only a bin is summed in order.  How far virtual time must run follows
from the supply of the sources alone (:func:`last_time`); documents and repeats that would finish later are dropped before they are
written.  The cut within what is left is found by totals of finish-time ranges, parted again until a range holds at most EDGE rows.

Results for odd input: null and empty texts have no tokens and take no part; documents of a null source, or of one without
a target, are counted in the total but not mixed; a target without documents, with a share of 0 or less, or with max_repeats
of 0, less or null is reported with nothing mixed; only the ratios of the shares matter to the mix, so they need not sum to 1; a source
named by several targets takes each of them; repeated documents count each time they are delivered; an empty table gives a report without tokens.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cluster import join_side, materialize

BIN = 2_000
RANGES = 4096
#: Rows that are put in order by one task to find the cut.
EDGE = 50_000
#: Classes of running-out times that the driver sees, for each doubling.
STEPS = 16
SEED = 17


def source_supply(docs: DataFrame, targets: DataFrame, source_col: str = "source", tokens_col: str = "tokens") -> DataFrame:
    """``source, target_share, max_repeats, tokens, documents, longest, budget, short``: what each target has and needs of a
    budget of all tokens; ``short`` where even all repeats cannot reach the share.  One row for each target."""
    supply = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(tokens_col).alias("tokens"), F.count("*").alias("documents"), F.max(tokens_col).alias("longest"))
    supply = materialize(supply)
    whole = supply.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("budget"))  # one row
    goals = targets.select("source", "target_share", "max_repeats")
    joined = goals.join(F.broadcast(whole)).join(supply, "source", "left").na.fill(0, ["tokens", "documents", "longest"])
    return joined.withColumn("short", F.coalesce(F.col("target_share") * F.col("budget") > F.coalesce("max_repeats", F.lit(0)) * F.col("tokens"), F.lit(False)))


def last_time(supply: DataFrame, size: float) -> float:
    """A virtual time by which the sources ``weight, max_repeats, pass_tokens, longest`` have surely yielded ``size`` tokens.

    A source yields its weight in each unit of time until all its repeats are used up, less at most one document.  The driver
    sees sums by class of running-out time, STEPS for each doubling, however many sources there are."""
    all_tokens = F.col("max_repeats") * F.col("pass_tokens")
    step = F.floor(F.log2(all_tokens / F.col("weight")) * STEPS).cast("int")
    classes = supply.groupBy(step.alias("step")).agg(F.sum(all_tokens).alias("all"), F.sum("weight").alias("weight"), F.sum("longest").alias("longest")).orderBy("step").collect()
    used, weight, slack = 0.0, sum(c["weight"] for c in classes), float(sum(c["longest"] for c in classes))
    least = 0.0
    for c in classes:
        # nothing of this class runs out before the time it begins at
        time = max(least, (size - used + slack) / weight) * (1 + 1e-9)
        if time <= 2.0 ** (c["step"] / STEPS):
            return time
        used, weight, slack = used + float(c["all"]), max(weight - c["weight"], 1e-300), slack - float(c["longest"])
        least = 2.0 ** ((c["step"] + 1) / STEPS)
        if used >= size:
            return least * (1 + 1e-9)
    return inf


def _first_tokens(timed: DataFrame, size: int) -> DataFrame:
    """The rows of ``timed``, in order of finish time, whose tokens before them are fewer than ``size``."""
    ends = timed.agg(F.min("finish").alias("low"), F.max("finish").alias("high"), F.sum("tokens").alias("t"), F.count("*").alias("n")).first()
    if not ends["n"] or ends["t"] <= size:
        return timed
    low, high, before, rows = ends["low"], ends["high"], 0, ends["n"]
    taken, edge = F.lit(False), F.lit(True)
    while rows > EDGE and high > low:
        width = (high - low) / RANGES
        range_ = F.least(F.floor((F.col("finish") - low) / width).cast("int"), F.lit(RANGES - 1))
        sums = timed.filter(edge).groupBy(range_.alias("range")).agg(
            F.sum("tokens").alias("t"), F.count("*").alias("n"), F.min("finish").alias("low"), F.max("finish").alias("high")
        )  # at most RANGES rows
        for r in sorted(sums.collect(), key=lambda r: r["range"]):
            if before + r["t"] >= size:
                break
            before += r["t"]
        if (r["low"], r["high"]) == (low, high):
            break
        low, high, rows = r["low"], r["high"], r["n"]
        taken, edge = F.col("finish") < low, F.col("finish").between(low, high)
    # at equal times each source has one row at most, so this holds no more than EDGE rows or one for each source
    order = Window.orderBy("finish", "source", "id", "repeat").rowsBetween(Window.unboundedPreceding, -1)
    last = timed.filter(edge).withColumn("total", F.coalesce(F.sum("tokens").over(order), F.lit(0)) + before).filter(F.col("total") < size).drop("total")
    return timed.filter(taken).unionByName(last)


def mix_sources(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens_col: str = "tokens",
                budget: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix ``doc_id, source, repeat, tokens, finish`` and its report, one row for each target:
    ``source, target_share, max_repeats, tokens, documents, budget, short, mixed_tokens, actual_share, most_repeats``.

    The order of the mix is that of ``finish``.  The budget defaults to the tokens of all documents; the last document of the
    prefix may pass it by its own length."""
    narrow = materialize(
        docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(tokens_col).cast("bigint").alias("tokens")).filter(F.col("tokens") > 0)
    )
    supply = materialize(source_supply(narrow, targets))
    able = supply.filter((F.col("target_share") > 0) & (F.col("tokens") > 0) & (F.col("max_repeats") > 0)).select(
        "source", F.col("target_share").cast("double").alias("weight"), "max_repeats", F.col("tokens").alias("pass_tokens"), "longest",
        F.greatest(F.lit(1), F.ceil(F.col("documents") / BIN)).cast("int").alias("bins"),
    )
    whole = supply.agg(F.max("budget")).first()[0]
    size = int(budget if budget is not None else whole or 0)
    until = last_time(able, size)
    queued = narrow.join(join_side(able), "source").withColumn("order", F.xxhash64("id", F.lit(SEED)))
    # the order's upper bits as a fraction give the bin, so bins follow each other in the order
    fraction = (F.shiftrightunsigned("order", 33).cast("double")) / float(1 << 31)
    queued = queued.withColumn("order", F.shiftrightunsigned("order", 1)).withColumn("bin", F.least(F.floor(fraction * F.col("bins")).cast("int"), F.col("bins") - 1))
    totals = queued.groupBy("source", "weight", "bin").agg(F.sum("tokens").alias("bin_tokens"))
    earlier = Window.partitionBy("source", "weight").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("source", "weight", "bin", F.coalesce(F.sum("bin_tokens").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "weight", "bin").orderBy("order", "id").rowsBetween(Window.unboundedPreceding, 0)
    # bins that begin after the last time are dropped whole, before they are put in order
    summed = queued.join(bases.filter(F.col("base") / F.col("weight") <= until), ["source", "weight", "bin"]).withColumn("sum", F.col("base") + F.sum("tokens").over(inside))
    in_time = F.floor((F.lit(until) * F.col("weight") - F.col("sum")) / F.col("pass_tokens"))
    last = F.least(F.col("max_repeats") - 1, in_time).cast("int") if until < inf else F.col("max_repeats") - 1
    repeats = F.when(last >= 0, F.sequence(F.lit(0), last))
    timed = materialize(
        summed.select("id", "source", "tokens", "weight", "pass_tokens", "sum", F.explode(repeats).alias("repeat"))
        .withColumn("finish", (F.col("repeat") * F.col("pass_tokens") + F.col("sum")) / F.col("weight"))
        .select("id", "source", "repeat", "tokens", "finish")
    )
    chosen = _first_tokens(timed, size).select(F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("repeat").cast("int"), "tokens", "finish")
    reached = materialize(chosen.groupBy(F.col(source_col).alias("source")).agg(F.sum("tokens").alias("mixed_tokens"), (F.max("repeat") + 1).alias("most_repeats")))
    mixed = reached.agg(F.sum("mixed_tokens").alias("mixed"))  # one row
    report = supply.drop("longest").join(reached, "source", "left").na.fill(0, ["mixed_tokens", "most_repeats"]).join(F.broadcast(mixed))
    report = report.withColumn("actual_share", F.coalesce(F.try_divide(F.col("mixed_tokens"), F.col("mixed")), F.lit(0.0))).drop("mixed")
    return chosen, report
