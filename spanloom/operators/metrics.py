"""Scores of retrieval and their roll-ups; every rate comes with its denominator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.spans import covered, covered_in, overlap, touches

SPANS = "array<struct<start:int,end:int>>"
CURVE = (1, 3, 5, 10, 20, 50)
#: Sums of these have eleven digits before the point.
RECIPROCAL = "decimal(28,27)"
# Least and greatest rank of each bucket.
BUCKETS = (("1", 1, 1), ("2-3", 2, 3), ("4-5", 4, 5), ("6-10", 6, 10), ("11-20", 11, 20), ("21-50", 21, 50))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or nothing was summed."""
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def score_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``hit, gold_chars_hit, gold_chars_total, retrieved_chars`` from their arrays ``retrieved`` and ``gold_spans``.

    Overlapping spans count once on either side. A row without gold has no hit and zeros for gold.
    """
    return (
        rows.withColumn("hit", touches(F.col("retrieved"), F.col("gold_spans")))
        .withColumn("gold_chars_hit", covered_in(F.col("gold_spans"), F.col("retrieved")))
        .withColumn("gold_chars_total", covered(F.col("gold_spans")))
        .withColumn("retrieved_chars", covered(F.col("retrieved")))
    )


def score_rankings(rankings: DataFrame, eval_rows: DataFrame, k: int = 5) -> DataFrame:
    """Scores of the first ``k`` spans for each eval row (``query_id``); a row without a ranking has retrieved nothing."""
    top = rankings.where(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end"))).alias("retrieved"))
    joined = eval_rows.join(top, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast(SPANS)))
    return score_rows(joined)


def roll_up(scores: DataFrame, *by: str) -> DataFrame:
    """One row (or one a group): scored and skipped rows, hit rate, recall and density in characters (ratios of sums), mean size.

    Rows without gold are skipped but counted. Without any scored row all figures are 0.
    """
    gold = F.col("has_gold_span")

    def total(c: str) -> Column:
        return F.coalesce(F.sum(F.when(gold, F.col(c))), F.lit(0))

    n = F.count_if(gold)
    return scores.groupBy(*by).agg(
        n.alias("n_scored"),
        F.count_if(~gold).alias("n_skipped_no_gold"),
        ratio(F.count_if(gold & F.col("hit")), n).alias("hit_rate"),
        ratio(total("gold_chars_hit"), total("gold_chars_total")).alias("gold_recall"),
        ratio(total("gold_chars_hit"), total("retrieved_chars")).alias("gold_density"),
        ratio(total("retrieved_chars"), n).alias("mean_retrieved_chars"),
    )


def first_gold_rank(rankings: DataFrame, eval_rows: DataFrame) -> DataFrame:
    """Scored rows with ``first_rank``: the first rank whose span touches gold, null if none does."""
    gold = eval_rows.where("has_gold_span").select("query_id", F.explode("gold_spans").alias("g")).select("query_id", F.col("g.start").alias("s"), F.col("g.end").alias("e"))
    hits = rankings.join(gold, "query_id").where(overlap(F.col("start_char"), F.col("end_char"), F.col("s"), F.col("e")) > 0)
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return eval_rows.where("has_gold_span").select("query_id", "contract_id", "category").join(first, "query_id", "left")


def rank_curve(first: DataFrame, ks: tuple[int, ...] = CURVE, base: int = 5) -> DataFrame:
    """Rows ``k, hit_rate, gain``: share of rows found by rank k, and its gain over k = ``base``."""
    rates = [ratio(F.count_if(F.col("first_rank") <= k), F.count("*")).alias(f"k{k}") for k in (*ks, base)]
    one = first.agg(*[r.alias(f"r{i}") for i, r in enumerate(rates)])
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{i}").alias("hit_rate"), (F.col(f"r{i}") - F.col(f"r{len(ks)}")).alias("gain")) for i, k in enumerate(ks)])
    return one.select(F.inline(rows))


def rank_buckets(first: DataFrame) -> DataFrame:
    """Rows ``bucket, n, share`` for all buckets, empty ones too."""
    label = F.lit("not found")
    for name, low, high in reversed(BUCKETS):
        label = F.when(F.col("first_rank").between(low, high), F.lit(name)).otherwise(label)
    counts = [F.count_if(F.col("bucket") == name).alias(f"b{i}") for i, name in enumerate([*(b[0] for b in BUCKETS), "not found"])]
    one = first.withColumn("bucket", label).agg(*counts, F.count("*").alias("all"))
    names = [*(b[0] for b in BUCKETS), "not found"]
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("bucket"), F.col(f"b{i}").alias("n"), ratio(F.col(f"b{i}"), F.col("all")).alias("share")) for i, n in enumerate(names)])))


def rank_summary(first: DataFrame) -> DataFrame:
    """Mean reciprocal rank (0 for rows not found), and median and mean rank of those found.

    Reciprocals are summed and divided as decimals and become a double at the end, so the order of rows changes no digit.
    """
    reciprocal = (F.lit(1).cast(RECIPROCAL) / F.col("first_rank")).cast(RECIPROCAL)
    mrr = F.try_divide(F.sum(reciprocal), F.count("*")).cast("double")
    return first.agg(
        F.count("*").alias("n"),
        F.count("first_rank").alias("n_found"),
        F.coalesce(mrr, F.lit(0.0)).alias("mrr"),
        F.percentile("first_rank", F.lit(0.5)).alias("median_rank"),
        F.avg("first_rank").alias("mean_rank"),
    )


def category_hits(first: DataFrame, k: int = 5, min_rows: int = 20) -> DataFrame:
    """Rows ``category, n, hit_rate`` at rank k of categories with enough rows."""
    return first.groupBy("category").agg(F.count("*").alias("n"), ratio(F.count_if(F.col("first_rank") <= k), F.count("*")).alias("hit_rate")).where(F.col("n") >= min_rows)


def worst_and_best(rates: DataFrame, worst: int = 12, best: int = 5, by: str = "category", rate: str = "hit_rate") -> DataFrame:
    """The worst and best groups of a report, with ``side`` and ``place``; equal rates in the order of the name."""
    low = rates.orderBy(F.asc(rate), by).limit(worst).withColumn("side", F.lit("worst")).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(F.asc(rate), by)))
    high = rates.orderBy(F.desc(rate), by).limit(best).withColumn("side", F.lit("best")).withColumn("place", F.row_number().over(Window.partitionBy("side").orderBy(F.desc(rate), by)))
    return low.unionByName(high)


def clamp_depth(depth: Column | int, n_segments: Column, n_windows: Column) -> Column:
    """How deep a ranking can go."""
    return F.least(depth if isinstance(depth, Column) else F.lit(depth), n_segments, n_windows)


def eval_counters(eval_rows: DataFrame, contracts: DataFrame) -> DataFrame:
    """Contracts, rows, rows with gold, without, with several spans, and spans whose text isn't at their place."""
    texts = contracts.select("contract_id", "context")
    spans = eval_rows.select("contract_id", F.explode("gold_spans").alias("g")).join(texts, "contract_id")
    wrong = spans.where(F.expr("substring(context, g.start + 1, g.end - g.start) <> g.text")).agg(F.count("*").alias("n_offset_mismatches"))
    size = F.size("gold_spans")
    rows = eval_rows.agg(
        F.countDistinct("contract_id").alias("n_contracts"),
        F.count("*").alias("n_rows"),
        F.count_if(size > 0).alias("n_with_gold"),
        F.count_if(size == 0).alias("n_empty"),
        F.count_if(size > 1).alias("n_multi_span"),
    )
    return rows.join(wrong, F.lit(True))


def offset_mismatches(eval_rows: DataFrame, contracts: DataFrame, keep: int = 5) -> DataFrame:
    """The first few gold spans whose text isn't at their place, in the order of contract, category and start."""
    spans = eval_rows.select("contract_id", "category", F.explode("gold_spans").alias("g")).join(contracts.select("contract_id", "context"), "contract_id")
    found = spans.withColumn("found", F.expr("substring(context, g.start + 1, g.end - g.start)")).where(F.col("found") != F.col("g.text"))
    return found.select("contract_id", "category", F.col("g.start").alias("start"), F.col("g.end").alias("end"), F.col("g.text").alias("expected"), "found").orderBy("contract_id", "category", "start").limit(keep)


def label_stats(labelled: DataFrame) -> DataFrame:
    """Rows ``category, n_positive, n_contracts``."""
    return labelled.select("contract_id", F.explode("labels").alias("category")).groupBy("category").agg(F.count("*").alias("n_positive"), F.countDistinct("contract_id").alias("n_contracts"))


def label_summary(labelled: DataFrame) -> DataFrame:
    """Segments with and without labels, and the spread of positives over categories (upper median)."""
    has = F.size("labels") > 0
    seg = labelled.agg(F.count("*").alias("n_segments"), F.count_if(has).alias("n_labelled"), F.count_if(~has).alias("n_unlabelled"))
    positives = F.sort_array(F.collect_list("n_positive"))
    # One number a category: a few dozen.
    cats = label_stats(labelled).agg(
        F.min("n_positive").alias("min_positive"),
        F.get(positives, F.floor(F.size(positives) / 2).cast("int")).alias("median_positive"),
        F.max("n_positive").alias("max_positive"),
        F.count_if(F.col("n_positive") < 50).alias("n_under_50"),
        F.count_if(F.col("n_positive") < 100).alias("n_under_100"),
    )
    return seg.join(cats, F.lit(True))


def capture_rate(captured: DataFrame) -> DataFrame:
    return captured.agg(F.count("*").alias("n_gold_spans"), F.count_if("captured").alias("n_captured"), ratio(F.count_if("captured"), F.count("*")).alias("capture_rate"))


def ceiling(reach: DataFrame, *by: str) -> DataFrame:
    return reach.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("reachable").alias("n_reachable"), ratio(F.count_if("reachable"), F.count("*")).alias("ceiling"))


def describe(rows: DataFrame, column: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90, 95, 99)) -> DataFrame:
    """Count, mean, sample deviation, least and greatest value and exact percentiles."""
    c = F.col(column)
    return rows.agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        *[F.percentile(c, F.lit(p / 100)).alias(f"p{p}") for p in percents],
    )


def clipped(rows: DataFrame, column: str, quantile: float = 0.99, out: str = "clipped") -> DataFrame:
    """``column`` cut off at a quantile of the table."""
    top = rows.agg(F.percentile(F.col(column), F.lit(quantile)).alias("__top"))
    return rows.join(F.broadcast(top), F.lit(True)).withColumn(out, F.least(F.col(column).cast("double"), F.col("__top"))).drop("__top")


def histogram(rows: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Rows ``bin, n`` of equal widths between least and greatest value, the greatest in the last bin; empty bins are left out."""
    ends = rows.agg(F.min(column).cast("double").alias("__lo"), F.max(column).cast("double").alias("__hi"))
    c = F.col(column).cast("double")
    at = F.when(F.col("__hi") > F.col("__lo"), F.least(F.lit(bins - 1), F.floor((c - F.col("__lo")) * bins / (F.col("__hi") - F.col("__lo"))))).otherwise(F.lit(0))
    return rows.where(F.col(column).isNotNull()).join(F.broadcast(ends), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def imbalance(counts: DataFrame, count: str = "n") -> DataFrame:
    """The largest count over the least."""
    return counts.agg(F.max(count).alias("largest"), F.min(count).alias("least"), ratio(F.max(count), F.min(count)).alias("imbalance"))


def nth_longest(rows: DataFrame, length: str, n: int, key: str) -> DataFrame:
    """The row of the n-th greatest length (from 0), equal ones in the order of ``key``."""
    return rows.orderBy(F.desc(length), key).offset(n).limit(1)
