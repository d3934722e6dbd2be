"""Specified but optional parts: category filter before ranking and its ablation, risk flags, drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.metrics import ratio


def filter_by_category(segments: DataFrame, questions: DataFrame, labels: str = "labels") -> DataFrame:
    """Pairs of question and segment that a question's ``category_filter`` lets through; questions without one keep all segments of the contract."""
    pairs = questions.join(segments, "contract_id")
    return pairs.where(F.col("category_filter").isNull() | F.array_contains(labels, F.col("category_filter")))


def ask_fields(rows: DataFrame) -> DataFrame:
    """``filter_applied`` and the classifier's confidence in it, null when no filter was chosen."""
    on = F.col("category_filter").isNotNull()
    return rows.withColumn("filter_applied", on).withColumn("classifier_confidence_on_filter", F.when(on, F.col("confidence")))


def ablation(on: DataFrame, off: DataFrame, metric: str = "hit_rate") -> DataFrame:
    """One row: a metric with and without the filter, and the difference."""
    a, b = on.agg(F.first(metric).alias("on")), off.agg(F.first(metric).alias("off"))
    return a.join(b, F.lit(True)).withColumn("delta", F.col("on") - F.col("off"))


def risk_flags(contract_labels: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows ``contract_id, category, flag, weight`` from found categories (``contract_id, category``) and a rule table (``category, flag_if, flag, weight``).

    ``flag_if`` is ``present`` or ``absent``. Rules are a few dozen rows; each contract meets each absent-rule once, inside its own record.
    """
    found = contract_labels.groupBy("contract_id").agg(F.collect_set("category").alias("found"))
    table = rules.agg(F.collect_list(F.struct("category", "flag_if", "flag", "weight")).alias("rules"))
    both = found.join(F.broadcast(table), F.lit(True)).select("contract_id", "found", F.explode("rules").alias("r"))
    hit = F.array_contains("found", F.col("r.category")) == (F.col("r.flag_if") == "present")
    return both.where(hit).select("contract_id", "r.category", "r.flag", "r.weight")


def risk_scores(flags: DataFrame) -> DataFrame:
    return flags.groupBy("contract_id").agg(F.count("*").alias("n_flags"), F.sum("weight").alias("risk"))


def input_drift(base: DataFrame, now: DataFrame, column: str, edges: list[float]) -> DataFrame:
    """Population stability index of a column over fixed edges: 0 if both tables spread alike; shares of 0 count as one in 10,000."""
    c = F.col(column).cast("double")
    bin_ = sum((F.when(c >= e, 1).otherwise(0) for e in edges), F.lit(0)).alias("bin")

    def shares(df: DataFrame, name: str) -> DataFrame:
        counts = df.where(c.isNotNull()).groupBy(bin_).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("t"))
        return counts.join(total, F.lit(True)).select("bin", ratio(F.col("n"), F.col("t")).alias(name))

    both = shares(base, "p").join(shares(now, "q"), "bin", "full")
    p, q = (F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(1e-4)) for x in ("p", "q"))
    return both.agg(F.coalesce(F.sum((q - p) * F.log(q / p)), F.lit(0.0)).alias("psi"))


def embedding_drift(base: DataFrame, now: DataFrame, vector: str = "vector") -> DataFrame:
    """Cosine distance of the mean vectors of two tables; means are taken by place, before the shuffle."""

    def centre(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg(F.avg("x").alias(name))

    both = centre(base, "a").join(centre(now, "b"), "i")
    return both.agg((1 - F.sum(F.col("a") * F.col("b")) / F.sqrt(F.sum(F.col("a") * F.col("a")) * F.sum(F.col("b") * F.col("b")))).alias("centroid_distance"))
