"""Multi-label classification of segments: features, splits by contract, one model a category, thresholds, gated levers."""

from __future__ import annotations

import math
import random
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import drawn, tokens, word_ngrams
from spanloom.operators.metrics import ratio

SEED, TEST, VALIDATION = 42, 0.2, 0.16
MIN_DF, MAX_DF = 3, 0.9
GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))
SCHEME_COLUMNS = ("article", "section_nn", "bare_nn", "fallback")
STRUCTURAL = (
    "relative_position", "is_first", "is_last", "is_preamble", "log_char_len", "is_oversized_split", "is_undersized", "has_parent", "header_tokens", "header_has_digit",
    *(f"scheme_{s}" for s in SCHEME_COLUMNS),
)


def _plain_letters() -> tuple[str, str]:
    """Letters that compatibility decomposition makes one letter and marks, with that letter, and the marks, which go."""
    found = {}
    for c in map(chr, range(0x80, 0x2FA20)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c != bare and len(bare) == 1 and not 0xAC00 <= ord(c) < 0xD7A4:
            found[c] = bare
    marks = "".join(c for c in map(chr, range(0x300, 0x1E95B)) if unicodedata.combining(c))
    return "".join(found) + marks, "".join(found.values())


#: Accents and other marks that are taken off before words are cut. What decomposes into several letters (ligatures, fractions, Hangul) stays whole.
ACCENTS = _plain_letters()


def structural(rows: DataFrame) -> DataFrame:
    """``rows`` with the fourteen structural columns as doubles; schemes outside SCHEME_COLUMNS have zeros for all four."""
    header = F.coalesce("header", F.lit(""))
    values = {
        "relative_position": F.col("relative_position"),
        "is_first": F.col("position") == 0,
        "is_last": F.col("position") == F.col("n_segments_in_contract") - 1,
        "is_preamble": header == "[preamble]",
        "log_char_len": F.log1p("char_len"),
        "is_oversized_split": F.col("is_oversized_split"),
        "is_undersized": F.col("is_undersized"),
        "has_parent": F.col("has_parent"),
        "header_tokens": F.size(F.filter(F.split(header, r"\s+"), lambda w: w != "")),
        "header_has_digit": F.rlike(header, F.lit("[0-9]")),
        **{f"scheme_{s}": F.coalesce(F.col("scheme") == s, F.lit(False)) for s in SCHEME_COLUMNS},
    }
    return rows.select(*[c for c in rows.columns if c not in STRUCTURAL], *[v.cast("double").alias(k) for k, v in values.items()])


def fit_ranges(train: DataFrame, columns: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """One row with the least and greatest value of each column of the training rows."""
    return train.agg(*[f(c).alias(f"{c}__{n}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])


def scaled(rows: DataFrame, ranges: DataFrame, columns: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """Columns scaled by the training ranges and clipped to 0..1; a column that is constant there becomes its offset from it, clipped."""
    joined = rows.join(F.broadcast(ranges), F.lit(True))

    def of(c: str) -> Column:
        width = F.when(F.col(f"{c}__hi") > F.col(f"{c}__lo"), F.col(f"{c}__hi") - F.col(f"{c}__lo")).otherwise(F.lit(1.0))
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - F.col(f"{c}__lo")) / width)).alias(c)

    return joined.select(*[of(c) if c in columns else F.col(c) for c in rows.columns])


def training_rows(labelled: DataFrame) -> DataFrame:
    """Labelled segments with position, counts and lengths for the classifier."""
    n = F.count("*").over(Window.partitionBy("contract_id")).cast("int")
    return (
        labelled.withColumn("n_segments_in_contract", n)
        .withColumn("char_len", F.char_length("text"))
        .withColumn("relative_position", F.col("position") / F.col("n_segments_in_contract"))
        .withColumn("has_parent", F.col("parent_id").isNotNull())
    )


def split_ids(ids: list[str], test: float = TEST, seed: int = SEED) -> tuple[list[str], list[str]]:
    """Training and test ids: sorted distinct ids, shuffled by the seed; the first ``max(1, round(test * n))`` are for the test."""
    own = sorted(set(ids))
    random.Random(seed).shuffle(own)
    n = max(1, round(test * len(own)))
    return own[n:], own[:n]


def split_three_ids(ids: list[str], test: float = TEST, validation: float = VALIDATION, seed: int = SEED) -> tuple[list[str], list[str], list[str]]:
    """Training, validation and test ids; validation is a share of all ids, and the test side is that of the two-way split."""
    pool, held = split_ids(ids, test, seed)
    train, val = split_ids(pool, validation / (1 - test), seed)
    return train, val, held


def _nth(ids: DataFrame, n: int, most: int) -> tuple[int, str | None]:
    """The n-th of distinct rows (hash, id) in order. The driver sees counts of 65,536 ranges of hashes, then one range, in finer ranges while it has over ``most`` ids."""
    for shift in (48, 32, 16, 0):
        part = F.shiftright("hash", shift)
        for r in ids.groupBy(part.alias("part")).count().orderBy("part").collect():
            if n <= r["count"]:
                break
            n -= r["count"]
        ids = ids.where(part == r.part)
        if r["count"] <= most:
            break
    return tuple(ids.orderBy("hash", "id").collect()[n - 1])


def split_by_contract(rows: DataFrame, test: float = TEST, validation: float = 0.0, seed: int = SEED, max_ids: int = 100_000) -> dict[str, DataFrame]:
    """``train``, ``test`` and, if asked for, ``validation`` parts; all rows of a contract are on one side.

    Contracts are ranked by a hash of seed and id: the first ranks are for the test, the next ones for validation, in the numbers of
    ``split_ids`` and ``split_three_ids``, and the others for training. The rule is the same at every size; ``max_ids`` bounds only the ids that the
    driver sees at once.
    """
    own = F.col("contract_id").cast("string")
    place = F.struct(drawn(F.lit(seed), own).alias("hash"), own.alias("id"))
    ids = rows.select(F.inline(F.array(place))).distinct()
    n = ids.count()
    held = min(n, max(1, round(test * n)))
    ends = {"test": held} | ({"validation": min(n, held + max(1, round(validation / (1 - test) * (n - held))))} if validation else {})
    side = F.lit("train")
    for name, end in reversed(ends.items() if n else ()):
        last, least = _nth(ids, end, max_ids)
        side = F.when(place <= F.struct(F.lit(last).cast("long").alias("hash"), F.lit(least).cast("string").alias("id")), F.lit(name)).otherwise(side)
    return {name: rows.where(side == name) for name in ("train", *reversed(ends))}


def unaccented(text: Column) -> Column:
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), *ACCENTS)


@dataclass(frozen=True)
class TextFeatures:
    """TF-IDF of the classifier: sublinear counts, idf fitted on training rows, length one."""

    model: CountVectorizerModel
    idf: list[float]
    ngrams: tuple[int, int]
    stop: tuple[str, ...]

    @staticmethod
    def terms(ngrams: tuple[int, int], stop: tuple[str, ...]) -> Column:
        return word_ngrams(tokens(unaccented(F.col("text")), stop), *ngrams)

    @classmethod
    def fit(cls, train: DataFrame, ngrams: tuple[int, int] = (1, 1), min_df: int = MIN_DF, max_df: float = MAX_DF, stop: tuple[str, ...] = (), vocabulary: int = (1 << 31) - 1) -> TextFeatures:
        """Every term within ``min_df`` and ``max_df`` is a feature, unless ``vocabulary`` asks for the most frequent ones alone."""
        rows = train.select(cls.terms(ngrams, stop).alias("terms"))
        model = CountVectorizer(inputCol="terms", outputCol="tf", minDF=float(min_df), maxDF=float(max_df), vocabSize=vocabulary).fit(rows)
        index = F.explode(F.array_distinct(F.transform("terms", lambda t: t))).alias("term")
        n = rows.count()
        kept = {t: i for i, t in enumerate(model.vocabulary)}
        df = [0] * len(kept)
        for r in rows.select(index).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_df).toLocalIterator():
            if r.term in kept:
                df[kept[r.term]] = r.n
        return cls(model, [math.log((1 + n) / (1 + d)) + 1 for d in df], ngrams, stop)

    def transform(self, rows: DataFrame, out: str = "features", beside: tuple[str, ...] = ()) -> DataFrame:
        """``rows`` with the weighted vector, and the columns ``beside`` (of numbers) behind it in the same vector."""
        idf = rows.sparkSession.sparkContext.broadcast(np.array(self.idf))

        @F.udf(VectorUDT())
        def weigh(tf, more):  # noqa: ANN001, ANN202  the vector type has no Arrow form
            w = (1 + np.log(tf.values)) * idf.value[tf.indices] if len(tf.indices) else tf.values
            length = float(np.sqrt((w * w).sum())) or 1.0
            other = np.array(more, dtype=float)
            full = np.flatnonzero(other)
            return SparseVector(tf.size + len(other), np.concatenate([tf.indices, tf.size + full]), np.concatenate([w / length, other[full]]))

        counted = self.model.transform(rows.withColumn("terms", self.terms(self.ngrams, self.stop)))
        extra = F.array(*[F.col(c).cast("double") for c in beside]) if beside else F.array().cast("array<double>")
        return counted.withColumn(out, weigh("tf", extra)).drop("terms", "tf")


def similarity(features: DataFrame, definitions: DataFrame, out: str = "similarity") -> DataFrame:
    """Rows of ``features`` (weights in rows: id, term, weight) against ``definitions`` (category, term, weight): id, category, dot product."""
    pairs = features.join(definitions.withColumnRenamed("weight", "__w"), "term")
    return pairs.groupBy("id", "category").agg(F.sum(F.col("weight") * F.col("__w")).alias(out))


def categories_of(rows: DataFrame) -> list[str]:
    """Sorted distinct labels: the columns of the label matrix, a few dozen."""
    return [r[0] for r in rows.select(F.explode("labels").alias("c")).distinct().orderBy("c").collect()]


def with_target(rows: DataFrame, category: str) -> DataFrame:
    return rows.withColumn("target", F.array_contains("labels", category).cast("double"))


def tune_thresholds(probabilities: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Rows ``category, threshold`` from ``category, target, probability`` of validation rows: the best F1 of the grid, the lowest of equals, 0.5 without a positive.

    Each row is tested against the grid inside its own record; what is shuffled are counts by category and threshold.
    """
    grown = probabilities.select("category", "target", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), (F.col("probability") >= t).alias("p")) for t in grid])).alias("g"))
    counts = grown.groupBy("category", F.col("g.t").alias("t")).agg(
        F.count_if(F.col("g.p") & (F.col("target") == 1)).alias("tp"),
        F.count_if(F.col("g.p") & (F.col("target") == 0)).alias("fp"),
        F.count_if(~F.col("g.p") & (F.col("target") == 1)).alias("fn"),
    )
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    best = counts.withColumn("f1", f1).groupBy("category").agg(F.max(F.struct("f1", (-F.col("t")).alias("neg"))).alias("b"), F.max(F.col("tp") + F.col("fn")).alias("positives"))
    # No threshold beats an F1 of 0, which is where the search starts.
    chosen = F.when((F.col("positives") > 0) & (F.col("b.f1") > 0), -F.col("b.neg")).otherwise(F.lit(0.5))
    return best.select("category", chosen.alias("threshold"))


def precision_recall(decisions: DataFrame) -> DataFrame:
    """Rows ``category, tp, fp, fn, precision, recall, f1, support`` from ``category, target, predicted``."""
    hit, miss = F.col("predicted") == 1, F.col("target") == 1
    counts = decisions.groupBy("category").agg(F.count_if(hit & miss).alias("tp"), F.count_if(hit & ~miss).alias("fp"), F.count_if(~hit & miss).alias("fn"))
    return _rates(counts).withColumn("support", F.col("tp") + F.col("fn"))


def _rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def macro_micro(per_category: DataFrame) -> DataFrame:
    """Two rows: macro (means over categories) and micro (from pooled counts). Accuracy is left out: with rare labels it says nothing."""
    macro = per_category.agg(*[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")]).withColumn("average", F.lit("macro"))
    pooled = _rates(per_category.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])).drop("tp", "fp", "fn").withColumn("average", F.lit("micro"))
    return macro.unionByName(pooled).select("average", "precision", "recall", "f1")


def aggregation_depth(partitions: int) -> int:
    """Levels of the solver's sums over so many partitions after which the fewest of them go to the driver, each as long as the vocabulary.

    Spark divides the partitions by their root of this degree while that saves work; two levels leave about the square root of them.
    """

    def left(depth: int) -> int:
        n, scale = partitions, max(2, math.ceil(partitions ** (1 / depth)))
        while n > scale + math.ceil(n / scale):
            n //= scale
        return n

    return min((2, 3, 4), key=lambda depth: (left(depth), depth))


def fit_category(train: DataFrame, category: str, features: str = "features", max_iter: int = 100, reg: float = 0.0):
    """A logistic model with balanced class weights, or None if the training rows lack a positive (or a negative)."""
    rows = with_target(train, category)
    n = {r.target: r["count"] for r in rows.groupBy("target").count().collect()}
    if not n.get(1.0) or not n.get(0.0):
        return None
    total = n[0.0] + n[1.0]
    weight = F.when(F.col("target") == 1, total / (2.0 * n[1.0])).otherwise(total / (2.0 * n[0.0]))
    # The penalty of C = 1 over the sum of losses is 1 / n over their mean.
    model = LogisticRegression(featuresCol=features, labelCol="target", weightCol="weight", maxIter=max_iter, regParam=reg or 1.0 / total, aggregationDepth=aggregation_depth(train.rdd.getNumPartitions()))
    return model.fit(rows.withColumn("weight", weight))


def probabilities(model, rows: DataFrame, category: str) -> DataFrame:
    """``category, target, probability`` with the keys of the rows."""
    scored = model.transform(with_target(rows, category)).withColumn("probability", vector_to_array("probability")[1])
    return scored.select("contract_id", "segment_id", F.lit(category).alias("category"), "target", "probability")


@dataclass(frozen=True)
class Step:
    """One rung of the ladder."""

    name: str
    ngrams: tuple[int, int] = (1, 1)
    structural: bool = False
    thresholds: bool = False


LADDER: tuple[tuple[str, dict], ...] = (
    ("bigrams", {"ngrams": (1, 2)}),
    ("structural", {"structural": True}),
    ("thresholds", {"thresholds": True}),
)


def assemble(parts: dict[str, DataFrame], step: Step) -> dict[str, DataFrame]:
    """The feature column of a step for all parts; vocabulary, idf and ranges come from the training part alone."""
    text = TextFeatures.fit(parts["train"], step.ngrams)
    if not step.structural:
        return {k: text.transform(v) for k, v in parts.items()}
    own = {k: structural(v) for k, v in parts.items()}
    ranges = fit_ranges(own["train"])
    return {k: text.transform(scaled(v, ranges), beside=STRUCTURAL) for k, v in own.items()}


def run_step(parts: dict[str, DataFrame], step: Step, categories: list[str]) -> dict:
    """Fit a model a category and score the test part; categories without a training positive are listed as untrainable."""
    ready = {k: v.persist() for k, v in assemble(parts, step).items()}
    decided, untrainable, thresholds = None, [], {}
    for c in categories:
        model = fit_category(ready["train"], c)
        if model is None:
            untrainable.append(c)
            continue
        cut = 0.5
        if step.thresholds:
            cut = tune_thresholds(probabilities(model, ready["validation"], c)).collect()[0].threshold
        thresholds[c] = cut
        rows = probabilities(model, ready["test"], c).withColumn("predicted", (F.col("probability") >= cut).cast("int"))
        decided = rows if decided is None else decided.unionByName(rows)
    result = {"step": step, "untrainable": untrainable, "thresholds": thresholds, "per_category": [], "macro": None, "micro": None}
    if decided is not None:
        per = precision_recall(decided).persist()
        rates = {r.average: r.asDict() for r in macro_micro(per).collect()}
        result |= {"per_category": [r.asDict() for r in per.orderBy("category").collect()], "macro": rates["macro"], "micro": rates["micro"]}
        per.unpersist()
    for v in ready.values():
        v.unpersist()
    return result


def climb(parts: dict[str, DataFrame], categories: list[str], ladder: tuple[tuple[str, dict], ...] = LADDER, run: Callable[[dict, Step, list[str]], dict] = run_step) -> list[dict]:
    """Each lever on top of the best step so far; it stays only if macro F1 grows. Results in order, each with ``adopted``."""
    best = Step("control")
    results = [run(parts, best, categories) | {"adopted": True, "delta": 0.0}]
    score = (results[0]["macro"] or {"f1": 0.0})["f1"]
    for name, change in ladder:
        step = replace(best, name=name, **change)
        got = run(parts, step, categories)
        delta = (got["macro"] or {"f1": 0.0})["f1"] - score
        results.append(got | {"adopted": delta > 0, "delta": delta})
        if delta > 0:
            best, score = step, score + delta
    return results
