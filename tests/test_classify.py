import math

import pytest
from pyspark.sql import functions as F

from spanloom.operators import classify as C

ROW = "contract_id string, segment_id string, text string, labels array<string>, position int, n_segments_in_contract int, char_len int, relative_position double, header string, scheme string, is_oversized_split boolean, is_undersized boolean, has_parent boolean"


def corpus(spark, n=40):
    rows = []
    for i in range(n):
        for p, (text, labels) in enumerate([(f"governing law of state number{i % 3}", ["Law"]), (f"audit of books and records number{i % 4}", ["Audit"]), ("filler words of no interest", [])]):
            rows.append((f"c{i:02d}", f"c{i:02d}_{p}", text, labels, p, 3, len(text), p / 3, "[preamble]" if p == 0 else f"Part {p}", "article" if p else "int_dot_inline", False, True, False))
    return spark.createDataFrame(rows, ROW)


def test_split_properties(spark):
    ids = [f"c{i}" for i in range(50)]
    train, test = C.split_ids(ids)
    assert len(test) == 10 and not set(train) & set(test) and set(train) | set(test) == set(ids)
    assert C.split_ids(reversed(ids)) == (train, test) and C.split_ids(ids, seed=1) != (train, test)
    tr, va, te = C.split_three_ids(ids)
    assert te == test and len(va) == 8 and len(tr) == 32
    assert C.split_ids(["a"]) == ([], ["a"])
    parts = C.split_by_contract(corpus(spark), validation=C.VALIDATION)
    sides = {k: {r[0] for r in v.select("contract_id").distinct().collect()} for k, v in parts.items()}
    assert sum(map(len, sides.values())) == 40 and not sides["train"] & sides["test"] and not sides["validation"] & sides["test"]
    by_hash = C.split_by_contract(corpus(spark), max_ids=3)
    assert by_hash["train"].count() + by_hash["test"].count() == 120


def test_structural_features(spark):
    rows = C.structural(corpus(spark, 1)).orderBy("position").collect()
    assert len(C.STRUCTURAL) == 14
    first, last = rows[0], rows[2]
    assert (first.is_first, first.is_last, first.is_preamble, last.is_last, last.header_has_digit, last.header_tokens) == (1.0, 0.0, 1.0, 1.0, 1.0, 2.0)
    assert first.scheme_article == first.scheme_fallback == 0.0 and last.scheme_article == 1.0 and first.log_char_len == pytest.approx(math.log1p(first.char_len))


def test_scaling_is_fitted_on_training_rows_and_clipped(spark):
    rows = C.structural(corpus(spark, 4))
    ranges = C.fit_ranges(rows.where("position < 2"))
    got = C.scaled(rows, ranges).select(F.max("relative_position"), F.min("relative_position"), F.max("header_tokens")).collect()[0]
    assert tuple(got) == (1.0, 0.0, 1.0)


def test_thresholds(spark):
    rows = [("a", 1.0, 0.3), ("a", 1.0, 0.32), ("a", 0.0, 0.1), ("b", 0.0, 0.9), ("c", 1.0, 0.01), ("c", 0.0, 0.5)]
    got = {r.category: r.threshold for r in C.tune_thresholds(spark.createDataFrame(rows, "category string, target double, probability double")).collect()}
    assert got == {"a": 0.15, "b": 0.5, "c": 0.5}


def test_precision_recall(spark):
    rows = [("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("b", 0, 0), ("c", 1, 1)]
    per = C.precision_recall(spark.createDataFrame(rows, "category string, target int, predicted int"))
    got = {r.category: (r.precision, r.recall, r.f1, r.support) for r in per.collect()}
    assert got == {"a": (0.5, 0.5, 0.5, 2), "b": (0.0, 0.0, 0.0, 0), "c": (1.0, 1.0, 1.0, 1)}
    avg = {r.average: r.f1 for r in C.macro_micro(per).collect()}
    assert avg["macro"] == pytest.approx(0.5) and avg["micro"] == pytest.approx(2 * 2 / (2 * 2 + 1 + 1))


def test_separable_categories_are_learnt(spark):
    rows = corpus(spark)
    result = C.run_step(C.split_by_contract(rows, validation=C.VALIDATION), C.Step("all", (1, 2), True, True), [*C.categories_of(rows), "Never"])
    assert result["macro"]["f1"] == 1.0 and result["untrainable"] == ["Never"] and "accuracy" not in result and set(result["thresholds"]) == {"Law", "Audit"}


def test_ladder_keeps_only_what_helps():
    seen = []

    def run(parts, step, categories):
        seen.append(step)
        return {"step": step, "macro": {"f1": {"control": 0.4, "bigrams": 0.3}.get(step.name, 0.5)}}

    got = C.climb({}, [], run=run)
    assert [r["adopted"] for r in got] == [True, False, True, False]
    assert seen[2].ngrams == (1, 1) and seen[3].structural and seen[3].thresholds


def test_similarity(spark):
    f = spark.createDataFrame([("s1", "law", 0.8), ("s1", "state", 0.6), ("s2", "cat", 1.0)], "id string, term string, weight double")
    d = spark.createDataFrame([("Law", "law", 1.0)], "category string, term string, weight double")
    assert [(r.id, r.category, r.similarity) for r in C.similarity(f, d).collect()] == [("s1", "Law", 0.8)]


def test_one_split_rule_at_every_size(spark):
    rows = spark.range(3000).selectExpr("cast(id as string) as contract_id").union(spark.range(50).selectExpr("cast(id as string)"))
    for validation in (0.0, C.VALIDATION):
        want = [len(x) for x in (C.split_three_ids if validation else C.split_ids)([str(i) for i in range(3000)], *([C.TEST, validation] if validation else []))]
        few, many = ({k: {r[0] for r in v.collect()} for k, v in C.split_by_contract(rows, validation=validation, max_ids=m).items()} for m in (1, 100_000))
        assert few == many and [len(x) for x in few.values()] == want and len(set().union(*few.values())) == 3000
    one = C.split_by_contract(rows.where("contract_id = '7'"), validation=C.VALIDATION)
    assert {k: v.count() for k, v in one.items()} == {"train": 0, "validation": 0, "test": 2}
    assert [v.count() for v in C.split_by_contract(rows.where("false")).values()] == [0, 0]


def test_vocabulary_holds_all_terms_in_range(spark):
    words = spark.range(0, 3000, 1, 4).selectExpr("array_join(transform(sequence(0, 269), i -> concat('w', (id % 1000) * 270 + i)), ' ') as text")
    got = C.TextFeatures.fit(words)
    assert len(got.model.vocabulary) == len(got.idf) == 270_000 > 1 << 18 and set(got.idf) == {math.log(3001 / 4) + 1}


def test_marks_of_any_script_are_taken_off(spark):
    df = spark.createDataFrame([("Čapek e\u0301tude ÅNGSTRÖM ńame ά й naïve ﬁne",)], "text string")
    assert df.select(C.unaccented(F.col("text"))).collect()[0][0] == "capek etude angstrom name α и naive ﬁne"


def test_few_sums_reach_the_driver():
    assert [C.aggregation_depth(n) for n in (1, 8, 48, 100, 600)] == [2, 2, 3, 3, 4]
