import pytest
from pyspark.sql import functions as F

from spanloom.operators import metrics, spans

GOLD = "array<struct<text:string,start:int,end:int>>"
CASES = {
    "exact": ([(100, 200)], [(100, 200)], (True, 100, 100, 100)),
    "partial": ([(150, 250)], [(100, 200)], (True, 50, 100, 100)),
    "none": ([(0, 50)], [(100, 200)], (False, 0, 100, 50)),
    "touching": ([(0, 100)], [(100, 200)], (False, 0, 100, 100)),
    "any of many": ([(5050, 5150)], [(100, 150), (5000, 5100), (9000, 9100)], (True, 50, 250, 100)),
    "two hits": ([(100, 200), (300, 400)], [(100, 200), (300, 400)], (True, 200, 200, 200)),
    "overlap": ([(100, 180), (150, 200)], [(100, 200)], (True, 100, 100, 100)),
    "empty gold": ([(0, 100)], [], (False, 0, 0, 100)),
    "unsorted": ([(50, 60), (0, 20), (10, 30)], [(25, 55)], (True, 10, 30, 40)),
}


def rows(spark, cases):
    data = [(k, r, [("x", *g) for g in gold], bool(gold)) for k, (r, gold, _) in cases.items()]
    return spark.createDataFrame(data, f"name string, retrieved array<struct<start:int,end:int>>, gold_spans {GOLD}, has_gold_span boolean")


def test_scores(spark):
    got = {r.name: (r.hit, r.gold_chars_hit, r.gold_chars_total, r.retrieved_chars) for r in metrics.score_rows(rows(spark, CASES)).collect()}
    assert got == {k: v[2] for k, v in CASES.items()}


def test_roll_up(spark):
    r = metrics.roll_up(metrics.score_rows(rows(spark, {k: CASES[k] for k in ("exact", "partial", "empty gold")}))).collect()[0]
    assert (r.n_scored, r.n_skipped_no_gold, r.hit_rate, r.gold_recall, r.gold_density, r.mean_retrieved_chars) == (2, 1, 1.0, 0.75, 0.75, 100.0)


def test_roll_up_of_nothing(spark):
    r = metrics.roll_up(metrics.score_rows(rows(spark, CASES).where("false"))).collect()[0]
    assert (r.n_scored, r.hit_rate, r.gold_recall, r.gold_density, r.mean_retrieved_chars) == (0, 0.0, 0.0, 0.0, 0.0)


def test_whole_documents_score_hits_but_no_density(spark):
    r = metrics.roll_up(metrics.score_rows(rows(spark, {"all": ([(0, 100_000)], [(100, 200)], None)}))).collect()[0]
    assert r.hit_rate == 1.0 and r.gold_density < 0.01


def test_union_rows(spark):
    df = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 9, 12), ("a", 10, 11), ("b", 3, 4)], "k string, start int, end int")
    assert sorted(map(tuple, spans.union_rows(df, "k").select("k", "start", "end").collect())) == [("a", 0, 7), ("a", 9, 12), ("b", 3, 4)]


def test_null_spans_are_none(spark):
    df = spark.createDataFrame([(None,)], "s array<struct<start:int,end:int>>")
    assert df.select(spans.covered(F.col("s")).alias("n"), spans.touches(F.col("s"), F.col("s")).alias("t")).collect()[0][:] == (0, False)


def test_labels_and_capture(spark):
    seg = spark.createDataFrame([("c", "s0", 0, 10), ("c", "s1", 10, 20), ("d", "s2", 0, 5)], "contract_id string, segment_id string, start_char int, end_char int")
    ev = spark.createDataFrame(
        [("c", "B", [("x", 8, 12)], True), ("c", "A", [("x", 10, 11), ("y", 30, 31)], True), ("d", "A", [], False)],
        f"contract_id string, category string, gold_spans {GOLD}, has_gold_span boolean",
    )
    got = {r.segment_id: r.labels for r in spans.label_segments(seg, ev).collect()}
    assert got == {"s0": ["B"], "s1": ["A", "B"], "s2": []}
    assert sorted((r.category, r.gold_start, r.captured) for r in spans.capture(seg, ev).collect()) == [("A", 10, True), ("A", 30, False), ("B", 8, True)]
    assert {(r.category, r.reachable) for r in spans.reachable(seg, ev).collect()} == {("A", True), ("B", True)}


@pytest.mark.parametrize("name", ["rank_buckets", "rank_curve"])
def test_rank_reports_count_rows_that_were_not_found(spark, name):
    first = spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, first_rank int")
    got = getattr(metrics, name)(first).collect()
    if name == "rank_buckets":
        assert {r.bucket: r.n for r in got if r.n} == {"1": 1, "4-5": 1, "not found": 1} and len(got) == 7
    else:
        assert [round(r.hit_rate, 3) for r in got] == [0.333, 0.333, 0.667, 0.667, 0.667, 0.667]


def test_rank_summary(spark):
    r = metrics.rank_summary(spark.createDataFrame([("a", 1), ("b", 4), ("c", None)], "query_id string, first_rank int")).collect()[0]
    assert (r.n, r.n_found, r.mrr, r.median_rank) == (3, 2, 1.25 / 3, 2.5)


@pytest.mark.parametrize("parts", [1, 3])
def test_mean_reciprocal_rank_is_exact_in_any_order(spark, parts):
    half_step = [1] * 3919 + [2] * 70 + [3] * 9 + [4, 5]  # 79149 / 20 / 4000 = 0.9893625
    cases = [(half_step, 0.9893625), (half_step[::-1], 0.9893625), ([10] * 10, 0.1), ([3] * 3 + [None] * 7, 0.1), ([None], 0.0), ([], 0.0)]
    for kind in ("int", "long"):
        for ranks, mrr in cases:
            first = spark.createDataFrame([(r,) for r in ranks], f"first_rank {kind}").coalesce(parts)
            got = metrics.rank_summary(first)
            assert got.collect()[0].mrr == mrr
            assert got.select(F.round("mrr", 6).alias("mrr")).collect()[0].mrr == (0.989363 if ranks in (half_step, half_step[::-1]) else mrr)


def test_union_is_one_sorted_stream(spark):
    import random

    r = random.Random(5)
    own = [(r.choice("abcd"), s, s + r.randrange(0, 9)) for s in (r.randrange(500) for _ in range(600))]
    df = spans.union_rows(spark.createDataFrame(own, "k string, start int, end int"), "k")
    want = []
    for k, s, e in sorted(own):
        if want and want[-1][0] == k and s <= want[-1][2]:
            want[-1] = (k, want[-1][1], max(e, want[-1][2]))
        else:
            want.append((k, s, e))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, df.collect())) == want
