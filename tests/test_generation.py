import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import generation as G
from spanloom.sources import corpus, sinks
from spanloom.streaming import run_log

CHUNK = "array<struct<header:string,start_char:int,end_char:int,text:string>>"


def test_excerpts_and_prompts(spark):
    df = spark.createDataFrame([("q1", [("Head", 5, 9, " body "), (None, 9, 12, "more")]), ("q2", []), ("q3", None)], f"q string, c {CHUNK}")
    got = [r[0] for r in df.orderBy("q").select(G.excerpts(F.col("c"))).collect()]
    assert got == ["[1] Head (chars 5-9)\nbody\n\n[2] (chars 9-12)\nmore", "(no excerpts retrieved)", "(no excerpts retrieved)"]
    prompt = df.where("q = 'q2'").select(G.judge_prompt(F.col("q"), F.col("c"), F.lit(" yes "))).collect()[0][0]
    assert prompt.index("CONTRACT EXCERPTS") < prompt.index("QUESTION\n--------\nq2") < prompt.index("ANSWER TO GRADE\n---------------\nyes\n\n")


@pytest.mark.parametrize(
    ("reply", "label", "why"),
    [
        ("SUPPORTED\nyes", "SUPPORTED", "yes"),
        ("partially_supported: x", "PARTIALLY_SUPPORTED", ""),
        ("PARTIALLY SUPPORTED", "SUPPORTED", ""),
        ("NOT SUPPORTED\nno", "SUPPORTED", "no"),
        ("\n\n Unsupported \n\n because", "UNSUPPORTED", "because"),
        ("<think>UNSUPPORTED\n?</think>\nSUPPORTED", "SUPPORTED", ""),
        ("hard to say", "UNPARSEABLE", "hard to say"),
        ("", "UNPARSEABLE", ""),
        (None, "UNPARSEABLE", ""),
    ],
)
def test_verdicts(spark, reply, label, why):
    v = spark.createDataFrame([(reply,)], "r string").select(G.verdict(F.col("r")).alias("v")).collect()[0].v
    assert (v.label, v.rationale) == (label, why)


def test_predicates(spark):
    df = spark.createDataFrame([("It is not_in_excerpts.",), ("",), (None,), ("HTTP 429 rate limit",), (" yes",), ("No.",)], "t string")
    assert [r[0] for r in df.select(T.declines(F.col("t"))).collect()] == [True, False, False, False, False, False]
    assert [r[0] for r in df.select(T.is_transient(F.col("t"))).collect()] == [False, False, False, True, False, False]
    assert [r[0] for r in df.select(T.yes_no(F.col("t"))).collect()] == [None, None, None, None, True, False]


def backend(name, call, **kw):
    return G.Backend(name, "m", call, delay=0.0, **kw)


def test_backends_return_failures_and_retry_what_passes():
    seen = []

    def call(prompt, system):
        seen.append(prompt)
        raise RuntimeError("503 overloaded" if len(seen) < 3 else "bad request")

    got = backend("ollama", call).generate("p")
    assert got["text"] == "" and "bad request" in got["error"] and len(seen) == 3
    assert backend("ollama", lambda p, s: " ok ").generate("p")["text"] == "ok"
    with pytest.raises(ValueError):
        G.build_backend("nowhere")


def answer(prompt, system):
    return "NOT_IN_EXCERPTS" if "absent" in prompt else "It says so."


def judge(prompt, system):
    if "limit" in prompt:
        raise RuntimeError("429 rate limit")
    return "SUPPORTED\nfine"


def run(spark):
    gold = "array<struct<text:string,start:int,end:int>>"
    sample = spark.createDataFrame(
        [("q1", "c", "A", "what?", [("x", 0, 5)], True), ("q2", "c", "B", "absent?", [], False), ("q3", "c", "C", "limit?", [("x", 50, 60)], True)],
        f"query_id string, contract_id string, category string, question string, gold_spans {gold}, has_gold_span boolean",
    )
    ranking = spark.createDataFrame([(q, "c", 10 * i, 10 * i + 10, i + 1) for q in ("q1", "q2", "q3") for i in range(2)], "query_id string, contract_id string, start_char int, end_char int, rank int")
    seg = spark.createDataFrame([("c", i, 10 * i, 10 * i + 10, f"text {i}", f"text {i}", "") for i in range(2)], "contract_id string, position int, start_char int, end_char int, text string, embedding_text string, header string")
    return G.run_generation(sample, ranking, seg, backend("ollama", answer), backend("gemini", judge, retries=0), "tfidf", k=2, run_id="r")


def test_run_log_and_rejudging(spark, tmp_path):
    rows = run(spark)
    got = {r.category: r for r in rows.collect()}
    assert {k: v.judge_label for k, v in got.items()} == {"A": "SUPPORTED", "B": "ABSTAINED", "C": "NOT_JUDGED"}
    assert got["A"].retrieval_hit and not got["C"].retrieval_hit and got["B"].retrieval_hit is None and got["B"].judge_latency_ms is None
    assert len(rows.columns) == 29 and [tuple(s) for s in got["A"].retrieved_spans] == [(0, 10), (10, 20)]
    summary = G.judge_summary(rows).collect()[0]
    assert (summary.n, summary.n_scored, summary.faithful_rate, summary.abstention_rate, summary.coverage) == (3, 1, 1.0, 1 / 3, 2 / 3)
    path = f"{tmp_path}/log"
    sinks.append_log(rows, path)
    sinks.append_log(rows, path)
    log = corpus.read_run_log(spark, path)
    assert log.count() == 6
    again = G.rejudged(log, backend("groq", lambda p, s: "UNSUPPORTED"))
    assert {(r.category, r.judge_label, r.judge_backend) for r in again.collect()} == {("A", "UNSUPPORTED", "groq"), ("B", "ABSTAINED", "groq"), ("C", "UNSUPPORTED", "groq")}
    out = f"{tmp_path}/out"
    run_log.append_stream(run_log.log_stream(spark, path), out, f"{tmp_path}/cp").awaitTermination()
    run_log.append_stream(run_log.log_stream(spark, path), out, f"{tmp_path}/cp").awaitTermination()
    assert corpus.read_run_log(spark, out).count() == 6 and run_log.label_counts(log).count() == 3


def test_judges_are_cloud_and_never_the_generator(spark):
    rows = spark.createDataFrame([("q", [], "a", False, "gemini", "m")], f"question string, chunks {CHUNK}, answer string, abstained boolean, generator_backend string, generator_model string")
    with pytest.raises(ValueError):
        G.judged(rows, backend("ollama", judge))
    with pytest.raises(Exception, match="own answers"):
        G.judged(rows, backend("gemini", judge)).collect()


def test_summary_without_scored_rows(spark):
    s = G.judge_summary(spark.createDataFrame([("ABSTAINED",)], "judge_label string")).collect()[0]
    assert s.faithful_rate is None and s.coverage == 1.0


def test_early_stop(spark):
    labels = ["SUPPORTED", *["NOT_JUDGED"] * 4, "SUPPORTED", *["NOT_JUDGED"] * 6, "SUPPORTED"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(labels)], "run_id string, at int, judge_label string")
    assert G.stop_after_failures(df, "at").count() == 11


def test_stratified_sample(spark):
    df = spark.createDataFrame([(f"c{i}", "A", i % 3 > 0) for i in range(300)], "contract_id string, category string, has_gold_span boolean")
    got = G.stratified_sample(df)
    assert {r.has_gold_span: r["count"] for r in got.groupBy("has_gold_span").count().collect()} == {True: 60, False: 20}
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, G.stratified_sample(df.repartition(3)).collect()))


def test_zero_shot_over_three_categories(spark):
    labelled = spark.createDataFrame([(f"c{i:02d}", i, f"a text of some length number {i}", ["A"] if i % 2 else ["B"]) for i in range(60)], "contract_id string, position int, text string, labels array<string>")
    rows = G.zero_shot_run(labelled, {"A": "Is it A?", "B": "Is it B?", "C": "Is it C?"}, backend("ollama", lambda p, s: "YES" if "Is it A" in p else "no"))
    got = {r.category: (r.n, r.yes) for r in rows.groupBy("category").agg(F.count("*").alias("n"), F.count_if("predicted").alias("yes")).collect()}
    assert got == {"A": (16, 16), "B": (16, 0), "C": (8, 0)}
    with pytest.raises(ValueError):
        G.zero_shot_run(labelled, {}, backend("ollama", judge))
    assert G.rejudged_path("/x/run.jsonl", backend("groq", judge)) == "/x/run__groq_m"


def test_chunks_are_put_together_in_their_contract(spark):
    from spanloom.operators.rank import attach_segments

    s = spark.createDataFrame([(c, p, 10 * p, 10 * p + 10, f"{c}{p}", f"{c}{p}", f"[window {p}]") for c in "cd" for p in range(3)], "contract_id string, position int, start_char int, end_char int, text string, embedding_text string, header string")
    r = spark.createDataFrame([(f"{c}|q", c, 10 * p, 10 * p + 10, 3 - p) for c in "cd" for p in range(3)], "query_id string, contract_id string, start_char int, end_char int, rank int")
    q = spark.createDataFrame([("c|q", "c", "why?"), ("d|q", "d", "how?"), ("d|none", "d", "what?")], "query_id string, contract_id string, question string")
    got = G.chunks_for(q, r, s)
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = q.select("query_id", "question").join(G.chunks_of(attach_segments(r, s)), "query_id").select("query_id", "question", "chunks")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() == 2
