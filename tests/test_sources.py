import json

import pytest

from spanloom.operators import metrics
from spanloom.plans import catalogue
from spanloom.sources import corpus, sinks

DATA = {
    "version": "1",
    "data": [
        {"title": "T1", "paragraphs": [{"context": "abc def", "qas": [{"id": "T1__Law", "question": "q1", "is_impossible": False, "answers": [{"text": "def", "answer_start": 4}, {"text": "b", "answer_start": 0}]}, {"id": "T1__Audit", "question": "q2", "is_impossible": True, "answers": []}]}]},
        {"title": "T2", "paragraphs": [{"context": "xyz", "qas": [{"id": "T2__Law", "question": "q3", "is_impossible": False, "answers": [{"text": "xyz", "answer_start": 0}]}]}]},
    ],
}


def test_corpus_to_eval_rows(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps(DATA))
    raw = corpus.read_corpus(spark, str(tmp_path / "c.json"))
    ev, con = corpus.eval_rows_of(raw), corpus.contracts_of(raw)
    got = {(r.contract_id, r.category): (r.has_gold_span, [(g.start, g.end) for g in r.gold_spans]) for r in ev.collect()}
    assert got == {("T1", "Law"): (True, [(4, 7), (0, 1)]), ("T1", "Audit"): (False, []), ("T2", "Law"): (True, [(0, 3)])}
    c = metrics.eval_counters(ev, con).collect()[0]
    assert (c.n_contracts, c.n_rows, c.n_with_gold, c.n_empty, c.n_multi_span, c.n_offset_mismatches) == (2, 3, 2, 1, 1, 1)
    assert [r.expected for r in metrics.offset_mismatches(ev, con).collect()] == ["b"]
    sinks.write_corpus(con, ev, metrics.eval_counters(ev, con), str(tmp_path / "out"))
    back = corpus.read_contracts(spark, str(tmp_path / "out/contracts"))
    assert back.count() == 2 and corpus.read_eval_rows(spark, str(tmp_path / "out/eval_rows"), back.where("contract_id = 'T1'")).count() == 2
    assert {(r.category, r.question) for r in corpus.first_questions(ev, "question").collect()} == {("Law", "q1"), ("Audit", "q2")}
    assert corpus.extract_contract(con, "T2").collect()[0][0] == "xyz"


def test_contract_limit_counts_distinct_ids(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps({"contract_id": i, "context": t}) for i, t in [("b", "1"), ("b", "2"), ("a", "3"), ("c", "4")]))
    got = {r.contract_id: r.context for r in corpus.read_contracts(spark, str(tmp_path / "c.jsonl"), 2).collect()}
    assert got == {"b": "2", "a": "3"}
    assert {r[0] for r in corpus.read_contract_ids(spark, str(tmp_path / "c.jsonl"), 1).collect()} == {"b"}
    assert corpus.read_jsonl(spark, str(tmp_path / "c.jsonl"), "contract_id string", 3).count() == 3


def test_training_scan(spark, tmp_path):
    rows = [{"contract_id": c, "segment_id": f"{c}{i}", "text": "t", "labels": [], "position": i} for c in "cab" for i in range(2)]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, rows)))
    assert {r.contract_id for r in corpus.read_training(spark, str(tmp_path / "t.jsonl"), 2).collect()} == {"a", "b"}
    (tmp_path / "old.jsonl").write_text(json.dumps({"contract_id": "a", "segment_id": "a0", "text": "t", "labels": []}))
    with pytest.raises(ValueError, match="position"):
        corpus.read_training(spark, str(tmp_path / "old.jsonl"))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        corpus.read_training(spark, str(tmp_path / "none.jsonl"))


def test_collection_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "s1", "c1_s1", [0.1]), ("c2", "s2", "c2_s2", [0.2])], "contract_id string, segment_id string, record_id string, vector array<double>")
    name = corpus.collection_name("org/all-mini.v2")
    assert name == "contract_segments_all_miniv2_win" and corpus.collection_name("org/all-mini.v2", windowed=False) == "contract_segments_all_miniv2"
    for reset in (True, True, False):
        sinks.write_collection(rows, str(tmp_path), name, reset=reset)
        assert corpus.open_collection(spark, str(tmp_path), name).count() == 2
    assert corpus.open_collection(spark, str(tmp_path), name, "c1").count() == 1
    more = spark.createDataFrame([("c1", "s1", "c1_s1", [0.9]), ("c3", "s3", "c3_s3", [0.3])], rows.schema)
    sinks.write_collection(more, str(tmp_path), name, reset=False)
    assert {r.record_id: r.vector for r in corpus.open_collection(spark, str(tmp_path), name).collect()} == {"c1_s1": [0.9], "c2_s2": [0.2], "c3_s3": [0.3]}


def test_upserts_touch_their_buckets_and_scans_are_pruned(spark, tmp_path):
    rows = spark.range(40).selectExpr("cast(id as string) as contract_id", "concat('s', id) as segment_id", "concat('r', id) as record_id", "array(0.5D) as vector")
    sinks.write_collection(rows, str(tmp_path), "c")
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "c").rglob("*.parquet")}
    more = spark.createDataFrame([("7", "s7", "r7", [0.9])], rows.schema)
    sinks.write_collection(more, str(tmp_path), "c", reset=False)
    kept = [p for p in files if p.exists() and p.stat().st_mtime_ns == files[p]]
    assert len(kept) == len(files) - 1 and corpus.open_collection(spark, str(tmp_path), "c").count() == 40
    one = corpus.open_collection(spark, str(tmp_path), "c", "7")
    assert one.collect()[0].vector == [0.9] and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert sinks.drop_collection(spark, str(tmp_path), "c") and not (tmp_path / "c").exists() and not sinks.drop_collection(spark, str(tmp_path), "c")


def test_data_version_and_order(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.json").write_bytes(b"abc")
    assert [(r.md5, r.size) for r in corpus.data_version(spark, str(tmp_path / "d")).collect()] == [("900150983cd24fb0d6963f7d28e17f72", 3)]
    rows = spark.createDataFrame([(f"c{i % 7}", f"k{i}") for i in range(50)], "contract_id string, category string").repartition(5)
    got = [(r.contract_id, r.category) for r in corpus.question_order(rows).orderBy("query_id").collect()]
    assert got == sorted(got) and sorted(r.query_id for r in corpus.question_order(rows).collect()) == list(range(50))


def test_results_are_merged_and_guarded(spark, tmp_path):
    one = spark.createDataFrame([(0.5,)], "hit_rate double")
    path = str(tmp_path / "results")
    assert sinks.merge_result(one, path, "tfidf") and sinks.merge_result(spark.createDataFrame([(0.7,)], "hit_rate double"), path, "hybrid")
    sinks.merge_result(spark.createDataFrame([(0.6,)], "hit_rate double"), path, "hybrid")
    got = {r.variant: (r.hit_rate, round(r.hit_rate_delta, 6)) for r in sinks.versus(sinks.read_results(spark, path)).collect()}
    assert got == {"tfidf": (0.5, 0.0), "hybrid": (0.6, 0.1)}
    for partial in ({"limit": 5}, {"split": "test"}):
        with pytest.raises(sinks.PartialRun):
            sinks.merge_result(one, path, "tfidf", **partial)
    assert not sinks.merge_result(one, path, "tfidf", write=False)
    sinks.log_run(spark, str(tmp_path / "runs"), "r", {"k": 5}, {"hit/rate now": 1.0})
    assert spark.read.parquet(str(tmp_path / "runs")).collect()[0].metrics == {"hit-rate_now": 1.0}
    sinks.log_run(spark, str(tmp_path / "more"), "r", {}, {"f1": 0.5}, per_category={"Audit Rights": {"f1": 1.0}}, artifact="report")
    assert [(r.metrics, r.artifact) for r in spark.read.parquet(str(tmp_path / "more")).collect()] == [({"f1": 0.5, "f1-Audit_Rights": 1.0}, "report")]


def test_catalogue_pairs():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 50
