import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import clients, embed, extras, generation


def test_vectors_have_length_one_and_queries_their_prefix(spark):
    df = spark.createDataFrame([("audit rights",), ("",), (None,)], "t string")
    got = [np.array(r[0]) for r in df.select(embed.embedded(F.col("t"))).collect()]
    assert [round(float(np.linalg.norm(v)), 6) for v in got] == [1.0, 0.0, 0.0] and len(got[0]) == 384
    bge = "BAAI/bge-small-en-v1.5"
    assert embed.query_prefix(bge) and not embed.query_prefix(embed.DEFAULT_MODEL)
    a, b = (df.limit(1).select(embed.embedded(F.col("t"), bge, is_query=q)).collect()[0][0] for q in (True, False))
    assert a != b and embed.max_tokens(bge) == 512


def test_ingest(spark, tmp_path):
    df = spark.createDataFrame([("c1", "one clause " * 200), ("c2", "audit")], "contract_id string, context string")
    stats = embed.ingest(df, str(tmp_path)).collect()[0]
    assert (stats.n_contracts, stats.n_segments_seen, stats.n_segments_written) == (2, 2, 2) and stats.n_records > 2
    rows = spark.read.parquet(str(tmp_path / "contract_segments_all_MiniLM_L6_v2_win"))
    assert rows.count() == stats.n_records and "category" not in rows.columns


def test_risk_flags(spark):
    labels = spark.createDataFrame([("c", "A"), ("d", "B")], "contract_id string, category string")
    rules = spark.createDataFrame([("A", "absent", "no A", 2.0), ("B", "present", "has B", 1.0)], "category string, flag_if string, flag string, weight double")
    assert {(r.contract_id, r.flag) for r in extras.risk_flags(labels, rules).collect()} == {("d", "no A"), ("d", "has B")}
    assert [tuple(r) for r in extras.risk_scores(extras.risk_flags(labels, rules)).collect()] == [("d", 2, 3.0)]


def test_category_filter(spark):
    seg = spark.createDataFrame([("c", 0, ["A"]), ("c", 1, [])], "contract_id string, position int, labels array<string>")
    q = spark.createDataFrame([("q1", "c", "A", 0.9), ("q2", "c", None, 0.9)], "query_id string, contract_id string, category_filter string, confidence double")
    assert sorted((r.query_id, r.position) for r in extras.filter_by_category(seg, q).collect()) == [("q1", 0), ("q2", 0), ("q2", 1)]
    assert {r.query_id: (r.filter_applied, r.classifier_confidence_on_filter) for r in extras.ask_fields(q).collect()} == {"q1": (True, 0.9), "q2": (False, None)}
    one = spark.createDataFrame([(0.5,)], "hit_rate double")
    assert extras.ablation(one, one).collect()[0].delta == 0.0


def test_drift_is_zero_between_equals(spark):
    df = spark.range(100).withColumn("v", F.array(F.col("id") * 1.0, F.lit(2.0)))
    assert extras.input_drift(df, df, "id", [10.0, 50.0]).collect()[0].psi == 0.0
    assert extras.embedding_drift(df, df, "v").collect()[0].centroid_distance == pytest.approx(0.0, abs=1e-12)
    assert extras.input_drift(df, df.where("id > 60"), "id", [10.0, 50.0]).collect()[0].psi > 1


def test_clients_are_registered_and_fail_as_rows(tmp_path, monkeypatch):
    for name in ("GEMINI_API_KEY", "GROQ_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert generation.default_judge().max_tokens == 2048 and generation.second_judge().extra == {"reasoning_effort": "low"}
    assert "is not set" in generation.build_backend("groq").generate("p")["error"]
    monkeypatch.setenv("OLLAMA_HOST", "http://127.0.0.1:9")
    assert generation.build_backend("ollama", retries=0).generate("p")["error"]
    assert clients.load_env(tmp_path / "none") is False
    (tmp_path / "env").write_text("# x\nSPANLOOM_TEST_A='1'\n")
    assert clients.load_env(tmp_path / "env") and os.environ.pop("SPANLOOM_TEST_A") == "1"
    with pytest.raises(ValueError):
        clients.load_env("env")


def test_stand_in_encoder_counts_words_like_a_plain_loop():
    import zlib

    texts = ["a b a", "", "Größe größe x", *(f"w{i} w{i % 7} w{i % 3}" for i in range(2500))]
    want = np.zeros((len(texts), 384), dtype=np.float32)
    for i, t in enumerate(texts):
        for w in t.lower().split():
            h = zlib.crc32(w.encode())
            want[i, h % 384] += 1.0 if h >> 31 else -1.0
    got = embed.hashed_encoder()(texts)
    assert got.dtype == np.float32 and (got == want).all() and embed.hashed_encoder()([]).shape == (0, 384)
