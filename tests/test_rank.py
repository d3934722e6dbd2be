import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as T
from spanloom.operators import rank as R
from spanloom.sources import sinks

SEG = "contract_id string, position int, start_char int, end_char int, text string, embedding_text string, header string"
RANKED = "query_id string, contract_id string, start_char int, end_char int, rank int"


def segs(spark, *texts, contract="c"):
    return spark.createDataFrame([(contract, i, 10 * i, 10 * i + 10, t, t, "") for i, t in enumerate(texts)], SEG)


def asked(spark, *questions, contract="c"):
    return spark.createDataFrame([(f"q{i}", contract, q) for i, q in enumerate(questions)], "query_id string, contract_id string, question string")


def ranking(spark, names):
    return spark.createDataFrame([("q0", "c", 10 * "ABCD".index(n), 10 * "ABCD".index(n) + 10, i) for i, n in enumerate(names, 1)], RANKED)


def order(df):
    return ["ABCD"[r.start_char // 10] for r in df.orderBy("rank").collect()]


def test_lexical_ranks_and_breaks_ties_late_first(spark):
    s = segs(spark, "governing law of the state", "audit rights of the buyer", "nothing here", "audit of books")
    got = R.lexical(asked(spark, "audit rights"), s, 4, stop=()).orderBy("rank").collect()
    assert [r.start_char for r in got] == [10, 30, 20, 0] and got[2].score == 0.0


def test_contract_without_terms_keeps_its_order(spark):
    got = R.lexical(asked(spark, "audit"), segs(spark, "", "a", "!"), 2, stop=()).orderBy("rank").collect()
    assert [r.start_char for r in got] == [0, 10]


def test_scope_is_the_contract(spark):
    s = segs(spark, "audit").unionByName(segs(spark, "audit audit", contract="d"))
    assert {r.contract_id for r in R.lexical(asked(spark, "audit"), s, 5).collect()} == {"c"}


def test_ngrams(spark):
    df = spark.createDataFrame([("The  cat sat",)], "t string")
    row = df.select(T.word_ngrams(T.tokens(F.col("t")), 1, 2).alias("w"), T.char_ngrams(F.lit("ab c"), 3, 5).alias("c")).collect()[0]
    assert row.w == ["the", "cat", "sat", "the cat", "cat sat"]
    assert row.c == [" ab", "ab ", " ab ", " c "]


@pytest.mark.parametrize(
    ("lex", "dense", "weights", "want"),
    [("AB", "CB", (1, 1), "BAC"), ("A", "B", (1, 1), "AB"), ("A", "B", (1, 2), "BA"), ("ABC", "D", (1, 0), "ABC"), ("A", "DCB", (0, 1), "DCB")],
)
def test_fusion(spark, lex, dense, weights, want):
    assert order(R.fuse([(ranking(spark, lex), weights[0]), (ranking(spark, dense), weights[1])], 4)) == list(want)


def test_fusion_depth(spark):
    assert order(R.fuse([(ranking(spark, "AB"), 1), (ranking(spark, "CD"), 1)], 4, depth=1)) == ["A", "C"]


def probe(name):
    return f'Highlight the parts (if any) of this contract related to "{name}" that should be reviewed by a lawyer. Details: What is it?'


def prior_rows(spark, n, hits, name="Parties"):
    gold = "array<struct<text:string,start:int,end:int>>"
    return spark.createDataFrame([(f"c{i}", probe(name), [("x", 0, 5) if i < hits else ("x", 15, 18)], True) for i in range(n)], f"contract_id string, question string, gold_spans {gold}, has_gold_span boolean")


@pytest.mark.parametrize(("n", "hits", "want"), [(30, 30, 1), (30, 0, 0), (5, 5, 0), (40, 16, 0), (20, 12, 1)])
def test_prior_fit(spark, n, hits, want):
    s = spark.createDataFrame([(f"c{i}", p, 10 * p, 10 * p + 10) for i in range(n) for p in range(2)], "contract_id string, position int, start_char int, end_char int")
    rows = prior_rows(spark, n, hits)
    assert R.fit_prior(rows, s).count() == want and [(r.n, r.rate) for r in R.lead_rates(rows, s).collect()] == [(n, hits / n)]


def test_prior_promotes_once_and_only_its_categories(spark, tmp_path):
    s = segs(spark, "a", "b", "c", "d")
    prior = spark.createDataFrame([("Parties", 1)], "category string, n_lead int")
    q = asked(spark, probe("Parties"))
    assert order(R.with_prior(ranking(spark, "BAC"), q, s, prior, 3)) == ["A", "B", "C"]
    assert order(R.with_prior(ranking(spark, "BAC"), asked(spark, probe("Other")), s, prior, 2)) == ["B", "A"]
    sinks.save_prior(prior, f"{tmp_path}/prior")
    assert [tuple(r) for r in sinks.load_prior(spark, f"{tmp_path}/prior").collect()] == [("Parties", 1)]


def test_dense_pools_windows_and_keeps_the_scope(spark):
    rec = spark.createDataFrame([("c", "a#w0", 0, 10, [1.0, 0.0]), ("c", "a#w1", 0, 10, [0.6, 0.8]), ("c", "b", 10, 20, [0.0, 1.0]), ("d", "x", 0, 9, [0.0, 1.0])], "contract_id string, record_id string, start_char int, end_char int, vector array<float>")
    q = spark.createDataFrame([("q0", "c", [0.0, 1.0])], "query_id string, contract_id string, vector array<float>")
    got = R.dense(q, rec, 5).orderBy("rank").collect()
    assert [(r.start_char, round(r.distance, 6)) for r in got] == [(10, 0.0), (0, 0.2)]
    assert R.dense(q, rec, 1, oversample=1).count() == 1


def test_rerank_reads_candidates_only_and_keeps_order_on_ties(spark):
    s = segs(spark, "x", "needle", "y", "needle")
    got = R.rerank(ranking(spark, "CABD"), asked(spark, "needle"), s, 4, depth=3)
    assert order(got) == ["B", "C", "A"]


def test_query_cleaning(spark):
    qs = [probe("Audit Rights"), 'highlight the parts (if any) of this contract related to  "X"\nthat should be reviewed by a lawyer.', "Free text?", ""]
    df = spark.createDataFrame([(q,) for q in qs], "q string")
    assert [r[0] for r in df.select(T.clean_query(F.col("q"))).collect()] == ["Audit Rights. What is it?", "X", "Free text?", ""]
    assert [r[0] for r in df.select(T.category_of(F.col("q"))).collect()] == ["Audit Rights", "X", None, None]


def test_all_variants_run(spark):
    s = segs(spark, "audit rights", "governing law", "parties named here", "other matters")
    q = asked(spark, probe("Parties"), "audit")

    def dense_of(q, s, k, windowed):
        return R.random_ranking(q, s, k, seed=1)

    stacks = R.variants(dense_of, spark.createDataFrame([("Parties", 1)], "category string, n_lead int"))
    assert len(stacks) == 13 and R.DEFAULT_VARIANT in stacks
    for name, run in stacks.items():
        rows = run(q, s, 2).collect()
        assert len(rows) == 4 and len({(r.query_id, r.start_char) for r in rows}) == 4, name
    with pytest.raises(ValueError):
        R.variants()["hybrid"](q, s, 2)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_never_leave_their_contract(spark):
    s = segs(spark, "audit rights", "audit of books").unionByName(segs(spark, "audit", contract="d"))
    q = asked(spark, "audit rights").unionByName(asked(spark, "books", contract="d"))
    kinds = {"one": R.Lexicon(), "two": R.Lexicon((1, 2)), "chars": R.Lexicon((3, 5), "char_wb"), "clean": R.Lexicon((1, 2), cleaned=True)}
    for df in (R.lexical(q, s, 5), R.lexicals(q, s, 5, kinds), R.term_stats(s)):
        text = plan(df)
        assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text and "Join" not in text


def test_rankings_of_one_walk_are_those_of_single_ones(spark):
    texts = [" ".join(f"w{(i * j * 7) % 23}" for j in range(1, 30)) for i in range(1, 30)]
    s, q = segs(spark, *texts), asked(spark, "w1 w2 w3 w7", probe("w5 w9"), "", "none of these")
    kinds = {"one": R.Lexicon(), "two": R.Lexicon((1, 2)), "chars": R.Lexicon((3, 5), "char_wb"), "clean": R.Lexicon((1, 2), cleaned=True)}
    both = {n: sorted(tuple(r[1:]) for r in rows) for n in kinds for rows in [R.lexicals(q, s, 6, kinds, stop=()).where(F.col("kind") == n).collect()]}
    cleaned = q.withColumn("question", T.clean_query(F.col("question")))
    for n, x in kinds.items():
        assert both[n] == sorted(map(tuple, R.lexical(cleaned if x.cleaned else q, s, 6, x.ngrams, x.analyzer, stop=()).collect())) and len(both[n]) == 24


def test_term_statistics(spark):
    got = {(r.position, r.term): (r.tf, r.df, r.n, r.first) for r in R.term_stats(segs(spark, "audit audit books", "books", ""), stop=()).collect()}
    assert got == {(0, "audit"): (2, 1, 3, True), (0, "books"): (1, 2, 3, True), (1, "books"): (1, 2, 3, False)}
    weights = {(r.position, r.term): r.weight for r in R.tfidf_weights(R.term_stats(segs(spark, "audit audit books", "books", ""), stop=())).collect()}
    assert weights[1, "books"] == 1.0 and abs(weights[0, "audit"] ** 2 + weights[0, "books"] ** 2 - 1) < 1e-12


def test_reranking_moves_texts_once(spark):
    s = segs(spark, "x", "needle", "y", "needle").unionByName(segs(spark, "other", contract="d"))
    for df in (R.rerank(ranking(spark, "CABD"), asked(spark, "needle"), s, 4), R.attach_segments(ranking(spark, "CABD"), s)):
        assert "Join" not in plan(df) and "Aggregate" not in plan(df)
    twice = s.unionByName(spark.createDataFrame([("c", 9, 0, 10, "last", "last", "h")], SEG))
    got = {r.start_char: (r.header, r.text, r.embedding_text) for r in R.attach_segments(ranking(spark, "AB").withColumn("start_char", F.when(F.col("rank") == 2, 77).otherwise(0)), twice).collect()}
    assert got == {0: ("h", "last", "last"), 77: ("", "", None)}


@pytest.mark.parametrize("oversample", [None, 1, 3])
def test_dense_in_blocks_is_the_plain_ranking(spark, monkeypatch, oversample):
    import random

    monkeypatch.setattr(R, "BLOCK", 40)
    r = random.Random(4)
    vectors = [[r.gauss(0, 1) for _ in range(8)] for _ in range(60)]
    # Contract c has many records, with copies and equal distances among them; d has few.
    own = [("c" if i < 300 else "d", i * 7 % 307, 10 * (i // 3), 10 * (i // 3) + 10, vectors[i % 60 if i % 5 else 0]) for i in range(307)]
    asked = [(f"{c}{i}", c, vectors[i] if i else [0.0] * 8) for c in "cd" for i in range(4)]
    rec = spark.createDataFrame(own, "contract_id string, record_id int, start_char int, end_char int, vector array<double>").repartition(3)
    q = spark.createDataFrame(asked, "query_id string, contract_id string, vector array<double>")
    df = R.dense(q, rec, 5, oversample)
    want = []
    for query, contract, v in asked:
        found = sorted((round(1 - sum(a * b for a, b in zip(v, x, strict=True)), 9), i, s) for c, i, s, _, x in own if c == contract)
        spans = {}
        for d, _, s in found[: 5 * oversample if oversample else None]:
            spans.setdefault(s, d)
        want += [(query, s, at) for at, s in enumerate(spans, 1) if at <= 5]
    assert sorted((x.query_id, x.start_char, x.rank) for x in df.collect()) == sorted(want)
    assert "CartesianProduct" not in plan(df) and "zip_with" not in plan(df)


def test_stacks_share_their_rankings(spark, monkeypatch):
    s = segs(spark, "audit rights", "governing law", "parties named here", "other matters")
    q, walks, own = asked(spark, probe("Parties"), "audit"), [], R.lexicals
    monkeypatch.setattr(R, "lexicals", lambda *a, **b: walks.append(a) or own(*a, **b))
    names = ("tfidf", "hybrid_bigram_prior", "hybrid_bigram", "hybrid_bigram_prior_cleanq", "hybrid_char_prior")

    def ranked(together):
        stacks = R.variants(lambda q, s, k, w: R.random_ranking(q, s, k, seed=1), spark.createDataFrame([("Parties", 1)], "category string, n_lead int"), together=together)
        return {n: sorted((r.query_id, r.rank, r.start_char) for r in stacks[n](q, s, 2).collect()) for n in names}

    each = ranked(False)
    assert len(walks) == 4 and ranked(True) == each and len(walks) == 5


def test_character_tables_agree_with_plain_counts(monkeypatch):
    import random
    from functools import partial

    r = random.Random(3)
    words = ["".join(r.choice("abcä") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    table, terms = R._CharTerms((3, 5)), partial(R.grams, ngrams=(3, 5), analyzer="char_wb", stop=frozenset(), known={})
    for cells in (10**7, 0):
        monkeypatch.setattr(R, "DENSE_CELLS", cells)
        for n in (1, 2, 7, 30):
            texts = [(i, 10 * i, 10 * i + 10, " ".join(r.choices(words, k=r.randrange(0, 40)))) for i in range(n)]
            asked = [(f"q{i}", " ".join(r.choices(words, k=i))) for i in range(5)] + [("q3", "abc")]
            assert list(table.ranked(texts, asked, 6)) == list(R._ranked(texts, asked, 6, terms)) and set(table.slot.tolist()) == {-1}


def test_words_of_an_id_are_counted_where_they_are(spark):
    df = R.count_weights(spark.createDataFrame([("a", "law law state"), ("a", "state law"), ("b", None), ("c", "cat")], "id string, text string"), stop=())
    text = plan(df)
    assert text.count("Exchange hashpartitioning") == 1 and "Window" not in text and "Aggregate" not in text
    assert {(r.id, r.term): round(r.weight, 9) for r in df.collect()} == {("a", "law"): round(3 / 13**0.5, 9), ("a", "state"): round(2 / 13**0.5, 9), ("c", "cat"): 1.0}
