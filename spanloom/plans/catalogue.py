"""Registered queries over the driver's tables, each with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.text import TOKEN, category_of, category_or_start, clean_query, stop_words
from spanloom.operators import classify, embed, extras, generation, metrics, rank, segment, spans
from spanloom.plans.fixtures import EVAL_SQL, KINDS, STRUCTURED_SQL, contracts, eval_rows, segments, segments_sql, structured, structured_segments_sql, table
from spanloom.sources import sinks
from spanloom.sources.stage import new_path, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 5


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- profile of the corpus --------------------------------------------------------------------------------------------------------

_P = (10, 25, 50, 75, 90, 95, 99)


@query(f"SELECT count(n_chars) AS n, avg(n_chars) AS mean, stddev_samp(n_chars) AS std, min(n_chars) AS min, max(n_chars) AS max, {', '.join(f'quantile_cont(n_chars, {p / 100}) AS p{p}' for p in _P)} FROM documents")
def corpus_profile(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.describe(table(spark, sf, "documents"), "n_chars")


@query("SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query("""SELECT CAST(CASE WHEN hi > lo THEN least(59, floor((CAST(n_chars AS DOUBLE) - lo) * 60 / (hi - lo))) ELSE 0 END AS INTEGER) AS bin, count(*) AS n
FROM documents, (SELECT CAST(min(n_chars) AS DOUBLE) AS lo, CAST(max(n_chars) AS DOUBLE) AS hi FROM documents) WHERE n_chars IS NOT NULL GROUP BY 1""")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.histogram(table(spark, sf, "documents"), "n_chars")


@query("SELECT source, sum(least(CAST(n_chars AS DOUBLE), q)) AS clipped_chars FROM documents, (SELECT quantile_cont(n_chars, 0.99) AS q FROM documents) GROUP BY source")
def length_clipped(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.clipped(table(spark, sf, "documents").select("source", "n_chars"), "n_chars").groupBy("source").agg(F.sum("clipped").alias("clipped_chars"))


@query("SELECT max(n) AS largest, min(n) AS least, CAST(max(n) AS DOUBLE) / min(n) AS imbalance FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def lang_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.imbalance(table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n")))


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 1 OFFSET 10")
def nth_longest(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.nth_longest(table(spark, sf, "documents").select("doc_id", "n_chars"), "n_chars", 10, "doc_id")


# --- evaluation rows --------------------------------------------------------------------------------------------------------------


@query(f"WITH {EVAL_SQL} SELECT e.contract_id, e.category, e.question, g.gold_start, g.gold_end, g.gold_text FROM ev e JOIN gold g USING (contract_id, category)")
def gold_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = eval_rows(spark, sf).select("contract_id", "category", "question", F.explode("gold_spans").alias("g"))
    return rows.select("contract_id", "category", "question", F.col("g.start").alias("gold_start"), F.col("g.end").alias("gold_end"), F.col("g.text").alias("gold_text"))


@query(f"""WITH {EVAL_SQL}, n AS (SELECT e.contract_id, e.category, count(g.contract_id) AS n FROM ev e LEFT JOIN gold g USING (contract_id, category) GROUP BY ALL)
SELECT count(DISTINCT contract_id) AS n_contracts, count(*) AS n_rows, count(*) FILTER (WHERE n > 0) AS n_with_gold, count(*) FILTER (WHERE n = 0) AS n_empty,
  count(*) FILTER (WHERE n > 1) AS n_multi_span, CAST(0 AS BIGINT) AS n_offset_mismatches FROM n""")
def eval_counters(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.eval_counters(eval_rows(spark, sf), contracts(spark, sf))


@query(f"""WITH {EVAL_SQL}, q AS (SELECT question FROM ev UNION ALL SELECT text FROM benchmark)
SELECT question, CASE WHEN position('related to "' IN question) > 0 THEN regexp_extract(question, 'related to "([^"]+)"', 1) || '. ' || trim(regexp_extract(question, 'Details: (.*)$', 1, 's'), ' ' || chr(10) || chr(13) || chr(9)) ELSE question END AS cleaned FROM q""")
def query_strip(spark: SparkSession, sf: str) -> DataFrame:
    q = eval_rows(spark, sf).select("question").unionByName(table(spark, sf, "benchmark").select(F.col("text").alias("question")))
    return q.select("question", clean_query(F.col("question")).alias("cleaned"))


@query(f"""WITH {EVAL_SQL}, q AS (SELECT question FROM ev UNION ALL SELECT text FROM benchmark)
SELECT question, nullif(regexp_extract(question, 'related to\\s+"([^"]+)"', 1), '') AS category, coalesce(nullif(regexp_extract(question, 'related to\\s+"(.*?)"', 1), ''), substr(question, 1, 50)) AS start FROM q""")
def category_parse(spark: SparkSession, sf: str) -> DataFrame:
    q = eval_rows(spark, sf).select("question").unionByName(table(spark, sf, "benchmark").select(F.col("text").alias("question")))
    return q.select("question", category_of(F.col("question")).alias("category"), category_or_start(F.col("question")).alias("start"))


# --- segmentation -----------------------------------------------------------------------------------------------------------------

_HEADER = "CASE WHEN n < {m} THEN '' ELSE '[window ' || position || ']' END"
_EMBED = "CASE WHEN length(text) < 175 THEN {h} || chr(10) || text ELSE text END"


@query(f"""WITH RECURSIVE {segments_sql(3000, 6000)}
SELECT contract_id, contract_id || '_seg' || position AS segment_id, CAST(position AS INTEGER) AS position, start_char, end_char, 'fallback' AS scheme, {_HEADER.format(m=6000)} AS header,
  length(text) < 175 AS is_undersized, md5(text) AS text_md5, md5({_EMBED.format(h=_HEADER.format(m=6000))}) AS embedding_md5 FROM seg""")
def window_segments(spark: SparkSession, sf: str) -> DataFrame:
    rows = segment.window_segments(contracts(spark, sf))
    return rows.select("contract_id", "segment_id", "position", "start_char", "end_char", "scheme", "header", "is_undersized", F.md5("text").alias("text_md5"), F.md5("embedding_text").alias("embedding_md5"))


_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_INDEX_SQL = f"""{segments_sql(3000, 6000)},
emb AS (SELECT contract_id, contract_id || '_seg' || position AS segment_id, position, text, {_HEADER.format(m=6000)} AS header, n FROM seg),
idx AS (SELECT *, coalesce(nullif(trim({_EMBED.format(h='header')}, {_WS}), ''), nullif(trim(text, {_WS}), ''), nullif(trim(header, {_WS}), '')) AS it FROM emb),
win AS (SELECT contract_id, segment_id, it, unnest(range(0, CAST(1 + ceil(greatest(0, length(it) - 870) / 696.0) AS BIGINT))) AS raw FROM idx WHERE it IS NOT NULL),
cut AS (SELECT contract_id, segment_id, raw, substr(it, raw * 696 + 1, 870) AS w FROM win),
rec AS (SELECT contract_id, segment_id, CAST(row_number() OVER (PARTITION BY segment_id ORDER BY raw) - 1 AS INTEGER) AS window_index, CAST(count(*) OVER (PARTITION BY segment_id) AS INTEGER) AS n_windows, w
  FROM cut WHERE trim(w, {_WS}) <> '')"""


@query(f"WITH RECURSIVE {_INDEX_SQL} SELECT segment_id || CASE WHEN n_windows > 1 THEN '#w' || window_index ELSE '' END AS record_id, window_index, n_windows, md5(w) AS window_md5 FROM rec")
def overlap_windows(spark: SparkSession, sf: str) -> DataFrame:
    return segment.index_records(segment.window_segments(contracts(spark, sf)), segment.windows_for(256)).select("record_id", "window_index", "n_windows", F.md5("window_text").alias("window_md5"))


@query(f"""WITH RECURSIVE {_INDEX_SQL} SELECT (SELECT count(DISTINCT contract_id) FROM seg) AS n_contracts, (SELECT count(*) FROM seg) AS n_segments_seen,
  (SELECT count(DISTINCT segment_id) FROM rec) AS n_segments_written, (SELECT count(*) FROM rec) AS n_records""")
def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    own = segment.window_segments(contracts(spark, sf))
    return sinks.ingest_stats(own, segment.index_records(own, segment.windows_for(256)))


_TITLE_SQL = r"[A-Z][A-Za-z0-9 ,/\-'']"
_SCHEME_SQL = "CASE " + " ".join(
    f"WHEN len(regexp_extract_all(context, '{p}')) >= 3 THEN '{name}'"
    for name, p in (
        ("article", rf"(?i)\n\nARTICLE\s+[IVXLCDM0-9]+\s+{_TITLE_SQL}{{2,80}}?\n"),
        ("section_nn", rf"(?i)\n\nSection\s+\d+(?:\.\d+){{1,3}}\s+{_TITLE_SQL}{{2,60}}?\.\s"),
        ("bare_nn", rf"\n\n\d+(?:\.\d+){{1,3}}\s+{_TITLE_SQL}{{2,60}}?\.\s"),
        ("section_inline", r"(?i)[.\s]SECTION\s+\d+(?:\.\d+)*\b"),
        ("article_inline", r"(?i)[.\s]ARTICLE\s+[IVXLCDM0-9]+\b"),
        ("bare_nn_inline", rf"[.\s]\d+(?:\.\d+){{1,3}}\s+{_TITLE_SQL}{{2,60}}?[.:]\s"),
        ("int_dot_inline", rf"[.\s]\d{{1,2}}\.\s+{_TITLE_SQL}{{2,60}}?[.:]\s"),
    )
) + " END"


@query(f"WITH {STRUCTURED_SQL} SELECT contract_id, {_SCHEME_SQL} AS scheme FROM structured")
def scheme_choice(spark: SparkSession, sf: str) -> DataFrame:
    return structured(spark, sf).select("contract_id", segment.scheme_of(F.col("context")).alias("scheme"))


@query(f"""WITH RECURSIVE {structured_segments_sql()}
SELECT contract_id, scheme, CAST(i AS INTEGER) AS position, base AS start_char, CAST(base + length(text) AS INTEGER) AS end_char, header, length(text) < 175 AS is_undersized, md5({_EMBED.format(h='header')}) AS embedding_md5
FROM top WHERE scheme <> 'fallback'""")
def header_split(spark: SparkSession, sf: str) -> DataFrame:
    """Every structured contract with headings, cut by its own grammar."""
    own, out = structured(spark, sf), None
    for k, scheme in enumerate(KINDS[:-1]):
        rows = segment.with_context(segment.header_pieces(own.where(F.pmod(F.col("contract_id").cast("long"), F.lit(len(KINDS))) == k), scheme)).withColumn("scheme", F.lit(scheme))
        out = rows if out is None else out.unionByName(rows)
    return out.select("contract_id", "scheme", "position", "start_char", "end_char", "header", "is_undersized", F.md5("embedding_text").alias("embedding_md5"))


@query(f"""WITH RECURSIVE {structured_segments_sql()}
SELECT contract_id, segment_id, position, start_char, end_char, scheme, header, parent_id, is_undersized, md5({_EMBED.format(h="CASE WHEN parent_id IS NULL THEN header ELSE above || ' > ' || header END")}) AS embedding_md5 FROM full_seg""")
def segment_full(spark: SparkSession, sf: str) -> DataFrame:
    rows = segment.segment_documents(structured(spark, sf))
    return rows.select("contract_id", "segment_id", "position", "start_char", "end_char", "scheme", "header", "parent_id", "is_undersized", F.md5("embedding_text").alias("embedding_md5"))


@query()
def segment_full_plain(spark: SparkSession, sf: str) -> DataFrame:
    rows = segment.segment_documents(contracts(spark, sf))
    return rows.select("contract_id", "segment_id", "position", "start_char", "end_char", "scheme", "header", "is_undersized", F.md5("text").alias("text_md5"), F.md5("embedding_text").alias("embedding_md5"))


SQL["segment_full_plain"] = SQL["window_segments"]


@query("""WITH s AS (SELECT l_suppkey, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
b AS (SELECT *, max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM b)
SELECT l_suppkey, min(s) AS "start", max(e) AS "end" FROM i GROUP BY l_suppkey, island""")
def span_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end"))
    return spans.union_rows(rows, "l_suppkey")


_MAP = [("a", 0, 10, 5), ("a", 10, 12, None), ("a", 12, 20, 40), ("b", 0, 2, None), ("b", 2, 6, 9)]
_POS = [(d, p) for d in "abc" for p in (0, 1, 2, 5, 9, 10, 11, 12, 15, 20, 25)]
_MAP_SQL = ", ".join(f"('{d}', {a}, {b}, {'NULL' if o is None else o})" for d, a, b, o in _MAP)
_POS_SQL = ", ".join(f"('{d}', {p})" for d, p in _POS)


@query(f"""WITH m(doc_id, c_start, c_end, o_start) AS (VALUES {_MAP_SQL}), p(doc_id, pos) AS (VALUES {_POS_SQL}), k AS (SELECT * FROM m WHERE o_start IS NOT NULL)
SELECT doc_id, pos, coalesce((SELECT max(o_start + pos - c_start) FROM k WHERE k.doc_id = p.doc_id AND c_start <= pos AND pos < c_end), (SELECT arg_min(o_start, c_start) FROM k WHERE k.doc_id = p.doc_id AND pos <= c_start),
  (SELECT arg_max(o_start + c_end - c_start, c_start) FROM k WHERE k.doc_id = p.doc_id), pos) AS start_original,
  coalesce((SELECT max(o_start + pos - c_start) FROM k WHERE k.doc_id = p.doc_id AND c_start < pos AND pos <= c_end), (SELECT arg_max(o_start + c_end - c_start, c_start) FROM k WHERE k.doc_id = p.doc_id AND c_end <= pos), 0) AS end_original FROM p""")
def offset_translate(spark: SparkSession, sf: str) -> DataFrame:
    m = spark.createDataFrame(_MAP, "doc_id string, c_start int, c_end int, o_start int")
    p = spark.createDataFrame(_POS, "doc_id string, pos int")
    return spans.translate_starts(p, m).withColumnRenamed("original", "start_original").join(spans.translate_ends(p, m).withColumnRenamed("original", "end_original"), ["doc_id", "pos"])


# --- labels, capture, ceiling -----------------------------------------------------------------------------------------------------

_OVER = "least(s.end_char, g.gold_end) > greatest(s.start_char, g.gold_start)"
_LABEL_SQL = f"""{segments_sql()}, {EVAL_SQL},
lab AS (SELECT s.contract_id, s.position, list_sort(list(DISTINCT g.category)) AS labels FROM seg s JOIN gold g ON g.contract_id = s.contract_id AND {_OVER} GROUP BY ALL),
labelled AS (SELECT s.contract_id, s.position, s.start_char, s.end_char, s.n, s.text, coalesce(l.labels, []) AS labels FROM seg s LEFT JOIN lab l USING (contract_id, position))"""


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return spans.label_segments(segments(spark, sf), eval_rows(spark, sf))


@query(f"WITH RECURSIVE {_LABEL_SQL} SELECT contract_id, CAST(position AS INTEGER) AS position, array_to_string(labels, ',') AS labels, CAST(len(labels) AS INTEGER) AS n_labels FROM labelled")
def segment_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _labelled(spark, sf).select("contract_id", "position", F.array_join("labels", ",").alias("labels"), "n_labels")


@query(f"WITH RECURSIVE {_LABEL_SQL} SELECT c AS category, count(*) AS n_positive, count(DISTINCT contract_id) AS n_contracts FROM (SELECT contract_id, unnest(labels) AS c FROM labelled) GROUP BY c")
def label_stats(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_stats(_labelled(spark, sf))


@query(f"""WITH RECURSIVE {_LABEL_SQL}, c AS (SELECT c, count(*) AS n FROM (SELECT unnest(labels) AS c FROM labelled) GROUP BY c)
SELECT (SELECT count(*) FROM labelled) AS n_segments, (SELECT count(*) FROM labelled WHERE len(labels) > 0) AS n_labelled, (SELECT count(*) FROM labelled WHERE len(labels) = 0) AS n_unlabelled,
  min(n) AS min_positive, list_sort(list(n))[CAST(count(*) // 2 + 1 AS INTEGER)] AS median_positive, max(n) AS max_positive, count(*) FILTER (WHERE n < 50) AS n_under_50, count(*) FILTER (WHERE n < 100) AS n_under_100 FROM c""")
def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.label_summary(_labelled(spark, sf))


def _late(spark: SparkSession, sf: str) -> DataFrame:
    """Segments without the first one of each contract, so that not all gold can be captured."""
    return segments(spark, sf).where("position > 0")


_CAP_SQL = f"""{segments_sql()}, {EVAL_SQL},
cap AS (SELECT g.contract_id, g.category, g.gold_start, g.gold_end, EXISTS (SELECT 1 FROM seg s WHERE s.position > 0 AND s.contract_id = g.contract_id AND {_OVER}) AS captured FROM gold g)"""


@query(f"WITH RECURSIVE {_CAP_SQL} SELECT * FROM cap")
def gold_capture(spark: SparkSession, sf: str) -> DataFrame:
    return spans.capture(_late(spark, sf), eval_rows(spark, sf))


@query(f"WITH RECURSIVE {_CAP_SQL} SELECT count(*) AS n_gold_spans, count(*) FILTER (WHERE captured) AS n_captured, count(*) FILTER (WHERE captured) / count(*) AS capture_rate FROM cap")
def capture_rate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.capture_rate(spans.capture(_late(spark, sf), eval_rows(spark, sf)))


@query(f"""WITH RECURSIVE {_CAP_SQL}, r AS (SELECT contract_id, category, bool_or(captured) AS reachable FROM cap GROUP BY ALL)
SELECT category, count(*) AS n, count(*) FILTER (WHERE reachable) AS n_reachable, count(*) FILTER (WHERE reachable) / count(*) AS ceiling FROM r GROUP BY category""")
def ceiling_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.ceiling(spans.reachable(_late(spark, sf), eval_rows(spark, sf)), "category")


# --- term statistics and lexical ranking ------------------------------------------------------------------------------------------

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) or "''"


def _words_sql(source: str, keys: str, text: str, name: str, bigrams: bool = False) -> str:
    pairs = f" UNION ALL SELECT {keys}, w || ' ' || nxt FROM (SELECT *, lead(w) OVER (PARTITION BY {keys} ORDER BY p) AS nxt FROM {name}_k) WHERE nxt IS NOT NULL" if bigrams else ""
    return f"""
{name}_w AS (SELECT {keys}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS w, generate_subscripts(regexp_extract_all(lower({text}), '{TOKEN}'), 1) AS p FROM {source}),
{name}_k AS (SELECT * FROM {name}_w WHERE w NOT IN ({_STOP})),
{name} AS (SELECT {keys}, w AS term FROM {name}_k{pairs})"""


#: Whole numbers as doubles, rounded once.
_DOUBLE = "CAST(CAST({} AS VARCHAR) AS DOUBLE)"


def _chars_sql(source: str, keys: str, text: str, name: str, bigrams: bool = False) -> str:
    """Character n-grams of 3 to 5 within words between spaces; a padded word that is shorter stands once for itself."""
    return f"""
{name}_w AS (SELECT {keys}, ' ' || unnest(list_filter(regexp_split_to_array(lower({text}), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) || ' ' AS w FROM {source}),
{name} AS (SELECT {keys}, w AS term FROM {name}_w WHERE length(w) < 3
  UNION ALL SELECT {keys}, substr(w, i, k) FROM (SELECT {keys}, w, k, unnest(range(1, length(w) - k + 2)) AS i FROM {name}_w, (VALUES (3), (4), (5)) s(k) WHERE length(w) >= k))"""


def _tfidf_sql(bigrams: bool, question: str = "question", name: str = "lex", terms=_words_sql) -> str:  # noqa: ANN001
    """CTE ``<name>``: query_id, contract_id, start_char, end_char, score, position, rank."""
    return f"""{terms('seg', 'contract_id, position', 'text', name + '_st', bigrams)},
{name}_tf AS (SELECT contract_id, position, term, count(*) AS tf FROM {name}_st GROUP BY ALL),
{name}_df AS (SELECT contract_id, term, count(*) AS df FROM {name}_tf GROUP BY ALL),
{name}_n AS (SELECT contract_id, count(*) AS n FROM seg GROUP BY ALL),
{name}_raw AS (SELECT t.*, df, tf * (ln((1 + n) / (1 + df)) + 1) AS w, CAST(floor((ln((1 + n) / (1 + df)) + 1) * 1000000000 + 0.5) AS HUGEINT) AS idf FROM {name}_tf t JOIN {name}_df USING (contract_id, term) JOIN {name}_n USING (contract_id)),
{name}_wt AS (SELECT contract_id, position, term, idf, tf * idf AS v, w / sqrt(sum(w * w) OVER (PARTITION BY contract_id, position)) AS weight FROM {name}_raw),
{name}_len AS (SELECT contract_id, position, {_DOUBLE.format('sum(v * v)')} AS l2 FROM {name}_wt GROUP BY ALL),
{terms('ev', 'query_id, contract_id', question, name + '_qt', bigrams)},
{name}_qtf AS (SELECT query_id, contract_id, term, count(*) AS tf FROM {name}_qt GROUP BY ALL),
{name}_qwt AS (SELECT q.*, q.tf * d.idf AS qv FROM {name}_qtf q JOIN (SELECT contract_id, term, any_value(idf) AS idf FROM {name}_wt GROUP BY ALL) d USING (contract_id, term)),
{name}_qlen AS (SELECT query_id, {_DOUBLE.format('sum(qv * qv)')} AS l2 FROM {name}_qwt GROUP BY ALL),
{name}_dot AS (SELECT query_id, contract_id, position, {_DOUBLE.format('sum(qv * v)')} AS dot FROM {name}_qwt JOIN {name}_wt USING (contract_id, term) GROUP BY ALL),
{name}_sc AS (SELECT d.*, dot / (sqrt(q.l2) * sqrt(s.l2)) AS score FROM {name}_dot d JOIN {name}_qlen q USING (query_id) JOIN {name}_len s USING (contract_id, position)),
{name}_all AS (SELECT e.query_id, s.contract_id, s.start_char, s.end_char, s.position, coalesce(c.score, 0) AS score, s.contract_id IN (SELECT contract_id FROM {name}_df) AS has_terms
  FROM ev e JOIN seg s USING (contract_id) LEFT JOIN {name}_sc c ON c.query_id = e.query_id AND c.position = s.position),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY floor(score / 1e-12 + 0.5) DESC, CASE WHEN has_terms THEN -position ELSE position END) AS rank FROM {name}_all)"""


_BASE_SQL = f"WITH RECURSIVE {segments_sql()}, {EVAL_SQL}"
_RANKED = "query_id, contract_id, start_char, end_char, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank"


def _shown(ranking: DataFrame) -> DataFrame:
    return ranking.withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {segments_sql()}, {_words_sql('seg', 'contract_id, position', 'text', 'st')},
tf AS (SELECT contract_id, position, term, count(*) AS tf FROM st GROUP BY ALL), df AS (SELECT contract_id, term, count(*) AS df FROM tf GROUP BY ALL)
SELECT contract_id, sum(tf)::BIGINT AS tokens, count(*) AS postings, count(DISTINCT term) AS terms, max(df) AS max_df FROM tf JOIN df USING (contract_id, term) GROUP BY contract_id""")
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank.term_stats(segments(spark, sf))
    return rows.groupBy("contract_id").agg(F.sum("tf").alias("tokens"), F.count("*").alias("postings"), F.count_if("first").alias("terms"), F.max("df").alias("max_df"))


@query(f"""WITH RECURSIVE {segments_sql()}, {EVAL_SQL}, {_tfidf_sql(False)} SELECT contract_id, CAST(position AS INTEGER) AS position, count(*) AS terms, round(max(weight), 6) AS max_weight, round(sum(weight), 6) AS sum_weight FROM lex_wt GROUP BY ALL""")
def tfidf_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = rank.tfidf_weights(rank.term_stats(segments(spark, sf)))
    return rows.groupBy("contract_id", "position").agg(F.count("*").alias("terms"), F.round(F.max("weight"), 6).alias("max_weight"), F.round(F.sum("weight"), 6).alias("sum_weight"))


@query(f"{_BASE_SQL}, {_tfidf_sql(False)} SELECT {_RANKED} FROM lex WHERE rank <= {K}")
def tfidf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(rank.lexical(eval_rows(spark, sf), segments(spark, sf), K))


@query(f"{_BASE_SQL}, {_tfidf_sql(True)} SELECT {_RANKED} FROM lex WHERE rank <= {K}")
def tfidf_bigram_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(rank.lexical(eval_rows(spark, sf), segments(spark, sf), K, (1, 2)))


@query(f"{_BASE_SQL}, {_tfidf_sql(False, terms=_chars_sql)} SELECT {_RANKED} FROM lex WHERE rank <= {K}")
def char_ngram_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _shown(rank.lexical(eval_rows(spark, sf), segments(spark, sf), K, (3, 5), "char_wb"))


#: The draw of ``functions.text.drawn``.
_DRAWN = "CAST('0x' || substr(md5({}), 1, 15) AS BIGINT)"


@query(f"""{_BASE_SQL}, r AS (SELECT query_id, s.contract_id, start_char, end_char, row_number() OVER (PARTITION BY query_id ORDER BY {_DRAWN.format("'0|' || query_id || '|' || start_char || '|' || end_char")}, start_char, end_char) AS rank FROM ev JOIN seg s USING (contract_id))
SELECT query_id, contract_id, start_char, end_char, 0.0::DOUBLE AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}""")
def random_baseline(spark: SparkSession, sf: str) -> DataFrame:
    return rank.random_ranking(eval_rows(spark, sf), segments(spark, sf), K)


# --- vector ranking, fusion, priors, reranking ------------------------------------------------------------------------------------


def _vectors(spark: SparkSession, sf: str, width: int) -> tuple[DataFrame, DataFrame]:
    own = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("contract_id"), F.col("embedding").alias("vector"))
    start = (F.floor(F.col("vec_id") / width) * width).cast("int")
    records = own.select("contract_id", F.col("vec_id").alias("record_id"), start.alias("start_char"), (start + width).alias("end_char"), "vector")
    asked = own.where("vec_id % 25 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "contract_id", "vector")
    return asked, records


def _dense_sql(width: int) -> str:
    return f"""WITH r AS (SELECT vec_id, CAST(label AS VARCHAR) AS contract_id, CAST(vec_id // {width} * {width} AS INTEGER) AS s, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
d AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, r.contract_id, r.s, r.vec_id, round(1 - list_dot_product(q.v, r.v), 9) AS distance FROM r q JOIN r USING (contract_id) WHERE q.vec_id % 25 = 0),
b AS (SELECT query_id, contract_id, s, min(distance) AS distance, arg_min(vec_id, (distance, vec_id)) AS vec_id FROM d GROUP BY query_id, contract_id, s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM b)
SELECT query_id, contract_id, s AS start_char, CAST(s + {width} AS INTEGER) AS end_char, round(distance, 6) + 0.0::DOUBLE AS distance, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= {K}"""


@query(_dense_sql(1))
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return rank.dense(*_vectors(spark, sf, 1), K).withColumn("distance", F.round("distance", 6))


@query(_dense_sql(8))
def dense_maxpool(spark: SparkSession, sf: str) -> DataFrame:
    return rank.dense(*_vectors(spark, sf, 8), K).withColumn("distance", F.round("distance", 6))


def _fuse_sql(weight: int) -> str:
    return f"""{_BASE_SQL}, {_tfidf_sql(False, name='la')}, {_tfidf_sql(True, name='lb')},
u AS (SELECT query_id, contract_id, start_char, end_char, rank, 0 AS source, 1.0::DOUBLE / (60 + rank) AS part FROM la WHERE rank <= 20
  UNION ALL SELECT query_id, contract_id, start_char, end_char, rank, 1, {weight}.0::DOUBLE / (60 + rank) FROM lb WHERE rank <= 20),
f AS (SELECT query_id, contract_id, start_char, end_char, round(sum(part), 12) AS score, min(rank) FILTER (WHERE source = 0) AS lr, min(source * 1000 + rank) AS seen FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lr NULLS LAST, seen) AS rank FROM f) SELECT {_RANKED} FROM r WHERE rank <= {K}"""


def _two(spark: SparkSession, sf: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Word and bigram rankings, made in one walk and staged together."""
    both = staged(rank.lexicals(eval_rows(spark, sf), segments(spark, sf), k, {"tfidf": rank.Lexicon(), "tfidf_bigram": rank.Lexicon((1, 2))}), "ranked")
    return both.where("kind = 'tfidf'").drop("kind"), both.where("kind = 'tfidf_bigram'").drop("kind")


@query(_fuse_sql(1))
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf, rank.DEPTH)
    return _shown(rank.fuse([(a, 1.0), (b, 1.0)], K))


@query(_fuse_sql(2))
def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _two(spark, sf, rank.DEPTH)
    return _shown(rank.fuse([(a, 1.0), (b, 2.0)], K))


_RATES_SQL = """rates AS (SELECT e.category, count(*) AS n, avg(CASE WHEN EXISTS (SELECT 1 FROM seg s JOIN gold g ON g.contract_id = s.contract_id
  WHERE s.position < 1 AND s.contract_id = e.contract_id AND g.category = e.category AND least(s.end_char, g.gold_end) > greatest(s.start_char, g.gold_start)) THEN 1.0 ELSE 0.0 END) AS rate
  FROM ev e WHERE has_gold_span GROUP BY e.category)"""


@query(f"{_BASE_SQL}, {_RATES_SQL} SELECT category, n, round(rate, 6) AS rate FROM rates")
def lead_prior_rates(spark: SparkSession, sf: str) -> DataFrame:
    return rank.lead_rates(eval_rows(spark, sf), segments(spark, sf)).withColumn("rate", F.round("rate", 6))


@query(f"{_BASE_SQL}, {_RATES_SQL} SELECT category, CAST(1 AS INTEGER) AS n_lead FROM rates WHERE n >= 20 AND rate >= 0.6")
def lead_prior_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rank.fit_prior(eval_rows(spark, sf), segments(spark, sf))


@query(f"""{_BASE_SQL}, {_RATES_SQL}, {_tfidf_sql(False)},
p AS (SELECT category FROM rates WHERE n >= 20 AND rate >= 0.6),
u AS (SELECT e.query_id, s.contract_id, s.start_char, s.end_char, s.position AS place FROM ev e JOIN p USING (category) JOIN seg s USING (contract_id) WHERE s.position < 1
  UNION ALL SELECT query_id, contract_id, start_char, end_char, 1000000 + rank FROM lex WHERE rank <= {K + 1}),
b AS (SELECT query_id, contract_id, start_char, end_char, min(place) AS place FROM u GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM b) SELECT query_id, contract_id, start_char, end_char, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}""")
def lead_prior_apply(spark: SparkSession, sf: str) -> DataFrame:
    q, s = eval_rows(spark, sf), segments(spark, sf)
    return rank.with_prior(rank.lexical(q, s, K + rank.PRIOR_LEAD), q, s, rank.fit_prior(q, s), K).drop("score")


@query(f"""{_BASE_SQL}, {_tfidf_sql(False)},
c AS (SELECT l.query_id, l.contract_id, l.start_char, l.end_char, l.rank, list_distinct(list_filter(regexp_split_to_array(lower(e.question), '\\s+'), lambda w: w <> '')) AS qw,
  list_filter(regexp_split_to_array(lower(substr({_EMBED.format(h="CASE WHEN s.n < 1200 THEN '' ELSE '[window ' || s.position || ']' END").replace('text', 's.text')}, 1, 1400)), '\\s+'), lambda w: w <> '') AS pw
  FROM lex l JOIN ev e USING (query_id) JOIN seg s ON s.contract_id = l.contract_id AND s.position = l.position WHERE rank <= 20),
n AS (SELECT query_id, contract_id, start_char, end_char, rank AS old, round(len(list_intersect(qw, pw)) / greatest(1, len(qw)), 9) AS score FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM n) SELECT {_RANKED} FROM r WHERE rank <= {K}""")
def rerank_stub(spark: SparkSession, sf: str) -> DataFrame:
    q, s = eval_rows(spark, sf), segments(spark, sf)
    return _shown(rank.rerank(rank.lexical(q, s, rank.RERANK_DEPTH), q, s, K))


# --- scores -----------------------------------------------------------------------------------------------------------------------

_SCORE_SQL = f"""hits AS (SELECT l.query_id, sum(greatest(0, least(l.end_char, g.gold_end) - greatest(l.start_char, g.gold_start))) AS chars FROM top l JOIN ev e USING (query_id) JOIN gold g ON g.contract_id = e.contract_id AND g.category = e.category GROUP BY 1),
ret AS (SELECT query_id, sum(end_char - start_char) AS chars FROM top GROUP BY 1),
tot AS (SELECT contract_id || '|' || category AS query_id, CASE WHEN count(*) = 2 AND max(gold_start) <= min(gold_end) THEN max(gold_end) - min(gold_start) ELSE sum(gold_end - gold_start) END AS chars FROM gold GROUP BY ALL),
scored AS (SELECT e.query_id, e.category, e.has_gold_span, coalesce(h.chars, 0) > 0 AS hit, CAST(coalesce(least(h.chars, t.chars), 0) AS INTEGER) AS gold_chars_hit, CAST(coalesce(t.chars, 0) AS INTEGER) AS gold_chars_total, CAST(coalesce(r.chars, 0) AS INTEGER) AS retrieved_chars
  FROM ev e LEFT JOIN hits h USING (query_id) LEFT JOIN ret r USING (query_id) LEFT JOIN tot t USING (query_id))"""
_ROLL = """count(*) FILTER (WHERE has_gold_span) AS n_scored, count(*) FILTER (WHERE NOT has_gold_span) AS n_skipped_no_gold,
  round(count(*) FILTER (WHERE has_gold_span AND hit) / count(*) FILTER (WHERE has_gold_span), 6) AS hit_rate,
  round(sum(gold_chars_hit) FILTER (WHERE has_gold_span) / sum(gold_chars_total) FILTER (WHERE has_gold_span), 6) AS gold_recall,
  round(sum(gold_chars_hit) FILTER (WHERE has_gold_span) / sum(retrieved_chars) FILTER (WHERE has_gold_span), 6) AS gold_density,
  round(sum(retrieved_chars) FILTER (WHERE has_gold_span) / count(*) FILTER (WHERE has_gold_span), 6) AS mean_retrieved_chars"""
_TOP = f"top AS (SELECT * FROM lex WHERE rank <= {K})"


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.score_rankings(rank.lexical(eval_rows(spark, sf), segments(spark, sf), K), eval_rows(spark, sf), K)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(f"{_BASE_SQL}, {_tfidf_sql(False)}, {_TOP}, {_SCORE_SQL} SELECT query_id, hit, gold_chars_hit, gold_chars_total, retrieved_chars FROM scored")
def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).select("query_id", "hit", "gold_chars_hit", "gold_chars_total", "retrieved_chars")


@query(f"{_BASE_SQL}, {_tfidf_sql(False)}, {_TOP}, {_SCORE_SQL} SELECT {_ROLL} FROM scored")
def score_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.roll_up(_scores(spark, sf)))


@query(f"{_BASE_SQL}, top AS (SELECT e.query_id, 0 AS start_char, d.n AS end_char FROM ev e JOIN ev_doc d USING (contract_id)), {_SCORE_SQL} SELECT {_ROLL} FROM scored")
def density_guard(spark: SparkSession, sf: str) -> DataFrame:
    whole = contracts(spark, sf).select("contract_id", F.lit(0).alias("start_char"), F.char_length("context").alias("end_char"))
    ranking = eval_rows(spark, sf).select("query_id", "contract_id").join(whole, "contract_id").withColumn("rank", F.lit(1))
    return _rounded(metrics.roll_up(metrics.score_rankings(ranking, eval_rows(spark, sf), 1)))


_FIRST_SQL = f"""{_BASE_SQL}, {_tfidf_sql(False)},
fr AS (SELECT e.query_id, e.contract_id, e.category, min(l.rank) AS first_rank FROM ev e LEFT JOIN (SELECT l.query_id, l.rank FROM lex l JOIN ev e USING (query_id) JOIN gold g ON g.contract_id = e.contract_id AND g.category = e.category
  WHERE l.rank <= 50 AND least(l.end_char, g.gold_end) > greatest(l.start_char, g.gold_start)) l USING (query_id) WHERE e.has_gold_span GROUP BY ALL)"""


def _first(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_gold_rank(rank.lexical(eval_rows(spark, sf), segments(spark, sf), 50), eval_rows(spark, sf))


@query(f"{_FIRST_SQL} SELECT query_id, contract_id, category, CAST(first_rank AS INTEGER) AS first_rank FROM fr")
def rank_first_gold(spark: SparkSession, sf: str) -> DataFrame:
    return _first(spark, sf)


@query(f"""{_FIRST_SQL}, k(k) AS (VALUES (1), (3), (5), (10), (20), (50)), c AS (SELECT k, count(*) FILTER (WHERE first_rank <= k) / count(*) AS r, count(*) FILTER (WHERE first_rank <= 5) / count(*) AS b FROM fr, k GROUP BY k)
SELECT k, round(r, 6) AS hit_rate, round(r - b, 6) AS gain FROM c""")
def rank_curve(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.rank_curve(_first(spark, sf)))


@query(f"""{_FIRST_SQL}, b(bucket, lo, hi) AS (VALUES ('1', 1, 1), ('2-3', 2, 3), ('4-5', 4, 5), ('6-10', 6, 10), ('11-20', 11, 20), ('21-50', 21, 50), ('not found', NULL, NULL))
SELECT bucket, count(*) FILTER (WHERE first_rank BETWEEN lo AND hi OR (lo IS NULL AND first_rank IS NULL)) AS n, round(count(*) FILTER (WHERE first_rank BETWEEN lo AND hi OR (lo IS NULL AND first_rank IS NULL)) / count(*), 6) AS share FROM fr, b GROUP BY bucket""")
def rank_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.rank_buckets(_first(spark, sf)))


@query(f"{_FIRST_SQL} SELECT count(*) AS n, count(first_rank) AS n_found, round(coalesce(sum(1.0 / first_rank), 0) / count(*), 6) AS mrr, quantile_cont(first_rank, 0.5) AS median_rank, round(avg(first_rank), 6) AS mean_rank FROM fr")
def rank_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.rank_summary(_first(spark, sf)))


@query(f"{_FIRST_SQL} SELECT category, count(*) AS n, round(count(*) FILTER (WHERE first_rank <= 5) / count(*), 6) AS hit_rate FROM fr GROUP BY category HAVING count(*) >= 20")
def category_hit5(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(metrics.category_hits(_first(spark, sf)))


# --- classifier -------------------------------------------------------------------------------------------------------------------


def _training(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled(spark, sf).withColumn("parent_id", F.lit(None).cast("string")).withColumn("is_oversized_split", F.lit(False))
    return classify.training_rows(rows)


_STRUCT_SQL = f"""WITH RECURSIVE {segments_sql()},
st AS (SELECT contract_id, CAST(position AS INTEGER) AS position, position / count(*) OVER (PARTITION BY contract_id) AS relative_position, CASE WHEN position = 0 THEN 1.0 ELSE 0.0 END AS is_first,
  CASE WHEN position = count(*) OVER (PARTITION BY contract_id) - 1 THEN 1.0 ELSE 0.0 END AS is_last, ln(1 + length(text)) AS log_char_len, CASE WHEN length(text) < 175 THEN 1.0 ELSE 0.0 END AS is_undersized,
  CASE WHEN n < 1200 THEN 0.0 ELSE 2.0 END AS header_tokens, CASE WHEN n < 1200 THEN 0.0 ELSE 1.0 END AS header_has_digit, 1.0 AS scheme_fallback,
  0.0 AS is_preamble, 0.0 AS is_oversized_split, 0.0 AS has_parent, 0.0 AS scheme_article, 0.0 AS scheme_section_nn, 0.0 AS scheme_bare_nn FROM seg)"""
_SHOWN = classify.STRUCTURAL


@query(f"{_STRUCT_SQL} SELECT contract_id, position, {', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in _SHOWN)} FROM st")
def structural_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(classify.structural(_training(spark, sf)).select("contract_id", "position", *_SHOWN))


@query(f"""{_STRUCT_SQL}, r AS (SELECT min(log_char_len) AS lo, max(log_char_len) AS hi FROM st WHERE contract_id NOT LIKE '%0')
SELECT contract_id, position, CASE WHEN contract_id LIKE '%0' THEN 'held' ELSE 'train' END AS side, round(greatest(0, least(1, (log_char_len - lo) / (hi - lo))), 6) AS log_char_len FROM st, r""")
def minmax_scaled(spark: SparkSession, sf: str) -> DataFrame:
    """Every segment, scaled by the ranges of the training side."""
    rows = classify.structural(_training(spark, sf)).withColumn("side", F.when(F.endswith("contract_id", F.lit("0")), "held").otherwise("train"))
    out = classify.scaled(rows, classify.fit_ranges(rows.where("side = 'train'")))
    return _rounded(out.select("contract_id", "position", "side", "log_char_len"))


_SIM_WORDS = _words_sql("docs_t", "id", "text", "dt") + "," + _words_sql("items_t", "id", "text", "it")


@query(f"""WITH docs_t AS (SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text FROM documents), items_t AS (SELECT CAST(item_id AS VARCHAR) AS id, text FROM benchmark), {_SIM_WORDS},
a AS (SELECT id, term, count(*) AS c FROM dt GROUP BY ALL), an AS (SELECT id, term, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM a),
b AS (SELECT id, term, count(*) AS c FROM it GROUP BY ALL), bn AS (SELECT id, term, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS w FROM b)
SELECT an.id, bn.id AS category, round(sum(an.w * bn.w), 6) AS similarity FROM an JOIN bn USING (term) GROUP BY ALL""")
def definition_similarity(spark: SparkSession, sf: str) -> DataFrame:
    docs = rank.count_weights(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text"))
    items = rank.count_weights(table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), "text")).withColumnRenamed("id", "category")
    return _rounded(classify.similarity(docs, items))


@query(f"""WITH i AS (SELECT CAST(doc_id AS VARCHAR) AS contract_id, row_number() OVER (ORDER BY {_DRAWN.format("'42|' || doc_id")}, CAST(doc_id AS VARCHAR)) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT doc_id FROM documents)),
h AS (SELECT *, CAST(greatest(1, round_even(0.2 * n, 0)) AS BIGINT) AS held FROM i), v AS (SELECT *, held + CAST(greatest(1, round_even(0.16 / 0.8 * (n - held), 0)) AS BIGINT) AS val FROM h)
SELECT contract_id, CASE WHEN k <= held THEN 'test' WHEN k <= val THEN 'validation' ELSE 'train' END AS side FROM v""")
def split_by_contract(spark: SparkSession, sf: str) -> DataFrame:
    parts = classify.split_by_contract(contracts(spark, sf).select("contract_id"), validation=classify.VALIDATION)
    out = None
    for name, rows in parts.items():
        part = rows.withColumn("side", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


_PSEUDO_SQL = "WITH s AS (SELECT l_returnflag AS category, CASE WHEN l_linestatus = 'O' THEN 1.0 ELSE 0.0 END AS target, l_discount * 5 + CASE WHEN l_linestatus = 'O' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS probability FROM lineitem)"


def _pseudo(spark: SparkSession, sf: str) -> DataFrame:
    positive = F.col("l_linestatus") == "O"
    score = F.col("l_discount") * 5 + F.when(positive, F.lit(0.3)).otherwise(F.lit(0.0))
    return table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("category"), positive.cast("double").alias("target"), score.alias("probability"))


@query(f"""{_PSEUDO_SQL}, g(t) AS (SELECT round(CAST(i AS DOUBLE) * 5 / 100, 2) FROM range(1, 20) r(i)),
c AS (SELECT category, t, count(*) FILTER (WHERE probability >= t AND target = 1) AS tp, count(*) FILTER (WHERE probability >= t AND target = 0) AS fp, count(*) FILTER (WHERE probability < t AND target = 1) AS fn FROM s, g GROUP BY ALL),
f AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY f1 DESC, t) AS k FROM f)
SELECT category, CASE WHEN tp + fn > 0 AND f1 > 0 THEN t ELSE 0.5 END AS threshold FROM b WHERE k = 1""")
def threshold_search(spark: SparkSession, sf: str) -> DataFrame:
    return classify.tune_thresholds(_pseudo(spark, sf))


_PRF_SQL = f"""{_PSEUDO_SQL}, c AS (SELECT category, count(*) FILTER (WHERE probability >= 0.5 AND target = 1) AS tp, count(*) FILTER (WHERE probability >= 0.5 AND target = 0) AS fp, count(*) FILTER (WHERE probability < 0.5 AND target = 1) AS fn FROM s GROUP BY ALL),
p AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM c)"""


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return classify.precision_recall(_pseudo(spark, sf).withColumn("predicted", (F.col("probability") >= 0.5).cast("int")))


@query(f"{_PRF_SQL} SELECT category, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM p")
def prf_report(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_decided(spark, sf))


@query(f"""{_PRF_SQL} SELECT 'macro' AS average, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1 FROM p
UNION ALL SELECT 'micro', round(sum(tp) / sum(tp + fp), 6), round(sum(tp) / sum(tp + fn), 6), round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) FROM p""")
def prf_macro_micro(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(classify.macro_micro(_decided(spark, sf)))


@query()
def ovr_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One model for quality and one for toxicity, trained and tested on documents apart."""
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").select(
        F.col("doc_id").cast("string").alias("contract_id"), F.col("doc_id").cast("string").alias("segment_id"), "text",
        F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull()).alias("labels"),
    )
    result = classify.run_step(classify.split_by_contract(rows), classify.Step("control"), classify.categories_of(rows))
    return spark.createDataFrame([(r["category"], r["precision"], r["recall"], r["f1"], r["support"]) for r in result["per_category"]], "category string, precision double, recall double, f1 double, support long")


# --- generation and judging -------------------------------------------------------------------------------------------------------

_CHUNK_SQL = f"""{_BASE_SQL}, {_tfidf_sql(False)},
ch AS (SELECT l.query_id, string_agg('[' || rank || ']' || CASE WHEN s.n < 1200 THEN '' ELSE ' [window ' || s.position || ']' END || ' (chars ' || l.start_char || '-' || l.end_char || ')' || chr(10) || trim(s.text, {_WS}), chr(10) || chr(10) ORDER BY rank) AS chunks
  FROM lex l JOIN seg s ON s.contract_id = l.contract_id AND s.position = l.position WHERE rank <= {K} GROUP BY 1)"""
_PROMPT_SQL = f"'CONTRACT EXCERPTS' || chr(10) || '-----------------' || chr(10) || chunks || chr(10) || chr(10) || 'QUESTION' || chr(10) || '--------' || chr(10) || trim(question, {_WS}) || chr(10) || chr(10) ||"


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    q, s = eval_rows(spark, sf), segments(spark, sf)
    return generation.chunks_for(q, rank.lexical(q, s, K), s)


@query(f"{_CHUNK_SQL} SELECT query_id, md5({_PROMPT_SQL} 'Answer using only the excerpts above.') AS prompt_md5 FROM ch JOIN ev USING (query_id)")
def prompt_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("query_id", F.md5(generation.answer_prompt(F.col("question"), F.col("chunks"))).alias("prompt_md5"))


@query(f"{_CHUNK_SQL} SELECT query_id, md5({_PROMPT_SQL} 'ANSWER TO GRADE' || chr(10) || '---------------' || chr(10) || query_id || chr(10) || chr(10) || 'Label this answer.') AS prompt_md5 FROM ch JOIN ev USING (query_id)")
def judge_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("query_id", F.md5(generation.judge_prompt(F.col("question"), F.col("chunks"), F.col("query_id"))).alias("prompt_md5"))


_REPLIES = ("SUPPORTED\nall of it", "partially_supported.\n\n  most of it ", "<think>is it SUPPORTED?</think>\nUnsupported\nno", "PARTIALLY SUPPORTED\nx", "no idea", "  \n", "rate limit 429")
_LOG_SQL = f"""log AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS run_id, (conv_id + turn) % 7 AS c, role = 'user' AS has_gold_span FROM conversations),
said AS (SELECT *, CASE c WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED' WHEN 3 THEN 'SUPPORTED' WHEN 4 THEN 'UNPARSEABLE' WHEN 5 THEN 'ABSTAINED' ELSE 'NOT_JUDGED' END AS judge_label FROM log)"""


def _log(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role").withColumn("c", F.pmod(F.col("conv_id") + F.col("turn"), F.lit(7)).cast("int"))
    reply = F.get(F.array(*map(F.lit, _REPLIES)), F.col("c"))
    label = F.when(F.col("c") == 5, generation.ABSTAINED).when(F.col("c") == 6, generation.NOT_JUDGED).otherwise(generation.verdict(reply)["label"])
    return rows.select("conv_id", "turn", F.col("conv_id").cast("string").alias("run_id"), (F.col("role") == "user").alias("has_gold_span"), reply.alias("reply"), label.alias("judge_label"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIALLY_SUPPORTED' WHEN 2 THEN 'UNSUPPORTED' WHEN 3 THEN 'SUPPORTED' ELSE 'UNPARSEABLE' END AS label,
  CASE (conv_id + turn) % 7 WHEN 0 THEN 'all of it' WHEN 1 THEN 'most of it' WHEN 2 THEN 'no' WHEN 3 THEN 'x' WHEN 4 THEN 'no idea' WHEN 5 THEN '' ELSE 'rate limit 429' END AS rationale FROM conversations""")
def verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _log(spark, sf).select("conv_id", "turn", generation.verdict(F.col("reply")).alias("v")).select("conv_id", "turn", "v.label", "v.rationale")


@query(f"""WITH {_LOG_SQL} SELECT count(*) AS n, {', '.join(f"count(*) FILTER (WHERE judge_label = '{x}') AS n_{x.lower()}" for x in generation.LABELS)},
  count(*) FILTER (WHERE judge_label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED')) AS n_scored,
  round(count(*) FILTER (WHERE judge_label = 'SUPPORTED') / count(*) FILTER (WHERE judge_label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED')), 6) AS faithful_rate,
  round(count(*) FILTER (WHERE judge_label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED')) / count(*) FILTER (WHERE judge_label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED')), 6) AS supported_or_partial_rate,
  round(count(*) FILTER (WHERE judge_label = 'ABSTAINED') / count(*), 6) AS abstention_rate,
  round(count(*) FILTER (WHERE judge_label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'UNSUPPORTED', 'ABSTAINED')) / count(*), 6) AS coverage FROM said""")
def judge_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(generation.judge_summary(_log(spark, sf)))


@query(f"WITH {_LOG_SQL} SELECT count(*) AS n_absent, count(*) FILTER (WHERE judge_label = 'ABSTAINED') AS n_abstained, round(count(*) FILTER (WHERE judge_label = 'ABSTAINED') / count(*), 6) AS abstention_rate FROM said WHERE NOT has_gold_span")
def absent_abstention(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(generation.absent_abstention(_log(spark, sf)))


@query("""WITH l AS (SELECT event_id, user_id % 50 AS run_id, CASE WHEN value > 20 THEN 'NOT_JUDGED' ELSE 'SUPPORTED' END AS judge_label FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY event_id) AS n FROM l),
g AS (SELECT *, coalesce(max(n) FILTER (WHERE judge_label <> 'NOT_JUDGED') OVER (PARTITION BY run_id ORDER BY event_id ROWS UNBOUNDED PRECEDING), 0) AS good FROM n),
s AS (SELECT *, min(n) FILTER (WHERE n - good >= 5) OVER (PARTITION BY run_id) AS stop FROM g)
SELECT event_id, run_id, judge_label FROM s WHERE stop IS NULL OR n <= stop""")
def early_stop(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("value") > 20, "NOT_JUDGED").otherwise("SUPPORTED")
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 50).alias("run_id"), label.alias("judge_label"))
    return generation.stop_after_failures(rows, "event_id")


@query(f"""WITH RECURSIVE {_LABEL_SQL}, g AS (SELECT contract_id, position, list_contains(labels, 'Middle Clause') AS gold FROM labelled WHERE length(trim(text, {_WS})) >= 20),
r AS (SELECT *, row_number() OVER (PARTITION BY gold ORDER BY contract_id, position) AS k FROM g) SELECT contract_id, CAST(position AS INTEGER) AS position, gold FROM r WHERE k <= 8""")
def zero_shot_sample(spark: SparkSession, sf: str) -> DataFrame:
    return generation.class_sample(_labelled(spark, sf), "Middle Clause").select("contract_id", "position", "gold")


@query("""WITH r AS (SELECT event_id % 2 = 0 AS gold, CASE event_id % 5 WHEN 0 THEN 'YES, it is' WHEN 1 THEN ' no' WHEN 2 THEN 'Yes' WHEN 3 THEN 'maybe' END AS reply, CASE WHEN event_id % 5 = 4 THEN 'failed' END AS error, value AS latency_s FROM events),
p AS (SELECT *, CASE WHEN starts_with(upper(trim(reply)), 'YES') THEN true WHEN starts_with(upper(trim(reply)), 'NO') THEN false END AS predicted FROM r)
SELECT count(*) AS n, count(predicted) AS n_parsed, count(*) FILTER (WHERE predicted IS NULL AND error IS NULL) AS n_unparseable, count(error) AS n_errors,
  round(count(*) FILTER (WHERE predicted = gold) / count(predicted), 6) AS accuracy, round(avg(latency_s), 4) AS mean_latency_s, round(sum(latency_s), 2) AS total_latency_s FROM p""")
def zero_shot_summary(spark: SparkSession, sf: str) -> DataFrame:
    from spanloom.functions.text import yes_no

    c = F.col("event_id") % 5
    reply = F.when(c == 0, "YES, it is").when(c == 1, " no").when(c == 2, "Yes").when(c == 3, "maybe")
    rows = table(spark, sf, "events").select((F.col("event_id") % 2 == 0).alias("gold"), yes_no(reply).alias("predicted"), F.when(c == 4, "failed").alias("error"), F.col("value").alias("latency_s"))
    out = generation.diagnostic_summary(rows)
    return out.withColumn("accuracy", F.round("accuracy", 6)).withColumn("mean_latency_s", F.round("mean_latency_s", 4)).withColumn("total_latency_s", F.round("total_latency_s", 2))


@query(f"""WITH {EVAL_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY has_gold_span ORDER BY {_DRAWN.format("'42|' || contract_id || '|' || category")}, contract_id, category) AS k FROM ev)
SELECT query_id, has_gold_span, {_DRAWN.format("'43|' || contract_id || '|' || category")} AS sample_order FROM r WHERE k <= CASE WHEN has_gold_span THEN 60 ELSE 20 END""")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    return generation.stratified_sample(eval_rows(spark, sf)).select("query_id", "has_gold_span", "sample_order")


def _scored_sql(name: str) -> str:
    """The CTEs of _SCORE_SQL for the ranking ``name``, their names with it in front."""
    out = f"top AS (SELECT * FROM {name} WHERE rank <= {K}), {_SCORE_SQL}"
    for cte in ("top", "hits", "ret", "tot", "scored"):
        out = re.sub(rf"\b{cte}\b(?= AS \(| [lhrt] | GROUP BY 1|$|\)|\n)", f"{name}_{cte}", out)
    return out


@query(f"""{_BASE_SQL}, {_tfidf_sql(False, name='la')}, {_tfidf_sql(True, name='lb')}, {_scored_sql('la')}, {_scored_sql('lb')},
res AS (SELECT 'tfidf' AS variant, {_ROLL.replace('round(', '(').replace(', 6)', ')')} FROM la_scored UNION ALL SELECT 'tfidf_bigram', {_ROLL.replace('round(', '(').replace(', 6)', ')')} FROM lb_scored)
SELECT variant, n_scored, n_skipped_no_gold, round(hit_rate, 6) AS hit_rate, round(gold_recall, 6) AS gold_recall, round(gold_density, 6) AS gold_density, round(mean_retrieved_chars, 6) AS mean_retrieved_chars,
  round(hit_rate - (SELECT hit_rate FROM res WHERE variant = 'tfidf'), 6) AS hit_rate_delta FROM res""")
def results_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Two variants recorded one after the other in one table, with the difference to the first."""
    path = new_path(spark, "results")
    q, s = eval_rows(spark, sf), segments(spark, sf)
    for name, ranking in zip(("tfidf", "tfidf_bigram"), _two(spark, sf, K), strict=True):
        sinks.merge_result(metrics.roll_up(metrics.score_rankings(ranking, q, K)), path, name)
    return _rounded(sinks.versus(sinks.read_results(spark, path)))


# --- the named stacks -------------------------------------------------------------------------------------------------------------


def _dense_of(spark: SparkSession, sf: str):  # noqa: ANN202
    """A vector ranking over the embeddings table: a segment's vectors are those numbered by its contract and position, one without windows, two with."""
    own = table(spark, sf, "embeddings").select(F.col("vec_id").alias("__v"), F.col("embedding").alias("vector"))
    n = own.count()

    def at(number):  # noqa: ANN001, ANN202
        return F.pmod(number, F.lit(n))

    done: dict[tuple, DataFrame] = {}

    def rank_of(q: DataFrame, s: DataFrame, k: int, windowed: bool) -> DataFrame:
        """Vectors hang on contract and category, so questions rank alike however they are put."""
        if (k, windowed) not in done:
            done[k, windowed] = staged(made_of(q, s, k, windowed), "dense")
        return done[k, windowed]

    def made_of(q: DataFrame, s: DataFrame, k: int, windowed: bool) -> DataFrame:
        number = F.col("contract_id").cast("long") * 31 + F.col("position") * 7
        parts = F.array(*[F.struct(F.lit(i).alias("w"), at(number + i).alias("__v")) for i in range(2 if windowed else 1)])
        records = s.select("contract_id", "position", "start_char", "end_char", F.inline(parts)).join(own, "__v")
        records = records.withColumn("record_id", F.format_string("%08d#%d", "position", "w"))
        asked = q.select("query_id", "contract_id", at(F.col("contract_id").cast("long") * 17 + F.char_length(F.element_at(F.split("query_id", "[|]"), 2))).alias("__v")).join(own, "__v")
        return rank.dense(asked.drop("__v"), records, k, rank.OVERSAMPLE)

    return rank_of


def _vector_sql(name: str, windows: int, k: int) -> str:
    return f"""
{name}_n AS (SELECT count(*) AS n FROM embeddings),
{name}_r AS (SELECT s.contract_id, s.start_char, s.end_char, printf('%08d#%d', s.position, w.w) AS rid, CAST(e.embedding AS DOUBLE[]) AS v FROM seg s, (SELECT unnest(range({windows})) AS w) w, {name}_n n JOIN embeddings e ON e.vec_id = (CAST(s.contract_id AS BIGINT) * 31 + s.position * 7 + w.w) % n.n),
{name}_d AS (SELECT q.query_id, r.contract_id, r.start_char, r.end_char, rid, round(1 - list_dot_product(CAST(e.embedding AS DOUBLE[]), r.v), 9) AS distance FROM ev q, {name}_n n JOIN embeddings e ON e.vec_id = (CAST(q.contract_id AS BIGINT) * 17 + length(q.category)) % n.n JOIN {name}_r r ON r.contract_id = q.contract_id),
{name}_o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, rid) AS seen FROM {name}_d),
{name}_b AS (SELECT query_id, contract_id, start_char, end_char, min((distance, rid)) AS best FROM {name}_o WHERE seen <= {5 * k} GROUP BY ALL),
{name} AS (SELECT query_id, contract_id, start_char, end_char, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM {name}_b)"""


def _fused_sql(name: str, *parts: str) -> str:
    union = " UNION ALL ".join(f"SELECT query_id, contract_id, start_char, end_char, rank, {i} AS source, 1.0::DOUBLE / (60 + rank) AS part FROM {p} WHERE rank <= 20" for i, p in enumerate(parts))
    return f"""
{name}_f AS (SELECT query_id, contract_id, start_char, end_char, round(sum(part), 12) AS score, min(rank) FILTER (WHERE source = 0) AS lr, min(source * 1000 + rank) AS seen FROM ({union}) GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, lr NULLS LAST, seen) AS rank FROM {name}_f)"""


def _primed_sql(name: str, base: str) -> str:
    return f"""
{name}_u AS (SELECT e.query_id, s.contract_id, s.start_char, s.end_char, s.position AS place FROM ev e JOIN prior USING (category) JOIN seg s USING (contract_id) WHERE s.position < 1
  UNION ALL SELECT query_id, contract_id, start_char, end_char, 1000000 + rank FROM {base} WHERE rank <= {K + 1}),
{name}_b AS (SELECT query_id, contract_id, start_char, end_char, min(place) AS place FROM {name}_u GROUP BY ALL),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM {name}_b)"""


def _reranked_sql(name: str, base: str, question: str) -> str:
    shown = _EMBED.format(h="CASE WHEN s.n < 1200 THEN '' ELSE '[window ' || s.position || ']' END").replace("text", "s.text")
    return f"""
{name}_c AS (SELECT l.query_id, l.contract_id, l.start_char, l.end_char, l.rank, list_distinct(list_filter(regexp_split_to_array(lower({question}), '\\s+'), lambda w: w <> '')) AS qw,
  list_filter(regexp_split_to_array(lower(substr({shown}, 1, 1400)), '\\s+'), lambda w: w <> '') AS pw
  FROM {base} l JOIN ev e USING (query_id) JOIN seg s ON s.contract_id = l.contract_id AND s.start_char = l.start_char AND s.end_char = l.end_char WHERE l.rank <= 20),
{name}_n AS (SELECT query_id, contract_id, start_char, end_char, rank AS old, round(len(list_intersect(qw, pw)) / greatest(1, len(qw)), 9) AS score FROM {name}_c),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM {name}_n)"""


_CLEAN = """(CASE WHEN position('related to "' IN question) > 0 THEN regexp_extract(question, 'related to "([^"]+)"', 1) || '. ' || trim(regexp_extract(question, 'Details: (.*)$', 1, 's'), ' ' || chr(10) || chr(13) || chr(9)) ELSE question END)"""
_STACKS_SQL = f"""{_BASE_SQL}, {_RATES_SQL}, prior AS (SELECT category FROM rates WHERE n >= 20 AND rate >= 0.6),
{_tfidf_sql(False, name='s1')}, {_tfidf_sql(True, name='s2')}, {_tfidf_sql(True, question=_CLEAN, name='s3')}, {_tfidf_sql(False, name='s4', terms=_chars_sql)},
{_vector_sql('v0', 1, K)}, {_vector_sql('v1', 2, K)}, {_vector_sql('v2', 2, 20)},
{_fused_sql('h1', 's1', 'v2')}, {_fused_sql('h2', 's2', 'v2')}, {_fused_sql('h3', 's3', 'v2')}, {_fused_sql('h4', 's2', 'v2', 's4')},
{_reranked_sql('r2', 'h2', 'e.question')}, {_reranked_sql('r3', 'h3', _CLEAN.replace('question', 'e.question'))},
{_primed_sql('p2', 's2')}, {_primed_sql('ph2', 'h2')}, {_primed_sql('ph4', 'h4')}, {_primed_sql('pr2', 'r2')}, {_primed_sql('ph3', 'h3')}, {_primed_sql('pr3', 'r3')}"""
_STACKS = {
    "tfidf": "s1", "tfidf_bigram": "s2", "dense": "v0", "dense_win": "v1", "hybrid": "h1", "hybrid_bigram": "h2", "tfidf_bigram_prior": "p2", "hybrid_bigram_prior": "ph2", "hybrid_char_prior": "ph4",
    "hybrid_bigram_rerank": "r2", "hybrid_bigram_prior_rerank": "pr2", "hybrid_bigram_prior_cleanq": "ph3", "hybrid_bigram_prior_cleanq_rerank": "pr3",
}


@query(_STACKS_SQL + " " + " UNION ALL ".join(f"SELECT '{n}' AS stack, query_id, contract_id, start_char, end_char, CAST(rank AS INTEGER) AS rank FROM {c} WHERE rank <= {K}" for n, c in _STACKS.items()))
def ranking_stacks(spark: SparkSession, sf: str) -> DataFrame:
    """All thirteen named stacks over the same questions, with vectors of the embeddings table."""
    q, s, out = eval_rows(spark, sf), segments(spark, sf), None
    for name, run in rank.variants(_dense_of(spark, sf), staged(rank.fit_prior(q, s), "prior"), together=True).items():
        rows = run(q, s, K).select(F.lit(name).alias("stack"), "query_id", "contract_id", "start_char", "end_char", "rank")
        out = rows if out is None else out.unionByName(rows)
    return out


# --- optional parts ---------------------------------------------------------------------------------------------------------------

_RULES = [("Opening Clause", "absent", "no opening", 2.0), ("Missing Clause", "absent", "missing", 1.0), ("Split Clause", "present", "split", 0.5)]
_RULES_SQL = ", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in _RULES)


@query(f"""WITH {EVAL_SQL}, r(category, flag_if, flag, weight) AS (VALUES {_RULES_SQL}), c AS (SELECT DISTINCT contract_id FROM gold)
SELECT c.contract_id, count(*) AS n_flags, CAST(sum(r.weight) AS DOUBLE) AS risk FROM c, r WHERE (r.flag_if = 'present') = EXISTS (SELECT 1 FROM gold g WHERE g.contract_id = c.contract_id AND g.category = r.category) GROUP BY 1""")
def risk_scores(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "category string, flag_if string, flag string, weight double")
    return extras.risk_scores(extras.risk_flags(spans.gold_rows(eval_rows(spark, sf)), rules))


@query("""WITH b AS (SELECT lang, CASE WHEN n_chars >= 4000 THEN 3 WHEN n_chars >= 1000 THEN 2 WHEN n_chars >= 200 THEN 1 ELSE 0 END AS bin FROM documents),
s AS (SELECT bin, greatest(count(*) FILTER (WHERE lang = 'en') / (SELECT count(*) FROM b WHERE lang = 'en'), 0.0001) AS p, greatest(count(*) FILTER (WHERE lang = 'de') / (SELECT count(*) FROM b WHERE lang = 'de'), 0.0001) AS q FROM b WHERE lang IN ('en', 'de') GROUP BY bin)
SELECT round(sum((q - p) * ln(q / p)), 6) AS psi FROM s""")
def input_drift(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("lang", "n_chars")
    return _rounded(extras.input_drift(docs.where("lang = 'en'"), docs.where("lang = 'de'"), "n_chars", [200.0, 1000.0, 4000.0]))


@query("""WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), a AS (SELECT i, avg(v) AS a FROM x WHERE label < 3 GROUP BY i), b AS (SELECT i, avg(v) AS b FROM x WHERE label >= 3 GROUP BY i)
SELECT round(1 - sum(a * b) / sqrt(sum(a * a) * sum(b * b)), 5) AS centroid_distance FROM a JOIN b USING (i)""")
def embedding_drift(spark: SparkSession, sf: str) -> DataFrame:
    own = table(spark, sf, "embeddings").select("label", F.col("embedding").alias("vector"))
    return extras.embedding_drift(own.where("label < 3"), own.where("label >= 3")).withColumn("centroid_distance", F.round("centroid_distance", 5))


@query()
def embedded_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Index records with vectors of the stand-in encoder."""
    records = segment.index_records(segment.window_segments(contracts(spark, sf)), segment.windows_for(256))
    return records.select("record_id", embed.embedded(F.col("window_text")).alias("vector"))


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of all documents, TF-IDF ranking of all questions, span scores, one row of metrics."""
    return score_rollup(spark, sf)
