"""Evaluation inputs derived from the driver's tables, in Spark and as SQL fragments for the oracle.

Each document is a contract; its evaluation rows ask for its opening, middle, closing and two split passages and for one that isn't
there, in the questions' fixed template. Nothing is joined to make them, so they scale with the table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.segment import window_segments

WINDOW, MIN_DOC = 600, 1200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: one file of a few MB is one task otherwise. A scan with tasks enough stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("contract_id"), "source", "lang", F.coalesce("text", F.lit("")).alias("context"))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_segments(contracts(spark, sf_dir), WINDOW, MIN_DOC)


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.char_length("context")
    half, quarter, three = F.expr("char_length(context) div 2"), F.expr("char_length(context) div 4"), F.expr("3 * char_length(context) div 4")

    def span(start, size):  # noqa: ANN001, ANN202
        start = start.cast("int")
        return F.struct(start.alias("start"), F.least(n, start + size).cast("int").alias("end"))

    rows = F.array(
        F.struct(F.lit("Opening Clause").alias("category"), F.array(span(F.lit(0), 80)).alias("spans")),
        F.struct(F.lit("Middle Clause").alias("category"), F.array(span(half, 120)).alias("spans")),
        F.struct(F.lit("Closing Clause").alias("category"), F.array(span(F.greatest(F.lit(0), n - 100), 100)).alias("spans")),
        F.struct(F.lit("Split Clause").alias("category"), F.array(span(quarter, 40), span(three, 40)).alias("spans")),
        F.struct(F.lit("Missing Clause").alias("category"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
    )
    own = contracts(spark, sf_dir).select("contract_id", "context", F.inline(rows))
    full = F.filter("spans", lambda s: s["end"] > s["start"])
    text = F.transform(full, lambda s: F.struct(F.substring(F.col("context"), s["start"] + 1, s["end"] - s["start"]).alias("text"), s["start"].alias("start"), s["end"].alias("end")))
    first = F.get(F.col("gold_spans"), F.lit(0))
    about = F.when(F.size("gold_spans") > 0, F.substring(F.coalesce(first["text"], F.lit("")), 1, 60)).otherwise(F.lit("What is missing from here?"))
    question = F.concat(F.lit('Highlight the parts (if any) of this contract related to "'), "category", F.lit('" that should be reviewed by a lawyer. Details: '), about)
    out = own.withColumn("gold_spans", text).withColumn("question", question).withColumn("has_gold_span", F.size("gold_spans") > 0)
    return out.select(F.concat_ws("|", "contract_id", "category").alias("query_id"), "contract_id", "category", "question", "gold_spans", "has_gold_span")


def _cut(start: str, window: int) -> str:
    late = window * 3 // 4
    part = f"reverse(substr(text, {start} + {late} + 1, {window - late}))"

    def behind(sep: str, back: str) -> str:
        return f"CASE WHEN strpos({part}, {back}) > 0 THEN {start} + {window} - strpos({part}, {back}) + 1 END"

    nl = "chr(10)"
    return f"CASE WHEN {start} + {window} >= n THEN n ELSE coalesce({behind('', nl + ' || ' + nl)}, {behind('', nl)}, {behind('', chr(39) + ' .' + chr(39))}, {start} + {window}) END"


def segments_sql(window: int = WINDOW, min_doc: int = MIN_DOC, name: str = "seg") -> str:
    """CTEs ``<name>`` with contract_id, position, start_char, end_char, n and text; needs WITH RECURSIVE before them."""
    return f"""
{name}_doc AS (SELECT CAST(doc_id AS VARCHAR) AS contract_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS INTEGER) AS n FROM documents),
{name}_walk AS (
  SELECT contract_id, text, n, 0 AS position, 0 AS start_char, CAST(CASE WHEN n < {min_doc} THEN n ELSE {_cut('0', window)} END AS INTEGER) AS end_char FROM {name}_doc
  UNION ALL
  SELECT contract_id, text, n, position + 1, end_char, CAST({_cut('end_char', window)} AS INTEGER) FROM {name}_walk WHERE end_char < n),
{name} AS (SELECT contract_id, position, start_char, end_char, n, substr(text, start_char + 1, end_char - start_char) AS text FROM {name}_walk)"""


EVAL_SQL = """
ev_doc AS (SELECT CAST(doc_id AS VARCHAR) AS contract_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS INTEGER) AS n FROM documents),
ev_span AS (
  SELECT contract_id, text, 'Opening Clause' AS category, 1 AS i, 0 AS s, least(n, 80) AS e FROM ev_doc
  UNION ALL SELECT contract_id, text, 'Middle Clause', 1, n // 2, least(n, n // 2 + 120) FROM ev_doc
  UNION ALL SELECT contract_id, text, 'Closing Clause', 1, greatest(0, n - 100), n FROM ev_doc
  UNION ALL SELECT contract_id, text, 'Split Clause', 1, n // 4, least(n, n // 4 + 40) FROM ev_doc
  UNION ALL SELECT contract_id, text, 'Split Clause', 2, 3 * n // 4, least(n, 3 * n // 4 + 40) FROM ev_doc),
gold AS (SELECT contract_id, category, i, CAST(s AS INTEGER) AS gold_start, CAST(e AS INTEGER) AS gold_end, substr(text, s + 1, e - s) AS gold_text FROM ev_span WHERE e > s),
ev AS (
  SELECT d.contract_id || '|' || c.category AS query_id, d.contract_id, c.category,
    'Highlight the parts (if any) of this contract related to "' || c.category || '" that should be reviewed by a lawyer. Details: '
      || coalesce(substr(g.gold_text, 1, 60), 'What is missing from here?') AS question,
    g.contract_id IS NOT NULL AS has_gold_span
  FROM ev_doc d CROSS JOIN (VALUES ('Opening Clause'), ('Middle Clause'), ('Closing Clause'), ('Split Clause'), ('Missing Clause')) c(category)
  LEFT JOIN (SELECT contract_id, category, arg_min(gold_text, i) AS gold_text FROM gold GROUP BY ALL) g ON g.contract_id = d.contract_id AND g.category = c.category)"""


#: Grammars of the structured contracts by the remainder of their id, each with its headings; the last remainder has none.
KINDS = ("article", "section_nn", "bare_nn", "section_inline", "article_inline", "bare_nn_inline", "int_dot_inline", None)
NAMES, ROMAN = ("First", "Second", "Third", "Fourth"), ("I", "II", "III", "IV")


def _heads(i: int) -> tuple[str, ...]:
    """Heading of part i by grammar: what goes to the part before it, a bar, and the heading."""
    name = NAMES[i - 1]
    return (
        f"|\n\nARTICLE {i} {name.upper()} PART\n", f"|\n\nSection {i}.{i} {name} Part. ", f"|\n\n{i}.1 {name} Part. ",
        f" |SECTION {i} ", f" |ARTICLE {ROMAN[i - 1]} ", f" |{i}.1 {name} Part. ", f" |{i}. {name} Part. ", "| ",
    )


def structured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts with an opening line and four parts each, the quarters of the whole text without line breaks, under headings of one of seven grammars or none."""
    flat = F.regexp_replace("context", "[\n\r]+", " ")
    kind = F.pmod(F.col("contract_id").cast("long"), F.lit(len(KINDS)))
    quarter = F.ceil(F.char_length("flat") / 4).cast("int")
    parts = [F.lit("This agreement opens here.")]
    for i in range(1, 5):
        heads = F.array(*[F.lit(h.replace("|", "")) for h in _heads(i)])
        parts += [F.get(heads, kind.cast("int")), F.substring(F.col("flat"), 1 + quarter * (i - 1), quarter), F.lit(" end")]
    return contracts(spark, sf_dir).withColumn("flat", flat).select("contract_id", F.concat(*parts).alias("context"))


def _literal(text: str) -> str:
    return " || ".join("chr(10)" if x == "\n" else f"'{x}'" for x in re.split("(\n)", text) if x) or "''"


def _head_sql(i: int, side: int) -> str:
    """The heading of part i (side 1), or what it leaves to the part before (side 0)."""
    return f"CASE doc_id % {len(KINDS)} " + " ".join(f"WHEN {k} THEN {_literal(h.split('|')[side])}" for k, h in enumerate(_heads(i))) + " END"


def _part_sql(i: int) -> str:
    own = f"{_head_sql(i, 1)} || substr(t, CAST(1 + q * {i - 1} AS BIGINT), CAST(q AS BIGINT)) || ' end'"
    return own + (f" || {_head_sql(i + 1, 0)}" if i < 4 else "")


#: CTEs: ``flat``, ``part`` (contract_id, kind, i, text: the opening and the four parts) and ``structured`` (contract_id, kind, context).
STRUCTURED_SQL = f"""
flat AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g') AS t, ceil(length(regexp_replace(coalesce(text, ''), '[\\n\\r]+', ' ', 'g')) / 4) AS q FROM documents),
part AS (SELECT CAST(doc_id AS VARCHAR) AS contract_id, doc_id % {len(KINDS)} AS kind, 0 AS i, 'This agreement opens here.' || {_head_sql(1, 0)} AS text FROM flat
  {" ".join(f"UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id % {len(KINDS)}, {i}, {_part_sql(i)} FROM flat" for i in range(1, 5))}),
structured AS (SELECT contract_id, kind, string_agg(text, '' ORDER BY i) AS context FROM part GROUP BY contract_id, kind)"""


def structured_segments_sql() -> str:
    """CTEs ``top`` (contract_id, scheme, i, header, text, start_char) and ``full_seg``, the segments of the structured contracts; needs WITH RECURSIVE.

    A part over 4,500 characters and from 6,000 on is cut into windows of 3,000, as is a contract without headings.
    """
    names = " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS) if n)
    header = " ".join(
        f"WHEN i = {i} AND kind = {k} THEN '{h}'"
        for i in range(1, 5)
        for k, h in enumerate((f"ARTICLE {i} {NAMES[i - 1].upper()} PART", f"{i}.{i} {NAMES[i - 1]} Part", f"{i}.1 {NAMES[i - 1]} Part", f"SECTION {i}", f"ARTICLE {ROMAN[i - 1]}", f"{i}.1 {NAMES[i - 1]} Part", f"{i} {NAMES[i - 1]} Part"))
    )
    none = len(KINDS) - 1
    return f"""{STRUCTURED_SQL},
top AS (SELECT contract_id, CASE kind {names} ELSE 'fallback' END AS scheme, i, CASE WHEN i = 0 THEN '[preamble]' {header} END AS header, text,
    CAST(sum(length(text)) OVER (PARTITION BY contract_id ORDER BY i) - length(text) AS INTEGER) AS base FROM part WHERE kind <> {none}
  UNION ALL SELECT contract_id, 'fallback', 0, '', context, 0 FROM structured WHERE kind = {none}),
sized AS (SELECT *, CAST(length(text) AS INTEGER) AS n FROM top),
walk AS (SELECT *, 0 AS j, 0 AS s, CAST(CASE WHEN n < 6000 THEN n ELSE {_cut('0', 3000)} END AS INTEGER) AS e FROM sized
  UNION ALL SELECT contract_id, scheme, i, header, text, base, n, j + 1, e, CAST({_cut('e', 3000)} AS INTEGER) FROM walk WHERE e < n),
named AS (SELECT contract_id, scheme, i, j, base + s AS start_char, base + e AS end_char, n >= 6000 AS cut, header AS above, substr(text, s + 1, e - s) AS text,
  contract_id || CASE scheme WHEN 'fallback' THEN '_seg' || j ELSE '_top' || i END AS own, CASE WHEN n >= 6000 THEN '[window ' || j || ']' ELSE header END AS header FROM walk),
full_seg AS (SELECT contract_id, CASE WHEN cut AND scheme <> 'fallback' THEN own || '_sub' || j ELSE own END AS segment_id, CAST(row_number() OVER (PARTITION BY contract_id ORDER BY i, j) - 1 AS INTEGER) AS position,
  start_char, end_char, scheme, header, CASE WHEN cut AND scheme <> 'fallback' THEN own END AS parent_id, above, length(text) < 175 AS is_undersized, text FROM named)"""
