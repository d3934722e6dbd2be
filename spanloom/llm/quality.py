"""Quality rules, line first: lines that fail are removed, and documents that lose too much text are rejected.

Built-in functions only, one pass over the texts, no shuffle: every rule looks at a single document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK_CLASS, WORD_CLASS, fresh, let, whole

SYMBOLS = "[#*$%&|<>]"
#: A document is rejected that loses more than this share of its characters in words to the line rules.
MAX_LOST = 0.3
#: A line fails on punctuation with more than this share of symbols among its characters in words, from MIN_MARKS of them on.
MAX_SYMBOLS, MIN_MARKS = 0.1, 4
#: It also fails with more runs of repeated ! or ? than this share of its words, and on navigation with more lone separators than this share.
MAX_SHOUTS, MAX_SEPARATORS = 0.3, 0.2
#: A line fails as boilerplate if phrases of this kind make up such a share of its characters in words, however long it is: prose that mentions one passes.
MIN_PHRASES = 0.25
#: Phrases in English, French, German and Spanish.
PHRASES = (
    "all rights reserved", "terms of (?:use|service)", "privacy policy", "cookie policy", "accept (?:all )?cookies", "click here", "sign (?:in|up) (?:to|for|now)", "log in to",
    "subscribe (?:to|now)", "share this", "follow us", "skip to (?:main )?content", "back to top", "lorem ipsum", "enable javascript",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "accepter (?:tous )?les cookies", "cliquez ici", "haut de page",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "alle cookies akzeptieren", "hier klicken", "nach oben",
    "todos los derechos reservados", "términos (?:y condiciones|de uso)", "política de privacidad", "aceptar (?:todas )?las cookies", "haga clic aquí", "volver arriba",
)
BOILERPLATE = rf"(?i)\b(?:{'|'.join(PHRASES)})"
WINDOW = 5
MIN_WORDS = 10
#: Base rule: more than this percentage of words in repeated windows fails the document.
MAX_REPEATED = 20


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0))


def chars_in_words(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, BLANK_CLASS + "+", ""))


def _repeated(words: Column) -> Column:
    """How many words stand in windows of WINDOW words that the text holds twice or more.

    Windows are compared by 64-bit hashes. Texts without a repeated window, nearly all, end after one pass through a hash
    set; for the rest the windows are sorted, and equal neighbours give the positions whose union is counted.
    """

    def counted(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = let(
            pairs,
            lambda p: F.filter(
                F.transform(p, lambda x, j: F.when((F.get(p, j - 1)["g"] == x["g"]) | (F.get(p, j + 1)["g"] == x["g"]), x["i"])), lambda i: i.isNotNull()
            ),
        )
        start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        covered = F.aggregate(
            F.array_sort(twice), start, lambda a, i: F.struct((a["n"] + i + WINDOW - F.greatest(a["end"], i)).alias("n"), (i + WINDOW).alias("end")), lambda a: a["n"]
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(covered)

    grams = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(let(grams, counted))


def line_fails(line: Column, phrases: Column | None = None) -> Column:
    """Punctuation, navigation and boilerplate rules on one line; a line without a word passes. ``phrases``: whether its document holds any phrase, if known."""
    n_words = F.regexp_count(line, F.lit(WORD_CLASS))
    marks = F.regexp_count(line, F.lit(SYMBOLS))
    punctuation = (marks >= MIN_MARKS) & (marks > MAX_SYMBOLS * chars_in_words(line))
    shouts = F.regexp_count(line, F.lit(r"[!?]{2,}"))
    loud = (shouts >= MIN_MARKS) & (shouts > MAX_SHOUTS * n_words)
    separators = F.regexp_count(line, F.lit(r"(?<![^\x20\x09-\x0D])[|/>»·•]+(?![^\x20\x09-\x0D])"))
    # The plain look for a sign comes first: most lines have none.
    navigation = F.rlike(line, F.lit("[|/>»·•]")) & (separators >= 2) & (separators > MAX_SEPARATORS * n_words)
    found = F.array_join(F.regexp_extract_all(line, F.lit(BOILERPLATE), F.lit(0)), "")
    held = F.rlike(line, F.lit(BOILERPLATE))
    boilerplate = F.when(held if phrases is None else phrases & held, chars_in_words(found) >= MIN_PHRASES * chars_in_words(line)).otherwise(F.lit(False))
    return punctuation | loud | navigation | boilerplate


def _quality(text: str, max_lost: float) -> Column:
    t = whole(F.col(text))

    def of_lines(lines: Column) -> Column:
        full = F.filter(lines, lambda x: F.rlike(x, F.lit(WORD_CLASS)))
        judged = let(F.rlike(t, F.lit(BOILERPLATE)), lambda any_: F.transform(lines, lambda x: F.struct(x.alias("line"), line_fails(x, any_).alias("fails"))))
        passed = let(judged, lambda j: F.array_join(F.transform(F.filter(j, lambda x: ~x["fails"]), lambda x: x["line"]), "\n"))
        return F.struct(let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).alias("dups"), passed.alias("clean"))

    def of_words(words: Column) -> Column:
        return F.struct(F.size(words).alias("n"), _repeated(words).alias("repeated"))

    raw = F.struct(
        let(words_of(t), of_words).alias("w"), let(F.split(t, "\n", -1), of_lines).alias("l"), chars_in_words(t).alias("c"), F.regexp_count(t, F.lit(SYMBOLS)).alias("s")
    )
    return _verdict(raw, max_lost)


def measured(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """``docs`` with one struct column ``quality`` more (one of that name is replaced).

    Fields: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (the base), ``base_failed``, ``lost_chars`` (characters in
    words of the lines that fail), ``clean_text`` (the lines that pass, joined by a newline) and ``kept``. A null text counts as empty:
    no words, so it fails the base. A row's result depends on its text alone, so ties and repeated rows need no rule.
    """
    return docs.withColumn("quality", _quality(text, max_lost))


def _verdict(q: Column, max_lost: float) -> Column:
    def of(x: Column) -> Column:
        n, rep, chars = x["w"]["n"], x["w"]["repeated"], x["c"]
        failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEATED * n)
        return let(
            chars - chars_in_words(x["l"]["clean"]),
            lambda lost: F.struct(
                n.cast("long").alias("n_words"),
                chars.cast("long").alias("word_chars"),
                x["s"].cast("long").alias("n_symbols"),
                x["l"]["dups"].cast("long").alias("n_dup_lines"),
                rep.cast("long").alias("n_repeat_words"),
                failed.alias("base_failed"),
                lost.cast("long").alias("lost_chars"),
                x["l"]["clean"].alias("clean_text"),
                (~failed & (lost <= max_lost * chars)).alias("kept"),
            ),
        )

    return let(q, of)


def cleaned(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", max_lost: float = MAX_LOST) -> DataFrame:
    """The kept rows with the failed lines gone from ``text``; the columns are those of ``docs``, ``n_chars`` counted anew if there."""
    # One expression judges, filters and hands on the text; a filter behind a projection would judge each document twice.
    passed = F.filter(F.array(_quality(text, max_lost)), lambda q: q["kept"])
    (q,) = fresh(docs.columns, "quality")
    kept = docs.select("*", F.explode(passed).alias(q))
    clean = F.col(q)["clean_text"]
    new = {text: clean}
    if n_chars in docs.columns:
        new[n_chars] = F.char_length(clean).cast(docs.schema[n_chars].dataType)
    return kept.select(*[new.get(c, F.col(c)).alias(c) for c in docs.columns])


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")
    return measured(docs).select("doc_id", *[f"quality.{f}" for f in fields])


_PHRASES_SQL = BOILERPLATE.replace("'", "''")
_LINE_FAILS = rf"""
  (length(regexp_extract_all(line, '{SYMBOLS}')) >= {MIN_MARKS} AND length(regexp_extract_all(line, '{SYMBOLS}')) > {MAX_SYMBOLS} * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))
  OR (length(regexp_extract_all(line, '[!?]{{2,}}')) >= {MIN_MARKS} AND length(regexp_extract_all(line, '[!?]{{2,}}')) > {MAX_SHOUTS} * length(regexp_extract_all(line, '{WORD_CLASS}')))
  OR (len(list_filter(regexp_extract_all(line, '{WORD_CLASS}'), lambda w: regexp_full_match(w, '[|/>»·•]+'))) >= 2
      AND len(list_filter(regexp_extract_all(line, '{WORD_CLASS}'), lambda w: regexp_full_match(w, '[|/>»·•]+'))) > {MAX_SEPARATORS} * length(regexp_extract_all(line, '{WORD_CLASS}')))
  OR (regexp_matches(line, '{_PHRASES_SQL}') AND length(regexp_replace(array_to_string(regexp_extract_all(line, '{_PHRASES_SQL}'), ''), '[\x20\x09-\x0D]+', '', 'g')) >= {MIN_PHRASES} * length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')))
"""

OP9_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD_CLASS}') AS w FROM documents),
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs),
by_line AS (
  SELECT doc_id,
    count(*) FILTER (WHERE regexp_matches(line, '{WORD_CLASS}')) - count(DISTINCT line) FILTER (WHERE regexp_matches(line, '{WORD_CLASS}')) AS n_dup_lines,
    coalesce(sum(length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'))) FILTER (WHERE {_LINE_FAILS}), 0) AS lost_chars
  FROM lines GROUP BY doc_id),
grams AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], chr(10)) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM docs WHERE len(w) >= 5)),
twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM twice, (SELECT unnest(range(0, 5)) AS o) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
    CAST(l.n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(l.lost_chars AS BIGINT) AS lost_chars
  FROM docs d JOIN by_line l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND lost_chars <= {MAX_LOST} * word_chars) AS kept, lost_chars
FROM judged
"""
