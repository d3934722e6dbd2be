"""Line de-duplication across documents, by hashes alone.

Built-in functions only. Each line of at least ``min_chars`` becomes a row of two 64-bit hashes, its document and its position; texts
stay where they are. The rows are range-partitioned by hash with a salt and sorted by document and position
inside it, and one pass over the sorted rows finds, for each hash and salt, the first document and how many there are.
The salt is drawn from the document, so a line that a third of the corpus holds is spread over ``SALTS`` ranges, and what is
merged afterwards is at most ``SALTS`` rows a line. Out come run-length coded bitmaps of the lines to keep, a few bytes a
document; texts are touched again only by ``apply_keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, fresh, let, staged, whole

SALTS = 64
#: Defaults of the operator: shorter lines and lines in fewer documents stay.
MIN_CHARS, MIN_DOCS = 20, 3


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def text_id(text: Column) -> Column:
    return F.xxhash64(whole(text))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, text_id, drop_runs, n_dropped`` for the documents that lose lines; the rest keep all.

    ``drop_runs`` is the bitmap of the lines, run-length coded: start and end (exclusive) of each run of dropped lines, flat and
    ascending; all other lines stay. A line goes if its key has ``min_chars`` code points or more, is found in
    ``min_docs`` documents or more (a document counts once), and this is not the largest ``key`` that holds it; a null key
    counts as the smallest document. Null and empty texts are one empty line, which stays. Rows repeated with the same key and
    text share a bitmap. Hashes have 128 bits together.
    """
    k = F.transform(F.split(whole(F.col(text)), "\n", -1), line_key)
    hashed = F.transform(k, lambda x: F.when(F.char_length(x) >= min_chars, F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(41), x).alias("h2"))))
    lines = (
        docs.select(F.col(key).alias("doc"), text_id(F.col(text)).alias("text_id"), F.posexplode(hashed).alias("pos", "h"))
        .where("h is not null")
        .select("h.h1", "h.h2", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"), "doc", "text_id", "pos")
    )
    # Written once: the sampling of ranges, the counting and the marking all read hashes, not texts.
    dealt = staged(lines, "lines").repartitionByRange("h1", "h2", "salt")

    # The stream: hash by hash in the order of documents (largest first), a row a position.
    same = Window.partitionBy("h1", "h2", "salt").orderBy(F.desc_nulls_last("doc"), "pos")
    first = F.row_number().over(same) == 1
    new_doc = (~F.lag("doc").over(same).eqNullSafe(F.col("doc"))) | first
    seen = (
        dealt.withColumn("first", first)
        .withColumn("new_doc", new_doc)
        .where("new_doc")
        .groupBy("h1", "h2", "salt")
        .agg(F.count("*").alias("docs"), F.max("doc").alias("last_doc"))
    )
    seen = staged(seen, "line-hashes")
    found = seen.groupBy("h1", "h2").agg(F.sum("docs").alias("docs"), F.max("last_doc").alias("keeper")).where(F.col("docs") >= min_docs)
    common = seen.select("h1", "h2", "salt").join(found.select("h1", "h2", "keeper"), ["h1", "h2"])
    gone = dealt.join(common, ["h1", "h2", "salt"]).where(~F.col("doc").eqNullSafe(F.col("keeper")))
    at = gone.groupBy("doc", "text_id").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    return at.select(F.col("doc").alias(key), "text_id", let(F.col("at"), _runs).alias("drop_runs"), F.size("at").alias("n_dropped"))


def _runs(at: Column) -> Column:
    """Start and end (exclusive) of each run, flat and ascending, from the sorted positions of dropped lines."""
    starts = F.filter(F.transform(at, lambda p, i: F.when((i == 0) | (F.get(at, i - 1) != p - 1), p)), lambda p: p.isNotNull())
    ends = F.filter(F.transform(at, lambda p, i: F.when((i == F.size(at) - 1) | (F.get(at, i + 1) != p + 1), p + 1)), lambda p: p.isNotNull())
    return F.flatten(F.zip_with(starts, ends, lambda s, e: F.array(s, e)))


def kept_lines(lines: Column, drop_runs: Column) -> Column:
    """The lines outside the runs, gap by gap; null runs drop nothing."""

    def gaps(own: Column) -> Column:
        edges = F.concat(F.array(F.lit(0)), drop_runs, F.array(F.size(own)))
        pairs = F.sequence(F.lit(0), F.size(drop_runs), F.lit(2))
        return let(edges, lambda e: F.flatten(F.transform(pairs, lambda j: F.slice(own, F.get(e, j) + 1, F.get(e, j + 1) - F.get(e, j)))))

    return F.when(drop_runs.isNull(), lines).otherwise(let(lines, gaps))


def apply_keep(docs: DataFrame, bitmaps: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` cut to the kept lines, joined by a newline, and ``n_lines`` (before) and ``n_dropped`` beside its columns.

    The only step that moves texts, once. Columns named like the two new ones are replaced. A null text becomes empty.
    """
    k, i, r, n = fresh(docs.columns, "key", "id", "runs", "n")
    marks = bitmaps.select(F.col(key).alias(k), F.col("text_id").alias(i), F.col("drop_runs").alias(r), F.col("n_dropped").alias(n))
    own = docs.withColumn(text, whole(F.col(text)))
    joined = own.join(marks, F.col(key).eqNullSafe(F.col(k)) & (text_id(F.col(text)) == F.col(i)), "left")
    lines = F.split(F.col(text), "\n", -1)
    cut = F.when(F.col(r).isNull(), F.col(text)).otherwise(F.array_join(kept_lines(lines, F.col(r)), "\n"))
    n_lines = (F.octet_length(text) - F.octet_length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1).cast("long")
    out = {"n_lines": n_lines, "n_dropped": F.coalesce(n, F.lit(0)).cast("long"), text: cut}
    return joined.select(*[F.col(c) for c in docs.columns if c not in out], *[v.alias(c) for c, v in out.items()])


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = apply_keep(docs, keep_bitmaps(docs))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
    translate(regexp_replace(line, '^[ 	-
]+|[ 	-
]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT d.*, (c.k IS NOT NULL AND d.doc_id <> c.keeper) AS gone FROM keyed d LEFT JOIN common c ON c.k = d.k)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
