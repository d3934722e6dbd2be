"""Corpus pipeline: raw documents to token ids in five stages.

Each stage takes what its predecessor wrote and returns a DataFrame; all but the last return the columns of ``documents``. The
rows that a stage keeps, and the texts that it changes, are what the next one sees; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe import round_trip
from spanloom.llm.common import fresh, staged
from spanloom.llm.decontaminate import with_leaks
from spanloom.llm.line_dedup import apply_keep, keep_bitmaps
from spanloom.llm.near_dedup import near_duplicates
from spanloom.llm.quality import cleaned

#: No SQL can express MinHash, edit matching and BPE; the stages are tested against brute force.
ORACLE_SQL = None


def _counted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with ``n_chars`` counted from the text."""
    n_chars = F.char_length("text").cast(like.schema["n_chars"].dataType)
    return docs.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in like.columns])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without the lines that fail them.

    A null or empty text has too few words and goes. Each row is judged alone, so ties and repeated rows agree; an empty table stays empty; extra
    columns are handed on.
    """
    return cleaned(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a later document of three or more repeats.

    A null text becomes the empty one; a null id counts as the smallest. Rows repeated with id and text lose the same lines; of an empty table nothing
    is left; extra columns are handed on.
    """
    return _counted(apply_keep(docs, keep_bitmaps(docs)), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least document of each group of near duplicates (five words, similarity of 0.8 or more).

    Texts without a word, null ones among them, are like nothing and stay, as do rows without an id. Rows that repeat an id are one document and
    stay or go together; an empty table stays empty; extra columns are handed on.
    """
    gone = near_duplicates(docs, percent=80).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark.

    Null and empty texts hold none and stay; each row is judged alone, so repeated rows agree; an empty table or benchmark changes nothing; extra
    columns are handed on.
    """
    (leaks,) = fresh(docs.columns, "leaks")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), leaks=leaks)
    return found.where(F.size(leaks) == 0).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and its text as they decode.

    A null or empty text has no ids and decodes to the empty text; rows are taken as they come, repeated ones too; an empty table gives no rows; columns
    beyond doc_id, lang and source are left out.
    """
    path = public_tokenizers.path("byte_bpe_50k.json")
    return round_trip(docs.select("doc_id", "lang", "source", "text"), path, ids="ids", back="text").select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES):
            docs = staged(docs, f"stage{at}")
    return docs
