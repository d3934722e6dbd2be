"""Schemas of the entities; readers use them instead of inference, operators check that the columns they need are there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPAN = "struct<start:int,end:int>"
GOLD = "array<struct<text:string,start:int,end:int>>"
CORPUS = "version string, data array<struct<title:string,paragraphs:array<struct<context:string,qas:array<struct<id:string,question:string,is_impossible:boolean,answers:array<struct<text:string,answer_start:int>>>>>>>>"
CONTRACT = "contract_id string, title string, context string"
EVAL_ROW = f"contract_id string, category string, question string, gold_spans {GOLD}, has_gold_span boolean"
SEGMENT = (
    "segment_id string, position int, text string, embedding_text string, start_char int, end_char int, scheme string, header string, "
    "parent_id string, is_oversized_split boolean, is_undersized boolean, metadata map<string,string>"
)
TRAINING = (
    "contract_id string, segment_id string, text string, labels array<string>, n_labels int, position int, n_segments_in_contract int, char_len int, "
    "relative_position double, header string, scheme string, is_oversized_split boolean, is_undersized boolean, has_parent boolean"
)
CHUNK = "struct<header:string,start_char:int,end_char:int,text:string>"
#: One row of a generation run: who, what was asked, what was retrieved, how retrieval scored, what was answered, how it was judged.
RUN_LOG = (
    f"run_id string, schema_version int, timestamp string, contract_id string, category string, question string, has_gold_span boolean, "
    f"retriever string, k int, retrieved_spans array<{SPAN}>, retrieved_chunks array<{CHUNK}>, "
    "retrieval_hit boolean, gold_chars_hit int, gold_chars_total int, retrieved_chars int, "
    "prompt string, answer string, abstained boolean, generator_backend string, generator_model string, generator_temperature double, "
    "generation_latency_ms int, generation_error string, "
    "judge_label string, judge_rationale string, judge_backend string, judge_model string, judge_latency_ms int, judge_error string"
)
RUN_LOG_VERSION = 1


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, if it has the columns; a ValueError that names the missing ones otherwise."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns {missing} are missing; rebuild the input with the current version")
    return df
