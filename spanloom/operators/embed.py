"""Embedding in Arrow batches, and the index pipeline from segments to a stored collection."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.segment import index_records, segment_documents, windows_for
from spanloom.sources import sinks
from spanloom.sources.corpus import collection_name

#: Models that want an instruction before a query, and that instruction.
PREFIXED = ("BAAI/bge-small-en-v1.5", "BAAI/bge-base-en-v1.5")
PREFIX = "Represent this sentence for searching relevant passages: "
#: Width and token limit by model; others count as the first.
MODELS = {"sentence-transformers/all-MiniLM-L6-v2": (384, 256), "BAAI/bge-small-en-v1.5": (384, 512), "BAAI/bge-base-en-v1.5": (768, 512)}
DEFAULT_MODEL = "sentence-transformers/all-MiniLM-L6-v2"
Encoder = Callable[[list[str]], np.ndarray]


def query_prefix(model: str) -> str:
    return PREFIX if model in PREFIXED else ""


def max_tokens(model: str) -> int:
    return MODELS.get(model, MODELS[DEFAULT_MODEL])[1]


@lru_cache(maxsize=4)
def hashed_encoder(model: str = DEFAULT_MODEL) -> Encoder:
    """An encoder that needs no weights: signed counts of hashed words. Stands in where the model can't be had."""
    width = MODELS.get(model, MODELS[DEFAULT_MODEL])[0]

    known: dict[str, int] = {}

    def place(word: str) -> int:
        if len(known) >= 500_000:
            known.clear()
        h = zlib.crc32(word.encode())
        known[word] = at = h % width if h >> 31 else h % width + width
        return at

    def few(texts: list[str]) -> np.ndarray:
        words = [t.lower().split() for t in texts]
        own = [at if (at := known.get(w)) is not None else place(w) for ws in words for w in ws]
        rows = np.repeat(np.arange(len(words)), [len(ws) for ws in words])
        # Counts of what adds and what takes away, side by side; whole numbers, so their order changes nothing.
        counts = np.bincount(rows * (2 * width) + np.array(own, dtype=np.int64), minlength=len(words) * 2 * width).reshape(len(words), 2, width)
        return (counts[:, 0] - counts[:, 1]).astype(np.float32)

    def encode(texts: list[str]) -> np.ndarray:
        return np.concatenate([few(texts[i : i + 1024]) for i in range(0, len(texts), 1024)] or [few([])])

    return encode


def embedded(text: Column, model: str = DEFAULT_MODEL, is_query: bool = False, load: Callable[[str], Encoder] = hashed_encoder) -> Column:
    """Vectors of length one (zeros for a text without words); ``load`` runs once a worker and should cache what it loads."""
    prefix = query_prefix(model) if is_query else ""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load(model)
        for texts in batches:
            v = np.asarray(encode([prefix + (t or "") for t in texts]), dtype=np.float32)
            n = np.linalg.norm(v, axis=1, keepdims=True)
            yield pd.Series(list(v / np.where(n > 0, n, 1)))

    return run(text)


def ingest(contracts: DataFrame, root: str, model: str = DEFAULT_MODEL, windowed: bool = True, reset: bool = True, name: str | None = None, load: Callable[[str], Encoder] = hashed_encoder) -> DataFrame:
    """Segment, window, embed and store; returns the counts. The collection's name tells model and windowing, so two never collide."""
    segments = segment_documents(contracts)
    records = index_records(segments, windows_for(max_tokens(model)) if windowed else None)
    meta = ["contract_id", "segment_id", "record_id", "start_char", "end_char", "header", "scheme", "is_oversized_split", "is_undersized", "window_index", "n_windows", "window_text"]
    rows = records.select(*meta).withColumn("vector", embedded(F.col("window_text"), model, load=load))
    sinks.write_collection(rows, root, name or collection_name(model, windowed), reset)
    return sinks.ingest_stats(segments, records)
