"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources.stage import shared_dir, staged  # noqa: F401  used by all operators here

#: The white space of all contracts here: space and the five controls 0x09 to 0x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def whole(text: Column) -> Column:
    """The text with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is; texts of one byte a character take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often body names it."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores behind it until no column has it (Spark tells names apart without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


_RESIDENT: dict = {}


def resident(name: tuple, build: Callable):
    """What ``build`` makes, kept by a worker from task to task under ``name``; what was kept under another name goes first."""
    if name not in _RESIDENT:
        _RESIDENT.clear()
        give_back()
        _RESIDENT[name] = build()
    return _RESIDENT[name]


def give_back() -> None:
    """Hands memory that is free in this process back to the system: Arrow's pool, and the C heap where its allocator can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable, keeps: bool = False) -> Callable:
    """The task ``run``, after which the worker gives its free memory back; unless it ``keeps`` something itself, what others keep goes before."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps and _RESIDENT:
            _RESIDENT.clear()
            give_back()
        yield from run(batches)
        give_back()

    return task
