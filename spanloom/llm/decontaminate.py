"""Benchmark decontamination: pigeonhole pieces, exact hits, and Myers' bit-parallel distance on words.

A text is its words (runs of letters, digits and underscores, case folded; in scripts without spaces each letter is one), so case, punctuation and
spacing don't hide a passage. An item of m words may differ from a passage by k = floor(ERRORS * m) inserted, missing or changed words. Cut into k + 1 pieces, at least one of them stands in such a passage
unchanged; pieces are found by rolling hashes, and around each hit the distance of item and text is computed a word at a time, all
rows of the table at once in the bits of an integer.

The benchmark is read in blocks of bounded size. Each is broadcast for a scan of the documents of its own, whose findings are written before
the next block is broadcast, so one block is alive at a time; documents are never shuffled for it.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import SLICE_CHARS, slices
from .common import fresh, resident, staged, tidy
from .near_dedup import word_hashes

ERRORS = 0.2
#: Code points of the benchmark that are broadcast at a time.
BLOCK_CHARS = 8_000_000
#: Scripts that put no space between words.
UNSPACED = r"\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
WORD = regex.compile(rf"(?V1)[{UNSPACED}]|[\w--[{UNSPACED}]]+")
PLAIN_WORD = regex.compile(r"\w+")
#: The scripts begin here (Thai is the first); texts without such a letter take the plain pattern.
HIGH = re.compile("[\u0e00-\U0010ffff]")
#: Items of fewer words are found only where they are the whole text: a single common word is no leak.
LEAST_WORDS = 5
STEP = np.uint64(0x9E3779B97F4A7C15)
LEAK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def words_of(text: str | None) -> list[str]:
    own = (text or "").casefold()
    return (WORD if not own.isascii() and HIGH.search(own) else PLAIN_WORD).findall(own)


def best_match(masks: dict, m: int, words: list) -> tuple[int, int]:
    """The least edit distance of an item of ``m`` words to any run of ``words``, and where the first such run ends.

    ``masks`` has, for each word of the item, the bits of its places. Bit i of ``rise`` and ``fall`` says whether the distance grows or shrinks
    from row i to row i + 1 of the current column.
    """
    full, top = (1 << m) - 1, 1 << (m - 1)
    rise, fall, score = full, 0, m
    best, end = m, 0
    for at, w in enumerate(words, 1):
        eq = masks.get(w, 0)
        level = (((eq & rise) + rise) ^ rise) | eq
        grown, shrunk = fall | (full & ~(level | rise)), rise & level
        if grown & top:
            score += 1
        elif shrunk & top:
            score -= 1
        # A run may begin anywhere, so the row above the first stays at 0.
        grown, shrunk = (grown << 1) & full, (shrunk << 1) & full
        still = eq | fall
        rise, fall = shrunk | (full & ~(still | grown)), grown & still
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """One block of the benchmark, ready to look for."""

    def __init__(self, items: list[tuple[int, str]], errors: float, least_words: int = LEAST_WORDS) -> None:
        self.items = []
        self.short: dict[tuple[str, ...], list[int]] = defaultdict(list)
        self.known: dict[str, int] = {}
        pieces: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for item_id, text in items:
            words = words_of(text)
            m = len(words)
            if m < least_words:
                if m:
                    self.short[tuple(words)].append(item_id)
                continue
            k = int(errors * m)
            masks: dict[str, int] = defaultdict(int)
            for i, w in enumerate(words):
                masks[w] |= 1 << i
            edges = [i * m // (k + 1) for i in range(k + 2)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                pieces[b - a][int(self.runs(words[a:b], b - a)[0])].append((len(self.items), a))
            self.items.append((item_id, dict(masks), m, k))
        self.pieces = {n: (np.array(sorted(found), dtype=np.uint64), found) for n, found in pieces.items()}

    def hashes(self, words: list[str]) -> np.ndarray:
        return word_hashes(words, self.known)

    def runs(self, words: list[str], n: int, hashes: np.ndarray | None = None) -> np.ndarray:
        h = self.hashes(words) if hashes is None else hashes
        out = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(n):
                out = out * STEP + h[i : i + len(out)]
            return out ^ (out >> np.uint64(29))

    def leaks(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, distance, first and last word + 1 of the best passage's window) of every item found in a text."""
        words = words_of(text)
        h = self.hashes(words)
        near: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for n, (sorted_hashes, found) in self.pieces.items():
            runs = self.runs(words, n, h)
            if not len(runs):
                continue
            at = np.minimum(np.searchsorted(sorted_hashes, runs), len(sorted_hashes) - 1)
            for pos in np.flatnonzero(sorted_hashes[at] == runs).tolist():
                for item, offset in found[int(runs[pos])]:
                    _, _, m, k = self.items[item]
                    near[item].append((max(0, pos - offset - k), min(len(words), pos - offset + m + k)))
        out: dict[int, tuple[int, int, int, int]] = {i: (i, 0, 0, len(words)) for i in self.short.get(tuple(words), ())} if self.short and len(words) < 64 else {}
        for item, windows in near.items():
            item_id, masks, m, k = self.items[item]
            for a, b in merged(windows):
                distance, end = best_match(masks, m, words[a:b])
                if distance <= k and (item_id not in out or distance < out[item_id][1]):
                    out[item_id] = (item_id, distance, max(a, a + end - m - k), a + end)
        return [out[i] for i in sorted(out)]


def merged(windows: list[tuple[int, int]]) -> list[list[int]]:
    """Overlapping windows made one, so that each word is compared once an item."""
    found: list[list[int]] = []
    for a, b in sorted(windows):
        if found and a <= found[-1][1]:
            found[-1][1] = max(found[-1][1], b)
        else:
            found.append([a, b])
    return found


def with_leaks(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, text: str = "text", leaks: str = "leaks", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with an array ``leaks`` of (item_id, distance, start, end) more, word positions of each item's best passage; a column of that name is replaced.

    Items are distinct rows ``item_id, text``; rows with a null in either, and texts without a word, are found nowhere, items of fewer than ``least_words``
    words only as a whole text, and items of fewer than 1 / errors words only unchanged. Null and empty documents, and an empty benchmark, give empty
    arrays. Each row is judged alone, so repeated rows agree; among equal distances the first passage counts.

    What a text holds depends on the text alone, so the findings of a benchmark of several blocks are kept by two hashes of the text, in rows
    of the texts that hold something, and are joined to the documents at the end.
    """
    out = docs.drop(leaks) if leaks in docs.columns else docs
    each_block = blocks(benchmark)
    first, second = next(each_block), next(each_block, None)
    broadcast = docs.sparkSession.sparkContext.broadcast
    if second is None:
        return _scanned(out, broadcast((uuid.uuid4().hex, first, errors, least_words)), text, leaks)
    own = F.struct(F.xxhash64(F.coalesce(text, F.lit(""))).alias("h1"), F.xxhash64(F.lit(41), F.coalesce(text, F.lit(""))).alias("h2"))
    found = None
    for block in chain([first, second], each_block):
        items = broadcast((uuid.uuid4().hex, block, errors, least_words))
        rows = _scanned(out.select(F.col(text), own.alias("id")), items, text, "found").where(F.size("found") > 0)
        rows = staged(rows.select("id.h1", "id.h2", F.inline("found")).distinct(), "leaks")
        items.destroy(blocking=True)
        found = rows if found is None else found.unionByName(rows)
    found_name, id_name = fresh(out.columns, "found", "id")
    each = found.groupBy("h1", "h2").agg(F.array_sort(F.collect_set(F.struct("item_id", "distance", "start", "end"))).alias(found_name))
    joined = out.withColumn(id_name, own).join(each.select(F.struct("h1", "h2").alias(id_name), found_name), id_name, "left")
    return joined.select(*[F.col(c) for c in out.columns], F.coalesce(found_name, F.array().cast(T.ArrayType(LEAK))).alias(leaks))


def blocks(benchmark: DataFrame, most: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of up to ``most`` code points (or one longer item); the driver holds one block at a time. At least one block, if an empty one."""
    own: list[tuple[int, str]] = []
    held = 0
    for row in _items(benchmark).toLocalIterator():
        if own and held + len(row.text) > most:
            yield own
            own, held = [], 0
        own.append((row.item_id, row.text))
        held += len(row.text)
    yield own


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct().orderBy("item_id", "text")


def _scanned(docs: DataFrame, held: Broadcast, text: str, leaks: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(leaks, T.ArrayType(LEAK))])
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("item_id", "distance", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Built once a worker; another block takes its place.
        ready = resident(("benchmark", held.value[0]), lambda: Items(*held.value[1:]))
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for a, b in slices([len(x or "") for x in texts], SLICE_CHARS):
                found = [[dict(zip(names, x, strict=True)) for x in ready.leaks(t)] for t in texts[a:b]]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(found, kind)], [*batch.schema.names, leaks])

    return docs.mapInArrow(tidy(run, keeps=True), schema)


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = with_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", F.explode("leaks").alias("l")).select("doc_id", "l.*")
