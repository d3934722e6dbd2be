"""Token ids in binary shards with keyed access.

A shard is one row of a Parquet file: the raw ids of neighbouring documents (little-endian unsigned 32-bit integers, an end id after
each document), where each document starts, and an index from document key to its rows. The index is a minimal perfect hash:
keys fall into small buckets, each bucket stores the seed that sends its keys to free slots (a bucket of one key stores the slot
itself), and each slot stores a 32-bit fingerprint of its key and its first row. A look-up in a shard is two hashes, one comparison and
one slice, whatever the number of documents. Shards hold neighbouring keys and say their first and last one, so the shard of a key is found by
ranges, of the files first and then of a file's shards, and neither the keys nor the ids of other shards are read.

Documents are range-partitioned by key, so the files hold them in ascending order; shards are cut at a bounded number of ids and of
documents, so neither a task nor a reader holds more than one shard. A file written twice after a lost executor is the same file.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .bpe import SLICE_CHARS, byte_letters, load, slices
from .common import shared_dir, staged

SHARD_IDS, SHARD_DOCS = 1_000_000, 50_000
#: Words, and pieces of words, whose ids a worker remembers; at the bound the memory starts anew.
MEMORY = 400_000
#: Longer ones are encoded anew each time.
WORD_CHARS = 64
#: Fixed pattern of the tokenizers whose plain words take the short way, and what it comes to on those: lower case, no combining marks.
PIECES = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = re.compile("[!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PLAIN_TEXT = re.compile("[ \t-\r!-~\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
PLAIN_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^ \t-\ra-z0-9\xdf-\xf6\xf8-\xff]+")
ROW_GROUP = 8_000_000
#: Up to so many shards, a look-up names them to the reader.
NAMED = 1000
#: Mean number of keys in a bucket of the hash.
BUCKET = 2
#: Seeds that are tried at a time.
TRIES = 32
ODD_BLANKS = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
BLANKS = re.compile("[ \t-\r]+")
SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("n_null", T.IntegerType()),
        T.StructField("first", T.LongType()),
        T.StructField("last", T.LongType()),
        T.StructField("keys", T.BinaryType()),
        T.StructField("offsets", T.BinaryType()),
        T.StructField("seeds", T.BinaryType()),
        T.StructField("slots", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
    ]
)
SLOT = np.dtype([("print", "<u4"), ("row", "<u4"), ("rows", "<u4")])


def mixed(keys: np.ndarray, seed: int | np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each key under a seed (a column of seeds: a row each)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.asarray(seed, dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
        return x ^ (x >> np.uint64(31))


def build_index(keys: np.ndarray, rows: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Seeds and slots for distinct 64-bit ``keys``, whose rows start at ``rows`` and are ``counts`` many."""
    n = len(keys)
    if not n:
        return b"", b""
    n_buckets = n // BUCKET + 1
    bucket = (mixed(keys, 0) % np.uint64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    seeds = np.zeros(n_buckets, dtype="<i8")
    free = np.ones(n, dtype=bool)
    place = np.empty(n, dtype=np.int64)
    sizes = np.diff(edges)
    for b in np.argsort(-sizes, kind="stable"):
        own = order[edges[b] : edges[b + 1]]
        if len(own) < 2:
            break
        tried = np.arange(1, TRIES + 1)
        while True:
            at = (mixed(keys[own], tried[:, None]) % np.uint64(n)).astype(np.int64)
            good = np.flatnonzero(free[at].all(axis=1) & (np.diff(np.sort(at, axis=1), axis=1) > 0).all(axis=1))
            if len(good):
                break
            tried += TRIES
        at = at[good[0]]
        seeds[b], place[own], free[at] = tried[good[0]], at, False
    left = iter(np.flatnonzero(free).tolist())
    for b in np.flatnonzero(sizes == 1):
        slot = next(left)
        seeds[b], place[order[edges[b]]] = -slot - 1, slot
    slots = np.zeros(n, dtype=SLOT)
    slots["print"][place] = (mixed(keys, -1) >> np.uint64(32)).astype(np.uint32)
    slots["row"][place], slots["rows"][place] = rows, counts
    return seeds.tobytes(), slots.tobytes()


class Shard:
    """One shard, read: ``rows_of(key)`` and ``ids(row)`` take constant time."""

    def __init__(self, row: dict) -> None:
        self.n_null, self.start, self.payload = row["n_null"], row["start"], memoryview(row["payload"])
        self.keys = np.frombuffer(row["keys"], "<i8")
        self.offsets = np.frombuffer(row["offsets"], "<i8")
        self.seeds, self.slots = np.frombuffer(row["seeds"], "<i8"), np.frombuffer(row["slots"], SLOT)

    def rows_of(self, key: int | None) -> range:
        """Rows of the shard that a document key has (one, unless the table repeats it); none if it isn't there."""
        if key is None:
            return range(self.n_null)
        if not len(self.slots):
            return range(0)
        k = np.array([key], dtype=np.int64)
        seed = int(self.seeds[int(mixed(k, 0)[0]) % len(self.seeds)])
        slot = self.slots[-seed - 1 if seed < 0 else int(mixed(k, seed)[0]) % len(self.slots)]
        if slot["print"] != int(mixed(k, -1)[0]) >> 32:
            return range(0)
        return range(int(slot["row"]), int(slot["row"]) + int(slot["rows"]))

    def key_at(self, row: int) -> int:
        return int(self.keys[row - self.n_null])

    def raw(self, row: int) -> memoryview:
        return self.payload[4 * self.offsets[row] : 4 * self.offsets[row + 1]]

    def ids(self, row: int) -> np.ndarray:
        return np.frombuffer(self.raw(row), "<u4")


class Known(dict):
    """Ids by word; a word that isn't known yet is encoded when it is asked for."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        ids = self.encode(word)
        if len(word) <= WORD_CHARS:
            self[word] = ids
        return ids

    def joined(self, words: list[str]) -> bytes:
        """Ids of the words in turn; the memory stays bounded inside a text too."""
        parts: list[bytes] = []
        for at in range(0, len(words), MEMORY // 4):
            parts += map(self.__getitem__, words[at : at + MEMORY // 4])
            if len(self) > MEMORY:
                self.clear()
        return b"".join(parts)


class WordCache:
    """Ids by the tokenizers library; where white space ends every token, word by word with a bounded memory of words.

    Words of plain letters of a tokenizer in the one form below go straight to the library's model, split as its file says; all others, and
    all of other tokenizers, take the whole way through the library.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        whole = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        #: Holds only if the tokenizer drops white space wherever it stands.
        self.by_word = all(whole(f"a{s}Be,") == whole("a") + whole("Be,") == whole(f"{s}a{s}{s}Be,{s}") for s in " \t\n\x0b\x0c\r")
        spec = json.loads(content)
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        self.plain = self.by_word and steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex") == PIECES and [x.get("type") for x in splits] == ["Split", "ByteLevel"]
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.plain &= all(x.startswith("<|") for x in self.special)
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_letters())})
        self.pieces, self.words = Known(self._piece), Known(self._word)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _word(self, word: str) -> bytes:
        if self.plain and PLAIN.fullmatch(word) and not ("<|" in word and any(x in word for x in self.special)):
            return b"".join(map(self.pieces.__getitem__, PLAIN_PIECES.findall(word.lower())))
        return self._whole(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self._whole(x) for x in texts]
        out = []
        for x in texts:
            if self.plain and PLAIN_TEXT.fullmatch(x) and not ("<|" in x and any(s in x for s in self.special)):
                out.append(self.pieces.joined(PLAIN_PIECES.findall(x.lower())))
            else:
                out.append(self.words.joined(BLANKS.split(x) if ODD_BLANKS.search(x) else x.split()))
        return out


@lru_cache(maxsize=2)
def _cache(content: str) -> WordCache:
    return WordCache(content)


def _shard(part: int, shard: int, start: int, keys: list, sizes: list[int], parts: list[bytes]) -> pa.RecordBatch:
    n_null = sum(k is None for k in keys)
    own = np.array(keys[n_null:], dtype=np.int64)
    distinct, first, counts = np.unique(own, return_index=True, return_counts=True)
    seeds, slots = build_index(distinct, first + n_null, counts)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<i8")
    row = [part, shard, start, int(offsets[-1]), n_null, *((int(own[0]), int(own[-1])) if len(own) else (None, None)), own.astype("<i8").tobytes(), offsets.tobytes(), seeds, slots, b"".join(parts)]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], SCHEMA.names)


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode every whole ``text``, append ``end_id``, and write shards below ``out`` in ascending order of ``key`` (an integer).

    Nulls come first; rows with equal keys follow each other in the order of their texts and keep a place each. Null and empty texts
    have the end id alone. Of ``docs`` only the two columns are read. An empty table writes no shard.
    """
    content = load(docs, tokenizer)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = _cache(content.value), TaskContext.get().partitionId()
        shard = start = 0
        keys: list = []
        sizes: list[int] = []
        parts: list[bytes] = []
        held = 0
        for batch in batches:
            own, texts = batch.column("key").to_pylist(), [x or "" for x in batch.column("text").to_pylist()]
            for a, b in slices([len(x) for x in texts], SLICE_CHARS):
                for k, ids in zip(own[a:b], words.encode(texts[a:b]), strict=True):
                    n = len(ids) // 4 + 1
                    if keys and (held + n > SHARD_IDS or len(keys) >= SHARD_DOCS):
                        yield _shard(part, shard, start, keys, sizes, parts)
                        shard, start, held = shard + 1, start + held, 0
                        keys, sizes, parts = [], [], []
                    keys.append(k)
                    sizes.append(n)
                    parts.extend((ids, end))
                    held += n
        if keys:
            yield _shard(part, shard, start, keys, sizes, parts)

    dealt = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    # Row groups of a few shards, so that a reader of one skips the others.
    dealt.mapInArrow(run, SCHEMA).write.option("parquet.block.size", ROW_GROUP).option("parquet.block.size.row.check.min", 1).parquet(out)


def read_tokens(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """Rows ``key, start, n_tokens, ids_crc32`` of the shards below ``out``, each found through the index of its shard.

    ``start`` counts the ids of all documents before it. An index that misses one of its keys fails the task.
    """
    shards = spark.read.schema(SCHEMA).parquet(out)
    # One row for each file part: what the driver needs to number ids through all of them.
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before = dict(zip([t.part for t in totals], accumulate([t.n for t in totals], initial=0), strict=False))
    schema = T.StructType([T.StructField(key, T.LongType()), *[T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                found = [(k, r) for k in ([None] if shard.n_null else []) + np.unique(shard.keys).tolist() for r in shard.rows_of(k)]
                if len(found) != len(shard.offsets) - 1:
                    raise ValueError(f"the index of shard {row['part']}-{row['shard']} misses keys")
                at = before[row["part"]] + shard.start
                columns = [[k for k, _ in found], *map(list, zip(*[(at + int(shard.offsets[r]), int(shard.offsets[r + 1] - shard.offsets[r]), zlib.crc32(shard.raw(r))) for _, r in found], strict=True))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema.names)

    return shards.mapInArrow(run, schema)


def shards_of(spark: SparkSession, out: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``part, shard, asked`` for the shards in whose range of keys wanted ones lie; the ranges alone are read.

    The driver holds two keys a file; a file's shards are found by a join on the file.
    """
    ranges = spark.read.schema(SCHEMA).parquet(out).where("first is not null").select("part", "shard", "first", "last")
    files = ranges.groupBy("part").agg(F.min("first").alias("first"), F.max("last").alias("last")).orderBy("first").collect()
    firsts, parts = np.array([f["first"] for f in files], dtype=np.int64), np.array([f.part for f in files], dtype=np.int32)
    asked = wanted.select(F.col(key).cast("long").alias("key")).where("key is not null").distinct()

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key").to_numpy()
            at = np.searchsorted(firsts, keys, "right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(keys[at >= 0]), pa.array(parts[at[at >= 0]], pa.int32())], ["key", "part"])

    routed = asked.mapInArrow(route, "key long, part int")
    held = routed.join(ranges, "part").where((F.col("first") <= F.col("key")) & (F.col("key") <= F.col("last")))
    return held.groupBy("part", "shard").agg(F.collect_set("key").alias("asked"))


def named(spark: SparkSession, out: str, pairs: DataFrame) -> DataFrame:
    """The shards below ``out`` that ``pairs`` name; a bounded number of them is told to the reader, which skips other files and row groups."""
    shards = spark.read.schema(SCHEMA).parquet(out)
    some = pairs.select("part", "shard").limit(NAMED + 1).collect()
    if len(some) <= NAMED:
        shards = shards.where(F.col("part").isin(sorted({r.part for r in some})) & F.col("shard").isin(sorted({r.shard for r in some})))
    return shards.join(pairs, ["part", "shard"])


def lookup(spark: SparkSession, out: str, wanted: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows ``key, ids`` for the keys of ``wanted``: ids are read only from shards in whose range a wanted key lies, and found there by the index.

    A key that occurs several times gives a row each; one that isn't there gives none; null keys aren't looked up.
    """
    schema = T.StructType([T.StructField(key, T.LongType()), T.StructField("ids", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                shard = Shard(row)
                found = [(k, shard.ids(r)) for k in row["asked"] for r in shard.rows_of(k) if shard.key_at(r) == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int64()), pa.array([x for _, x in found], pa.list_(pa.int64()))], schema.names)

    return named(spark, out, staged(shards_of(spark, out, wanted, key), "asked")).mapInArrow(run, schema)


def op4_token_ids(spark, sf_dir: str) -> DataFrame:
    import uuid

    import public_tokenizers

    out = f"{shared_dir(spark)}/spanloom-tokens-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    write_tokens(docs, out, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, out)
