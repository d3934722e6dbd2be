"""Byte-level BPE by dynamic programming over prefixes, and its inverse.

For every prefix of a word one token can end its encoding. An automaton over the vocabulary lists the tokens that are
suffixes of a prefix; the right one is that which stays apart from the last token of the rest, a test of two tokens alone:
two neighbours stay apart if at no time a merge joins the right edge of the one to the left edge of the other. The table of last
tokens fills from left to right, and following it back from the end gives the ids. Work is linear in the text, whatever
the length of a word.

Merges must be in the order in which they were learnt (each after those that make its parts), and each token must have one merge;
other files are refused. The vocabulary (about 1.5 MB) is read on the driver and broadcast; its size is checked.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from .common import fresh, resident, tidy, whole

#: Fixed pattern of this kind of tokenizer: contractions, words, numbers, marks, white space.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_FILE_BYTES = 64_000_000
#: Words whose ids a worker remembers, in two generations of half as many; and pairs whose test it remembers, anew at the bound.
MEMORY, PAIRS = 150_000, 300_000
#: Code points that a worker takes at a time.
SLICE_CHARS = 2_000_000
FOREVER = 1 << 60
#: From this code point on, libraries differ on which ones are letters (it came with the Unicode version); the tokenizers library decides.
DISPUTED = regex.compile("[\u0558-\U0010ffff]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the file: printable bytes stand for themselves, the others follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Decoder:
    """Bytes of the ids of one tokenizer file (its parsed JSON)."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        split = spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("only byte-level BPE without normalizer and prefix space is supported")
        vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        as_byte = {c: b for b, c in enumerate(byte_letters())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(as_byte[c] for c in token) if all(c in as_byte for c in token) else token.encode()
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.raw_bytes = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_size = np.array([len(x) for x in raw], dtype=np.int64)
        self.raw_at = np.concatenate([[0], np.cumsum(self.raw_size)[:-1]])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids."""
        sizes = self.raw_size[ids]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.raw_bytes[np.repeat(self.raw_at[ids] - (ends - sizes), sizes) + np.arange(total)].tobytes()


class PrefixBpe(Decoder):
    """Encoder and decoder for one tokenizer file (its JSON text)."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        super().__init__(spec)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        letters = byte_letters()
        self.letters = dict(enumerate(letters))
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized") for x in spec.get("added_tokens", [])):
            raise ValueError("only plain added tokens are supported")
        self.special_at = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(PATTERN)
        self.by_library = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)

        born = dict.fromkeys((vocab[c] for c in letters if c in vocab), -1)
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        for at, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if left not in born or right not in born or both in born:
                raise ValueError(f"merge {at} is out of order or makes a token anew")
            born[both] = at
            self.rank[left, right] = at
            self.parts[both] = (left, right)
        self.born = born

        self.right: dict[int, list[tuple[int, int, int]]] = {}
        self.left: dict[int, list[tuple[int, int, int]]] = {}
        self.suffixes = ahocorasick.Automaton()
        for token, i in vocab.items():
            if i in born and self._whole(i):
                self.suffixes.add_word(token, (i, len(token)))
        self.suffixes.make_automaton()
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that are at one edge of a token while it is built: token, when it is made, when it is used up."""
        kept = self.right if side else self.left
        if (found := kept.get(token)) is None:
            found, until, t = [], FOREVER, token
            while True:
                found.append((t, self.born[t], until))
                if t not in self.parts:
                    break
                until = self.born[t]
                t = self.parts[t][side]
            kept[token] = found
        return found

    def _crossed(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of a rank under ``before`` joins the right edge of a and the left edge of b."""
        rank = self.rank
        for x, x_from, x_until in self._edge(a, 1):
            for y, y_from, y_until in self._edge(b, 0):
                r = rank.get((x, y))
                # Equal merges run from left to right: x is gone if its own is of that rank, y is not.
                if r is not None and r < before and x_from < r < x_until and y_from < r <= y_until:
                    return True
        return False

    def _whole(self, token: int) -> bool:
        """Whether the text of a token encodes as that token alone; its parts come before it, so they were asked already."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return self._whole(a) and self._whole(b) and not self._crossed(a, b, self.born[token])

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word of the pattern."""
        w = (word if word.isascii() else word.encode().decode("latin-1")).translate(self.letters)
        last, size = [0] * (len(w) + 1), [0] * (len(w) + 1)
        apart = self.apart
        for end, (token, n) in self.suffixes.iter(w):
            end += 1
            if size[end]:
                continue
            if n < end:
                before = last[end - n]
                pair = before << 32 | token
                if (ok := apart.get(pair)) is None:
                    if len(apart) >= PAIRS:
                        apart.clear()
                    ok = apart[pair] = not self._crossed(before, token, FOREVER)
                if not ok:
                    continue
            last[end], size[end] = token, n
        ids, at = [], len(w)
        while at:
            if not size[at]:
                raise ValueError("the vocabulary lacks a byte of the text")
            ids.append(last[at])
            at -= size[at]
        return ids[::-1]

    def _split(self, text: str) -> list[str]:
        if not text.isascii() and DISPUTED.search(text):
            return [text[a:b] for _, (a, b) in self.by_library.pre_tokenize_str(text)]
        return self.words.findall(text)

    def _add(self, out: list[bytes], text: str) -> None:
        known = self.known
        for word in self._split(text):
            if (got := known.get(word)) is None:
                if (got := self.older.get(word)) is None:
                    got = array("i", self.word_ids(word)).tobytes()
                if len(word) <= 64:
                    if len(known) >= MEMORY // 2:
                        self.older, known = known, {}
                        self.known = known
                    known[word] = got
            out.append(got)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers; strings of special tokens inside the text become those tokens."""
        out: list[bytes] = []
        at = 0
        for m in self.special_at.finditer(text) if self.special_at else ():
            self._add(out, text[at : m.start()])
            out.append(np.array([self.special[m[0]]], dtype="<i4").tobytes())
            at = m.end()
        self._add(out, text[at:] if at else text)
        return b"".join(out)


def built(content: str) -> PrefixBpe:
    """The encoder, built once a worker."""
    return resident(("bpe", content), lambda: PrefixBpe(content))


@lru_cache(maxsize=1)
def _decoder(content: str) -> Decoder:
    return Decoder(json.loads(content))


def load(docs: DataFrame, path: str) -> Broadcast:
    """The tokenizer file, read by the driver and broadcast; a file beyond MAX_FILE_BYTES is refused."""
    with open(path, encoding="utf-8") as f:
        content = f.read(MAX_FILE_BYTES + 1)
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return docs.sparkSession.sparkContext.broadcast(content)


def slices(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of up to ``most`` in sum, at least one each."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def encoded(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with ``ids`` (array of int) more, the exact BPE ids of the whole ``text``; a column of that name is replaced.

    Null and empty texts have no ids. Rows are taken as they come, in slices of bounded size, so ties and repeated rows need no rule.
    """
    vocabulary = load(docs, path)
    kept = docs.drop(ids) if ids in docs.columns else docs
    schema = T.StructType([*kept.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(vocabulary.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(text).to_pylist()]
            for a, b in slices([len(x) for x in texts], SLICE_CHARS):
                lists = _id_lists([bpe.encode(x) for x in texts[a:b]])
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, lists], [*batch.schema.names, ids])

    return kept.mapInArrow(tidy(run, keeps=True), schema)


def _id_lists(got: list[bytes]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in got])]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(got), dtype="<i4")))


def round_trip(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """``docs`` with ``ids`` and ``back`` more: what ``encoded`` gives, and what ``decoded`` makes of it, by one worker a task instead of two.

    Null and empty texts have no ids and decode to the empty text. ``back`` may be ``text`` itself, or another column, which it replaces.
    """
    vocabulary = load(docs, path)
    (read,) = fresh([*docs.columns, ids, back], "whole")
    kept = docs.select(*[F.col(c) for c in docs.columns if c not in (ids, back)], F.col(text).alias(read))
    own = [f for f in kept.schema.fields if f.name != read]
    schema = T.StructType([*own, T.StructField(ids, T.ArrayType(T.IntegerType(), False)), T.StructField(back, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = built(vocabulary.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(read).to_pylist()]
            others = batch.select([f.name for f in own])
            for a, b in slices([len(x) for x in texts], SLICE_CHARS):
                got = [bpe.encode(x) for x in texts[a:b]]
                again = pa.array([bpe.decode(np.frombuffer(x, dtype="<i4")).decode("utf-8", "replace") for x in got], pa.string())
                yield pa.RecordBatch.from_arrays([*others.slice(a, b - a).columns, _id_lists(got), again], [f.name for f in schema.fields])

    return kept.mapInArrow(tidy(run, keeps=True), schema)


def decoded(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with ``text`` more, decoded from ``ids``; bytes that are no UTF-8 become U+FFFD. A column of that name is replaced.

    Null or no ids give the empty text; an id outside the vocabulary fails the task.
    """
    vocabulary = load(rows, path)
    kept = rows.drop(text) if text in rows.columns else rows
    schema = T.StructType([*kept.schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(vocabulary.value)
        for batch in batches:
            column = batch.column(ids)
            sizes = [n or 0 for n in column.value_lengths().to_pylist()]
            for a, b in slices(sizes, SLICE_CHARS):
                part = column.slice(a, b - a)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes[a:b])
                texts = [decoder.decode(flat[e - n : e]).decode("utf-8", "replace") for e, n in zip(ends, sizes[a:b], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return kept.mapInArrow(run, schema)


def op6_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return round_trip(docs, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2(F.encode(whole(F.col("decoded")), "UTF-8"), 256).alias("decoded_sha256"),
    )
