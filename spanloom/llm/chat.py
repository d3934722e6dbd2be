"""Chat formatting with loss masks that are aligned by character offsets.

A conversation is rendered whole, encoded once, and the tokenizer's offsets tell which characters each token covers. The spans of the
assistant's texts and the spans of the tokens are both sorted, so two binary searches a turn find its tokens.

Template: ``<|role|>``, newline, text, ``<|end|>``, newline for each turn. Control strings inside a text (those of this template and of
other common ones) get a backslash after their first character, and one more if backslashes stand there; a role is
percent-encoded. Reading back takes one backslash away, so every text comes back as it was.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import SLICE_CHARS, PrefixBpe, load, slices
from .common import resident

END = "<|end|>\n"
#: Control strings are these starts: ours and the special tokens <|...|>, sentence marks, instruction marks.
CONTROL = re.compile(r"(<|\[)(\\*)(\||/?s>|/?INST\])")
ESCAPED = re.compile(r"(<|\[)\\(\\*)(\||/?s>|/?INST\])")
TURN = re.compile(r"<\|([^|]*)\|>\n(.*?)<\|end\|>\n", re.S)
SCHEMA = "conv_id long, formatted string, ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans of the assistant's texts in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"<|{quote(role, safe='')}|>\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens share a character with a span; token spans and spans are sorted."""
    out = np.zeros(len(starts), dtype=bool)
    for s, e in spans:
        if s < e:
            out[np.searchsorted(ends, s, "right") : np.searchsorted(starts, e, "left")] = True
    return out


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn."""
    return [(unquote(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in TURN.finditer(formatted)]


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, on: np.ndarray) -> str:
    """The text under the mask, unescaped: the masked tokens' characters inside each turn's text, each once."""
    out = []
    for _, _, s, e in parse(formatted):
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(starts, e, "left")
        own = a + np.flatnonzero(on[a:b])
        if len(own):
            # Tokens that share a character overlap; runs of tokens without a gap are taken at once.
            low, high = np.maximum(starts[own], s), np.maximum.accumulate(np.minimum(ends[own], e))
            first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
            out.append(unescape("".join(formatted[low[x]:high[y]] for x, y in zip(first, [*(first[1:] - 1), len(own) - 1], strict=True))))
    return "".join(out)


class Aligner:
    """Ids of a text with the characters that each covers; a character that several tokens share counts for each of them.

    Byte-level BPE files go through the prefix encoder, whose tokens' byte lengths add up to the offsets; all others through the library.
    """

    def __init__(self, content: str) -> None:
        try:
            self.bpe: PrefixBpe | None = PrefixBpe(content)
        except ValueError:
            # A kind of file that the prefix encoder refuses.
            self.bpe = None
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.library = Tokenizer.from_str(content)
            self.library.no_padding()
            self.library.no_truncation()

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.bpe is None:
            e = self.library.encode(text, add_special_tokens=False)
            edges = np.array(e.offsets, dtype=np.int32).reshape(-1, 2)
            return np.array(e.ids, dtype=np.int32), edges[:, 0], edges[:, 1]
        ids = np.frombuffer(self.bpe.encode(text), dtype="<i4")
        sizes = self.bpe.raw_size[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        if not text.isascii():
            of_byte = np.cumsum((np.frombuffer(text.encode(), dtype=np.uint8) & 0xC0) != 0x80) - 1
            starts, ends = of_byte[starts], of_byte[ends - 1] + 1
        return ids, starts.astype(np.int32), ends.astype(np.int32)


def _aligner(content: str) -> Aligner:
    return resident(("aligner", content), lambda: Aligner(content))


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts), kind))


def formatted(rows: DataFrame, tokenizer: str) -> DataFrame:
    """One row a conversation of ``rows`` (``conv_id, turn, role, text``): its formatted text, ids, token spans and loss mask.

    Turns are in the order of ``turn`` (nulls first); equal turns in the order of role and text, repeated rows each count. A null
    role or text is empty; a null conv_id is a conversation of its own. Extra columns are left out. A conversation is one record, so it
    is gathered in one row, however long.
    """
    content = load(rows, tokenizer)
    turns = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turns)).alias("turns")).select("conv_id", "turns.role", "turns.text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = _aligner(content.value)
        for batch in batches:
            ids, roles, texts = (batch.column(i).to_pylist() for i in range(3))
            for a, b in slices([sum(map(len, t)) for t in texts], SLICE_CHARS):
                done = [render(list(zip(r, t, strict=True))) for r, t in zip(roles[a:b], texts[a:b], strict=True)]
                aligned = [align(f) for f, _ in done]
                masks = [mask(x[1], x[2], spans) for x, (_, spans) in zip(aligned, done, strict=True)]
                columns = [pa.array(ids[a:b], pa.int64()), pa.array([f for f, _ in done], pa.string()), *(_lists([x[i] for x in aligned], pa.int32()) for i in range(3)), _lists(masks, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "formatted", "ids", "token_starts", "token_ends", "loss_mask"])

    return whole.mapInArrow(run, SCHEMA)


def _values(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


def read_back(rows: DataFrame) -> DataFrame:
    """What ``formatted`` rows say when they are parsed: turns, their digest, and the text under the mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("conv_id").to_pylist(), batch.column("formatted").to_pylist()
            edges = batch.column("ids").offsets.to_numpy()
            flat = [_values(batch.column(c)) for c in ("token_starts", "token_ends", "loss_mask")]
            out: dict[str, list] = {c: [] for c in READ.names}
            for i, f, a, b in zip(ids, texts, edges[:-1] - edges[0], edges[1:] - edges[0], strict=True):
                turns, loss = parse(f), loss_text(f, *(x[a:b] for x in flat))
                said = "".join(f"{role}\n{text}\n" for role, text, _, _ in turns)
                row = (i, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(f))
                for c, v in zip(READ.names, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, READ)

    return rows.select("conv_id", "formatted", "ids", "token_starts", "token_ends", "loss_mask").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(rows.unionByName(more), public_tokenizers.path("byte_bpe_50k.json")))
