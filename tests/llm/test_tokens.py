"""BPE, token shards and chat masks against the tokenizers library and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm import bpe, chat, token_store

BYTE, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
R = random.Random(7)


def odd_texts(n):
    kinds = [lambda: R.randrange(1, 0x250), lambda: R.randrange(1, 0xD7FF), lambda: R.randrange(0x300, 0x370), lambda: R.randrange(0x10000, 0x1FFFF), lambda: ord(R.choice(" \n\tabest's'ReLL 01"))]
    out = ["", None, "<|endoftext|>", " a<|endoftext|> b", "<|startoftext|>x", "a" * 3000, "  x  ", "\x1c a\x85b\xa0c　d", "don't DON'T 'll", "Σ ΑΣ İı ﬁ"]
    return out + ["".join(chr(R.choice(kinds)()) for _ in range(R.randrange(50))) for _ in range(n)]


def table(spark, texts):
    return spark.createDataFrame([(i, t, "c", "d") for i, t in enumerate(texts)], "doc_id long, text string, ids string, decoded string")


def test_bpe_equals_the_library(spark):
    texts = odd_texts(600)
    own = Tokenizer.from_file(BYTE)
    rows = bpe.decoded(bpe.encoded(table(spark, texts), BYTE), BYTE).collect()
    for r in rows:
        want = own.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want and r.decoded == own.decode(want, skip_special_tokens=False) == (texts[r.doc_id] or "")
    assert bpe.encoded(table(spark, ["x"]).where("false"), BYTE).count() == 0
    both = bpe.round_trip(table(spark, texts), BYTE).collect()
    assert sorted(map(str, both)) == sorted(str(r) for r in bpe.decoded(bpe.encoded(table(spark, texts), BYTE), BYTE).select(both[0].__fields__).collect())
    again = bpe.round_trip(table(spark, texts).drop("decoded"), BYTE, back="text")
    assert again.columns == ["doc_id", "ids", "text"] and {r.doc_id: r.text for r in again.collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert bpe.round_trip(table(spark, ["x"]).where("false"), BYTE).count() == 0


def test_partial_characters_decode_as_the_library_does(spark):
    own, ids = Tokenizer.from_file(BYTE), [[R.randrange(50257) for _ in range(R.randrange(12))] for _ in range(300)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(ids)] + [(300, None)], "doc_id int, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decoded(df, BYTE).collect()}
    assert all(got[i] == own.decode(x, skip_special_tokens=False) for i, x in enumerate(ids)) and got[300] == ""


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.PrefixBpe(open(WORDS).read())


@pytest.mark.parametrize("path", [WORDS, BYTE])
def test_shards_hold_what_the_library_gives(spark, tmp_path, path):
    texts = odd_texts(300)
    rows = [(R.choice([None, *range(-5, 80)]), t) for t in texts] + [(7, "same")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = str(tmp_path / "ids")
    token_store.write_tokens(df, out, path, end_id=2)
    own = Tokenizer.from_file(path)
    ids = lambda t: [*own.encode(t or "", add_special_tokens=False).ids, 2]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, (x[1] or "").encode()))
    start, want = 0, []
    for k, t in order:
        x = ids(t)
        want.append((k, start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        start += len(x)
    key = lambda x: x[1]
    assert sorted(map(tuple, token_store.read_tokens(spark, out).collect()), key=key) == want
    asked = spark.createDataFrame([(7,), (-999,), (3,), (None,)], "doc_id long")
    got = sorted((r.doc_id, tuple(r.ids)) for r in token_store.lookup(spark, out, asked).collect())
    assert got == sorted((k, tuple(ids(t))) for k, t in rows if k in (7, 3))


def test_a_key_is_looked_up_in_one_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 50)
    rows = [(2 * i, f"document number {i}") for i in range(2000)]
    out = str(tmp_path / "ids")
    token_store.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), out, WORDS, end_id=2)
    n_shards = spark.read.parquet(out).count()
    assert n_shards >= 40
    own = Tokenizer.from_file(WORDS)
    for key, there in ((0, True), (2222, True), (3998, True), (2223, False), (-1, False), (4001, False)):
        asked = spark.createDataFrame([(key,)], "doc_id long")
        pairs = token_store.shards_of(spark, out, asked)
        assert pairs.count() <= 1
        read = token_store.named(spark, out, pairs)
        assert "PushedFilters: [In(part" in read._jdf.queryExecution().toString() or pairs.count() == 1 or not there
        got = [list(r.ids) for r in token_store.lookup(spark, out, asked).collect()]
        assert got == ([[*own.encode(rows[key // 2][1], add_special_tokens=False).ids, 2]] if there else [])


def test_one_text_of_very_many_words_keeps_memory_bounded(monkeypatch):
    monkeypatch.setattr(token_store, "MEMORY", 1000)
    cache = token_store.WordCache(open(WORDS).read())
    text = " ".join(f"w{i}ord" for i in range(20_000)) + " " + "x" * 5000
    assert cache.encode([text])[0] == np.array(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
    assert len(cache.words) <= 1500 and len(cache.pieces) <= 1500


def test_offsets_equal_the_library():
    own, align = Tokenizer.from_file(BYTE), chat.Aligner(open(BYTE).read())
    assert align.bpe is not None and chat.Aligner(open(WORDS).read()).bpe is None
    for t in odd_texts(400):
        e = own.encode(t or "", add_special_tokens=False)
        ids, starts, ends = align(t or "")
        assert ids.tolist() == e.ids and list(zip(starts.tolist(), ends.tolist(), strict=True)) == e.offsets


def test_empty_table_has_no_shards(spark, tmp_path):
    token_store.write_tokens(table(spark, ["x"]).where("false"), str(tmp_path / "e"), WORDS, 2)
    assert token_store.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 3, 40, 5000])
def test_perfect_hash(n):
    keys = np.sort(np.random.default_rng(n).choice(10**12, n, replace=False)).tolist()
    batch = token_store._shard(0, 0, 0, [None, *keys], [1] * (n + 1), [b"\2\0\0\0"] * (n + 1))
    shard = token_store.Shard(batch.to_pylist()[0])
    assert [list(shard.rows_of(k)) for k in keys] == [[i + 1] for i in range(n)] and list(shard.rows_of(None)) == [0]
    assert len(shard.slots) == n and sum(len(shard.rows_of(-k - 1)) for k in range(1000)) <= 2


def test_chat_round_trip(spark):
    bits = ["<|", "|>", "<|end|>\n", "<|user|>", "\\", "<\\|", "</s>", "<s>", "[INST]", "[/INST]", "[\\INST]", "<", "[", "é", "\U0001f469‍\U0001f469", "x y", "\n", "<|endoftext|>"]
    rows, said = [], {}
    for c in range(80):
        turns = [(R.choice(["user", "assistant", "system", "we|rd>\n", None]), R.choice([None, "", "".join(R.choice(bits) for _ in range(R.randrange(12)))])) for _ in range(R.randrange(1, 7))]
        said[c] = [(r or "", t or "") for r, t in turns]
        rows += [(c, i, r, t, "x") for i, (r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").orderBy(F.rand(1))
    shown = chat.formatted(df, BYTE)
    for r in shown.collect():
        assert [(a, b) for a, b, _, _ in chat.parse(r.formatted)] == said[r.conv_id]
    for r in chat.read_back(shown).collect():
        loss = "".join(t for role, t in said[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(said[r.conv_id]), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said[r.conv_id]).encode()).hexdigest()
    assert chat.formatted(df.where("false"), BYTE).count() == 0


def test_ties_and_null_conversations(spark):
    rows = [(None, None, "user", "b"), (None, None, "user", "a"), (1, 0, "user", "x"), (1, 0, "user", "x")]
    got = {r.conv_id: [t for _, t, _, _ in chat.parse(r.formatted)] for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BYTE).collect()}
    assert got == {None: ["a", "b"], 1: ["x", "x"]}
