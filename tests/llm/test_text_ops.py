"""Quality rules, line dedup, sharding and secrets against plain versions, with nulls, ties, repeats, clashing columns and empty tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, quality, secrets, sharding

BLANK = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " ", "\n\n", "a", "é\U0001f600 x", "tab\tone two three four five six seven", "no break space and more", "a b c d e " * 30, "| home | about | contact |\n" + "plain words of a text that goes on. " * 9]


def docs(spark, texts, clash=""):
    extra = f", {clash} string" if clash else ""
    return spark.createDataFrame([(i, t, *(["x"] if clash else [])) for i, t in enumerate(texts)], f"doc_id long, text string{extra}")


def plain_quality(text):
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    covered = {i + o for i, g in enumerate(grams) if n[g] > 1 for o in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def test_quality_counts(spark):
    r = random.Random(1)
    texts = [*ODD, *["".join(r.choice(["a ", "b ", "c\n", "word ", "# ", "x\ty ", "\x0b", "é "]) for _ in range(r.randrange(120))) for _ in range(150)]]
    got = {x.doc_id: x.quality for x in quality.measured(docs(spark, texts, "quality")).collect()}
    for i, t in enumerate(texts):
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == plain_quality(t), t
        assert not (q.base_failed and q.kept)


def test_line_rules_keep_prose_and_reject_junk(spark):
    prose = "It was a fine day and they all went to the shore. Nobody came back before the evening.\n" * 1 + "The next day they stayed at home, reading | as always | by the fire."
    texts = [prose, prose + "\nClick here to subscribe now\n| Home | News | About |", "word*** other### thing%%% more&&& " * 20 + "end", "\n".join(f"item{i} | thing{i} | a{i} | b{i}" for i in range(20)), "THIS!! IS!! SOME!! LOUD!! TEXT!! THAT!! GOES!! ON!! AND!! NEVER!! ENDS!!"]
    table = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in quality.cleaned(table).collect()}
    assert set(got) == {0, 1} and got[0].text == prose == got[1].text and got[1].n_chars == len(prose)
    assert quality.cleaned(table).columns == table.columns and quality.cleaned(table.where("false")).count() == 0


def test_boilerplate_is_a_share_of_the_line(spark):
    long = "Our lawyers read the privacy policy of each company, and after some weeks they had more questions than answers about it."
    lines = ["All rights reserved.", "© 2020 Someone. Tous droits réservés", long, "Click here", "privacy policy | terms of use " * 30, "They click here and there on the page while the others wait for the whole thing to end, as people do."]
    got = [r.f for r in docs(spark, lines).orderBy("doc_id").select(quality.line_fails(F.col("text")).alias("f")).collect()]
    assert got == [True, True, False, True, True, False]


def plain_dedup(rows, least=20, most=3):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))
    held = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                held[key(line)].add(d)
    gone = lambda d, line: len(held.get(key(line), ())) >= most and d != max(held[key(line)], key=lambda x: (x is not None, x or 0))
    return [(d, len((t or "").split("\n")), sum(gone(d, x) for x in (t or "").split("\n")), "\n".join(x for x in (t or "").split("\n") if not gone(d, x))) for d, t in rows]


def test_line_dedup(spark):
    r = random.Random(2)
    pool = ["A common line of text number one", " a COMMON line of text number one\t", "another line that many texts do hold", "short", "", "ÀÉ line with accents that are kept apart", "àÉ line with accents that are kept apart", "exactly twenty chars", "just nineteen chars"]
    rows = [(i % 37 if i % 41 else None, "\n".join(r.choice([*pool, f"own line {i} {j} that no other text holds"]) for j in range(r.randrange(9)))) for i in range(150)]
    rows += [(5, None), (6, ""), *[(9, "same row\nA common line of text number one")] * 3]
    df = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, n_lines string")
    got = line_dedup.apply_keep(df, line_dedup.keep_bitmaps(df))
    assert sorted(got.columns) == ["doc_id", "n_dropped", "n_lines", "text"]
    want = Counter(plain_dedup(rows))
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, x.text) for x in got.collect()) == want
    assert sum(n * x[2] for x, n in want.items()) > 50
    runs = line_dedup.keep_bitmaps(df).collect()
    assert all(list(x.drop_runs) == sorted(x.drop_runs) and sum(b - a for a, b in zip(x.drop_runs[::2], x.drop_runs[1::2], strict=True)) == x.n_dropped for x in runs)
    none = df.where("false")
    assert line_dedup.apply_keep(none, line_dedup.keep_bitmaps(none)).count() == 0


def test_shards(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(60)]), r.choice([*ODD[:6], "x" * r.randrange(300), "é" * r.randrange(200)]), "s") for _ in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    got = sharding.assign_shards(df, 8).collect()
    own = lambda t: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((x.doc_id, x["size"], x.text_crc32) for x in got) == Counter((d, *own(t)) for d, t, _ in rows)
    by = defaultdict(list)
    for x in got:
        by[x.shard].append(x)
    total, largest = sum(x["size"] for x in got), max(x["size"] for x in got)
    assert sorted(by) == list(range(8))
    for s, members in by.items():
        assert sorted(x.slot for x in members) == list(range(len(members)))
        assert abs(sum(x["size"] for x in members) - total / 8) <= largest, s
    order = [x.doc_id if x.doc_id is not None else -1 for x in sorted(got, key=lambda x: (x.shard, x.slot))]
    assert order == sorted(order)
    assert sharding.assign_shards(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        sharding.assign_shards(df, 0)


def test_written_shards_hold_every_row(spark, tmp_path):
    df = docs(spark, [t for t in ODD if t is not None] * 3)
    sharding.write_shards(df, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((x.doc_id, x.text) for x in back.collect()) == Counter((x.doc_id, x.text) for x in df.collect()) and back.select("__shard").distinct().count() == 3


PATTERN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_spans(t):
    t = t or ""
    out = [(m.start(), 0, "assign", m.end()) for m in PATTERN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 24]
    return ",".join(f"{k}:{s}:{e}" for s, _, k, e in sorted(out))


def test_secret_patterns(spark):
    r = random.Random(4)
    bits = ["secret", "TOKEN", "api_key", "ApiKey", "passwd", "=", ":", '"', "'", " ", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789ab", "é", "\U0001f600", ".", "abc", "\n", "K"]
    texts = [*ODD, "secret=token: abcdef12", "AKIA" * 6, *["".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(400)]]
    found = secrets.secrets(docs(spark, texts, "spans"))
    got = {x.doc_id: x.b for x in found.select("doc_id", secrets.spelled(found["base"]).alias("b")).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    assert any(got.values())


def plain_battery(texts):
    """Spans of random tokens by plain loops over characters, from the same constants."""
    S = secrets
    rest = "".join(re.sub(S.TOKEN, " ", t or "").lower() + "\n" for t in texts)
    counts = [rest.count(c) for c in S.LOWER + S.DIGITS]
    letters = [a + S.KNOWN * b / sum(S.LETTERS) for a, b in zip(counts[:26], S.LETTERS, strict=True)]
    digits = [a + S.KNOWN * b / 1000 for a, b in zip(counts[26:], S.NUMBERS, strict=True)]
    pairs = S.KNOWN + sum(a in S.LOWER and b in S.LOWER for a, b in zip(rest, rest[1:], strict=False))
    both = S.KNOWN * S.VOWEL_PAIRS + sum(a in "aeiou" and b in "aeiou" for a, b in zip(rest, rest[1:], strict=False))
    vowel = sum(letters[S.LOWER.index(c)] for c in "aeiou") / sum(letters)
    turn = (both / pairs - vowel**2) / (vowel * (1 - vowel))
    agree = lambda c, k: sum((x / sum(c)) ** k for x in c)

    def score(b):
        alphabet = next(a for a in S.ALPHABETS if set(b) <= set(a))
        n, kinds = len(b), [sum(c in k for c in b) for k in (S.LOWER, S.UPPER, S.DIGITS)]
        own = letters[:6] if S.ALPHABETS.index(alphabet) in S.HEX else letters
        mean, third = (sum((k / n) ** p for k in kinds[:2]) * agree(own, p) + (kinds[2] / n) ** p * agree(digits, p) for p in (2, 3))
        same = sum(b[i] == b[j] for i in range(n) for j in range(n) if i != j) / (n * (n - 1))
        tests = [(mean - same) / math.sqrt((2 * mean * (1 - mean) + 4 * (n - 2) * max(third - mean**2, 0)) / (n * (n - 1)))]
        kind = lambda c: (c in S.LOWER) + 2 * (c in S.UPPER)
        if sum(k > 0 for k in kinds) > 1:
            q = S.CHANGES[kinds[0] > 0 and kinds[1] > 0]
            tests.append((sum(kind(x) != kind(y) for x, y in zip(b, b[1:], strict=False)) - (n - 1) * q) / math.sqrt((n - 1) * q * (1 - q)))
        near = [(x.lower() in "aeiou", y.lower() in "aeiou") for x, y in zip(b, b[1:], strict=False) if x.isalpha() and y.isalpha()]
        if len(near) >= 6 and own is letters:
            tests.append((sum((x - vowel) * (y - vowel) for x, y in near) / (len(near) * vowel * (1 - vowel)) - turn) * math.sqrt(len(near)))
        at = [alphabet.index(c) for c in b]
        centre = sum(at) / n
        var = sum((x - centre) ** 2 for x in at)
        order = abs(sum((x - centre) * (y - centre) for x, y in zip(at, at[1:], strict=False)) / var + 1 / n) * math.sqrt(n) if var else n
        return -10.0 if order > S.MOST_ORDER else sum(tests) / math.sqrt(len(tests))

    found = []
    for d, t in enumerate(texts):
        taken = [(int(a), int(b)) for a, b in (x.split(":")[1:] for x in plain_spans(t).split(",") if x)]
        for m in re.finditer(S.TOKEN, t or ""):
            pieces = [p for p in re.split(S.SEPARATORS, m[0]) if p]
            own = {p for p in ("".join(pieces), max(pieces, key=len, default="")) if len(p) >= S.MIN_TOKEN}
            if own and not any(a < m.end() and m.start() < b for a, b in taken):
                z = max(map(score, own))
                p = min(1.0, len(own) * (1.0 if z <= 0 else math.exp(-z * z / 2) / math.sqrt(2 * math.pi) * 4 / (3 * z + math.sqrt(z * z + 8))))
                found.append((d, m.start(), m.end(), sum(len("".join(pieces)) >= low for low in S.STRATA), 10 ** (-math.floor(-math.log10(max(p, 1e-300)) * S.BINS) / S.BINS)))
    out = set()
    for stratum in {x[3] for x in found}:
        ps = sorted(x[4] for x in found if x[3] == stratum)
        cut = max((p for p in ps if p <= S.ALPHA * sum(q <= p for q in ps) / len(ps)), default=-1)
        out |= {x[:3] for x in found if x[3] == stratum and x[4] <= cut}
    return out


#: Names as code has them.
NAMES = (
    "getUserAccountById2FromCache convertUtf8StringToBase64 sha256WithRSAEncryption README2023FinalVersionCopy ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 "
    "Version1Version2Version3Version4 2024-01-02-the-Third-of-all-the-Pages AbcAbcAbcAbcAbcAbcAbc1111111 averylongwordthathasnodigitsatall src/main/python/streaming/example "
    "MAX_BUFFER_SIZE_IN_BYTES_PER_CHANNEL donaudampfschifffahrtsgesellschaft 12345678901234567890123456789012 test_groupby_with_hierarchical_columns"
).split()


def named(r, n):
    """Names put together from words, in four styles."""
    words = "get set user account item value index first last stream buffer table column row read write file path name count total size open close parse load save text line word page view model data json http client server request response error state event handler manager factory builder service".split()
    out = []
    while len(out) < n:
        own = [r.choice(words) for _ in range(r.randrange(4, 7))]
        x = r.choice([lambda w: w[0] + "".join(map(str.title, w[1:])), "_".join, "-".join, lambda w: "".join(map(str.title, w)) + str(r.randrange(100))])(own)
        out += [x] if len(re.sub("[-_]", "", x)) >= 20 else []
    return out


def test_random_tokens_are_found_and_names_are_not(spark):
    r = random.Random(5)
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    some, letters, small = secrets.ALPHABETS[9], secrets.ALPHABETS[8], secrets.ALPHABETS[6]
    makers = {
        "plain": lambda: pick(some, r.choice([32, 40, 64])),
        "letters": lambda: pick(letters, 40),
        "low": lambda: pick(small, 40),
        "uuid": lambda: "-".join(pick("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        "prefix": lambda: "ghp_" + pick(some, 36),
        "slack": lambda: f"xoxb-{pick(secrets.DIGITS, 12)}-{pick(secrets.DIGITS, 12)}-{pick(some, 28)}",
        "base64": lambda: pick(some + "+/", 43) + "=",
    }
    keys = [(k, f()) for k, f in makers.items() for _ in range(40)]
    names = NAMES + named(r, 500)
    texts = [f"see {k} there" for _, k in keys] + [f"see {w} there" for w in names]
    found = secrets.secrets(docs(spark, texts)).collect()
    hit = {(x.doc_id, s.start, s.end) for x in found for s in x.spans if s.kind == "random"}
    assert hit == plain_battery(texts)
    caught = Counter(keys[d][0] for d, s, e in hit if d < len(keys) and (s, e) == (4, 4 + len(keys[d][1])))
    assert sum(caught.values()) >= 0.95 * len(keys) and min(caught[k] for k in makers) >= 36, caught
    assert sum(d >= len(keys) for d, _, _ in hit) < 0.02 * len(names)
    assert secrets.secrets(docs(spark, ["x"]).where("false")).count() == 0


def test_texts_of_many_secrets_take_linear_time(spark):
    r = random.Random(6)
    text = "\n".join("%032x" % r.getrandbits(128) for _ in range(40_000))
    began = time.monotonic()
    row = secrets.secrets(docs(spark, [text, text[:-1] + "g " + "x" * 3_000_000])).select("doc_id", F.size("base").alias("n")).orderBy("doc_id").collect()
    assert [x.n for x in row] == [40_000, 40_000] and time.monotonic() - began < 15


def test_base_spans_stay_and_are_not_found_twice(spark):
    key = "aB3dE5gH7jK9mN1pQ3sT5vX7zA9"
    x = secrets.secrets(docs(spark, [f"token={key} and {key}"])).collect()[0]
    assert [s.kind for s in x.spans] == ["assign", "random"] and [s.kind for s in x.base] == ["assign"]
    assert hashlib.sha256(b"assign:0:33").hexdigest() and x.base[0].end == 6 + len(key)


def test_random_tokens_behind_an_equals_sign(spark):
    r = random.Random(8)
    key = lambda n: "".join(r.choice(secrets.ALPHABETS[9]) for _ in range(n))
    long, short, padded = key(40), key(26), key(26) + "=="
    texts = [f"AWS_SECRET_ACCESS_KEY={long}\n", f"https://x.org/f?a=1&sig={short}&b=2", f"AccountName=x;AccountKey={padded};EndpointSuffix=y", f'export NAME="{long}"', f"a_name_longer_than_twenty_letters={short}"]
    found = {x.doc_id: [texts[x.doc_id][s.start : s.end] for s in x.spans] for x in secrets.secrets(docs(spark, texts)).collect()}
    assert found == {0: [long], 1: [short], 2: [padded], 3: [long], 4: [short]}
