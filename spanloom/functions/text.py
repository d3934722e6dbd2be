"""Text functions as column expressions."""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word tokens of the ranking and classifier features: two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
#: Fixed question templates: the boilerplate around a category, and the category alone.
PROBE = (
    r"(?is)^\s*Highlight the parts \(if any\) of this contract related to\s+"
    r'"([^"]+)"\s*that should be reviewed by a lawyer\.\s*(?:Details:\s*(.*))?$'
)
CATEGORY = r'related to\s+"([^"]+)"'
#: Fixed marker of an answer that declines.
NO_ANSWER = "NOT_IN_EXCERPTS"
#: Fixed parts of messages of errors that go away by themselves.
TRANSIENT = (
    "429", "rate limit", "ratelimit", "resource_exhausted", "500", "502", "503", "504", "unavailable", "overloaded", "timeout", "timed out", "connection",
)


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def non_empty(text: Column) -> Column:
    """Null for the empty string."""
    return F.when(text != "", text)


@lru_cache(maxsize=1)
def stop_words() -> tuple[str, ...]:
    """English stop words as Spark ships them. Callers who need another list pass it to the operators."""
    import pyspark

    for jar in sorted((Path(pyspark.__file__).parent / "jars").glob("spark-mllib_*.jar")):
        with zipfile.ZipFile(jar) as z:
            words = z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split()
            return tuple(sorted(set(words)))
    return ()


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often body (or a lambda in it) names it."""
    return F.transform(F.array(value), body)[0]


def emitted(items: Column, start: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str, block: int = 256) -> Column:
    """What ``step(state, item) -> (state, out)`` gives for each item in turn, as an array of ``kind``; the work is linear but for one copy a block.

    A fold that appends to one array copies all that is there for each item. Here items come in blocks, and only a block's own array grows.
    """
    none, no_blocks = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def add(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(out)).alias("out"))

    def add_block(acc: Column, xs: Column) -> Column:
        done = F.aggregate(xs, F.struct(acc["at"].alias("at"), none.alias("out")), add)
        return let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def walked(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / block).cast("int")), lambda i: F.slice(own, i * block + 1, block))
        return F.when(F.size(own) == 0, none).otherwise(F.aggregate(blocks, F.struct(start.alias("at"), no_blocks.alias("out")), add_block, lambda acc: F.flatten(acc["out"])))

    return let(items, walked)


def tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Word tokens in lower case and in order, without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(list(stop))) if stop else found


def word_ngrams(words: Column, low: int, high: int) -> Column:
    """All runs of ``low`` to ``high`` neighbouring words, joined by spaces."""
    if low == high == 1:
        return words

    def runs(own: Column, n: int) -> Column:
        if n == 1:
            return own
        starts = F.sequence(F.lit(1), F.size(own) - (n - 1))
        return F.when(F.size(own) < n, F.array().cast("array<string>")).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(own, i, n), " ")))

    return let(words, lambda own: F.concat(*[runs(own, n) for n in range(low, high + 1)]))


def _cut(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def char_ngrams(text: Column, low: int, high: int) -> Column:
    """Character n-grams that stay inside words: every word in lower case between two spaces; a padded word shorter than n counts once, whole."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")

    def of(padded: Column) -> Column:
        size = F.char_length(padded)
        sized = [
            F.when(size > n, F.transform(F.sequence(F.lit(1), size - (n - 1)), _cut(padded, n))).when(size == n, F.array(padded)).otherwise(F.array().cast("array<string>"))
            for n in range(low, high + 1)
        ]
        # Beyond its own size a word gives no longer n-grams; shorter than the least, it stands once for itself.
        return F.when(size < low, F.array(padded)).otherwise(F.concat(*sized))

    return F.flatten(F.transform(F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" "))), of))


def category_of(question: Column) -> Column:
    """The quoted category of a question, null without one."""
    return non_empty(F.regexp_extract(question, CATEGORY, 1))


def category_or_start(question: Column) -> Column:
    """The quoted category, or the first 50 characters."""
    return F.coalesce(non_empty(F.regexp_extract(question, r'related to\s+"(.*?)"', 1)), F.substring(question, 1, 50))


def clean_query(question: Column) -> Column:
    """``category. details`` or ``category`` of a templated question; any other stays as it is."""
    category, details = strip(F.regexp_extract(question, PROBE, 1)), strip(F.regexp_extract(question, PROBE, 2))
    return F.when(F.rlike(question, F.lit(PROBE)), F.concat_ws(". ", category, non_empty(details))).otherwise(question)


def declines(answer: Column) -> Column:
    """Whether an answer holds the marker, in any case; an empty or missing one doesn't."""
    return F.coalesce(F.contains(F.lower(answer), F.lit(NO_ANSWER.lower())), F.lit(False))


def is_transient(message: Column) -> Column:
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.exists(F.array(*map(F.lit, TRANSIENT)), lambda m: F.contains(low, m))


def yes_no(answer: Column) -> Column:
    """True, false, or null for anything that starts with neither YES nor NO."""
    head = F.upper(strip(answer))
    return F.when(F.startswith(head, F.lit("YES")), True).when(F.startswith(head, F.lit("NO")), False)


def passage(embedding_text: Column, text: Column, size: int = 1400) -> Column:
    """What a reranker reads of a segment."""
    return F.substring(F.coalesce(non_empty(embedding_text), text, F.lit("")), 1, size)


def index_text(embedding_text: Column, text: Column, header: Column) -> Column:
    """What is indexed of a segment: its embedding text, else its text, else its header; null if all are blank."""
    return F.coalesce(*[let(strip(x), non_empty) for x in (embedding_text, text, header)])


def drawn(*parts: Column | str) -> Column:
    """A number of 60 bits drawn from the parts, the same in any engine: the first 15 hexadecimal digits of the MD5 of the parts joined by bars."""
    own = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in own])), 1, 15), 16, 10).cast("long")
