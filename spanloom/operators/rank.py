"""Retrieval: TF-IDF and vector rankings inside a contract, fusion, priors, reranking.

Every ranker takes questions and segments for any number of contracts and returns rows
``query_id, contract_id, start_char, end_char, rank`` (rank from 1, with its score beside it). All joins hash on the contract with
the term or alone, so a sweep over all questions is one job; a row-number filter cuts each ranking before the next shuffle.
Questions need ``query_id, contract_id, question``; segments ``contract_id, position, start_char, end_char, text``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import category_of, char_ngrams, clean_query, drawn, passage, stop_words, tokens, word_ngrams
from spanloom.operators.spans import overlap
from spanloom.operators.walk import Group, walked
from spanloom.sources.stage import staged

SPAN = ["start_char", "end_char"]
# Fusion constant and depth, prior, rerank depth, oversampling.
RRF, DEPTH = 60, 20
PRIOR_RATE, PRIOR_LEAD, PRIOR_ROWS = 0.6, 1, 20
RERANK_DEPTH, OVERSAMPLE = 20, 5
#: Pairs of question and passage in a batch of a scorer, and those of one contract more.
PAIRS = 256
#: Distances and model scores are compared at this many digits, which is coarser than what the order of summing changes.
DIGITS = 9
#: Inverse document frequencies are whole numbers in these units: products and sums of them are exact in any order.
UNIT = 10**9
#: Cells of a contract's table of segments by n-grams; larger ones are counted without a table.
DENSE_CELLS = 10_000_000
#: Records of a contract that one task compares at a time; distances this far apart are in order however they are summed.
BLOCK, SLACK = 4096, 5e-9
#: Lexical scores that differ by less than this are ties.
TIE = 1e-12


def terms_of(text: Column, ngrams: tuple[int, int] = (1, 1), analyzer: str = "word", stop: tuple[str, ...] | None = None) -> Column:
    """Terms of a text: word n-grams without stop words, or character n-grams within words."""
    if analyzer == "char_wb":
        return char_ngrams(text, *ngrams)
    return word_ngrams(tokens(text, stop_words() if stop is None else stop), *ngrams)


def smooth_idf(df: Column, n: Column) -> Column:
    return F.log((1 + n) / (1 + df)) + 1


def _idf(df: int, n: int) -> float:
    """``smooth_idf`` of two numbers."""
    return math.log((1 + n) / (1 + df)) + 1


def spaced(text: Column, analyzer: str = "word") -> Column:
    """A text as ``grams`` reads it: its words, or for character n-grams all that stands between white space, in lower case and one space apart."""
    if analyzer == "char_wb":
        return F.array_join(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != ""), " ")
    return F.array_join(tokens(text), " ")


def grams(text: str, ngrams: tuple[int, int], analyzer: str, stop: frozenset[str], known: dict[str, list[str]]) -> list[str]:
    """The terms of a ``spaced`` text, as ``terms_of`` has them. ``known`` keeps the n-grams of words, of 100,000 at most."""
    words, (low, high) = text.split(" ") if text else [], ngrams
    if analyzer == "char_wb":
        out: list[str] = []
        for w in words:
            own = known.get(w)
            if own is None:
                p = f" {w} "
                own = [p[i : i + n] for n in range(low, high + 1) for i in range(len(p) - n + 1)] if len(p) >= low else [p]
                if len(known) >= 100_000:
                    known.clear()
                known[w] = own
            out += own
        return out
    words = [w for w in words if w not in stop]
    if high == 1:
        return words
    out = list(words) if low == 1 else []
    for n in range(max(2, low), high + 1):
        out += map(" ".join, zip(*[words[i:] for i in range(n)], strict=False))
    return out


def _stop(stop: tuple[str, ...] | None) -> frozenset[str]:
    return frozenset(stop_words() if stop is None else stop)


def term_stats(segments: DataFrame, ngrams: tuple[int, int] = (1, 1), analyzer: str = "word", stop: tuple[str, ...] | None = None) -> DataFrame:
    """Rows ``contract_id, position, term, tf, df, n, first, length``: counts in the segment, segments of the contract with the term, segments of the contract.

    ``first`` marks the first row of a term in its contract; ``length`` is that of the segment's raw counts times smoothed idf. A contract is walked as
    a whole, so no term is shuffled.
    """
    own = _stop(stop)

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        known: dict[str, list[str]] = {}
        for (contract,), (rows,) in groups:
            n, counts = len(rows), {}
            for position, text in sorted(rows):
                counts.setdefault(position, Counter()).update(grams(text, ngrams, analyzer, own, known))
            df: Counter = Counter()
            for c in counts.values():
                df.update(c.keys())
            idf = {d: _idf(d, n) for d in set(df.values())}
            seen: set[str] = set()
            for position, c in counts.items():
                dfs = [df[t] for t in c]
                length = math.sqrt(math.fsum((f * idf[d]) ** 2 for f, d in zip(c.values(), dfs, strict=True)))
                m, first = len(c), [t not in seen for t in c]
                seen.update(c)
                yield [contract] * m, [position] * m, list(c), list(c.values()), dfs, [n] * m, first, [length] * m

    texts = segments.select("contract_id", "position", spaced(F.col("text"), analyzer).alias("words"))
    return walked([texts], ["contract_id"], run, "contract_id string, position int, term string, tf long, df long, n long, first boolean, length double")


def count_weights(rows: DataFrame, stop: tuple[str, ...] | None = None) -> DataFrame:
    """Rows ``id, term, weight`` of texts (``id, text``): counts of words, of length one for each id. The texts of an id are counted together, where they are."""
    own = _stop(stop)

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        for (key,), (texts,) in groups:
            counts = Counter(w for (text,) in texts for w in grams(text, (1, 1), "word", own, {}))
            length = math.sqrt(float(sum(c * c for c in counts.values())))
            yield [key] * len(counts), list(counts), [c / length for c in counts.values()]

    return walked([rows.select("id", spaced(F.col("text")).alias("words"))], ["id"], run, "id string, term string, weight double")


def tfidf_weights(stats: DataFrame) -> DataFrame:
    """Rows ``contract_id, position, term, weight``: raw counts times smoothed idf, of length one for each segment."""
    return stats.select("contract_id", "position", "term", (F.col("tf") * smooth_idf(F.col("df"), F.col("n")) / F.col("length")).alias("weight"))


@dataclass(frozen=True)
class Lexicon:
    """What a lexical ranking counts: word n-grams, or character n-grams of ``char_wb``; of the question as it is, or ``cleaned``."""

    ngrams: tuple[int, int] = (1, 1)
    analyzer: str = "word"
    cleaned: bool = False


def _ranked(segments: list[tuple], asked: list[tuple], k: int, terms: Callable[[str], list[str]]) -> Iterator[tuple]:
    """Rows query_id, start, end, score, rank of one contract. ``segments`` are (position, start, end, text), ``asked`` (query_id, text)."""
    n, counts = len(segments), {}
    for position, start, end, text in segments:
        counts.setdefault((position, start, end), Counter()).update(terms(text))
    df: Counter = Counter()
    for c in counts.values():
        df.update(c.keys())
    idf = {d: math.floor(_idf(d, n) * UNIT + 0.5) for d in set(df.values())}
    lengths: dict[int, int] = {}
    for (position, _, _), c in counts.items():
        # Terms of the same count and document frequency weigh the same.
        alike = Counter(zip(c.values(), map(df.__getitem__, c), strict=True))
        lengths[position] = lengths.get(position, 0) + sum(m * (f * idf[d]) ** 2 for (f, d), m in alike.items())
    last_first = sorted(counts, reverse=True) if df else sorted(counts)
    questions: dict[str, Counter] = {}
    for query, text in asked:
        questions.setdefault(query, Counter()).update(terms(text))
    for query, own in questions.items():
        weights = [(t, f * idf[df[t]], idf[df[t]]) for t, f in own.items() if t in df]
        length = math.sqrt(float(sum(w * w for _, w, _ in weights)))
        scored = []
        for place, c in counts.items():
            both = sum(w * c[t] * u for t, w, u in weights if t in c)
            if both:
                score = float(both) / (length * math.sqrt(float(lengths[place[0]])))
                scored.append((math.floor(score / TIE + 0.5), place, score))
        yield from _first(query, scored, last_first, k)


def _first(query: str, scored: list[tuple], last_first: list[tuple], k: int) -> Iterator[tuple]:
    """The first ``k`` rows of a question: by level and position, the latest first, then the places that share no term with it."""
    scored.sort(reverse=True)
    found = {place for _, place, _ in scored}
    rows = [(place, score) for _, place, score in scored[:k]]
    if len(rows) < k:
        rows += [(place, 0.0) for place in last_first if place not in found][: k - len(rows)]
    for at, ((_, start, end), score) in enumerate(rows, 1):
        yield query, start, end, score, at


class _CharTerms:
    """Character n-grams as numbers. A word is cut once, and its numbers are kept; between contracts all are forgotten beyond 400,000 n-grams."""

    def __init__(self, ngrams: tuple[int, int]) -> None:
        self.ngrams = ngrams
        self.forget()

    def forget(self) -> None:
        self.number, self.words, self.known = {}, {}, {}
        self.slot = np.full(1 << 16, -1, dtype=np.int64)

    def of(self, text: str) -> list[np.ndarray]:
        out = []
        for w in text.split(" ") if text else ():
            own = self.words.get(w)
            if own is None:
                number = self.number
                own = self.words[w] = np.array([number.setdefault(g, len(number)) for g in grams(w, self.ngrams, "char_wb", frozenset(), {})], dtype=np.int64)
            out.append(own)
        return out

    def ranked(self, segments: list[tuple], asked: list[tuple], k: int) -> Iterator[tuple]:
        """The rows of ``_ranked``, from a table of segments by n-grams. Sums are grouped by document frequency and stay whole numbers of any size."""
        if len(self.number) > 400_000:
            self.forget()
        n, parts = len(segments), {}
        for position, start, end, text in segments:
            parts.setdefault((position, start, end), []).extend(self.of(text))
        questions: dict[str, list[np.ndarray]] = {}
        for query, text in asked:
            questions.setdefault(query, []).extend(self.of(text))
        none = np.zeros(0, dtype=np.int64)
        places, own = list(parts), [np.concatenate(p) if p else none for p in parts.values()]
        flat = np.concatenate([none, *own])
        if len(self.slot) < len(self.number):
            self.slot = np.full(2 * len(self.number), -1, dtype=np.int64)
        # One place of each n-gram stands for it.
        self.slot[flat] = np.arange(len(flat))
        one = self.slot[flat]
        chosen = one == np.arange(len(flat))
        vocabulary = flat[chosen]
        if len(places) * len(vocabulary) > DENSE_CELLS:
            self.slot[vocabulary] = -1
            yield from _ranked(segments, asked, k, partial(grams, ngrams=self.ngrams, analyzer="char_wb", stop=frozenset(), known=self.known))
            return
        here = (np.cumsum(chosen) - 1)[one]
        self.slot[vocabulary] = np.arange(len(vocabulary))
        tf = np.bincount(np.repeat(np.arange(len(own)), [len(x) for x in own]) * len(vocabulary) + here, minlength=len(own) * len(vocabulary)).reshape(len(own), len(vocabulary))
        df = (tf > 0).sum(axis=0)
        idf2 = [0, *(math.floor(_idf(d, n) * UNIT + 0.5) ** 2 for d in range(1, len(own) + 1))]
        by_position: dict[int, int] = {}
        for place, counts in zip(places, tf, strict=True):
            at = np.flatnonzero(counts)
            alike = np.bincount(df[at], weights=counts[at] * counts[at], minlength=1).tolist()
            by_position[place[0]] = by_position.get(place[0], 0) + sum(int(m) * u for m, u in zip(alike, idf2, strict=False) if m)
        lengths = [math.sqrt(float(by_position[place[0]])) for place in places]
        last_first = sorted(places, reverse=len(vocabulary) > 0)
        for query, terms in questions.items():
            at = self.slot[np.concatenate([none, *terms])]
            weight = np.bincount(at[at >= 0], minlength=len(vocabulary))
            at = np.flatnonzero(weight)
            scored = []
            if len(at):
                at = at[np.argsort(df[at], kind="stable")]
                dfs = df[at]
                starts = np.flatnonzero(np.diff(dfs, prepend=-1))
                units = [idf2[d] for d in dfs[starts].tolist()]
                length = math.sqrt(float(sum(m * u for m, u in zip(np.add.reduceat(weight[at] * weight[at], starts).tolist(), units, strict=True))))
                for place, own_length, sums in zip(places, lengths, np.add.reduceat(tf[:, at] * weight[at], starts, axis=1).tolist(), strict=True):
                    both = sum(m * u for m, u in zip(sums, units, strict=True) if m)
                    if both:
                        score = float(both) / (length * own_length)
                        scored.append((math.floor(score / TIE + 0.5), place, score))
            yield from _first(query, scored, last_first, k)
        self.slot[vocabulary] = -1


def lexicals(questions: DataFrame, segments: DataFrame, k: int, kinds: dict[str, Lexicon], stop: tuple[str, ...] | None = None) -> DataFrame:
    """Several TF-IDF rankings of the same questions, with the name of each in ``kind``, in one walk over contracts.

    Fitted for each contract; ties, zeros among them, go to later segments; a contract without any term keeps its order. Terms of the question that the
    contract lacks go before its length is made one. Sums are of whole numbers, so neither partitions nor their order change a score. Texts and
    questions move once, to the task that has the contract; terms never leave it.
    """
    analyzers = sorted({x.analyzer for x in kinds.values()})
    own, todo = _stop(stop), [(name, x, analyzers.index(x.analyzer), i) for i, (name, x) in enumerate(kinds.items())]

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        chars = {name: _CharTerms(x.ngrams) for name, x, *_ in todo if x.analyzer == "char_wb"}
        for (contract,), (segs, asked) in groups:
            rows: list[tuple] = []
            if segs and asked:
                for name, x, text, question in todo:
                    mine, wanted = [(*s[:3], s[3 + text]) for s in segs], [(a[0], a[1 + question]) for a in asked]
                    if name in chars:
                        ranked = chars[name].ranked(mine, wanted, k)
                    else:
                        ranked = _ranked(mine, wanted, k, partial(grams, ngrams=x.ngrams, analyzer=x.analyzer, stop=own, known={}))
                    rows += [(name, query, contract, *r) for query, *r in ranked]
            if rows:
                yield tuple(zip(*rows, strict=True))

    texts = segments.select("contract_id", "position", *SPAN, *[spaced(F.col("text"), a).alias(f"w{i}") for i, a in enumerate(analyzers)])
    asked = questions.select("contract_id", "query_id", *[spaced(clean_query(F.col("question")) if x.cleaned else F.col("question"), x.analyzer).alias(f"q{i}") for i, x in enumerate(kinds.values())])
    return walked([texts, asked], ["contract_id"], run, "kind string, query_id string, contract_id string, start_char int, end_char int, score double, rank int")


def lexical(questions: DataFrame, segments: DataFrame, k: int, ngrams: tuple[int, int] = (1, 1), analyzer: str = "word", stop: tuple[str, ...] | None = None) -> DataFrame:
    """One ranking of ``lexicals``."""
    return lexicals(questions, segments, k, {"": Lexicon(ngrams, analyzer)}, stop).drop("kind")


def dense(query_vectors: DataFrame, records: DataFrame, k: int, oversample: int | None = None) -> DataFrame:
    """Vector ranking inside the contract: the best record of each distinct span counts, then the first ``k`` spans.

    ``query_vectors``: query_id, contract_id, vector; ``records``: contract_id, record_id, start_char, end_char, vector (length one).
    Exact by default; with ``oversample`` only that many times k records are looked at, as an index with a capped answer would.

    A contract of many records is dealt in blocks, each of which meets all questions of its contract, a few at a time; what leaves a block are the
    records that can be among the first ones, so memory is bounded and no pair is shuffled.
    """
    large = records.groupBy("contract_id").agg(F.count("*").alias("__n")).where(F.col("__n") > BLOCK).select("contract_id", F.ceil(F.col("__n") / BLOCK).cast("int").alias("__blocks"))
    # At most one row in BLOCK records.
    large = F.broadcast(staged(large, "blocks"))
    blocks = F.coalesce("__blocks", F.lit(1))
    dealt = records.join(large, "contract_id", "left").select("contract_id", F.pmod(F.xxhash64("record_id"), blocks).cast("int").alias("block"), "record_id", *SPAN, "vector")
    asked = query_vectors.join(large, "contract_id", "left").select("contract_id", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "query_id", "vector")
    most = oversample * k if oversample else None

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        for (contract, _), (own, questions) in groups:
            for at in range(0, len(questions) if own else 0, 256):
                for rows in _nearest(own, questions[at : at + 256], k, most):
                    yield [contract] * len(rows[0]), *rows

    kind = dict(records.dtypes)["record_id"]
    rows = walked([dealt, asked], ["contract_id", "block"], run, f"contract_id string, query_id string, record_id {kind}, start_char int, end_char int, distance double")
    rows = rows.withColumn("distance", F.round("distance", DIGITS)).repartition("query_id", "contract_id")
    if oversample:
        seen = Window.partitionBy("query_id", "contract_id").orderBy("distance", "record_id")
        rows = rows.withColumn("__r", F.row_number().over(seen)).where(F.col("__r") <= oversample * k)
    spans = rows.groupBy("query_id", "contract_id", *SPAN).agg(F.min(F.struct("distance", "record_id")).alias("best"))
    order = Window.partitionBy("query_id", "contract_id").orderBy("best.distance", "best.record_id")
    return spans.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "contract_id", *SPAN, F.col("best.distance").alias("distance"), "rank")


def _rounded(x: float) -> Decimal:
    return Decimal(repr(x)).quantize(Decimal(1).scaleb(-DIGITS), ROUND_HALF_UP)


def _nearest(records: list[tuple], questions: list[tuple], k: int, most: int | None) -> Iterator[tuple]:
    """Columns query, record, start, end, distance of what a block has for each question: the first ``most`` records, or the best one of the first ``k`` spans.

    A product of matrices finds those that are near enough, give or take what the order of summing changes; their distances are then summed one
    number after the other, as ``dot`` does.
    """
    sizes = Counter(len(r[3]) for r in records if r[3] is not None)
    for size in sizes:
        own = [r for r in records if r[3] is not None and len(r[3]) == size and None not in r[3]]
        asked = [q for q in questions if q[1] is not None and len(q[1]) == size and None not in q[1]]
        if not own or not asked:
            continue
        have, want = np.array([r[3] for r in own], dtype=np.float64), np.array([q[1] for q in asked], dtype=np.float64)
        spans: dict[tuple, int] = {}
        of_span = np.array([spans.setdefault((r[1], r[2]), len(spans)) for r in own])
        keep = np.ones((len(asked), len(own)), dtype=bool)
        if (most or k) < len(own if most else spans):
            near = 1 - want @ have.T
            if most:
                least = np.partition(near, most - 1, axis=1)[:, most - 1]
            else:
                by_span = np.argsort(of_span, kind="stable")
                starts = np.searchsorted(of_span[by_span], np.arange(len(spans)))
                least = np.partition(np.minimum.reduceat(near[:, by_span], starts, axis=1), k - 1, axis=1)[:, k - 1]
            # Also what is no number stays, as the plain sum decides about it.
            keep = ~(near > (least + SLACK)[:, None])
        for (query, _), vector, mine in zip(asked, want, keep, strict=True):
            at = np.flatnonzero(mine)
            distance = (1 - np.add.accumulate(have[at] * vector, axis=1)[:, -1]).tolist() if size else [1.0] * len(at)
            rows = [(*own[i][:3], d) for i, d in zip(at.tolist(), distance, strict=True)]
            if len(rows) > (most or k):
                digits = {d: _rounded(d) if math.isfinite(d) else Decimal("Infinity") for d in set(distance)}
                rows.sort(key=lambda r: (digits[r[3]], r[0]))
                if most:
                    rows = rows[:most]
                else:
                    first: dict[tuple, tuple] = {}
                    for r in rows:
                        if first.setdefault(r[1:3], r) is r and len(first) == k:
                            break
                    rows = list(first.values())
            if rows:
                yield [query] * len(rows), *zip(*rows, strict=True)


def fuse(rankings: list[tuple[DataFrame, float]], k: int, depth: int = DEPTH) -> DataFrame:
    """Reciprocal rank fusion of (ranking, weight) pairs; the first one is the lexical one, which breaks ties, then the order of first sight.

    A ranking of weight 0 is left out; of each the first ``depth`` ranks count; a span that a ranking repeats counts each time.
    """
    parts = [
        r.where(F.col("rank") <= depth).select("query_id", "contract_id", *SPAN, F.col("rank"), F.lit(i).alias("source"), (F.lit(float(w)) / (RRF + F.col("rank"))).alias("part"))
        for i, (r, w) in enumerate(rankings)
        if w
    ]
    if not parts:
        raise ValueError("all weights are 0")
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    lexical_rank = F.min(F.when(F.col("source") == 0, F.col("rank")))
    # Dealt by the question, rows need not move again to be ordered.
    fused = rows.repartition("query_id", "contract_id").groupBy("query_id", "contract_id", *SPAN).agg(
        F.round(F.sum("part"), 12).alias("score"), lexical_rank.alias("lexical_rank"), F.min(F.struct("source", "rank")).alias("seen")
    )
    order = Window.partitionBy("query_id", "contract_id").orderBy(F.desc("score"), F.asc_nulls_last("lexical_rank"), "seen")
    return fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "contract_id", *SPAN, "score", "rank")


def random_ranking(questions: DataFrame, segments: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``k`` segments of the contract without replacement, drawn by a hash of seed, question and span: the same on any cluster."""
    pairs = questions.select("query_id", "contract_id").join(segments.select("contract_id", *SPAN), "contract_id")
    order = Window.partitionBy("query_id", "contract_id").orderBy(drawn(F.lit(seed), F.col("query_id"), *map(F.col, SPAN)), *SPAN)
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.lit(0.0)).select("query_id", "contract_id", *SPAN, "score", "rank")


def lead_rates(eval_rows: DataFrame, segments: DataFrame, n_lead: int = PRIOR_LEAD) -> DataFrame:
    """Rows ``category, n, rate``: scored rows of a category, and the share whose gold the first ``n_lead`` segments touch.

    The category is the one that the question names; rows whose question names none, or without gold, don't count.
    """
    rows = eval_rows.where("has_gold_span").withColumn("category", category_of(F.col("question"))).where("category is not null").select("contract_id", "category", "question", "gold_spans")
    leads = segments.where(F.col("position") < n_lead).groupBy("contract_id").agg(F.collect_list(F.struct("start_char", "end_char")).alias("leads"))
    hit = F.exists("leads", lambda s: F.exists("gold_spans", lambda g: overlap(s["start_char"], s["end_char"], g["start"], g["end"]) > 0))
    joined = rows.join(leads, "contract_id", "left").withColumn("hit", F.coalesce(hit, F.lit(False)).cast("int"))
    return joined.groupBy("category").agg(F.count("*").alias("n"), F.avg("hit").alias("rate"))


def fit_prior(eval_rows: DataFrame, segments: DataFrame, rate: float = PRIOR_RATE, n_lead: int = PRIOR_LEAD, min_rows: int = PRIOR_ROWS) -> DataFrame:
    """Rows ``category, n_lead`` of the categories whose answers open the document often enough; fit it on training rows."""
    rates = lead_rates(eval_rows, segments, n_lead)
    return rates.where((F.col("n") >= min_rows) & (F.col("rate") >= rate)).select("category", F.lit(n_lead).alias("n_lead"))


def with_prior(ranking: DataFrame, questions: DataFrame, segments: DataFrame, prior: DataFrame, k: int) -> DataFrame:
    """The lead segments before the ranking for questions of a fitted category, each span once, then the first ``k``; others as they are.

    ``prior`` has a row a category, a few dozen at most, so it is joined on the category that the question names.
    """
    asked = questions.select("query_id", "contract_id", category_of(F.col("question")).alias("category")).join(prior, "category")
    leads = asked.join(segments.select("contract_id", "position", *SPAN), "contract_id").where(F.col("position") < F.col("n_lead"))
    first = leads.select("query_id", "contract_id", *SPAN, F.lit(0).alias("part"), F.col("position").alias("at"))
    rest = ranking.select("query_id", "contract_id", *SPAN, F.lit(1).alias("part"), F.col("rank").alias("at"))
    best = first.unionByName(rest).repartition("query_id", "contract_id").groupBy("query_id", "contract_id", *SPAN).agg(F.min(F.struct("part", "at")).alias("best"))
    order = Window.partitionBy("query_id", "contract_id").orderBy("best")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).withColumn("score", F.lit(None).cast("double")).select("query_id", "contract_id", *SPAN, "score", "rank")


def attach_segments(ranking: DataFrame, segments: DataFrame) -> DataFrame:
    """Ranked spans with header and texts of their segment; of segments with the same span the last one counts, a miss has the empty text.

    Segments and ranked spans move once, to the task that has the contract.
    """
    texts, own = ["header", "text", "embedding_text"], [c for c in ranking.columns if c != "contract_id"]
    span = [own.index(c) for c in SPAN]

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        for (contract,), (segs, ranked) in groups:
            last = _last_of_span(segs) if ranked else {}
            for row in ranked:
                header, text, embedding = last.get((row[span[0]], row[span[1]]), (None, None, None))
                yield tuple([x] for x in (contract, *row, header or "", text or "", embedding))

    kinds = dict(ranking.dtypes)
    schema = ", ".join([f"contract_id {kinds['contract_id']}", *[f"`{c}` {kinds[c]}" for c in own], *[f"{c} string" for c in texts]])
    out = walked([segments.select("contract_id", "position", *SPAN, *texts), ranking], ["contract_id"], run, schema)
    return out.select(*ranking.columns, *texts)


def _last_of_span(segments: list[tuple]) -> dict[tuple[int, int], tuple]:
    """What comes behind (position, start, end), by span; of equal spans that of the last position."""
    return {(start, end): rest for _, start, end, *rest in sorted(segments, key=lambda s: s[0])}


def overlap_scorer(questions: pd.Series, passages: pd.Series) -> pd.Series:
    """A scorer that needs no model: the share of the question's words that the passage holds."""
    out = []
    for q, p in zip(questions, passages, strict=True):
        words = set(q.lower().split())
        out.append(len(words & set(p.lower().split())) / max(1, len(words)))
    return pd.Series(out, dtype="float64")


def rerank(ranking: DataFrame, questions: DataFrame, segments: DataFrame, k: int, scorer: Callable[[pd.Series, pd.Series], pd.Series] = overlap_scorer, depth: int = RERANK_DEPTH) -> DataFrame:
    """The first ``depth`` spans in the order of a pair scorer (batches of question and passage in, scores out), then the first ``k``.

    Equal scores keep the order of the ranking. A cross-encoder is such a scorer; it runs once a batch, in the Python worker. Texts move once, to the
    task that has the contract; what a question finds there is read there.
    """

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        held: list[tuple] = []
        for (contract,), (segs, ranked, asked) in groups:
            last, questions = _last_of_span(segs) if ranked else {}, dict(asked)
            held += [(query, contract, start, end, at, questions[query], (last.get((start, end)) or ("",))[0]) for query, start, end, at in ranked if query in questions]
            if len(held) >= PAIRS:
                yield scores(held)
                held = []
        if held:
            yield scores(held)

    def scores(rows: list[tuple]) -> tuple:
        *columns, question, text = zip(*rows, strict=True)
        found = scorer(pd.Series(question, dtype="object"), pd.Series(text, dtype="object"))
        return *columns, [None if x is None or x != x else float(x) for x in found]

    texts = segments.select("contract_id", "position", *SPAN, passage(F.col("embedding_text"), F.col("text")).alias("passage"))
    parts = [texts, ranking.where(F.col("rank") <= depth).select("contract_id", "query_id", *SPAN, "rank"), questions.select("contract_id", "query_id", "question")]
    rows = walked(parts, ["contract_id"], run, "query_id string, contract_id string, start_char int, end_char int, rank int, new_score double")
    rows = rows.withColumn("new_score", F.round("new_score", DIGITS))
    order = Window.partitionBy("query_id", "contract_id").orderBy(F.desc("new_score"), F.col("rank"))
    return rows.withColumn("new_rank", F.row_number().over(order)).where(F.col("new_rank") <= k).select("query_id", "contract_id", *SPAN, F.col("new_score").alias("score"), F.col("new_rank").alias("rank"))


Retriever = Callable[[DataFrame, DataFrame, int], DataFrame]


def variants(
    dense_of: Callable[[DataFrame, DataFrame, int, bool], DataFrame] | None = None,
    prior: DataFrame | None = None,
    scorer: Callable[[pd.Series, pd.Series], pd.Series] = overlap_scorer,
    stop: tuple[str, ...] | None = None,
    together: bool = False,
) -> dict[str, Retriever]:
    """Thirteen named stacks as functions of (questions, segments, k).

    ``dense_of(questions, segments, k, windowed)`` ranks by vectors; ``prior`` comes from ``fit_prior``. Stacks that lack what they need
    raise a ValueError when they are run. Cleaning of the question lies below the prior, which reads the original; reranking lies inside it.

    What several stacks rank by is made once for the same questions and segments, and staged; with ``together`` all lexical rankings are made in one walk.
    """
    made: dict[tuple, tuple] = {}
    plain: dict[int, DataFrame] = {}
    lexicons = {1: Lexicon(), 2: Lexicon((1, 2)), "chars": Lexicon((3, 5), "char_wb")}

    def once(name, q: DataFrame, s: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:  # noqa: ANN001
        # Questions and segments are kept beside the ranking: as long as they are, no other table has their ids.
        key = (name, id(q), id(s))
        if key not in made:
            made[key] = (staged(make(), "ranked"), q, s)
        return made[key][0]

    def deep(name, q: DataFrame, s: DataFrame, k: int, make: Callable[[int], DataFrame]) -> DataFrame:  # noqa: ANN001
        """The first ``k`` ranks of a ranking that is as deep as any stack asks for."""
        depth = max(k, DEPTH, RERANK_DEPTH)
        return once((name, depth), q, s, lambda: make(depth)).where(F.col("rank") <= k)

    def lexicon(n, q: DataFrame, s: DataFrame, k: int) -> DataFrame:  # noqa: ANN001
        if not together:
            return deep(("lexical", n), q, s, k, lambda depth: lexicals(q, s, depth, {"": lexicons[n]}, stop if n != "chars" else None).drop("kind"))
        own = plain.get(id(q), q)
        kinds = {str(m): x for m, x in lexicons.items()} | {"cleaned 2": Lexicon((1, 2), cleaned=True)}
        name = str(n) if own is q else f"cleaned {n}"
        kinds.setdefault(name, replace(lexicons[n], cleaned=True))
        return deep(("lexical", tuple(kinds)), own, s, k, lambda depth: lexicals(own, s, depth, kinds, stop)).where(F.col("kind") == name).drop("kind")

    def words(n: int) -> Retriever:
        return lambda q, s, k: lexicon(n, q, s, k)

    def vectors(windowed: bool) -> Retriever:
        def run(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
            if dense_of is None:
                raise ValueError("this variant needs a vector ranking")
            return once(("dense", windowed, k), q, s, lambda: dense_of(q, s, k, windowed))

        return run

    def hybrid(n: int, chars: float = 0.0) -> Retriever:
        def run(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
            def make(depth: int) -> DataFrame:
                parts = [(words(n)(q, s, DEPTH), 1.0), (vectors(True)(q, s, DEPTH), 1.0)]
                if chars:
                    parts.append((lexicon("chars", q, s, DEPTH), chars))
                return fuse(parts, depth)

            return deep(("hybrid", n, chars), q, s, k, make)

        return run

    def primed(base: Retriever) -> Retriever:
        def run(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
            if prior is None:
                raise ValueError("this variant needs a fitted prior")
            return with_prior(base(q, s, k + PRIOR_LEAD), q, s, prior, k)

        return run

    def cleaned(base: Retriever) -> Retriever:
        def run(q: DataFrame, s: DataFrame, k: int) -> DataFrame:
            key = ("cleaned", id(q))
            if key not in made:
                made[key] = (q.withColumn("question", clean_query(F.col("question"))), q)
                plain[id(made[key][0])] = q
            return base(made[key][0], s, k)

        return run

    def reranked(base: Retriever) -> Retriever:
        return lambda q, s, k: deep(("reranked", base), q, s, k, lambda depth: rerank(base(q, s, RERANK_DEPTH), q, s, depth, scorer))

    bigram = hybrid(2)
    second = reranked(bigram)
    return {
        "tfidf": words(1),
        "tfidf_bigram": words(2),
        "dense": vectors(False),
        "dense_win": vectors(True),
        "hybrid": hybrid(1),
        "hybrid_bigram": bigram,
        "tfidf_bigram_prior": primed(words(2)),
        "hybrid_bigram_prior": primed(bigram),
        "hybrid_char_prior": primed(hybrid(2, chars=1.0)),
        "hybrid_bigram_rerank": second,
        "hybrid_bigram_prior_rerank": primed(second),
        "hybrid_bigram_prior_cleanq": primed(cleaned(bigram)),
        "hybrid_bigram_prior_cleanq_rerank": primed(cleaned(second)),
    }


DEFAULT_VARIANT = "hybrid_bigram_prior_cleanq"
