"""Answers and verdicts: prompts, backends that never raise, judging, run logs, summaries."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from importlib import import_module

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import NO_ANSWER, TRANSIENT, declines, drawn, is_transient, strip, yes_no
from spanloom.operators.metrics import ratio, score_rows
from spanloom.operators.rank import attach_segments
from spanloom.operators.walk import Group, walked
from spanloom.schemas import CHUNK, RUN_LOG, RUN_LOG_VERSION, struct

# Labels; the first three are verdicts on a claim and make up the denominator of the faithful rate.
SUPPORTED, PARTIAL, UNSUPPORTED = "SUPPORTED", "PARTIALLY_SUPPORTED", "UNSUPPORTED"
ABSTAINED, UNPARSEABLE, NOT_JUDGED = "ABSTAINED", "UNPARSEABLE", "NOT_JUDGED"
SCORED = (SUPPORTED, PARTIAL, UNSUPPORTED)
LABELS = (*SCORED, ABSTAINED, UNPARSEABLE, NOT_JUDGED)
# Settings of generators and judges.
TEMPERATURE, MAX_TOKENS, JUDGE_MAX_TOKENS = 0.0, 512, 2048
RETRIES, RETRY_DELAY = 4, 2.0
EARLY_STOP = 5
GOLD_ROWS, ABSENT_ROWS, SAMPLE_SEED = 60, 20, 42
CLOUD, LOCAL = ("gemini", "groq"), ("ollama",)
#: Rules for the answering model: excerpts alone, three sentences, or the marker.
ANSWER_RULES = f"Answer from the contract excerpts below and nothing else, in three sentences at most, with their own words where you can. If they don't hold the answer, reply {NO_ANSWER} and no more."
#: Rules for the judging model: one label on the first line, one sentence on the second.
JUDGE_RULES = f"Say whether each claim of the answer stands in the excerpts; whether it is right or useful doesn't matter. First line: {SUPPORTED}, {PARTIAL} (the main claim does, some detail doesn't) or {UNSUPPORTED}. Second line: one sentence with your reason."


def _ruled(title: str) -> str:
    return f"{title}\n{'-' * len(title)}\n"


def excerpts(chunks: Column) -> Column:
    """Numbered excerpts: ``[i] header (chars s-e)``, the text below, a blank line between; a note if there are none."""

    def one(c: Column, i: Column) -> Column:
        head = strip(F.coalesce(c["header"], F.lit("")))
        label = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"), F.when(head != "", F.concat(F.lit(" "), head)).otherwise(F.lit("")))
        span = F.concat(F.lit(" (chars "), c["start_char"].cast("string"), F.lit("-"), c["end_char"].cast("string"), F.lit(")\n"))
        return F.concat(label, span, strip(F.coalesce(c["text"], F.lit(""))))

    return F.when(F.coalesce(F.size(chunks), F.lit(0)) <= 0, F.lit("(no excerpts retrieved)")).otherwise(F.array_join(F.transform(chunks, one), "\n\n"))


def answer_prompt(question: Column, chunks: Column) -> Column:
    return F.concat(F.lit(_ruled("CONTRACT EXCERPTS")), excerpts(chunks), F.lit("\n\n" + _ruled("QUESTION")), strip(question), F.lit("\n\nAnswer using only the excerpts above."))


def judge_prompt(question: Column, chunks: Column, answer: Column) -> Column:
    return F.concat(
        F.lit(_ruled("CONTRACT EXCERPTS")), excerpts(chunks), F.lit("\n\n" + _ruled("QUESTION")), strip(question),
        F.lit("\n\n" + _ruled("ANSWER TO GRADE")), strip(answer), F.lit("\n\nLabel this answer."),
    )


def chunks_of(attached: DataFrame) -> DataFrame:
    """Rows ``query_id, retrieved, chunks``: spans and excerpts of each question in the order of rank."""
    item = F.struct("rank", "header", "start_char", "end_char", "text")
    rows = attached.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("__c"))
    chunks = F.transform("__c", lambda c: F.struct(c["header"].alias("header"), c["start_char"].alias("start_char"), c["end_char"].alias("end_char"), c["text"].alias("text")))
    spans = F.transform("__c", lambda c: F.struct(c["start_char"].alias("start"), c["end_char"].alias("end")))
    return rows.select("query_id", spans.alias("retrieved"), chunks.alias("chunks"))


def chunks_for(questions: DataFrame, ranking: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows ``query_id, question, chunks`` of the questions that the ranking has: what ``chunks_of`` gives, beside its question.

    A contract's texts move once and are put together where they are, so what is shuffled doesn't grow with the number of excerpts.
    """

    def run(groups: Iterator[Group]) -> Iterator[tuple]:
        for _, (segs, ranked, asked) in groups:
            last, found = {(start, end): rest for _, start, end, *rest in sorted(segs, key=lambda s: s[0])} if ranked else {}, {}
            for query, *place in sorted(ranked, key=lambda r: r[1]):
                found.setdefault(query, []).append(place[1:])
            for query, question in asked:
                if query in found:
                    own = [(start, end, *last.get((start, end), (None, None))) for start, end in found[query]]
                    yield [query], [question], [[{"header": header or "", "start_char": start, "end_char": end, "text": text or ""} for start, end, header, text in own]]

    span = ["start_char", "end_char"]
    parts = [segments.select("contract_id", "position", *span, "header", "text"), ranking.select("contract_id", "query_id", "rank", *span), questions.select("contract_id", "query_id", "question")]
    return walked(parts, ["contract_id"], run, f"query_id string, question string, chunks array<{CHUNK}>")


@dataclass
class Backend:
    """A model behind a name. ``call(prompt, system)`` returns its text or raises; ``generate`` never raises."""

    name: str
    model: str
    call: Callable[[str, str | None], str]
    temperature: float = TEMPERATURE
    max_tokens: int = MAX_TOKENS
    retries: int = RETRIES
    delay: float = RETRY_DELAY
    extra: dict = field(default_factory=dict)

    @property
    def identity(self) -> str:
        return f"{self.name}:{self.model}"

    @property
    def is_cloud(self) -> bool:
        return self.name in CLOUD

    def generate(self, prompt: str, system: str | None = None) -> dict:
        """Text or error with provenance; errors that go away by themselves are tried again, each time after twice the wait."""
        began, error, text = time.monotonic(), None, ""
        for attempt in range(self.retries + 1):
            try:
                text, error = self.call(prompt, system) or "", None
                break
            except Exception as e:  # whatever a client raises becomes a row
                error = f"{type(e).__name__}: {e}"
                if attempt == self.retries or not any(m in error.lower() for m in TRANSIENT):
                    break
                time.sleep(self.delay * 2**attempt)
        return {"text": text.strip(), "latency_ms": int(1000 * (time.monotonic() - began)), "error": error}


_CLIENTS: dict[str, tuple[str, Callable[..., Callable[[str, str | None], str]]]] = {}


def register_backend(name: str, default_model: str, client: Callable[..., Callable[[str, str | None], str]]) -> None:
    """Make a backend known: ``client(model, temperature, max_tokens, **extra)`` returns its call."""
    _CLIENTS[name] = (default_model, client)


def build_backend(name: str, model: str | None = None, temperature: float = TEMPERATURE, max_tokens: int = MAX_TOKENS, extra: dict | None = None, **settings) -> Backend:  # noqa: ANN003
    """A registered backend (``spanloom.operators.clients`` registers three and is imported if need be); a ValueError names those that are known."""
    if name not in _CLIENTS:
        import_module("spanloom.operators.clients")
    if name not in _CLIENTS:
        raise ValueError(f"unknown backend {name!r}; known: {sorted(_CLIENTS)}")
    default, client = _CLIENTS[name]
    call = client(model or default, temperature, max_tokens, **(extra or {}))
    return Backend(name, model or default, call, temperature, max_tokens, extra=extra or {}, **settings)


def default_judge() -> Backend:
    return build_backend("gemini", max_tokens=JUDGE_MAX_TOKENS)


def second_judge() -> Backend:
    """For the spread between judges: another vendor, little reasoning."""
    return build_backend("groq", max_tokens=JUDGE_MAX_TOKENS, extra={"reasoning_effort": "low"})


GENERATION = "struct<text:string,latency_ms:int,error:string>"


def _called(backend: Backend, system: str) -> Callable[[Column], Column]:
    @F.pandas_udf(GENERATION)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for prompts in batches:
            yield pd.DataFrame([backend.generate(p, system) if p is not None else {"text": "", "latency_ms": 0, "error": None} for p in prompts], columns=["text", "latency_ms", "error"])

    return run


def generate_interactive(rows: DataFrame, model: str | None = None) -> DataFrame:
    """Answers by the local backend; a user's question never leaves the machine, so there is no backend to choose."""
    return _generated(rows, build_backend(LOCAL[0], model))


def generate_for_eval(rows: DataFrame, backend: Backend) -> DataFrame:
    """Answers by the given backend."""
    return _generated(rows, backend)


def _generated(rows: DataFrame, backend: Backend) -> DataFrame:
    out = rows.withColumn("prompt", answer_prompt(F.col("question"), F.col("chunks"))).withColumn("__g", _called(backend, ANSWER_RULES)("prompt"))
    return out.select(
        *[c for c in out.columns if c != "__g"],
        F.col("__g.text").alias("answer"),
        declines(F.col("__g.text")).alias("abstained"),
        F.lit(backend.name).alias("generator_backend"),
        F.lit(backend.model).alias("generator_model"),
        F.lit(backend.temperature).alias("generator_temperature"),
        F.col("__g.latency_ms").alias("generation_latency_ms"),
        F.col("__g.error").alias("generation_error"),
    )


def verdict(reply: Column) -> Column:
    """Struct of label and rationale from a judge's reply: reasoning blocks go, the first line that isn't blank holds the label."""
    body = F.regexp_replace(F.coalesce(reply, F.lit("")), r"(?is)<think>.*?</think>", "")
    lines = F.filter(F.transform(F.split(body, r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"), strip), lambda x: x != "")
    head = F.upper(F.get(lines, F.lit(0)))
    label = F.lit(UNPARSEABLE)
    for name in (SUPPORTED, UNSUPPORTED, PARTIAL):
        label = F.when(F.rlike(head, F.lit(rf"(?U)\b{name}\b")), F.lit(name)).otherwise(label)
    reason = F.when(label != UNPARSEABLE, F.coalesce(F.get(lines, F.lit(1)), F.lit(""))).otherwise(F.coalesce(F.substring(F.get(lines, F.lit(0)), 1, 200), F.lit("")))
    return F.struct(label.alias("label"), reason.alias("rationale"))


def judged(rows: DataFrame, judge: Backend) -> DataFrame:
    """``rows`` with the verdict of a cloud judge that isn't their generator; answers that decline are labelled without a call.

    A call that failed for a while gives NOT_JUDGED, any other failure UNPARSEABLE. Breaking a rule fails the query.
    """
    if not judge.is_cloud:
        raise ValueError("the judge must be a cloud backend")
    identity = F.concat_ws(":", "generator_backend", "generator_model")
    same = F.assert_true(~identity.eqNullSafe(F.lit(judge.identity)), F.lit("a model may not judge its own answers"))
    prompt = F.when(~F.col("abstained"), judge_prompt(F.col("question"), F.col("chunks"), F.col("answer")))
    out = rows.where(same.isNull()).withColumn("__v", _called(judge, JUDGE_RULES)(prompt)).withColumn("__p", verdict(F.col("__v.text")))
    failed = F.col("__v.error").isNotNull()
    label = F.when(F.col("abstained"), F.lit(ABSTAINED)).when(failed & is_transient(F.col("__v.error")), F.lit(NOT_JUDGED)).when(failed, F.lit(UNPARSEABLE)).otherwise(F.col("__p.label"))
    drop = {"judge_label", "judge_rationale", "judge_backend", "judge_model", "judge_latency_ms", "judge_error"}
    return out.select(
        *[c for c in rows.columns if c not in drop],
        label.alias("judge_label"),
        F.when(F.col("abstained") | failed, F.lit("")).otherwise(F.col("__p.rationale")).alias("judge_rationale"),
        F.lit(judge.name).alias("judge_backend"),
        F.lit(judge.model).alias("judge_model"),
        F.when(~F.col("abstained"), F.col("__v.latency_ms")).alias("judge_latency_ms"),
        F.col("__v.error").alias("judge_error"),
    )


def rejudged(log: DataFrame, judge: Backend) -> DataFrame:
    """A stored run under another judge: questions, retrieval and answers stay, verdicts are new. Extra columns of the log are left out."""
    schema = struct(RUN_LOG)
    rows = log.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names if c in log.columns]).withColumn("chunks", F.col("retrieved_chunks"))
    return judged(rows, judge).drop("chunks").select(*schema.names)


def rejudged_path(log_path: str, judge: Backend) -> str:
    """Where the rows of a stored run under another judge go: beside the run, named by the judge."""
    return f"{log_path.rstrip('/').removesuffix('.jsonl')}__{judge.name}_{re.sub('[^A-Za-z0-9.]+', '-', judge.model)}"


ZERO_SHOT_CATEGORIES, ZERO_SHOT_ROWS = 3, 16


def zero_shot_run(labelled: DataFrame, questions: dict[str, str], backend: Backend, rows: int = ZERO_SHOT_ROWS) -> DataFrame:
    """The diagnostic over up to three categories (``questions``: category to question): half of the examples of each with it, half without, all scored in one table."""
    if not 0 < len(questions) <= ZERO_SHOT_CATEGORIES:
        raise ValueError(f"ask for one to {ZERO_SHOT_CATEGORIES} categories")
    out = None
    for category, question in questions.items():
        part = zero_shot(class_sample(labelled, category, rows // 2), question, backend).withColumn("category", F.lit(category))
        out = part if out is None else out.unionByName(part)
    return out


def judge_summary(rows: DataFrame, *by: str) -> DataFrame:
    """Counts of the six labels, faithful and partly faithful shares of the scored rows (null without any), abstention and coverage of all."""
    label = F.col("judge_label")
    n = F.count("*")
    scored = F.count_if(label.isin(*SCORED))
    return rows.groupBy(*by).agg(
        n.alias("n"),
        *[F.count_if(label == x).alias(f"n_{x.lower()}") for x in LABELS],
        scored.alias("n_scored"),
        F.try_divide(F.count_if(label == SUPPORTED).cast("double"), scored).alias("faithful_rate"),
        F.try_divide(F.count_if(label.isin(SUPPORTED, PARTIAL)).cast("double"), scored).alias("supported_or_partial_rate"),
        ratio(F.count_if(label == ABSTAINED), n).alias("abstention_rate"),
        ratio(F.count_if(label.isin(*SCORED, ABSTAINED)), n).alias("coverage"),
    )


def absent_abstention(rows: DataFrame) -> DataFrame:
    """Among rows without gold, the share that was rightly declined."""
    absent = rows.where(~F.col("has_gold_span"))
    return absent.agg(F.count("*").alias("n_absent"), F.count_if(F.col("judge_label") == ABSTAINED).alias("n_abstained"), ratio(F.count_if(F.col("judge_label") == ABSTAINED), F.count("*")).alias("abstention_rate"))


def stop_after_failures(rows: DataFrame, order: str, run: int = EARLY_STOP, by: str = "run_id") -> DataFrame:
    """Rows of each run up to and with the ``run``-th NOT_JUDGED in a row; all rows if there is no such streak."""
    w = Window.partitionBy(by).orderBy(order)
    bad = (F.col("judge_label") == NOT_JUDGED).cast("int")
    numbered = rows.withColumn("__n", F.row_number().over(w)).withColumn("__good", F.coalesce(F.max(F.when(bad == 0, F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    ended = numbered.withColumn("__stop", F.min(F.when(F.col("__n") - F.col("__good") >= run, F.col("__n"))).over(Window.partitionBy(by)))
    return ended.where(F.col("__stop").isNull() | (F.col("__n") <= F.col("__stop"))).drop("__n", "__good", "__stop")


def stratified_sample(eval_rows: DataFrame, gold: int = GOLD_ROWS, absent: int = ABSENT_ROWS, seed: int = SAMPLE_SEED) -> DataFrame:
    """Exactly so many rows with and without gold (or all there are), drawn by a hash of seed and row, with ``sample_order`` for a mixed order."""
    draw = drawn(F.lit(seed), F.col("contract_id"), F.col("category"))

    def first(rows: DataFrame, n: int) -> DataFrame:
        # The first rows of each partition go on, so a side is never sorted in one task.
        return rows.orderBy(draw, "contract_id", "category").limit(n)

    picked = first(eval_rows.where("has_gold_span"), gold).unionByName(first(eval_rows.where("not has_gold_span"), absent))
    return picked.withColumn("sample_order", drawn(F.lit(seed + 1), F.col("contract_id"), F.col("category")))


def class_sample(labelled: DataFrame, category: str, n: int = 8, min_chars: int = 20) -> DataFrame:
    """The first ``n`` segments with and without a category in the order of contract and position; texts of under ``min_chars`` don't count."""
    rows = labelled.where(F.char_length(strip(F.col("text"))) >= min_chars).withColumn("gold", F.array_contains("labels", category))
    w = Window.partitionBy("gold").orderBy("contract_id", "position")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def diagnostic_summary(rows: DataFrame) -> DataFrame:
    """Accuracy over the replies that could be read, and what couldn't, from ``gold, predicted, error, latency_s``."""
    read = F.col("predicted").isNotNull()
    return rows.agg(
        F.count("*").alias("n"),
        F.count_if(read).alias("n_parsed"),
        F.count_if(~read & F.col("error").isNull()).alias("n_unparseable"),
        F.count_if(F.col("error").isNotNull()).alias("n_errors"),
        F.try_divide(F.count_if(read & (F.col("predicted") == F.col("gold"))).cast("double"), F.count_if(read)).alias("accuracy"),
        F.avg("latency_s").alias("mean_latency_s"),
        F.sum("latency_s").alias("total_latency_s"),
    )


def zero_shot(sample: DataFrame, question: str, backend: Backend, max_chars: int = 2000) -> DataFrame:
    """Yes or no of a model on each segment of a sample, with ``predicted, error, latency_s``."""
    prompt = F.concat(F.lit(f"{question}\nAnswer YES or NO.\n\nCLAUSE\n------\n"), F.substring("text", 1, max_chars))
    out = sample.withColumn("__g", _called(backend, "Answer with YES or NO.")(prompt))
    return out.select(*sample.columns, yes_no(F.col("__g.text")).alias("predicted"), F.col("__g.error").alias("error"), (F.col("__g.latency_ms") / 1000).alias("latency_s"))


def run_generation(sample: DataFrame, ranking: DataFrame, segments: DataFrame, generator: Backend, judge: Backend, retriever: str, k: int = 5, run_id: str | None = None) -> DataFrame:
    """The whole run as log rows: excerpts in rank order, answer, mechanical score, verdict.

    Sample rows need query_id, contract_id, category, question, gold_spans and has_gold_span. Scores are null for rows without gold: the two signals
    stay apart, and neither is computed from the other.
    """
    chunks = chunks_of(attach_segments(ranking.where(F.col("rank") <= k), segments))
    rows = sample.join(chunks, "query_id", "left").withColumn("retrieved", F.coalesce("retrieved", F.array().cast("array<struct<start:int,end:int>>")))
    scored = score_rows(rows)
    said = judged(generate_for_eval(scored, generator), judge)
    now = datetime.now(UTC)
    gold = F.col("has_gold_span")
    values = {
        "run_id": F.lit(run_id or f"{now:%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"),
        "schema_version": F.lit(RUN_LOG_VERSION),
        "timestamp": F.lit(now.isoformat()),
        "retriever": F.lit(retriever),
        "k": F.lit(k),
        "retrieved_spans": F.col("retrieved"),
        "retrieved_chunks": F.col("chunks"),
        "retrieval_hit": F.when(gold, F.col("hit")),
        **{c: F.when(gold, F.col(c)) for c in ("gold_chars_hit", "gold_chars_total", "retrieved_chars")},
    }
    schema = struct(RUN_LOG)
    return said.select(*[values.get(c, F.col(c)).cast(schema[c].dataType).alias(c) for c in schema.names])
