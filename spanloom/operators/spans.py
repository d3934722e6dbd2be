"""Algebra of half-open character spans: overlap, union, coverage, labelling, capture and reach.

Two forms of everything: on array columns (one row holds all spans of a query), and on rows with an equality key next to the
interval condition, so that joins hash on the key and never run nested loops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

SPANS = "array<struct<start:int,end:int>>"


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Characters that two spans share; spans that only touch share none."""
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def plain(spans: Column) -> Column:
    """Start and end alone, null as no spans."""
    return F.coalesce(F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"))), F.array().cast(SPANS))


def merged(spans: Column) -> Column:
    """The union of an array of spans as sorted spans that don't touch."""

    def add(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        # Slices need a length of 0 at least.
        head = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(s["start"] <= last["end"], F.concat(head, F.array(joined))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(plain(spans)), F.array().cast(SPANS), add)


def covered(spans: Column) -> Column:
    """Characters of the union."""
    return F.aggregate(merged(spans), F.lit(0), lambda acc, s: acc + s["end"] - s["start"])


def covered_in(spans: Column, others: Column) -> Column:
    """Characters of the union of ``spans`` that the union of ``others`` holds too."""
    a, b = merged(spans), merged(others)
    return F.aggregate(a, F.lit(0), lambda acc, s: acc + F.aggregate(b, F.lit(0), lambda n, o: n + overlap(s["start"], s["end"], o["start"], o["end"])))


def touches(spans: Column, others: Column) -> Column:
    """Whether any span of one array overlaps one of the other."""
    return F.exists(plain(spans), lambda s: F.exists(plain(others), lambda o: overlap(s["start"], s["end"], o["start"], o["end"]) > 0))


def union_rows(rows: DataFrame, *keys: str, start: str = "start", end: str = "end") -> DataFrame:
    """The union of the spans of each key as rows: spans that touch or overlap become one.

    A new island begins where a start lies beyond the largest end so far. Rows are sorted once and read as a stream, of which one island is held.
    """
    names = [*keys, start, end]
    own = rows.select(*names)
    dealt = (own.repartition(*keys) if keys else own.repartition(1)).sortWithinPartitions(*names)
    arrow, n = to_arrow_schema(own.schema), len(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, low, high, out = None, None, None, []

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            for *key, s, e in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if at == key and high is not None and (s is None or s <= high):
                    low, high = s if low is None else low, high if e is None or e <= high else e
                    continue
                if at is not None:
                    out.append((*at, low, high))
                at, low, high = key, s, e
            if len(out) >= 4096:
                yield made()
                out = []
        if at is not None:
            out.append((*at, low, high))
        if out:
            yield made()

    return dealt.mapInArrow(task, own.schema)


def gold_rows(eval_rows: DataFrame) -> DataFrame:
    """One row a gold span: contract_id, category, gold_start, gold_end."""
    spans = eval_rows.select("contract_id", "category", F.explode("gold_spans").alias("g"))
    return spans.select("contract_id", "category", F.col("g.start").alias("gold_start"), F.col("g.end").alias("gold_end"))


def _meeting() -> Column:
    return overlap(F.col("start_char"), F.col("end_char"), F.col("gold_start"), F.col("gold_end")) > 0


def label_segments(segments: DataFrame, eval_rows: DataFrame) -> DataFrame:
    """Segments with the sorted categories of the gold spans that they overlap (``labels``), and how many (``n_labels``); segments without any stay.

    Needs contract_id, segment_id, start_char and end_char. Matching pairs are reduced to one row a segment before segments
    are joined back, so texts move once.
    """
    where = segments.select("contract_id", "segment_id", "start_char", "end_char")
    found = where.join(gold_rows(eval_rows), "contract_id").where(_meeting()).groupBy("contract_id", "segment_id").agg(F.sort_array(F.collect_set("category")).alias("labels"))
    labels = F.coalesce("labels", F.array().cast("array<string>"))
    return segments.join(found, ["contract_id", "segment_id"], "left").withColumn("labels", labels).withColumn("n_labels", F.size("labels"))


def capture(segments: DataFrame, eval_rows: DataFrame) -> DataFrame:
    """One row a gold span with ``captured``: whether any segment of its contract overlaps it."""
    gold = gold_rows(eval_rows)
    where = segments.select("contract_id", "start_char", "end_char")
    hits = gold.join(where, "contract_id").where(_meeting()).select("contract_id", "category", "gold_start", "gold_end").distinct().withColumn("captured", F.lit(True))
    keys = ["contract_id", "category", "gold_start", "gold_end"]
    return gold.join(hits, keys, "left").withColumn("captured", F.coalesce("captured", F.lit(False)))


def reachable(segments: DataFrame, eval_rows: DataFrame) -> DataFrame:
    """Scored rows (those with gold) with ``reachable``: whether any segment overlaps any of their gold spans."""
    hit = capture(segments, eval_rows).groupBy("contract_id", "category").agg(F.max("captured").alias("reachable"))
    return eval_rows.where("has_gold_span").select("contract_id", "category").join(hit, ["contract_id", "category"], "left").withColumn("reachable", F.coalesce("reachable", F.lit(False)))


def translate_starts(positions: DataFrame, offset_map: DataFrame) -> DataFrame:
    """Start-style translation of cleaned positions (``doc_id, pos``) through map rows (``doc_id, c_start, c_end, o_start``; a null o_start is a gap).

    Inside a kept span the place is exact; in or at a gap it is where kept text goes on; behind all, where the last kept span ends;
    without any kept span the position itself.
    """
    kept = offset_map.where("o_start is not null")
    both = positions.join(kept, "doc_id", "left")
    inside = F.max(F.when((F.col("c_start") <= F.col("pos")) & (F.col("pos") < F.col("c_end")), F.col("o_start") + F.col("pos") - F.col("c_start")))
    onward = F.min_by(F.when(F.col("pos") <= F.col("c_start"), F.col("o_start")), F.when(F.col("pos") <= F.col("c_start"), F.col("c_start")))
    last = F.max_by(F.col("o_start") + F.col("c_end") - F.col("c_start"), F.col("c_start"))
    return both.groupBy("doc_id", "pos").agg(F.coalesce(inside, onward, last, F.col("pos")).alias("original"))


def translate_ends(positions: DataFrame, offset_map: DataFrame) -> DataFrame:
    """End-style (exclusive) translation: inside or at the end of a kept span exact, else where kept text ended last before it, else 0."""
    kept = offset_map.where("o_start is not null")
    both = positions.join(kept, "doc_id", "left")
    inside = F.max(F.when((F.col("c_start") < F.col("pos")) & (F.col("pos") <= F.col("c_end")), F.col("o_start") + F.col("pos") - F.col("c_start")))
    back = F.max_by(
        F.when(F.col("c_end") <= F.col("pos"), F.col("o_start") + F.col("c_end") - F.col("c_start")), F.when(F.col("c_end") <= F.col("pos"), F.col("c_start"))
    )
    return both.groupBy("doc_id", "pos").agg(F.coalesce(inside, back, F.lit(0)).alias("original"))
