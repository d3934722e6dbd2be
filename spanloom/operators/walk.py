"""Several tables side by side, group by group, in Arrow batches.

Rows move once, to where their group is, and are sorted there; a group is held by one task at a time, so neither a window nor a join multiplies rows
on disk. Made for steps that need all of a contract at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from spanloom.schemas import struct

#: Rows of a batch that goes back to Spark; a group's own rows stay together.
OUT_ROWS = 4096

Group = tuple[tuple, list[list[tuple]]]


def _groups(batches: Iterator[pa.RecordBatch], n_keys: int, widths: list[int]) -> Iterator[Group]:
    at, rows = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        own, place = [], n_keys + 1
        for w in widths:
            own.append(list(zip(*columns[place : place + w], strict=True)) if w else [()] * batch.num_rows)
            place += w
        for i, (key, part) in enumerate(zip(zip(*columns[:n_keys], strict=True), columns[n_keys], strict=True)):
            if key != at:
                if rows is not None:
                    yield at, rows
                at, rows = key, [[] for _ in widths]
            rows[part].append(own[part][i])
    if rows is not None:
        yield at, rows


def walked(parts: list[DataFrame], keys: list[str], run: Callable[[Iterator[Group]], Iterator[tuple]], schema: str) -> DataFrame:
    """What ``run`` makes of the groups: it gets pairs of key and one list of tuples a part, and gives tuples of columns (lists or arrays of equal length).

    A part's tuples have its columns without the keys, in no order. A null key belongs to no group, as in a join.
    """
    wide = []
    for k, part in enumerate(parts):
        own = [c for c in part.columns if c not in keys]
        known = part.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys]))
        wide.append(known.select(*keys, F.lit(k).alias("__part"), *[F.col(c).alias(f"__{k}_{c}") for c in own]))
    widths = [len(w.columns) - len(keys) - 1 for w in wide]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), wide)
    columns = [*keys, "__part", *[c for w in wide for c in w.columns[len(keys) + 1 :]]]
    kind = struct(schema)
    arrow, n_keys = to_arrow_schema(kind), len(keys)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in arrow]
        for made in run(_groups(batches, n_keys, widths)):
            for have, new in zip(held, made, strict=True):
                have.extend(new)
            if len(held[0]) >= OUT_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow, strict=True)], schema=arrow)
                held = [[] for _ in arrow]
        if held[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, arrow, strict=True)], schema=arrow)

    return rows.select(*columns).repartition(*keys).sortWithinPartitions(*keys, "__part").mapInArrow(task, kind)
