"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact confirmation.

1. Each text becomes the set of its word shingles (64-bit hashes), and the set a signature of BANDS x ROWS minima. Documents of equal sets
   form a class; its least document stands for it from here on.
2. Representatives that share a band meet in a bucket. Each is paired with the least document of its bucket: as many pairs as
   members, never all pairs.
3. Of each pair, signatures are compared batch by batch; after each batch the posterior of the similarity (uniform prior) is known, and
   a pair goes once the chance that it reaches the threshold is under MISS. What survives is confirmed on the full sets.
4. The links found so far give components. Inside a bucket that still holds several, members of different components are compared
   in the same way, block by block and with their sets at hand, so that no link is lost between documents that differ from the bucket's
   least one. The bucket's largest component lies in blocks of its own, which meet the blocks of the other members but never each other. Pairs inside a
   component are never compared, and none but the links that join components leave the bucket.

A pair at the threshold shares no band with a chance under 1e-7 at 0.85 and 4e-6 at 0.8. Texts are read twice: for the signatures and, of
bucket members only, for the sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import MEMORY, SLICE_CHARS, slices
from .common import staged, tidy
from .components import components

WORDS = 5
BANDS, ROWS, BATCH = 32, 5, 32
SIZE = BANDS * ROWS
#: Chance of a pair at the threshold to be given up after any one batch.
MISS = 1e-7
#: Members of a bucket are compared in pairs of blocks of about so many members, and of so many shingles together.
MEMBERS, BLOCK = 400, 500_000
#: Longer words are hashed anew each time.
WORD_BYTES = 64
_RNG = np.random.default_rng(20240229)
FACTORS = (_RNG.integers(0, 2**63, SIZE, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)
SIGNED = "doc long, n_shingles long, f1 long, f2 long, signature binary, bands array<long>"


def _mix(x: np.ndarray) -> np.ndarray:
    for shift, by in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(32))


def word_hashes(words: list, known: dict) -> np.ndarray:
    """Hashes of words, of which at most MEMORY short ones are remembered, whatever a single text holds."""
    out = np.empty(len(words), dtype=np.uint64)
    for at in range(0, len(words), MEMORY):
        part = words[at : at + MEMORY]
        if len(known) > MEMORY:
            known.clear()
        long: dict = {}
        for w in set(part):
            if w not in known:
                (known if len(w) <= WORD_BYTES else long)[w] = xxhash.xxh3_64_intdigest(w)
        look = (lambda w, a=known, b=long: a[w] if w in a else b[w]) if long else known.__getitem__
        out[at : at + len(part)] = np.fromiter(map(look, part), dtype=np.uint64, count=len(part))
    return out


class Shingler:
    """Sets of shingles as sorted, distinct 64-bit hashes; remembers the hashes of a bounded number of words."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words
        self.known: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        return word_hashes(words, self.known)

    def shingles(self, text: str | None) -> np.ndarray:
        """Lower-cases A-Z, splits at blanks; fewer words than a shingle has make one of them all, none make none."""
        words = (text or "").encode("utf-8").lower().split()
        if not words:
            return np.empty(0, dtype=np.uint64)
        h = self._hashes(words)
        k = min(self.words, len(words))
        with np.errstate(over="ignore"):
            out = np.full(len(words) - k + 1, k, dtype=np.uint64)
            for i in range(k):
                out = out * STEP + h[i : len(h) - k + 1 + i]
            return np.unique(_mix(out))


def sign(shingles: np.ndarray) -> tuple[int, int, bytes, np.ndarray]:
    """Two hashes of the set, the signature (a byte of each minimum) and the keys of the bands."""
    with np.errstate(over="ignore"):
        low = np.full(SIZE, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(shingles), 2048):
            np.minimum(low, np.multiply.outer(FACTORS, shingles[at : at + 2048]).min(axis=1), out=low)
        keys = np.arange(1, BANDS + 1, dtype=np.uint64)
        for row in low.reshape(BANDS, ROWS).T:
            keys = _mix(keys * STEP + row)
    raw = shingles.tobytes()
    both = xxhash.xxh3_128_intdigest(raw)
    ints = np.array([both >> 64, both & (2**64 - 1)], dtype=np.uint64).view(np.int64)
    return int(ints[0]), int(ints[1]), (low >> np.uint64(56)).astype(np.uint8).tobytes(), keys.view(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    for batch in batches:
        docs, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
        for a, b in slices([len(x or "") for x in texts], SLICE_CHARS):
            yield docs[a:b], texts[a:b]


def signatures(docs: DataFrame, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc, n_shingles, f1, f2, signature, bands``, one a row of ``docs``; empty sets have null hashes and no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for own, texts in _texts(batches):
            sets = [shingler.shingles(t) for t in texts]
            signed = [sign(s) if len(s) else (None, None, None, []) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    *(pa.array([s[i] for s in signed], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))),
                ],
                ["doc", "n_shingles", "f1", "f2", "signature", "bands"],
            )

    return docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text")).mapInArrow(tidy(run), SIGNED)


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows ``doc, shingles`` of the columns ``doc, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for own, texts in _texts(batches):
            sets = [shingler.shingles(t).view(np.int64) for t in texts]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets)))], ["doc", "shingles"])

    return docs.select("doc", "text").mapInArrow(tidy(run), "doc long, shingles array<long>")


def least_matches(percent: int) -> list[int]:
    """For each number of batches, the least number of equal bytes with which a pair stays.

    With a uniform prior and m of n equal, the chance of a similarity of t or more is that of at most m successes in n + 1 draws at t. A
    byte of two different minima is equal once in 256.
    """
    t = percent / 100
    t += (1 - t) / 256
    found = []
    for n in range(BATCH, SIZE + 1, BATCH):
        below, m = 0.0, -1
        while below < MISS:
            m += 1
            below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        found.append(m)
    return found


def _survive(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Positions of the rows of signatures a and b that no batch gives up; b may be a single row."""
    at = np.arange(len(a))
    equal = np.zeros(len(a), dtype=np.int64)
    for k, m in enumerate(least):
        cut = slice(k * BATCH, (k + 1) * BATCH)
        equal = equal + (a[at, cut] == (b[at, cut] if len(b) == len(a) else b[:, cut])).sum(axis=1)
        at, equal = at[equal >= m], equal[equal >= m]
        if not len(at):
            break
    return at


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), SIZE)


def bayes_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures ``sa, sb`` survive all batches."""
    least = least_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at = pa.array(_survive(_matrix(batch.column("sa")), _matrix(batch.column("sb")), least))
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("a", "b")], ["a", "b"])

    return pairs.select("a", "b", "sa", "sb").mapInArrow(tidy(run), "a long, b long")


def bucket_links(rows: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between different components inside the buckets of ``rows``, which lie together sorted by ``bucket, i, j``.

    A group holds one block of a bucket, or two to be compared with each other. Pairs that survive the batches are confirmed on their
    full sets at once, and a link is returned only if it joins what the group's links haven't joined yet, so a group gives fewer links than
    it has members.
    """
    least = least_matches(percent)

    def links(t: pa.Table) -> list[tuple[int, int]]:
        docs, labels, blocks, leaders = (t.column(c).to_numpy() for c in ("doc", "label", "block", "leader"))
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        signed = _matrix(t.column("signature").combine_chunks())
        lists = t.column("shingles").combine_chunks()
        sizes = lists.value_lengths().to_numpy()
        flat = lists.flatten().to_numpy()
        starts = np.concatenate([[0], np.cumsum(sizes)])
        local = np.unique(flat, return_inverse=True)[1]
        mark = np.zeros(len(flat) + 1, dtype=bool)
        roots = np.unique(labels, return_inverse=True)[1]
        right = np.flatnonzero((blocks == j) & (docs != leaders))
        found = []
        for x in np.flatnonzero((blocks == i) & (docs != leaders)):
            y = right[roots[right] != roots[x]]
            if i == j:
                y = y[y > x]
            if not len(y):
                continue
            y = y[_survive(signed[y], signed[x : x + 1], least)]
            if not len(y):
                continue
            own = local[starts[x] : starts[x + 1]]
            mark[own] = True
            spans = np.repeat(starts[y] - np.concatenate([[0], np.cumsum(sizes[y])[:-1]]), sizes[y]) + np.arange(sizes[y].sum())
            common = np.add.reduceat(mark[local[spans]].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[y])[:-1]]))
            mark[own] = False
            for other in y[100 * common >= percent * (sizes[x] + sizes[y] - common)]:
                if roots[other] != roots[x]:
                    roots[roots == roots[other]] = roots[x]
                    found.append((int(min(docs[x], docs[other])), int(max(docs[x], docs[other]))))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def done() -> Iterator[pa.RecordBatch]:
            if found := links(pa.concat_tables(held)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            keys = np.stack([t.column(c).to_numpy() for c in ("bucket", "i", "j")])
            edges = [0, *(np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1).tolist(), t.num_rows]
            for a, b in pairwise(edges):
                if held and any(held[0].column(c)[0].as_py() != keys[k][a] for k, c in enumerate(("bucket", "i", "j"))):
                    yield from done()
                held.append(t.slice(a, b - a))
        if held:
            yield from done()

    return rows.select("bucket", "i", "j", "block", "doc", "label", "leader", "signature", "shingles").mapInArrow(tidy(run), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have percent * union <= 100 * intersection."""
    both = pairs.join(sets.select(F.col("doc").alias("b"), F.col("shingles").alias("y")), "b").join(sets.select(F.col("doc").alias("a"), F.col("shingles").alias("x")), "a")
    shared = both.select("a", "b", (F.size("x") + F.size("y")).alias("total"), F.size(F.array_intersect("x", "y")).alias("common"))
    return shared.where(F.lit(100) * F.col("common") >= F.lit(percent) * (F.col("total") - F.col("common"))).select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, n_shingles, component_id, kept``, one a row of ``docs``; documents are linked from a similarity of percent / 100 on.

    ``component_id`` is the least key reachable over links, ``kept`` whether that is the row's own. Texts without a word (null, empty,
    blanks) have no shingle and are linked with nothing. Rows that repeat a key are one document, linked with itself. Rows without a
    key aren't linked; their component is null and they are kept. An empty table gives no rows; extra columns are left out.
    """
    signed = staged(signatures(docs, words, key, text), "signatures")
    full = signed.where("n_shingles > 0 and doc is not null")
    copies = staged(full.groupBy("f1", "f2").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").drop("most"), "copies")
    classed = full.select("doc", "f1", "f2").join(copies, ["f1", "f2"], "left")
    members = staged(classed.where("least < doc").select("doc", "least"), "members")
    alone = full.join(members.select("doc"), "doc", "left_anti").select("doc", "n_shingles", "signature", "bands")

    banded = alone.select("doc", "n_shingles", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.min("doc").alias("leader"), F.count("*").alias("n")).where("n > 1")
    met = staged(banded.join(buckets.select("bucket", "leader", "n"), "bucket"), "buckets")
    met_docs = met.select("doc").distinct()
    signs = staged(alone.select("doc", "signature").join(met_docs, "doc", "left_semi"), "signs")
    own = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    sets = staged(shingle_sets(own.join(met_docs, "doc", "left_semi"), words), "sets")

    star = met.where("doc <> leader").select(F.col("leader").alias("a"), F.col("doc").alias("b")).distinct()
    star = star.join(signs.select(F.col("doc").alias("b"), F.col("signature").alias("sb")), "b").join(signs.select(F.col("doc").alias("a"), F.col("signature").alias("sa")), "a")
    links = staged(confirmed(bayes_pairs(star, percent), sets, percent), "links")
    labels = components(links)

    larger = met.where("n > 2").join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    larger = staged(larger, "larger")
    sides = larger.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size"))
    largest = F.max(F.struct("n", F.col("size").alias("size"), "label"))
    plan = sides.groupBy("bucket").agg(largest.alias("top"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("labels")).where("labels > 1")

    def blocks(n: Column, size: Column) -> Column:
        return F.greatest(F.ceil(n / MEMBERS), F.ceil(size / BLOCK), F.lit(1)).cast("int")

    plan = plan.select("bucket", F.col("top.label").alias("top"), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")).alias("rest"), blocks(F.col("top.n"), F.col("top.size")).alias("tops"))
    # Blocks of the other members come first; each pair of blocks has one of them, as its first.
    is_top, of = F.col("label") == F.col("top"), F.xxhash64("doc")
    met_blocks = F.when(is_top, F.sequence(F.lit(0), F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") + F.col("tops") - 1))
    dealt = (
        larger.drop("n")
        .join(plan, "bucket")
        .withColumn("block", F.when(is_top, F.col("rest") + F.pmod(of, F.col("tops"))).otherwise(F.pmod(of, F.col("rest"))).cast("int"))
        .withColumn("other", F.explode(met_blocks))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("bucket", "i", "j", "block", "doc", "label", "leader")
        .join(signs, "doc")
        .join(sets, "doc")
        .repartition("bucket", "i", "j")
        .sortWithinPartitions("bucket", "i", "j", "doc")
    )
    more = staged(bucket_links(dealt, percent).distinct(), "links")
    labels = components(links.union(more).union(members.select(F.col("doc").alias("a"), F.col("least").alias("b"))))

    out = signed.select("doc", "n_shingles").join(labels.withColumnRenamed("node", "doc"), "doc", "left")
    component = F.coalesce("label", "doc")
    return out.select(F.col("doc").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), percent=85)
