"""Sharding by global byte-size prefix sums: contiguous shards, cut at equal targets.

Built-in functions only. Texts are measured where they are scanned; from there on a document is a row of a
few numbers. Rows are range-partitioned by document; the totals of the partitions (one row a partition, the only thing
that the driver sees) give every partition its global offset, and a running sum inside each partition does the rest.
No step gathers a shard, so eight shards of 100 TB need no task of 12 TB.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole

LAW = "bytes"


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus one (for the end mark), so that empty documents count too."""
    return F.octet_length(whole(text)).cast("long") + 1


def assign_shards(docs: DataFrame, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``key, size, text_crc32, shard, slot``, one for each row of ``docs``, extra columns left out.

    The order is that of ``key`` (nulls first), then checksum, then size; a document belongs to the shard in which its middle byte
    falls, so each shard is within one document of total / n_shards. ``slot`` counts from 0 without gaps inside a shard.
    Null and empty texts have size 1; repeated rows each keep a slot; an empty table gives no rows. A single document
    larger than a shard's share leaves the shards that it covers empty.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), text_size(F.col(text)).alias("size"), F.crc32(F.encode(whole(F.col(text)), "UTF-8")).alias("crc"))
    rows = staged(rows.repartitionByRange("key", "crc", "size").withColumn("part", F.spark_partition_id()), "sizes")

    totals = rows.groupBy("part").agg(F.sum("size").alias("bytes")).orderBy("part").collect()
    total = sum(r.bytes for r in totals)
    starts = [0, *accumulate(r.bytes for r in totals)]
    offsets = spark.createDataFrame([(r.part, b) for r, b in zip(totals, starts, strict=False)], "part int, bytes_before long")

    order = Window.partitionBy("part").orderBy(F.asc_nulls_first("key"), "crc", "size")
    placed = (
        rows.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("at", F.row_number().over(order))
        .join(F.broadcast(offsets), "part")
        .withColumn("twice_middle", 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size"))
        .select("key", "size", "crc", "part", "at", F.least(F.expr(f"cast(twice_middle * {n_shards} div {2 * max(total, 1)} as int)"), F.lit(n_shards - 1)).alias("shard"))
    )
    placed = staged(placed, "shards")

    # One row for each partition and shard that meet: at most partitions + shards of them.
    pieces = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first")).orderBy("shard", "part").collect()
    seen: dict[int, int] = {}
    slots = []
    for p in pieces:
        slots.append((p.shard, p.part, seen.get(p.shard, 0) - p["first"]))
        seen[p.shard] = seen.get(p.shard, 0) + p.rows
    shift = spark.createDataFrame(slots, "shard int, part int, shift long")
    return placed.join(F.broadcast(shift), ["shard", "part"]).select(
        F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") + F.col("shift")).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, key: str = "doc_id", text: str = "text") -> None:
    """Write ``docs`` with all its columns as one folder a shard, rows in the order of slots inside each file.

    Rows with equal key and text are the same document written as often as it came.
    """
    where = assign_shards(docs, n_shards, key, text).groupBy(key, "text_crc32", "size").agg(F.min("shard").alias("shard"), F.min("slot").alias("slot"))
    where = where.select(F.col(key).alias("__key"), F.col("text_crc32").alias("__crc"), F.col("size").alias("__size"), F.col("shard").alias("__shard"), F.col("slot").alias("__slot"))
    own = docs.withColumn("__c", F.crc32(F.encode(whole(F.col(text)), "UTF-8"))).withColumn("__s", text_size(F.col(text)))
    joined = own.join(where, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__c") == F.col("__crc")) & (F.col("__s") == F.col("__size")))
    (
        joined.drop("__key", "__crc", "__size", "__c", "__s")
        .repartitionByRange("__shard", "__slot")
        .sortWithinPartitions("__shard", "__slot")
        .drop("__slot")
        .write.partitionBy("__shard")
        .parquet(path)
    )


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign_shards(docs).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
