"""Writers: corpus files, index collections, guarded results, run logs, experiment runs, fitted priors."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import RUN_LOG, struct
from spanloom.sources.corpus import BUCKETS, bucket_of, metric_key
from spanloom.sources.stage import staged


class PartialRun(ValueError):
    """A run over part of the data may not be recorded as a result."""


def write_corpus(contracts: DataFrame, eval_rows: DataFrame, counters: DataFrame, out: str) -> None:
    """Contracts and evaluation rows as JSON lines, counters beside them."""
    contracts.write.mode("overwrite").json(f"{out}/contracts")
    eval_rows.write.mode("overwrite").json(f"{out}/eval_rows")
    counters.coalesce(1).write.mode("overwrite").json(f"{out}/metadata")


def write_training(rows: DataFrame, stats: DataFrame, out: str) -> None:
    rows.write.mode("overwrite").json(f"{out}/training_segments")
    stats.coalesce(1).write.mode("overwrite").json(f"{out}/label_stats")


def write_text(rows: DataFrame, out: str) -> None:
    """One text column as files of text."""
    rows.write.mode("overwrite").text(out, lineSep="\n")


def write_collection(records: DataFrame, root: str, name: str, reset: bool = True, buckets: int = BUCKETS) -> None:
    """Index records, one folder a bucket of contracts; ``reset`` replaces the collection, else records of the same id are replaced.

    Buckets of a hash keep the number of folders bounded whatever the number of contracts. An upsert reads and writes only the buckets that it touches.
    """
    path = f"{root}/{name}"
    rows = records.withColumn("bucket", bucket_of(F.col("contract_id"), buckets))
    if reset:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return
    rows = staged(rows, "upsert")
    touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
    try:
        old = records.sparkSession.read.parquet(path).where(F.col("bucket").isin(touched))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        merged = rows
    else:
        merged = staged(old.join(rows.select("record_id"), "record_id", "left_anti").unionByName(rows), "upsert")
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def drop_collection(spark: SparkSession, root: str, name: str) -> bool:
    """Remove a collection; False if there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def ingest_stats(segments: DataFrame, records: DataFrame) -> DataFrame:
    seen = segments.agg(F.countDistinct("contract_id").alias("n_contracts"), F.count("*").alias("n_segments_seen"))
    written = records.agg(F.countDistinct("segment_id").alias("n_segments_written"), F.count("*").alias("n_records"))
    return seen.join(written, F.lit(True))


def merge_result(metrics: DataFrame, path: str, variant: str, *, limit: int | None = None, split: str = "all", write: bool = True) -> bool:
    """Record one variant's metrics and leave the others; a run over part of the data raises PartialRun instead."""
    if not write:
        return False
    if limit or split != "all":
        raise PartialRun(f"limit={limit}, split={split}: not recorded")
    rows = metrics.withColumn("variant", F.lit(variant))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("variant").parquet(path)
    return True


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def versus(results: DataFrame, base: str = "tfidf", metric: str = "hit_rate") -> DataFrame:
    """Results with the difference of a metric to a base variant, null if it isn't there."""
    ref = results.where(F.col("variant") == base).agg(F.first(metric).alias("__base"))
    return results.join(ref, F.lit(True), "left").withColumn(f"{metric}_delta", F.col(metric) - F.col("__base")).drop("__base")


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a run log; a job's rows appear together or not at all."""
    rows.select(*struct(RUN_LOG).names).write.mode("append").json(path)


def log_run(
    spark: SparkSession, path: str, name: str, params: dict, metrics: dict[str, float], tags: dict[str, str] | None = None, per_category: dict[str, dict[str, float]] | None = None, artifact: str | None = None
) -> None:
    """One row of an experiment table. Figures of categories are metrics named ``metric/category``; ``artifact`` is a text that is kept with the run."""
    own = {**metrics, **{f"{m}/{c}": v for c, figures in (per_category or {}).items() for m, v in figures.items()}}
    row = (name, datetime.now(UTC).isoformat(), {k: str(v) for k, v in params.items()}, {metric_key(k): float(v) for k, v in own.items()}, tags or {}, artifact)
    schema = "name string, timestamp string, params map<string,string>, metrics map<string,double>, tags map<string,string>, artifact string"
    spark.createDataFrame([row], schema).write.mode("append").parquet(path)


def save_prior(prior: DataFrame, path: str) -> None:
    """A fitted prior as one row: its categories, sorted, and the number of lead segments."""
    one = prior.agg(F.sort_array(F.collect_set("category")).alias("categories"), F.coalesce(F.max("n_lead"), F.lit(1)).alias("n_lead"))
    one.coalesce(1).write.mode("overwrite").json(path)


def load_prior(spark: SparkSession, path: str) -> DataFrame:
    one = spark.read.schema("categories array<string>, n_lead int").json(path)
    return one.select(F.explode("categories").alias("category"), "n_lead")


def save_ladder(results: list[dict], model, out: str, seed: int) -> None:  # noqa: ANN001
    """Results and best model of a ladder, kept apart by seed."""
    from pyspark.sql import SparkSession as S

    rows = [(r["step"].name, bool(r["adopted"]), float(r["delta"]), float((r["macro"] or {"f1": 0.0})["f1"]), float((r["micro"] or {"f1": 0.0})["f1"])) for r in results]
    S.active().createDataFrame(rows, "step string, adopted boolean, delta double, macro_f1 double, micro_f1 double").coalesce(1).write.mode("overwrite").json(f"{out}/seed={seed}/results")
    if model is not None:
        model.write().overwrite().save(f"{out}/seed={seed}/model")
