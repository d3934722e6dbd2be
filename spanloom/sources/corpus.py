"""Readers of the corpus, evaluation rows, training segments and run logs."""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.schemas import CONTRACT, CORPUS, EVAL_ROW, RUN_LOG, TRAINING, require, struct
from spanloom.sources.stage import staged


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row a question of a nested question-answering corpus: contract_id, title, context, question_id, question, is_impossible, answers."""
    raw = spark.read.schema(struct(CORPUS)).json(path, multiLine=True)
    docs = raw.select(F.explode("data").alias("d")).select("d.title", F.explode("d.paragraphs").alias("p"))
    return docs.select(F.col("title").alias("contract_id"), "title", "p.context", F.explode("p.qas").alias("q")).select(
        "contract_id", "title", "context", F.col("q.id").alias("question_id"), "q.question", "q.is_impossible", "q.answers"
    )


def contracts_of(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("contract_id").agg(F.first("title").alias("title"), F.first("context").alias("context"))


def gold_spans(answers: Column) -> Column:
    """Answers as spans with exclusive ends."""
    own = F.coalesce(answers, F.array().cast("array<struct<text:string,answer_start:int>>"))
    return F.transform(own, lambda a: F.struct(a["text"].alias("text"), a["answer_start"].alias("start"), (a["answer_start"] + F.char_length(a["text"])).alias("end")))


def eval_rows_of(corpus: DataFrame) -> DataFrame:
    """Evaluation rows; a question id must be its title, two underscores and the category."""
    prefix = F.concat("title", F.lit("__"))
    ok = F.assert_true(F.startswith("question_id", prefix), F.concat(F.lit("question id without its title: "), F.col("question_id")))
    category = F.expr("substring(question_id, char_length(title) + 3)")
    rows = corpus.where(ok.isNull()).withColumn("gold_spans", gold_spans(F.col("answers")))
    return rows.select("contract_id", category.alias("category"), "question", "gold_spans", (F.size("gold_spans") > 0).alias("has_gold_span"))


def _first_contracts(rows: DataFrame, limit: int | None) -> DataFrame:
    if not limit:
        return rows
    ids = rows.groupBy("contract_id").agg(F.min("__at").alias("__first")).orderBy("__first").limit(limit)
    return rows.join(ids.select("contract_id"), "contract_id", "left_semi")


def read_contracts(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Contracts of a JSON-lines file or folder: the first ``limit`` distinct ids in file order (0 or None: all); of a repeated id the last row counts."""
    rows = spark.read.schema(struct(CONTRACT)).json(path).withColumn("__at", F.monotonically_increasing_id())
    own = _first_contracts(rows, limit)
    last = own.groupBy("contract_id").agg(F.max_by(F.struct("title", "context"), "__at").alias("r"))
    return last.select("contract_id", "r.title", "r.context")


def read_contract_ids(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    ids = spark.read.schema("contract_id string").json(path).withColumn("__at", F.monotonically_increasing_id())
    return _first_contracts(ids, limit).select("contract_id").distinct()


def read_eval_rows(spark: SparkSession, path: str, contracts: DataFrame | None = None) -> DataFrame:
    """Evaluation rows, of the given contracts only."""
    rows = spark.read.schema(struct(EVAL_ROW)).json(path)
    return rows if contracts is None else rows.join(contracts.select("contract_id").distinct(), "contract_id", "left_semi")


def read_jsonl(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    rows = spark.read.schema(struct(schema)).json(path)
    return rows.limit(limit) if limit else rows


def read_training(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Training segments; ``limit`` keeps the first contracts in the order of their ids, not rows. Fails if the file isn't there or lacks positions."""
    rows = spark.read.schema(struct(TRAINING)).json(path)
    # An old file lacks columns, which its first row shows without a pass over the rest.
    needed = ["contract_id", "segment_id", "text", "labels", "position"]
    first = rows.select(*needed).limit(1).collect()
    if first and None in tuple(first[0]):
        require(rows.select(*[c for c in needed if first[0][c] is not None]), *needed)
    if not limit:
        return rows
    ids = rows.select("contract_id").distinct().orderBy("contract_id").limit(limit)
    return rows.join(ids, "contract_id", "left_semi")


def first_questions(eval_rows: DataFrame, order: str | None = None) -> DataFrame:
    """The first question of each category, in the order of a column or as the rows come."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    return eval_rows.withColumn("__at", at).groupBy("category").agg(F.min_by("question", "__at").alias("question"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows; blank lines are no rows, fields that a log lacks are null."""
    return spark.read.schema(struct(RUN_LOG)).json(path).where("run_id is not null")


def extract_contract(contracts: DataFrame, title: str) -> DataFrame:
    """The text of one contract, found by its title."""
    return contracts.where(F.col("title") == title).select("context")


def model_tag(model: str) -> str:
    """Name of a model in table names: its last path part, dashes as underscores, dots gone."""
    return model.rsplit("/", 1)[-1].replace("-", "_").replace(".", "")


def collection_name(model: str, windowed: bool = True, prefix: str = "contract_segments") -> str:
    return f"{prefix}_{model_tag(model)}{'_win' if windowed else ''}"


#: Folders of a collection: contracts fall into so many by a hash.
BUCKETS = 256


def bucket_of(contract_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(contract_id), F.lit(buckets)).cast("int")


def open_collection(spark: SparkSession, root: str, name: str, contract_id: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Index records of a collection; with a contract only its folder is read."""
    rows = spark.read.parquet(f"{root}/{name}")
    if contract_id is None:
        return rows
    bucket = spark.range(1).select(bucket_of(F.lit(contract_id), buckets)).collect()[0][0]
    return rows.where((F.col("bucket") == bucket) & (F.col("contract_id") == contract_id))


def data_version(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``path, md5, size`` of the files below a path: what a stored pointer to a version of the data says."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.md5("content").alias("md5"), F.col("length").alias("size"))


def question_order(rows: DataFrame) -> DataFrame:
    """``query_id`` numbered from 0 in the order of contract and category."""
    # Ranks inside ranges plus the sizes of the ranges before, of which the driver sees one number each.
    dealt = rows.repartitionByRange("contract_id", "category").withColumn("__part", F.spark_partition_id())
    dealt = staged(dealt, "ordered")
    sizes = sorted((r["__part"], r["count"]) for r in dealt.groupBy("__part").count().collect())
    before = dict(zip([p for p, _ in sizes], accumulate([n for _, n in sizes], initial=0), strict=False))
    start = F.element_at(F.create_map(*[F.lit(x) for p, n in before.items() for x in (p, n)]), F.col("__part")) if before else F.lit(0)
    w = Window.partitionBy("__part").orderBy("contract_id", "category")
    return dealt.withColumn("query_id", (start + F.row_number().over(w) - 1).cast("int")).drop("__part")


def metric_key(name: str) -> str:
    """A name as experiment trackers take it: slashes as dashes, spaces as underscores, 80 characters."""
    return re.sub(" ", "_", name.replace("/", "-"))[:80]
