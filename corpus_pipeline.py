"""Training documents from a raw corpus: five stages, each one operator on all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the
docs of the next. All but the last return the columns of ``documents``. What a stage stored on its way is needed until its result is
written; it goes when the next stage begins, or at the end of ``run``.

Every stage judges rows, not ids: a row without an id, or one of several with the same, is treated by its own text. Null texts
count as empty; texts are read whole, however long. An empty table gives an empty table. Other columns are carried along.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puckspark.llm import decontaminate, mixing, near, sharding, toxicity
from puckspark.llm.rows import row_keyed
from puckspark.llm.ship import with_code
from puckspark.operators.sizing import lookup
from puckspark.operators.skew import join_by_key
from puckspark.session import Pins, pin, shared_dir

REJECT_FROM = 0.3  # toxicity score
NEAR_PERCENT = 80
SHARDS = 8


_held: dict[str, Pins] = {}  # by application: what the latest stage has stored


def _release(spark: SparkSession) -> None:
    """Deletes what the stage before stored; its result is written by now."""
    held = _held.pop(spark.sparkContext.applicationId, None)
    if held is not None:
        held.delete()


def _stage(function):
    """A stage that owns what it stores, and at its start deletes what the one before did."""
    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _release(spark)
        pins = _held[spark.sparkContext.applicationId] = Pins(spark)
        pins.__enter__()
        try:
            return function(spark, docs, sf_dir)
        finally:
            pins.close()
    return run_stage


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECT_FROM``; the labels are those of the folder. Every row is judged by its
    own text, also one without an id or with the id of others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.scored_rows(docs, *toxicity.fit(docs, labels)).where(F.col("score") < REJECT_FROM).select("doc.*")


@_stage
def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates: the one with the smallest id, rows without an id coming last. Rows are grouped
    by their texts alone, so copies go whether or not they have an id or share it; texts without words stay."""
    keyed = row_keyed(docs)
    rows = keyed.select("row", F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"))
    groups = pin(near.near_groups(rows, "row", percent=NEAR_PERCENT).select("row", "component_id").join(rows.select("row", "doc_id"), "row"))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row")))["row"]
    best = groups.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), first.alias("best")).where("n > 1").drop("n")
    away = join_by_key(groups, best, ["component_id"], "inner").where("row <> best").select(F.col("row").alias("_away"))
    return keyed.join(lookup(away), F.col("row") == F.col("_away"), "left_anti").select("doc.*")


@_stage
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, those labelled as good quality sooner and as poor later; the labels are those of the folder."""
    return mixing.mixed_documents(docs, labels=spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard and their place in it."""
    return sharding.sharded_documents(docs, shards=SHARDS)


STAGES = [
    ("toxicity", drop_toxic), ("near_duplicates", keep_one_of_each_group), ("decontamination", drop_benchmark),
    ("mixing", mix), ("sharding", shard),
]

#: Learned scores and sampled splitters have no SQL; the tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, written to the shared folder after each."""
    docs = with_code(spark).read.parquet(f"{sf_dir}/documents.parquet")
    place = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{place}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    _release(spark)
    return docs
