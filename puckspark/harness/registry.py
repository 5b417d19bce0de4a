"""Queries bound to the benchmark tables, each with its SQL counterpart where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """``t.orders`` reads orders.parquet of the given folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._spread: dict[str, DataFrame] = {}

    def spread(self, name: str) -> DataFrame:
        """A table for heavy row-wise work: one in fewer pieces than cores is dealt out over them."""
        if name not in self._spread:
            df = getattr(self, name)
            cores = self.spark.sparkContext.defaultParallelism
            few = df.rdd.getNumPartitions() < cores
            self._spread[name] = df.repartition(cores, df.columns[0]) if few else df
        return self._spread[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def R(e: str, k: int) -> str:
    """SQL for rounding half away from zero on the binary value."""
    return f"(sign({e}) * floor(abs({e}) * 1e{k} + 0.5) / 1e{k})"


def cents(c: str) -> Column:
    """Money as whole cents, so that sums are exact in any order."""
    return F.round(F.col(c) * 100).cast("long")


def CENTS(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


def SUM(e: str) -> str:
    return f"CAST(sum({e}) AS BIGINT)"
