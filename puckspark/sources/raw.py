"""Readers for landed files and small generated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from puckspark.functions.scalars import season_of_year
from puckspark.sources.schemas import LOADED_AT, RAW


def read_raw(spark: SparkSession, folder: str, table: str, default_season: int | None = None) -> DataFrame:
    """One landed feed (newline-delimited JSON) under its declared schema; a broken line fails the read.

    Standings rows take their season from ``seasonId`` or the given default.
    """
    df = spark.read.schema(RAW[table]).option("mode", "FAILFAST").json(f"{folder}/{table}.ndjson")
    if table == "raw_standings":
        df = season_fallback(df, default_season)
    return df


def season_fallback(df: DataFrame, default: int | None, season: str = "season_id", source: str = "seasonId") -> DataFrame:
    """Keep the season, else the row's own feed season, else the default."""
    value = F.coalesce(season, source, F.lit(default).cast("long"))
    return df.withColumn(season, value).drop(source)


def stamp_loaded(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn(LOADED_AT, F.lit(ts).cast("timestamp"))


def read_payloads(spark: SparkSession, glob: str) -> DataFrame:
    """One JSON document per file, kept as text in ``payload``."""
    return spark.read.text(glob, wholetext=True).select(F.col("value").alias("payload"))


def wrap_payload(df: DataFrame, key: str, season) -> DataFrame:
    """Each row as (game_id, season_id, JSON text of the whole row)."""
    return df.select(
        F.col(key).alias("game_id"), F.lit(season).cast("long").alias("season_id"),
        F.to_json(F.struct("*")).alias("payload"),
    )


def season_spine(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Every season from the first starting year to the last, as 8-digit ids."""
    return spark.range(first, last + 1).select(season_of_year("id").alias("season_id"))


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A published table by name."""
    return spark.read.parquet(f"{root}/{name}")
