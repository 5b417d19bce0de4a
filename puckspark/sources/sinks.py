"""Writers. Rows are counted while they are written."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

RUN = "_run"  # partition of a served table that tells its run
_SERVED = "at long, run string"


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def publish(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Replace a table in full and return its row count."""
    out, seen = _counted(df)
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return seen.get["n"]


def write_ndjson(df: DataFrame, path: str) -> int:
    """Newline-delimited JSON with explicit nulls."""
    out, seen = _counted(df)
    out.write.mode("overwrite").json(path, ignoreNullFields=False)
    return seen.get["n"]


def append_log(df: DataFrame, path: str, question_chars: int | None = None, sql_chars: int | None = None) -> None:
    """Append interactions (question, answer_chars, sql array, row_count, duration_ms,
    status, model). Texts are logged whole unless a number of characters is given."""
    log_rows(df, question_chars, sql_chars).write.mode("append").json(path, ignoreNullFields=False)


def log_rows(df: DataFrame, question_chars: int | None = None, sql_chars: int | None = None) -> DataFrame:
    cut = lambda c, n: c if n is None else F.substring(c, 1, n)
    return df.select(
        F.current_timestamp().alias("created_at"),
        cut(F.col("question"), question_chars).alias("question"),
        "answer_chars",
        cut(F.array_join("sql", "\n---\n"), sql_chars).alias("sql_queries"),
        F.size("sql").alias("sql_count"),
        "row_count", "duration_ms", "status", "model",
    )


def _database(spark: SparkSession, layer: str, location: str | None) -> None:
    where = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {layer}{where}")


def register(spark: SparkSession, layer: str, paths: dict[str, str], location: str | None = None) -> None:
    """Name published tables ``layer.table`` for SQL, as views over their files; the data stay where they are. A name that
    exists is replaced in one step. ``location`` is the folder of a database made anew (default: the session's)."""
    _database(spark, layer, location)
    for name, path in paths.items():
        spark.sql(f"CREATE OR REPLACE VIEW {layer}.{name} AS SELECT * FROM parquet.`{path}`")


def run_path(folder: str, name: str, columns: Sequence[str], run: str) -> str:
    """Where a run's table lies: tables of equal columns are parts of one folder, so that one view serves all runs."""
    shape = hashlib.md5(",".join(columns).encode()).hexdigest()[:8]
    return f"{folder}/{name}/v{shape}/{RUN}=r{run}"


def serve_run(spark: SparkSession, layer: str, folder: str, run: str, tables: dict[str, Sequence[str]], location: str | None = None) -> None:
    """Let the names ``layer.table`` mean a run's tables ({name: columns}, written to ``run_path``), all from one moment on.

    The views read the run that the last row of ``folder/_served`` names. Appending that row is the only step of the switch:
    a query sees all tables of one run or of the other, and a failure before it leaves everything as it was. Only a table whose
    columns changed needs a new view, which is made after the switch; until then its name has no rows.
    """
    log = f"{folder}/_served"
    try:
        last = spark.read.schema(_SERVED).parquet(log).agg(F.max("at")).first()[0] or 0
    except AnalysisException:  # nothing was served from this folder so far
        last = 0
    spark.createDataFrame([(last + 1, f"r{run}")], _SERVED).coalesce(1).write.mode("append").parquet(log)
    _database(spark, layer, location)
    for name, columns in tables.items():
        listed = ", ".join(f"`{c}`" for c in columns)
        whole = run_path(folder, name, columns, run).rsplit("/", 1)[0]
        spark.sql(f"CREATE OR REPLACE VIEW {layer}.{name} AS SELECT {listed} FROM parquet.`{whole}` WHERE {RUN} = (SELECT max_by(run, at) FROM parquet.`{log}`)")
