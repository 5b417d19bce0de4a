"""Size checks that decide between the plain and the split form of a plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from puckspark.session import broadcast_rows, group_rows, pin_counted, shuffles_end, task_rows


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    """Tasks over which so many rows are dealt before they are sorted; None where every core gets fewer than a task may hold anyway.

    Adaptive execution merges partitions by their compressed size, of which a task's memory may be twenty times; it leaves a
    number of tasks that was asked for alone.
    """
    n = -(-rows // task_rows(spark))
    return max(n, int(spark.conf.get("spark.sql.shuffle.partitions"))) if n > spark.sparkContext.defaultParallelism else None


def dealt(df: DataFrame, tasks: int | None, keys: Sequence[str]) -> DataFrame:
    """Rows laid out by a hash of the keys over so many tasks; as they are when ``tasks`` is None."""
    return df if tasks is None else df.repartition(tasks, *keys)


def has_large_group(df: DataFrame, keys: Sequence[str]) -> bool:
    """True when some key holds more rows than one window task should."""
    limit = group_rows(df.sparkSession)
    with shuffles_end(df.sparkSession):
        return not df.groupBy(*keys).count().filter(F.col("count") > limit).isEmpty()


def lookup(df: DataFrame, materialise: bool = True) -> DataFrame:
    """A join side: broadcast once its row count is known to be small, shuffled otherwise
    (Spark then splits skewed partitions of the other side itself).

    The frame is written first and counted on the way, so the check does not compute it
    twice. Pass ``materialise=False`` for a stored table, whose count is cheap.
    """
    limit = broadcast_rows(df.sparkSession)
    if materialise:
        df, n = pin_counted(df)
    else:
        n = df.count()
    return F.broadcast(df) if n <= limit else df


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match each other; the right side's keys are dropped."""
    other = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond: Column = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(other[f"_r_{k}"])
    return left.join(other, cond, how).drop(*[f"_r_{k}" for k in keys])
