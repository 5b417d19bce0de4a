"""Data-quality checks. Each returns the failing rows: empty means passed."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(RuntimeError):
    """Raised by the gate; ``failures`` maps check name to failing-row count."""

    def __init__(self, failures: dict[str, int]):
        super().__init__(", ".join(f"{k}: {v} rows" for k, v in sorted(failures.items())))
        self.failures = failures


def unique(df: DataFrame, column: str) -> DataFrame:
    return (
        df.filter(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count("*").alias("n_records")).filter("n_records > 1")
    )


def not_null(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    bad = F.col(column).isNull()
    return df.filter(bad if where is None else where & bad)


def accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Values outside the list with their counts; nulls pass."""
    return (
        df.groupBy(F.col(column).alias("value_field")).agg(F.count("*").alias("n_records"))
        .filter(~F.col("value_field").isin(*values))
    )


def group_count(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("game_count")).filter(F.col("game_count") != n)


def row_count(df: DataFrame, n: int) -> DataFrame:
    return df.agg(F.count("*").alias("game_count")).filter(F.col("game_count") != n)


def calibration(df: DataFrame, predicted: str, actual: Column, tolerance: float) -> DataFrame:
    """The totals, if the predicted one is off by more than the tolerance."""
    sums = df.filter(F.col(predicted).isNotNull()).agg(
        F.sum(predicted).alias("predicted_goals"), F.count_if(actual).alias("actual_goals")
    )
    gap = F.abs(F.col("predicted_goals") - F.col("actual_goals"))
    return sums.filter(F.try_divide(gap, F.col("actual_goals")) > tolerance)


def declared_total(df: DataFrame, key: Sequence[str], declared: DataFrame, total: str) -> DataFrame:
    """Batches whose row count differs from the total they declared; no declaration passes."""
    received = df.groupBy(*key).agg(F.count("*").alias("received"))
    return (
        declared.filter(F.col(total).isNotNull()).join(received, list(key), "left")
        .withColumn("received", F.coalesce("received", F.lit(0)))
        .filter(F.col("received") != F.col(total)).select(*key, total, "received")
    )


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], column: str, tolerance: float) -> DataFrame:
    """Keys on which two sources disagree by more than the tolerance."""
    left = a.select(*keys, F.col(column).alias("value_a"))
    right = b.select(*keys, F.col(column).alias("value_b"))
    return left.join(right, list(keys)).filter(F.abs(F.col("value_a") - F.col("value_b")) > tolerance)


@dataclass(frozen=True)
class RowCheck:
    """A check that looks at single rows: the number of rows for which ``bad`` holds. Checks of one table are counted in one pass over it."""

    table: DataFrame
    bad: Column


@dataclass(frozen=True)
class ListCheck:
    """The number of distinct values of ``column`` outside ``values``; nulls pass. Counted in the same pass as the table's other checks."""

    table: DataFrame
    column: str
    values: tuple


@dataclass(frozen=True)
class SizeCheck:
    """One failure if the table does not hold ``n`` rows. Counted in the same pass as the table's other checks."""

    table: DataFrame
    n: int


Check = DataFrame | RowCheck | ListCheck | SizeCheck


def absent(df: DataFrame, column: str, where: Column | None = None) -> RowCheck:
    """``not_null`` as a count."""
    bad = F.col(column).isNull()
    return RowCheck(df, bad if where is None else where & bad)


def _folded(check: RowCheck | ListCheck | SizeCheck) -> Column:
    if isinstance(check, RowCheck):
        return F.count_if(check.bad)
    if isinstance(check, ListCheck):
        outside = ~F.col(check.column).isin(*check.values)
        return F.count_distinct(F.when(outside, F.col(check.column)))
    return F.when(F.count(F.lit(1)) != check.n, 1).otherwise(0).cast("long")


def summary(checks: dict[str, Check]) -> DataFrame:
    """(check, failures) for every check, evaluated as one job.

    Row, list and size checks of one table share one aggregate, so the table is scanned once for all of them. A frame counts its
    own rows: checks that group (unique keys, totals per group) need a shuffle of their own.
    """
    folded: dict[int, dict[str, Check]] = {}
    counts = []
    for name, check in checks.items():
        if isinstance(check, DataFrame):
            counts.append(check.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), "failures"))
        else:
            folded.setdefault(id(check.table), {})[name] = check
    for group in folded.values():
        table = next(iter(group.values())).table
        sums = table.agg(*[_folded(c).alias(f"c{i}") for i, c in enumerate(group.values())])
        pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(f"c{i}").alias("failures")) for i, n in enumerate(group)])
        counts.append(sums.select(F.inline(pairs)))
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def gate(checks: dict[str, Check]) -> dict[str, int]:
    """Stop the caller when any check has failing rows; returns the counts otherwise."""
    counts = {r["check"]: r["failures"] for r in summary(checks).collect()}  # one row per check
    failed = {k: v for k, v in counts.items() if v}
    if failed:
        raise QualityError(failed)
    return counts
