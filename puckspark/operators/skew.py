"""Joins of rows to a table with one row per key, where a key may hold a third of the rows or be null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.operators.sizing import dealt
from puckspark.session import pin

HOT_SHARE = 200  # a key is hot when it holds more than one in so many rows: there are fewer hot keys than this
PARTS_PER_TASK = 16  # parts that all rows of a hot key would be cut into per shuffle partition


def hot_keys(df: DataFrame, keys: Sequence[str], share: int = HOT_SHARE, counts: DataFrame | None = None) -> DataFrame:
    """(keys, parts) of the keys that hold more than one in ``share`` rows; null keys are left out. Stored, fewer rows than ``share``.

    Counted map-side, unless stored ``counts`` (keys, _n) are given; ``parts`` is in proportion to the key's rows, so that a part is a
    small fraction of a task.
    """
    spark = df.sparkSession
    parts = PARTS_PER_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    if counts is None:
        known = df.select(*keys).dropna()
        total = known.count()
        counts = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    else:
        counts = counts.dropna(subset=list(keys))
        total = counts.agg(F.sum("_n")).first()[0] or 0
    counts = counts.where((F.col("_n") * share > total) & (F.col("_n") > 1))
    share_of = F.ceil(F.col("_n") * F.lit(parts) / F.lit(float(max(total, 1)))).cast("int")
    return pin(counts.select(*keys, share_of.alias("_parts")))


def join_by_key(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left", share: int = HOT_SHARE, counts: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """``left`` joined (left or inner) to ``right``, which holds every key once at most. Null keys match nothing.

    Adaptive execution splits a hot key only where both sides come straight from a shuffle, which an aggregated side does
    not. Here the rows of counted hot keys are dealt over parts and ``right``'s rows of those keys are copied to each;
    rows with a null key bypass the join. ``left`` is read up to three times, so it should be stored; the part of a
    row follows from its place in the stored files, so a retried task deals it alike. ``counts`` (keys, _n) are the rows of each
    key where they are known already. ``tasks`` fixes the number of tasks that the join is dealt over.
    """
    keys = list(keys)
    hot = hot_keys(left, keys, share, counts)
    nulls = F.lit(False)
    for k in keys:
        nulls = nulls | F.col(k).isNull()
    known = left.where(~nulls)
    if hot.isEmpty():
        joined = dealt(known, tasks, keys).join(dealt(right, tasks, keys), keys, how)
    else:
        few = F.broadcast(hot)  # fewer rows than ``share``
        spread = known.withColumn("_at", F.monotonically_increasing_id()).join(few, keys, "left")
        spread = spread.withColumn("_part", F.coalesce(F.pmod(F.col("_at"), F.col("_parts")), F.lit(0)).cast("int")).drop("_at", "_parts")
        copies = right.join(few, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
        whole = [*keys, "_part"]
        joined = dealt(spread, tasks, whole).join(dealt(copies, tasks, whole), whole, how).drop("_part")
    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    joined = joined.select(*columns)
    return joined if how == "inner" else joined.unionByName(left.where(nulls), allowMissingColumns=True)
