"""Season and career arithmetic: era guards, tracked ratios, for/against, careers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.functions.scalars import as_col, ratio, rnd, sdiv
from puckspark.operators.sizing import lookup, null_safe_join


def era_guard(df: DataFrame, part: Sequence[str], guards: dict[str, str]) -> DataFrame:
    """Null out columns in groups where their base stat sums to zero.

    ``guards`` maps column -> base column. Totals are aggregated map-side and joined
    back, so a season with most of the rows is never gathered into one task.
    """
    bases = sorted(set(guards.values()))
    totals = df.groupBy(*part).agg(*[(F.sum(b) > 0).alias(f"_live_{b}") for b in bases])
    joined = null_safe_join(df, lookup(totals), list(part), "left")
    return joined.withColumns({
        c: F.when(F.col(f"_live_{b}"), F.col(c)) for c, b in guards.items()
    }).drop(*[f"_live_{b}" for b in bases])


def ratio_of_sums(n, d, k: int) -> Column:
    return ratio(F.sum(as_col(n)), F.sum(as_col(d)), k)


def tracked_ratio(n, d, k: int) -> Column:
    """Sum of n over sum of d, using n only where d was recorded."""
    d = as_col(d)
    return ratio(F.sum(F.when(d.isNotNull(), as_col(n))), F.sum(d), k)


def career(
    seasons: DataFrame, key: str, season: str, identity: dict[str, str], aggs: Sequence[Column]
) -> DataFrame:
    """One row per entity: attributes of its newest season plus totals, in one shuffle."""
    newest = F.max_by(F.struct(*[F.col(c).alias(o) for o, c in identity.items()]), season)
    return (
        seasons.groupBy(key)
        .agg(newest.alias("_id"), *aggs)
        .select(key, "_id.*", *_names_after(seasons, key, aggs))
    )


def _names_after(seasons: DataFrame, key: str, aggs: Sequence[Column]) -> list[str]:
    return seasons.groupBy(key).agg(*aggs).columns[1:]


def for_against(
    df: DataFrame, own: str, other: str, keys: Sequence[str], measures: dict[str, Column], out: str
) -> DataFrame:
    """Each measure summed for a side and against it, for sides that have both.

    One scan: every row is counted once for its owner and once against the other side.
    """
    sides = df.select(
        *keys,
        F.explode(F.array(
            F.struct(F.col(own).alias("side"), F.lit(True).alias("is_for")),
            F.struct(F.col(other).alias("side"), F.lit(False).alias("is_for")),
        )).alias("_s"),
        *[m.alias(f"_m_{n}") for n, m in measures.items()],
    ).select(*keys, F.col("_s.side").alias(out), F.col("_s.is_for").alias("_for"), *[f"_m_{n}" for n in measures])
    mine, theirs = F.col("_for"), ~F.col("_for")
    return (
        sides.groupBy(out, *keys)
        .agg(
            F.count_if(mine).alias("_rows_for"),
            F.count_if(theirs).alias("_rows_against"),
            *[F.sum(F.when(mine, F.col(f"_m_{n}"))).alias(f"{n}_for") for n in measures],
            *[F.sum(F.when(theirs, F.col(f"_m_{n}"))).alias(f"{n}_against") for n in measures],
        )
        .filter((F.col("_rows_for") > 0) & (F.col("_rows_against") > 0) & F.col(out).isNotNull())
        .drop("_rows_for", "_rows_against")
    )


def share(own, other, k: int = 4) -> Column:
    return rnd(sdiv(own, as_col(own) + as_col(other)), k)
