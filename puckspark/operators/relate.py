"""Projections, joins and unions with the semantics the marts rely on."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from puckspark.operators.sizing import dealt, lookup, tasks_for


def rename_select(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """{output: input path}; nested fields by dotted path."""
    return df.select(*[F.col(src).alias(out) for out, src in mapping.items()])


def try_cast_cols(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Casts that yield null instead of failing."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items()})


def qualified(df: DataFrame, c: str, n) -> DataFrame:
    return df.filter(F.col(c) >= n)


def left_chain(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str], rows: int | None = None) -> DataFrame:
    """Left joins on one key; the sides share one hash layout of that key.

    A task holds its part of all sides at once, so they are dealt over tasks by the base's number of ``rows`` where that is known;
    no key may then hold a large part of them.
    """
    tasks = None if rows is None else tasks_for(base.sparkSession, rows)
    return reduce(lambda acc, o: acc.join(dealt(o, tasks, keys), list(keys), "left"), others, dealt(base, tasks, keys))


def attach_within(df: DataFrame, others: Sequence[tuple[DataFrame, Sequence[str]]], by: str, tasks: int | None = None) -> DataFrame:
    """Left joins to tables (frame, keys) with one row a key, where all keys hold the column ``by``; null keys match nothing.

    Rows and tables are dealt by ``by`` together, once, and rows take their values within its groups, so that a window over
    ``by`` moves nothing more; joins would deal the rows by all keys of each. No group of ``by`` may be too large for a task.
    """
    keys = list(dict.fromkeys([by, *[k for _, on in others for k in on]]))
    held = [c for c in df.columns if c not in keys]
    parts = [df.select(*keys, F.struct(*held).alias("_row"))]
    for i, (other, on) in enumerate(others):
        values = F.struct(*[c for c in other.columns if c not in on]).alias(f"_o{i}")
        parts.append(other.dropna(subset=list(on)).select(*on, values))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.repartition(by) if tasks is None else dealt(rows, tasks, [by])
    found = {f"_o{i}": F.max(f"_o{i}").over(Window.partitionBy(*on)) for i, (_, on) in enumerate(others)}
    rows = rows.withColumns(found).filter(F.col("_row").isNotNull())
    return rows.select(
        *[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns],
        *[F.col(f"_o{i}")[c].alias(c) for i, (other, on) in enumerate(others) for c in other.columns if c not in on],
    )


def resolve_via(
    df: DataFrame, bridge: DataFrame, on: str, code: str, attributes: DataFrame
) -> DataFrame:
    """Two hops: id -> code through the full reference, code -> current attributes."""
    sides = [lookup(d, materialise=False) for d in (bridge, attributes)]
    return df.join(sides[0], on, "left").join(sides[1], code, "left")


def with_name(df: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Prefer the dimension's name and fall back to the row's own."""
    dim = lookup(names.select(key, F.col(name).alias("_dim_name")), materialise=False)
    return df.join(dim, key, "left").withColumn(name, F.coalesce("_dim_name", name)).drop("_dim_name")


def with_latest_identity(df: DataFrame, key: str, order: str, attrs: Sequence[str]) -> DataFrame:
    """Every row gets the attributes of its entity's newest row."""
    newest = (
        df.groupBy(key)
        .agg(F.max_by(F.struct(*attrs), order).alias("_id"))
        .select(key, *[F.col(f"_id.{a}").alias(f"latest_{a}") for a in attrs])
    )
    return df.join(lookup(newest), key)


def year_over_year(df: DataFrame, key: str, season: str, now: int, before: int, metric: str) -> DataFrame:
    """Entities present in both seasons with the change of a metric, best first."""
    cur = df.filter(F.col(season) == now).select(key, F.col(metric).alias("current"))
    prev = df.filter(F.col(season) == before).select(key, F.col(metric).alias("previous"))
    return (
        cur.join(prev, key)
        .withColumn("improvement", F.col("current") - F.col("previous"))
        .orderBy(F.desc("improvement"), key)
    )


def played_previous_day(df: DataFrame, entity: str, day: str) -> DataFrame:
    """Rows whose entity also has a row on the day before."""
    days = df.select(F.col(entity).alias("_e"), F.date_add(F.col(day), 1).alias("_next")).distinct()
    cond = (df[entity] == days["_e"]) & (df[day] == days["_next"])
    return df.join(days, cond, "left_semi")


def last_n_rows(df: DataFrame, entity: str, who, position: str, n: int) -> DataFrame:
    """The rows of one entity at its n last positions; positions are unique and have no gaps."""
    return df.filter(F.col(entity) == who).orderBy(F.desc(position)).limit(n).orderBy(position)


def two_perspectives(
    df: DataFrame, shared: Sequence[str], home: dict[str, Column], away: dict[str, Column]
) -> DataFrame:
    """Each game as two rows, one per side, from a single scan."""
    rows = [F.struct(*[c.alias(n) for n, c in side.items()]) for side in (home, away)]
    return df.select(*shared, F.inline(F.array(*rows)))


def stack_sections(sections: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, sections)


def union_seasons(reports: dict[int, DataFrame]) -> DataFrame:
    """All seasons of a report, each row tagged with its season."""
    tagged = [df.withColumn("season_id", F.lit(s).cast("long")) for s, df in reports.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def attach_scores(df: DataFrame, scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows, with the score where one exists."""
    return df.join(scored, list(keys), "left")


def leaders(
    df: DataFrame, section: str, label: Column, sublabel: Column, value: str, key: str, n: int = 10
) -> DataFrame:
    """Global top n as (section, rank, label, sublabel, value); ties broken by ``key``."""
    order = [F.col("value").desc_nulls_last(), F.col("_key")]
    top = df.select(
        F.lit(section).alias("section"), label.alias("label"), sublabel.cast("string").alias("sublabel"),
        F.col(value).cast("double").alias("value"), F.col(key).alias("_key"),
    ).orderBy(*order).limit(n)
    rank = F.row_number().over(Window.partitionBy("section").orderBy(*order))  # n rows at most
    return top.select("section", rank.alias("rank"), "label", "sublabel", "value")
