"""Order-dependent operators: numbering, trailing frames, carried values, percentiles.

Each has two exact forms. When every group fits one task (checked), it is a plain
window. Otherwise rows are range-partitioned by (group, order), so that a group may
span many tasks, and only one total or last value per task is combined across them.
``order`` must be unique inside a group in both forms.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from puckspark.operators.sizing import dealt, has_large_group, lookup, null_safe_join, tasks_for
from puckspark.operators.skew import join_by_key
from puckspark.session import broadcast_rows, group_rows, pin

Order = Sequence[Column | str]
SEG = "_seg"


def _cols(order: Order) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in order]


def segmented(df: DataFrame, part: Sequence[str], order: Order) -> DataFrame:
    """Rows with a ``_seg`` number that rises with (part, order).

    The range bounds are sampled, so the result is written once: every later use,
    and every retry, sees the same segments. Their number grows with the rows.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // group_rows(spark)))
    ranged = df.repartitionByRange(n, *[F.col(p) for p in part], *_cols(order))
    return pin(ranged.withColumn(SEG, F.spark_partition_id()))


def _continuations(seg: DataFrame, part: Sequence[str], aggs: list[Column], carry: Callable[[WindowSpec], list[Column]]) -> DataFrame:
    """Values entering a segment from the earlier segments of the same group.

    A range boundary cuts at most one group, so there are fewer rows here than
    segments: the result is safe to broadcast whatever the data size.
    """
    per = seg.groupBy(*part, SEG).agg(*aggs)
    group = Window.partitionBy(*part)
    spanning = per.withColumn("_segs", F.count("*").over(group)).filter("_segs > 1")
    before = group.orderBy(SEG).rowsBetween(Window.unboundedPreceding, -1)
    carried = spanning.select(
        *part, SEG, *carry(before), F.row_number().over(group.orderBy(SEG)).alias("_nth")
    )
    return F.broadcast(carried.filter("_nth > 1").drop("_nth"))


def running_total(
    df: DataFrame, part: Sequence[str], order: Order, value: Column, out: str, large: bool | None = None
) -> DataFrame:
    """Sum of ``value`` over the rows of the group up to and including this one."""
    if large is None:
        large = has_large_group(df, part)
    upto = Window.unboundedPreceding, Window.currentRow
    if not large:
        w = Window.partitionBy(*part).orderBy(*_cols(order)).rowsBetween(*upto)
        return df.withColumn(out, F.sum(value).over(w))
    seg = segmented(df.withColumn("_add", value), part, order)
    base = _continuations(
        seg, part, [F.sum("_add").alias("_seg_sum")], lambda before: [F.sum("_seg_sum").over(before).alias("_before")]
    )
    w = Window.partitionBy(*part, SEG).orderBy(*_cols(order)).rowsBetween(*upto)
    local = seg.withColumn(out, F.sum("_add").over(w))
    joined = null_safe_join(local, base, [*part, SEG], "left")
    # as in the plain form, the total is null until the first value
    both = F.when(F.col(out).isNotNull() & F.col("_before").isNotNull(), F.col(out) + F.col("_before"))
    kind = df.select(F.sum(value).alias("v")).schema["v"].dataType
    return joined.withColumn(out, F.coalesce(both, out, "_before").cast(kind)).drop("_add", SEG, "_before")


def sequence_number(
    df: DataFrame, part: Sequence[str], order: Order, out: str, large: bool | None = None
) -> DataFrame:
    """1-based position of each row in its group."""
    if large is None:
        large = has_large_group(df, part)
    if not large:
        w = Window.partitionBy(*part).orderBy(*_cols(order))
        return df.withColumn(out, F.row_number().over(w).cast("long"))
    return running_total(df, part, order, F.lit(1).cast("long"), out, large=True)


def windowed(
    df: DataFrame,
    part: Sequence[str],
    order: Order,
    reach: int,
    build: Callable[[WindowSpec], dict[str, Column]],
    number: str | None = None,
    large: bool | None = None,
) -> DataFrame:
    """Window expressions that look back at most ``reach`` rows (lags, trailing frames).

    ``build`` receives the ordered window and returns {output: expression};
    ``number`` also adds the row's position under that name. Large groups are cut into
    blocks of positions, each with the last ``reach`` rows of the block before it.
    """
    if large is None:
        large = has_large_group(df, part)
    if not large:
        w = Window.partitionBy(*part).orderBy(*_cols(order))
        extra = {number: F.row_number().over(w).cast("long")} if number else {}
        return df.withColumns({**extra, **build(w)})
    pos = number or "_pos"
    block_rows = max(group_rows(df.sparkSession), reach + 1)
    rows = sequence_number(df, part, order, pos, large=True)
    block = F.floor((F.col(pos) - 1) / block_rows)
    tail = (F.col(pos) - 1) % block_rows >= block_rows - reach
    rows = rows.withColumn("_home", block).withColumn(
        "_block", F.explode(F.when(tail, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home")))
    )
    w = Window.partitionBy(*part, "_block").orderBy(pos)
    done = rows.withColumns(build(w)).filter("_home = _block").drop("_home", "_block")
    return done if number else done.drop("_pos")


def carry_last(
    df: DataFrame,
    part: Sequence[str],
    order: Order,
    values: dict[str, Column],
    include_current: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """For each output the latest non-null value at earlier rows (or up to this row)."""
    if large is None:
        large = has_large_group(df, part)
    end = Window.currentRow if include_current else -1
    if not large:
        w = Window.partitionBy(*part).orderBy(*_cols(order)).rowsBetween(Window.unboundedPreceding, end)
        return df.withColumns({o: F.last(v, ignorenulls=True).over(w) for o, v in values.items()})
    held = {o: f"_v_{o}" for o in values}
    seg = segmented(df.withColumns({held[o]: v for o, v in values.items()}), part, order)
    rank_in_seg = Window.partitionBy(*part, SEG).orderBy(*_cols(order))
    local_w = rank_in_seg.rowsBetween(Window.unboundedPreceding, end)
    seg = seg.withColumns({
        "_at": F.row_number().over(rank_in_seg),
        **{o: F.last(held[o], ignorenulls=True).over(local_w) for o in values},
    })
    aggs = [
        F.max_by(h, F.when(F.col(h).isNotNull(), F.col("_at"))).alias(f"_t_{o}") for o, h in held.items()
    ]
    base = _continuations(
        seg, part, aggs,
        lambda before: [F.last(f"_t_{o}", ignorenulls=True).over(before).alias(f"_b_{o}") for o in values],
    )
    joined = null_safe_join(seg, base, [*part, SEG], "left")
    joined = joined.withColumns({o: F.coalesce(F.col(o), F.col(f"_b_{o}")) for o in values})
    return joined.drop(SEG, "_at", *held.values(), *[f"_b_{o}" for o in values])


def percentile_within(
    df: DataFrame,
    part: Sequence[str],
    metrics: dict[str, str],
    qualified: Column,
    rounded: Callable[[Column], Column] = lambda c: c,
    large: bool | None = None,
) -> DataFrame:
    """percent_rank of each metric among the qualified rows of its group; null for the rest.

    Metrics are compared as doubles. Nulls sort first, so they take rank 0 and still count as rows. A window would hold a group's whole rows once for every
    metric, so rows are only counted by value, the counts run up in value order, and the share below each value is looked up:
    in a broadcast table for metrics with few enough values, in one join of the rows for the others. ``large`` fixes the
    form: False is the plain window, True the join for all metrics.
    """
    df = df.withColumn("_q", F.coalesce(qualified, F.lit(False)))
    names = [c for c in df.columns if c != "_q"]
    if large is False:
        ranked = df.withColumns({
            o: F.percent_rank().over(Window.partitionBy(*part, "_q").orderBy(m)) for o, m in metrics.items()
        })
        return ranked.withColumns({o: F.when(F.col("_q"), rounded(F.col(o))) for o in metrics}).drop("_q")
    stored = pin(df.withColumn("_row", F.monotonically_increasing_id()))
    below = _shares_below(stored.filter("_q"), part, list(metrics.values()), large)
    room, near = broadcast_rows(df.sparkSession), []
    if not large:
        for m, n in sorted(below.groupBy("_m").count().collect(), key=lambda r: (r[1], r[0])):  # a row for each metric
            if n <= room:
                room -= n
                near.append(m)
    far = [i for i in range(len(metrics)) if i not in near]
    out = _with_joined_shares(stored, below, part, metrics, far) if far else stored
    for i in near:
        m = list(metrics.values())[i]
        few = below.filter(F.col("_m") == i).select(*part, F.col("_v").alias(f"_v{i}"), F.col("_p").alias(f"_p{i}"))
        out = null_safe_join(out.withColumn(f"_v{i}", F.col(m).cast("double")), F.broadcast(few), [*part, f"_v{i}"], "left").drop(f"_v{i}")
    shares = {o: F.when(F.col("_q"), rounded(F.col(f"_p{i}"))).alias(o) for i, o in enumerate(metrics)}
    return out.select(*[shares[c] if c in shares else c for c in [*names, *[o for o in metrics if o not in names]]])


def _shares_below(pool: DataFrame, part: Sequence[str], values: list[str], large: bool | None) -> DataFrame:
    """(part, _m, _v, _n, _p): rows with each distinct value of each metric, and the share of the group's other rows below it. Stored."""
    sizes = pool.groupBy(*part).agg(F.count("*").alias("_rows"))
    each = F.posexplode(F.array(*[F.col(v).cast("double") for v in values])).alias("_m", "_v")
    counts = pin(pool.select(*part, each).groupBy(*part, "_m", "_v").agg(F.count("*").alias("_n")))
    upto = running_total(counts, [*part, "_m"], [F.col("_v").asc_nulls_first()], F.col("_n"), "_upto", large=large)
    upto = null_safe_join(upto, lookup(sizes), list(part), "inner")
    return pin(upto.select(
        *part, "_m", "_v", "_n", F.coalesce(F.try_divide(F.col("_upto") - F.col("_n"), F.col("_rows") - 1), F.lit(0.0)).alias("_p")))


def _with_joined_shares(stored: DataFrame, below: DataFrame, part: Sequence[str], metrics: dict[str, str], far: list[int]) -> DataFrame:
    """The stored rows (_row, _q) with ``_p<i>`` of the metrics in ``far``, by one join for all of them; frequent values are dealt over parts."""
    pool = stored.filter("_q")
    names = [c for c in stored.columns if c != "_row"]
    # a struct is never null, and nulls inside are equal to each other
    key = F.struct(*[F.col(p).alias(f"k{i}") for i, p in enumerate(part)], "_m", "_v").alias("_key")
    below = pin(below.filter(F.col("_m").isin(far)).select(key, "_n", "_p"))
    cells = [F.struct(F.lit(i).alias("_m"), F.col(list(metrics.values())[i]).cast("double").alias("_v")) for i in far]
    # a row's columns travel with its first metric only
    spread = pool.select("_row", F.struct(*names).alias("_doc"), *part, F.inline(F.array(*cells)))
    spread = spread.select("_row", F.when(F.col("_m") == far[0], F.col("_doc")).alias("_doc"), key)
    tasks = tasks_for(stored.sparkSession, pool.count() * len(far))
    found = join_by_key(spread, below.select("_key", "_p"), ["_key"], "inner", counts=below.select("_key", "_n"), tasks=tasks)
    back = dealt(found, tasks, ["_row"]).groupBy("_row").agg(
        F.any_value("_doc", F.lit(True)).alias("_doc"),
        *[F.max(F.when(F.col("_key._m") == i, F.col("_p"))).alias(f"_p{i}") for i in far],
    )
    ranked = back.select(*[F.col("_doc")[c].alias(c) for c in names], *[f"_p{i}" for i in far])
    rest = stored.filter("not _q").select(*names, *[F.lit(None).cast("double").alias(f"_p{i}") for i in far])
    return ranked.unionByName(rest)


HISTOGRAM_BITS = 12


def nth_rows(df: DataFrame, part: Sequence[str], value: str, ties: Sequence[str], targets: DataFrame, large_rows: int | None = None) -> DataFrame:
    """(part, cut): for each group the struct (value, ties) of the row at position ``target`` under that order, from 1.

    ``value`` is a long whose bits are spread evenly, such as a hash; ``targets`` holds (part, target) and is small. Rows are only
    counted by their leading bits, map-side, and of the group's one bucket that holds the position by the next ones, until
    a bucket fits a task; only that bucket's rows are ordered. ``df`` is read once a round, so it should be stored.
    """
    limit = large_rows or group_rows(df.sparkSession)
    part, ties = list(part), list(ties)
    flipped = F.col(value).bitwiseXOR(F.lit(-(1 << 63)).cast("long"))  # unsigned order of the flipped is signed order of the value
    head = lambda b: F.shiftrightunsigned(flipped, 64 - b) if b else F.lit(0).cast("long")
    now = pin(targets.where("target > 0").select(*part, F.lit(0).cast("long").alias("_head"), F.col("target").alias("_left")))
    bits = 0
    while True:
        bits += HISTOGRAM_BITS
        inside = null_safe_join(df.select(*part, head(bits - HISTOGRAM_BITS).alias("_head"), head(bits).alias("_next")), lookup(now, materialise=False), [*part, "_head"])
        counts = inside.groupBy(*part, "_next", "_left").agg(F.count(F.lit(1)).alias("_n"))  # at most 2^HISTOGRAM_BITS rows a group
        upto = F.sum("_n").over(Window.partitionBy(*part).orderBy("_next"))
        found = counts.withColumn("_upto", upto).where("_upto >= _left and _upto - _n < _left")
        now = pin(found.select(*part, F.col("_next").alias("_head"), (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_n"))
        if bits + HISTOGRAM_BITS > 64 or now.where(F.col("_n") > limit).isEmpty():
            break
    rows = null_safe_join(df.select(*part, value, *ties, head(bits).alias("_head")), lookup(now.drop("_n"), materialise=False), [*part, "_head"])
    place = F.row_number().over(Window.partitionBy(*part).orderBy(value, *ties))
    return rows.withColumn("_place", place).where("_place = _left").select(*part, F.struct(value, *ties).alias("cut"))


def top_k_per(df: DataFrame, part: Sequence[str], order: Order, k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group. Spark cuts each group to k rows before the shuffle
    (window group limit), so a hot group never travels whole; it does so up to a
    configured k, beyond which the rows are numbered with the split plan."""
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if k > limit:
        return sequence_number(df, part, order, rank).filter(F.col(rank) <= k)
    w = Window.partitionBy(*part).orderBy(*_cols(order))
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("long"))


def latest_per(df: DataFrame, part: Sequence[str], order: Order) -> DataFrame:
    """One row per key: the first under ``order`` (newest load, newest season)."""
    return top_k_per(df, part, order, 1, "_first").drop("_first")
