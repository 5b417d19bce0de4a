"""Shards of near equal bytes by sampled splitters.

Records are ordered by a hash of their text, so copies lie side by side. A sample of the keys, drawn
with chances in proportion to their bytes, gives splitters for many fine ranges; ranges that turn out
overfull are split again; then whole ranges fill the shards one after the other. A group of copies that alone
is larger than a fine range is placed first, and divided by its rows' positions only when it exceeds a shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from puckspark.llm.rows import row_keyed
from puckspark.operators.ordered import sequence_number
from puckspark.operators.sizing import lookup
from puckspark.session import pin

RANGES_PER_SHARD = 128  # fine ranges; a shard's bytes differ from the mean by about two of them at most
SAMPLES_PER_RANGE = 16


def _range_of(splitters: list[int]):
    """Column function: number of splitters not above the key."""
    cuts = np.array(splitters, np.int64)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    return place


def _sampled(groups: DataFrame, rate: float) -> list[tuple[int, float]]:
    """(key, weight) of keys kept with a chance of rate * bytes, 1 at most; the weight is bytes over chance."""
    unit = (F.shiftrightunsigned(F.xxhash64("key", F.lit(5)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    chance = F.least(F.lit(1.0), F.col("bytes") * F.lit(float(rate)))
    return [(r[0], r[1]) for r in groups.where(unit < chance).select("key", F.col("bytes") / chance).collect()]


def _quantiles(sample: list[tuple[int, float]], ranges: int) -> list[int]:
    """Keys that cut the sample into ranges of equal weight."""
    if not sample:
        return []
    sample.sort()
    keys, upto = np.array([k for k, _ in sample], np.int64), np.cumsum([w for _, w in sample])
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return np.unique(keys[at]).tolist()


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row; size is the UTF-8 bytes of the text plus 1.

    Null counts as the empty text. Shards follow from the texts alone, so rows without an id or with the id of others are placed like
    any. Rows with equal texts share a shard unless together they exceed one, and are then divided by their positions; shards
    hold near equal bytes as long as no text alone exceeds a shard. Slots number the rows of a shard from 0 without gaps, by key, id
    and place. An empty table gives no rows. Other columns are ignored.

    To the driver come a sample of keys and one total per fine range, both bounded by ``shards`` and ``ranges_per_shard``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"), F.monotonically_increasing_id().alias("row"),
    )
    return _assigned(pin(own), shards, ranges_per_shard).drop("row")


def _assigned(own: DataFrame, shards: int, ranges_per_shard: int) -> DataFrame:
    """``assign_shards`` for stored rows (id, size, crc, key, row), of which it keeps ``row``."""
    groups = pin(own.groupBy("key").agg(F.sum("size").alias("bytes")))
    total = groups.agg(F.sum("bytes")).first()[0] or 0
    fine = shards * ranges_per_shard
    least = max(1.0, total / fine)
    heavy = {r[0]: r[1] for r in groups.where(F.col("bytes") > least).collect()}  # fewer than ``fine`` groups
    light = groups.where(F.col("bytes") <= least)
    splitters = _quantiles(_sampled(light, SAMPLES_PER_RANGE * fine / max(total, 1)), fine)
    for _ in range(3):
        place = _range_of(splitters)
        sums = {r[0]: r[1] for r in light.groupBy(place("key").alias("r")).agg(F.sum("bytes")).collect()}
        full = [r for r, b in sums.items() if b > 2 * least]
        if not full:
            break
        # a denser sample inside the overfull ranges only
        dense = light.withColumn("r", place("key")).where(F.col("r").isin(full))
        rate = 4 * SAMPLES_PER_RANGE * fine / max(total, 1)
        extra: dict[int, list[tuple[int, float]]] = {}
        for k, w in _sampled(dense, rate):
            extra.setdefault(int(np.searchsorted(splitters, k, "right")), []).append((k, w))
        more = [q for r, s in extra.items() for q in _quantiles(s, int(2 * sums[r] / least) + 1)]
        if not set(more) - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    place = _range_of(splitters)
    sums = {r[0]: r[1] for r in light.groupBy(place("key").alias("r")).agg(F.sum("bytes")).collect()}

    goal = total / shards if shards else 0
    load = [0.0] * shards
    parts: dict[int, list[tuple[int, float]]] = {}  # heavy key -> (shard, share of its rows)
    for key, size in sorted(heavy.items(), key=lambda x: (-x[1], x[0])):
        left = float(size)
        while left > 0:
            s = min(range(shards), key=lambda i: (load[i], i))
            take = left if left <= max(goal - load[s], 0) or load[s] > 0 and left <= goal else min(left, max(goal - load[s], least))
            parts.setdefault(key, []).append((s, take / size))
            load[s] += take
            left -= take
    shard_of, s = [], 0
    for r in range(len(splitters) + 1):
        size = sums.get(r, 0)
        while s < shards - 1 and load[s] + size / 2 > goal:
            s += 1
        shard_of.append(s)
        load[s] += size
    return _numbered(own, splitters, shard_of, parts)


def _numbered(own: DataFrame, splitters: list[int], shard_of: list[int], parts: dict[int, list[tuple[int, float]]]) -> DataFrame:
    """Shard and slot of every row, given the shard of every range and of every part of a heavy group."""
    cuts, shards = np.array(splitters, np.int64), np.array(shard_of, np.int32)
    whole = {k: v[0][0] for k, v in parts.items() if len(v) == 1}
    divided = [(k, i, s, float(b)) for k, v in parts.items() if len(v) > 1 for i, ((s, _), b) in enumerate(zip(v, np.cumsum([x for _, x in v])))]
    whole_keys = np.array(sorted(whole), np.int64)
    whole_shards = np.array([whole[k] for k in whole_keys.tolist()], np.int32)

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        keys = key.to_numpy()
        out = shards[np.searchsorted(cuts, keys, "right")]
        if len(whole_keys):
            at = np.minimum(np.searchsorted(whole_keys, keys), len(whole_keys) - 1)
            out = np.where(whole_keys[at] == keys, whole_shards[at], out)
        return pd.Series(out)

    columns = ["id", "size", "crc", "key", "row"]
    if divided:  # groups larger than a shard: fewer than there are shards
        spark = own.sparkSession
        bounds = F.broadcast(spark.createDataFrame([(k, [x[2] for x in divided if x[0] == k], [x[3] for x in divided if x[0] == k]) for k in sorted({x[0] for x in divided})],
                                                   "key long, into array<int>, upto array<double>"))
        heavy = sequence_number(own.join(bounds.select("key"), "key", "left_semi"), ["key"], ["id", "row"], "at")
        totals = F.broadcast(heavy.groupBy("key").agg(F.count(F.lit(1)).alias("n")))
        share = (F.col("at") - 0.5) / F.col("n")
        part = F.least(F.size("into") - 1, F.size(F.filter("upto", lambda u: u <= share)))
        placed = heavy.join(bounds, "key").join(totals, "key").select(*columns, F.get("into", part).alias("shard"))
        placed = own.join(bounds.select("key"), "key", "left_anti").select(*columns, place("key").alias("shard")).unionByName(placed)
    else:
        placed = own.select(*columns, place("key").alias("shard"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            shard = batch.column("shard").to_numpy()
            at = np.empty(len(shard), np.int64)
            for s in np.unique(shard):
                rows = np.flatnonzero(shard == s)
                at[rows] = seen.get(s, 0) + np.arange(len(rows))
                seen[s] = seen.get(s, 0) + len(rows)
            yield pa.RecordBatch.from_arrays([
                *(batch.column(k) for k in ("id", "size", "crc", "row", "shard")), pa.array(np.full(len(shard), part, np.int32)), pa.array(at),
            ], names=["id", "size", "crc", "row", "shard", "part", "at"])

    order = ["shard", "key", "id", "row"]
    spread = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = pin(spread.mapInArrow(count, "id long, size long, crc long, row long, shard int, part int, at long"))
    # one row per task and shard it holds
    ahead = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "ahead", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(F.broadcast(ahead.drop("n")), ["shard", "part"]).select(
        "id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("at") + F.col("ahead")).alias("slot"), "row")


def sharded_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, ranges_per_shard: int = RANGES_PER_SHARD) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``, both replaced if present. Every row gets the place that ``assign_shards`` gives to it, whatever its id:
    rows are numbered, placed by narrow columns, and meet their place by number, so texts travel once."""
    plain = docs.drop("shard", "slot")
    keyed = row_keyed(plain)
    text = F.coalesce(F.col("doc")[text_col], F.lit(""))
    own = pin(keyed.select(
        F.col("doc")[id_col].cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"), F.xxhash64(text).alias("key"), "row"))
    got = _assigned(own, shards, ranges_per_shard).select("row", "shard", "slot")
    return keyed.join(lookup(got), "row").select("doc.*", "shard", "slot")
