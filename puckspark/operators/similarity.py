"""Weighted nearest neighbours by cosine inside pools of any size.

Equal vectors are compared once, with the lowest of their ids as a list. Large pools are cut into blocks around sampled centres; a
block is summed up by its centre and angular radius. Every block is compared with itself first, which gives each vector a score that
the rest must reach. Then only the blocks whose summaries allow such a score pass by, and each vector keeps its best so far.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from puckspark.operators.ordered import top_k_per
from puckspark.operators.sizing import lookup, null_safe_join
from puckspark.operators.skew import join_by_key
from puckspark.session import pin

WHOLE_ROWS = 4096  # pools up to so many rows are compared as they are
BLOCK_ROWS = 32768  # vectors of a block; more when all pools together would get over MAX_BLOCKS blocks
MAX_BLOCKS = 16384  # so many centres at most come to the driver and go to every task
PASSING_BLOCKS = 16  # blocks that pass by the vectors of one task
CHUNK_ROWS = 512  # vectors of one block scored at a time
PASSING_ROWS = 4096  # against so many others
EXACT_PAIRS = 1 << 18  # pairs whose scores are worked out in full at a time
TIE_DIGITS = 12  # scores equal to this many digits are ordered by id
SLACK = 1e-9  # by which a bound may be off through rounding


def zscore(df: DataFrame, part: Sequence[str], features: Sequence[str], out: str = "vec") -> DataFrame:
    """Feature vector per row: mean-imputed, then standardised within its group.

    The deviation is the population one over the imputed rows; a constant or never
    recorded feature becomes 0. One aggregation: imputing the mean leaves the mean
    alone and adds nothing to the squared deviations.
    """
    stats = []
    for f in features:
        spread = F.var_pop(f) * F.count(f) / F.count("*")
        stats += [F.avg(f).alias(f"_mean_{f}"), F.sqrt(spread).alias(f"_sd_{f}")]
    joined = null_safe_join(df, lookup(df.groupBy(*part).agg(*stats)), list(part))

    def z(f: str):
        centred = F.col(f).cast("double") - F.col(f"_mean_{f}")
        return F.coalesce(F.when(F.col(f"_sd_{f}") > 0, centred / F.col(f"_sd_{f}")), F.lit(0.0))

    work = [f"_{s}_{f}" for f in features for s in ("mean", "sd")]
    return joined.withColumn(out, F.array(*[z(f) for f in features])).drop(*work)


def blend_prior(current: DataFrame, prior: DataFrame, key: Sequence[str], weight: float = 0.25, vec: str = "vec") -> DataFrame:
    """(1 - weight) * current + weight * prior; rows without a prior keep their vector."""
    before = prior.select(*key, F.col(vec).alias("_prior"))
    mixed = F.zip_with(vec, "_prior", lambda c, p: c * (1 - weight) + p * weight)
    return (
        current.join(before, list(key), "left")
        .withColumn(vec, F.when(F.col("_prior").isNull(), F.col(vec)).otherwise(mixed)).drop("_prior")
    )


def apply_profiles(df: DataFrame, features: Sequence[str], profiles: dict[str, dict[str, float]], vec: str = "vec") -> DataFrame:
    """One row per profile with the features scaled by the square root of their weight (default 1)."""
    scaled = [
        F.struct(F.lit(name).alias("profile"), F.array(*[
            F.col(vec)[i] * float(weights.get(f, 1.0)) ** 0.5 for i, f in enumerate(features)
        ]).alias("_scaled"))
        for name, weights in profiles.items()
    ]
    keep = [c for c in df.columns if c != vec]
    return df.select(*keep, F.inline(F.array(*scaled))).withColumnRenamed("_scaled", vec)


def unit(vec: str):
    """The vector at length 1; a zero vector stays zero, so its cosine is 0."""
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(vec, lambda x: F.coalesce(F.try_divide(x, norm), F.lit(0.0)))


def _leading(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the k largest finite entries per row; equal entries by lower column."""
    width = score.shape[1]
    floor = np.partition(score, width - k, axis=1)[:, width - k, None] if width > k else -np.inf
    row, col = np.nonzero((score >= floor) & (score > -np.inf))
    by = np.lexsort((col, -score[row, col], row))
    row, col = row[by], col[by]
    place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return row[place < k], col[place < k]


def _best(seek_ids: np.ndarray, seek: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position of the seeker, id found, score): the k best vectors for every seeker, equal scores by lower id."""
    order = np.argsort(ids, kind="stable")  # columns in id order, so ties go to the lower id
    ids, vectors = ids[order], vectors[order]
    rows, found, scores = [np.zeros(0, np.int64)], [ids[:0]], [np.zeros(0)]
    for a in range(0, len(seek_ids) if len(ids) else 0, CHUNK_ROWS):
        score = np.round(seek[a: a + CHUNK_ROWS] @ vectors.T, TIE_DIGITS)
        row, col = _leading(score, k)
        rows.append(row + a)
        found.append(ids[col])
        scores.append(score[row, col])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


class Nearest:
    """The k best (score, id) so far for each of some unit vectors, while others pass by in any order.

    Scores are first worked out roughly, in single precision, whose error stays below ``margin``; those that may reach the vector's k-th
    best so far, or ``least``, are worked out in full. Equal scores go to the lower id.
    """

    def __init__(self, vectors: np.ndarray, k: int, least: np.ndarray | None = None):
        self.vectors, self.rough, self.k = vectors, vectors.astype(np.float32), k
        self.margin = 4e-7 * (vectors.shape[1] + 4)
        self.floor = np.full(len(vectors), -np.inf) if least is None else least.copy()
        self.scores, self.ids = np.full((len(vectors), k), -np.inf), None

    def meet(self, vectors: np.ndarray, starts: np.ndarray, ids: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Vectors pass by those in ``rows`` (default: all); the ids of vector j are ``ids[starts[j]: starts[j + 1]]``, one at least."""
        if self.ids is None:
            self.ids = np.zeros(self.scores.shape, ids.dtype)
        rows = np.arange(len(self.vectors)) if rows is None else rows
        for b in range(0, len(vectors), PASSING_ROWS):
            there = vectors[b: b + PASSING_ROWS]
            rough = there.astype(np.float32).T
            for a in range(0, len(rows), CHUNK_ROWS):
                self._chunk(rows[a: a + CHUNK_ROWS], there, rough, starts[b: b + PASSING_ROWS + 1], ids)

    def _chunk(self, at: np.ndarray, there: np.ndarray, rough: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> None:
        score = self.rough[at] @ rough
        floor, width = self.floor[at] - self.margin, score.shape[1]
        if width > self.k and not np.isfinite(floor).all():
            floor = np.maximum(floor, np.partition(score, width - self.k, axis=1)[:, width - self.k] - 2 * self.margin)
        place = np.flatnonzero(score >= floor.astype(np.float32)[:, None] - np.float32(self.margin))
        if not len(place):
            return
        row, col = np.divmod(place, width)
        full = [np.einsum("ij,ij->i", self.vectors[at[row[p: p + EXACT_PAIRS]]], there[col[p: p + EXACT_PAIRS]]) for p in range(0, len(row), EXACT_PAIRS)]
        score = np.round(np.concatenate(full), TIE_DIGITS) + 0.0
        row = at[row]
        good = score >= self.floor[row]
        row, col, score = row[good], col[good], score[good]
        many = (starts[1:] - starts[:-1])[col]
        first = np.cumsum(many) - many
        found = ids[np.repeat(starts[col] - first, many) + np.arange(many.sum())]
        self._keep(np.repeat(row, many), found, np.repeat(score, many))

    def _keep(self, row: np.ndarray, found: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(row)
        old, slot = np.nonzero(self.scores[touched] > -np.inf)
        row = np.concatenate((touched[old], row))
        found = np.concatenate((self.ids[touched[old], slot], found))
        score = np.concatenate((self.scores[touched[old], slot], score))
        rank = found if found.dtype.kind in "iu" else np.unique(found, return_inverse=True)[1]
        by = np.lexsort((rank, -score, row))
        row, found, score = row[by], found[by], score[by]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        kept = place < self.k
        self.scores[row[kept], place[kept]], self.ids[row[kept], place[kept]] = score[kept], found[kept]
        self.floor[touched] = np.maximum(self.floor[touched], self.scores[touched, -1])

    def found(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids and negative scores of each vector's best, in order."""
        known = (self.scores > -np.inf).sum(axis=1)
        ids = self.ids if self.ids is not None else np.zeros(self.scores.shape, np.int64)
        return [i[:n] for i, n in zip(ids, known)], [-s[:n] for s, n in zip(self.scores, known)]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, 0))


class Summaries:
    """Centre and radius of every block of the large pools, by (pool, block); one row per block, ``MAX_BLOCKS`` and a few at most."""

    def __init__(self, centres: dict[int, np.ndarray], rows: list[tuple]):
        self.centres = centres
        self.rows = {(no, block): (cell, radius, least) for no, block, cell, radius, least in rows}
        self.of_pool: dict[int, list[int]] = {}
        for no, block in sorted(self.rows):
            self.of_pool.setdefault(no, []).append(block)

    def reach(self, no: int, block: int, vectors: np.ndarray, spread: float = 0.0) -> np.ndarray:
        """An upper bound of the cosine between each vector, or any within an angle of ``spread`` around it, and the block's members."""
        cell, radius, _ = self.rows[no, block]
        if cell < 0:  # the zero vector, whose cosine is 0
            return np.zeros(len(vectors))
        if no not in self.centres:
            return np.ones(len(vectors))
        angle = np.arccos(np.clip(vectors @ self.centres[no][cell], -1, 1))
        bound = np.cos(np.clip(angle - radius - spread, 0, np.pi))
        return np.where(np.abs(vectors).any(axis=1), bound, 0.0)

    def _allowed(self, no: int, block: int, others: list[int]) -> np.ndarray:
        """An upper bound of the cosine between any member of the block and any of each other block."""
        cell, radius, _ = self.rows[no, block]
        if no not in self.centres:
            return np.ones(len(others))
        if cell < 0:
            return np.zeros(len(others))
        cells, radii = (np.array([self.rows[no, b][i] for b in others]) for i in range(2))
        if not others:
            return np.zeros(0)
        angle = np.arccos(np.clip(self.centres[no][cells.astype(np.int64)] @ self.centres[no][cell], -1, 1))
        return np.where(cells < 0, 0.0, np.cos(np.clip(angle - radii - radius, 0, np.pi)))

    def needed(self, no: int, block: int) -> list[int]:
        """Other blocks of the pool that may hold one of the best for a member of this block."""
        others = [b for b in self.of_pool[no] if b != block]
        return [others[i] for i in np.flatnonzero(self._allowed(no, block, others) >= self.rows[no, block][2] - SLACK)]

    def partners(self, no: int, block: int) -> list[int]:
        """Later blocks of the pool that may hold one of the best for a member of this block, or the other way round."""
        later = [b for b in self.of_pool[no] if b > block]
        least = np.array([min(self.rows[no, b][2], self.rows[no, block][2]) for b in later])
        return [later[i] for i in np.flatnonzero(self._allowed(no, block, later) >= least - SLACK)] if later else []


def _placed(centres: dict[int, np.ndarray]):
    """Column function (pool, vector) -> (nearest centre, angle to it); -1 for the zero vector."""

    @F.pandas_udf("cell int, angle double")
    def place(no: pd.Series, vec: pd.Series) -> pd.DataFrame:
        cell, angle = np.zeros(len(no), np.int32), np.full(len(no), np.pi)
        numbers = no.to_numpy()
        for pool in np.unique(numbers):
            at = np.flatnonzero(numbers == pool)
            for a in range(0, len(at), CHUNK_ROWS):
                rows = at[a: a + CHUNK_ROWS]
                vectors = _matrix(vec.iloc[rows])
                zero = ~vectors.any(axis=1)
                if pool in centres:
                    score = vectors @ centres[pool].T
                    cell[rows] = score.argmax(axis=1)
                    angle[rows] = np.arccos(np.clip(score.max(axis=1), -1, 1))
                cell[rows[zero]], angle[rows[zero]] = -1, 0.0
        return pd.DataFrame({"cell": cell, "angle": angle})

    return place


def _cut(rows: DataFrame, block_rows: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Adds ``block``, ``cell`` and ``angle`` to rows (no, id, vec, ids); and the centres of the pools with more than one block."""
    n = F.count(F.lit(1))
    sizes = pin(rows.groupBy("no").agg(n.alias("n")))
    total = sizes.where(F.col("n") > block_rows).agg(F.sum("n")).first()[0] or 0
    limit = max(block_rows, -(-total // MAX_BLOCKS))
    large = sizes.where(F.col("n") > limit)  # fewer than MAX_BLOCKS pools
    chance = (F.shiftrightunsigned(F.xxhash64("id", F.lit(11)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    sampled = rows.join(F.broadcast(large), "no").where(chance * F.col("n") < F.ceil(F.col("n") / limit)).where(F.exists("vec", lambda x: x != 0))
    lists: dict[int, list] = {}
    for r in sampled.select("no", "id", "vec").distinct().orderBy("no", "id").collect():  # as many as there will be blocks
        lists.setdefault(r["no"], []).append(r["vec"])
    centres = {no: np.array(v) for no, v in lists.items()}
    if total == 0 or large.isEmpty():
        return rows.withColumns({"block": F.lit(0).cast("long"), "cell": F.lit(0), "angle": F.lit(float(np.pi))}), {}
    marked = rows.join(F.broadcast(large.select("no", F.lit(True).alias("many"))), "no", "left")
    placed = marked.where("many").withColumn("at", _placed(centres)("no", "vec")).select("no", "id", "vec", "ids", "at.cell", "at.angle")
    placed = pin(placed)
    # a cell with too many vectors is cut by a hash of the id; the parts share its centre
    full = placed.groupBy("no", "cell").agg(F.ceil(n / limit).alias("parts")).where("parts > 2")
    placed = placed.join(lookup(full), ["no", "cell"], "left")
    part = F.pmod(F.xxhash64("id", F.lit(13)), F.coalesce("parts", F.lit(1)))
    placed = placed.withColumn("block", (F.col("cell") + 2).cast("long") * (1 << 24) + part)
    few = marked.where("many is null").select("no", "id", "vec", "ids", F.lit(0).alias("cell"), F.lit(float(np.pi)).alias("angle"), F.lit(0).cast("long").alias("block"))
    return placed.select(*few.columns).unionByName(few), centres


def _unpacked(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and values of a column of lists."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    starts = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
    return starts.astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _vectors(lists: pa.Array) -> np.ndarray:
    return _unpacked(lists)[1].reshape(len(lists), -1)


def _compared_blocks(rows: DataFrame, k: int, block_rows: int) -> tuple[DataFrame, DataFrame | None, object]:
    """What is compared: all rows with their best in their own block; (no, i, slot, j): block j passes by block i's vectors in the task
    (no, i, slot); the summaries."""
    cut, centres = _cut(rows, block_rows)
    kind = rows.schema["id"].dataType.simpleString()

    def own(block: pa.Table) -> pa.Table:
        vectors, (starts, ids) = _vectors(block["vec"]), _unpacked(block["ids"])
        near = Nearest(vectors, k)
        near.meet(vectors, starts, ids)
        comps, scores = near.found()
        least = np.where(np.isfinite(near.floor), near.floor, -2.0)  # of fewer than k, any score will do
        return (block.append_column("comps", pa.array(comps, block.schema.field("ids").type))
                .append_column("scores", pa.array(scores, pa.list_(pa.float64()))).append_column("least", pa.array(least)))

    schema = f"no long, id {kind}, vec array<double>, ids array<{kind}>, cell int, angle double, block long, comps array<{kind}>, scores array<double>, least double"
    done = cut.select("no", "id", "vec", "ids", "cell", "angle", "block").groupBy("no", "block").applyInArrow(own, schema)
    done = pin(done)
    if not centres and done.where("block > 0").isEmpty():
        return done, None, None
    sums = pin(done.where("block > 0").groupBy("no", "block").agg(
        F.first("cell").alias("cell"), F.max("angle").alias("radius"), F.min("least").alias("least")))
    summaries = Summaries(centres, [tuple(r) for r in sums.select("no", "block", "cell", "radius", "least").collect()])
    sent = rows.sparkSession.sparkContext.broadcast(summaries)

    def find(frames):
        for frame in frames:
            for no, block in zip(frame["no"], frame["block"]):
                needed = sent.value.needed(no, block)
                yield pd.DataFrame({"no": no, "i": block, "slot": np.arange(len(needed)) // PASSING_BLOCKS, "j": needed}).astype("int64")

    return done, pin(sums.repartition("no", "block").mapInPandas(find, "no long, i long, slot long, j long")), sent


def _passing(k: int, sent):
    """Runs through rows in order of (no, i, slot, j): first block i's vectors, with j null, then the blocks that pass by.
    Gives (id, comps, scores) of each vector that found any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, waiting, near = None, [], None

        def out() -> Iterator[pa.RecordBatch]:
            if near is not None:
                comps, scores = near.found()
                some = [p for p, c in enumerate(comps) if len(c)]
                for a in range(0, len(some), PASSING_ROWS):
                    at = some[a: a + PASSING_ROWS]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at), task[0])), seekers.take(pa.array(at)), pa.array([comps[p] for p in at], pa.list_(kind)),
                        pa.array([scores[p] for p in at], pa.list_(pa.float64()))], names=["no", "id", "comps", "scores"])

        for batch in batches:
            kind = batch.schema.field("id").type
            where = np.stack([batch.column(c).fill_null(-1).to_numpy(zero_copy_only=False) for c in ("no", "i", "slot", "j")])
            edges = np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                piece, (no, i, slot, j) = batch.slice(a, b - a), where[:, a].tolist()
                if (no, i, slot) != task:
                    yield from out()
                    task, waiting, near = (no, i, slot), [], None
                if j < 0:
                    waiting.append(piece)
                    continue
                if near is None:
                    mine = pa.Table.from_batches(waiting)
                    seekers, waiting = mine["id"].combine_chunks(), []
                    near = Nearest(_vectors(mine["vec"]), k, mine["least"].to_numpy())
                rows = np.flatnonzero(sent.value.reach(no, j, near.vectors) >= near.floor - SLACK)
                near.meet(_vectors(piece.column("vec")), *_unpacked(piece.column("ids")), rows)
        yield from out()

    return run


def _searched(rows: DataFrame, k: int, block_rows: int) -> DataFrame:
    """(no, id, best): the k best (minus, comp) of the pool for every row, as an array in order; ``minus`` is the score's negative."""
    done, passes, sent = _compared_blocks(rows, k, block_rows)
    kind = rows.schema["id"].dataType.simpleString()
    found = done.select("no", "id", "comps", "scores")
    if passes is not None:
        tasks = passes.select("no", "i", "slot").distinct()
        block = done.select("no", F.col("block").alias("i"), "id", "vec", "least")
        nothing = F.lit(None).cast(f"array<{kind}>").alias("ids")
        left = block.join(lookup(tasks), ["no", "i"]).select("no", "i", "slot", F.lit(None).cast("long").alias("j"), "id", "vec", nothing, "least")
        other = done.select("no", F.col("block").alias("j"), "id", "vec", "ids")
        right = other.join(lookup(passes, materialise=False), ["no", "j"]).select("no", "i", "slot", "j", "id", "vec", "ids", F.lit(None).cast("double").alias("least"))
        task = ["no", "i", "slot"]
        n = max(2 * tasks.count(), 1)
        ordered = left.unionByName(right).repartition(n, *task).sortWithinPartitions(*task, F.col("j").asc_nulls_first())
        found = found.unionByName(ordered.mapInArrow(_passing(k, sent), f"no long, id {kind}, comps array<{kind}>, scores array<double>"))
    best = found.select("no", "id", F.arrays_zip(F.col("scores").alias("minus"), F.col("comps").alias("comp")).alias("best"))
    if passes is None:
        return best
    # a row for every task of its block: few, with k entries each
    return best.groupBy("no", "id").agg(F.slice(F.sort_array(F.flatten(F.collect_list("best"))), 1, k).alias("best"))


def _numbered(df: DataFrame, pool: list[str], key: str, vec: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(no, id, vec) of all rows, with a number for each pool; the pools and their numbers; and what is compared: each vector once, with
    the k + 1 lowest of its ids."""
    rows = df.select(*pool, F.col(key).alias("id"), unit(vec).alias("vec"))
    pools = pin(rows.select(*pool).distinct().withColumn("no", F.monotonically_increasing_id()))
    rows = pin(null_safe_join(rows, lookup(pools, materialise=False), pool).select("no", "id", "vec"))
    first = top_k_per(rows, ["no", "vec"], ["id"], k + 1, "at")
    alike = first.groupBy("no", "vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return rows, pools, pin(alike.select("no", F.col("ids")[0].alias("id"), "vec", "ids"))


def _whole_pools(rows: DataFrame, pool: list[str], k: int) -> DataFrame:
    """The k best others for rows (pool, id, vec) of which every pool is one block."""
    def best(frame: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = frame["id"].to_numpy(), _matrix(frame["vec"])
        row, comp, score = _best(ids, vectors, ids, vectors, k + 1)
        other = comp != ids[row]
        row, comp, score = row[other], comp[other], score[other]
        rank = np.arange(len(row)) - np.searchsorted(row, row, side="left") + 1
        out = pd.DataFrame({"id": ids[row], "comp": comp, "score": score, "rank": rank.astype(np.int64)})[rank <= k]
        return out.assign(**{c: frame[c].iloc[0] for c in pool})

    kind = rows.schema["id"].dataType
    schema = T.StructType([
        T.StructField("id", kind), T.StructField("comp", kind), T.StructField("score", T.DoubleType()), T.StructField("rank", T.LongType()),
        *[rows.schema[c] for c in pool]])
    return rows.groupBy(*pool).applyInPandas(best, schema)


def comparison_load(df: DataFrame, pool: Sequence[str], key: str, vec: str, k: int, block_rows: int = BLOCK_ROWS) -> dict[str, int]:
    """What ``top_comps`` compares: ids that take part, blocks, pairs of different blocks compared, and rows sent to those pairs' tasks."""
    _, _, distinct = _numbered(pin(df), list(pool), key, vec, k)
    done, passes, _ = _compared_blocks(distinct, k + 1, block_rows)
    sizes = done.groupBy("no", "block").agg(F.count(F.lit(1)).alias("n"))
    out = {"vectors": distinct.agg(F.sum(F.size("ids"))).first()[0] or 0, "blocks": sizes.count(), "pairs": 0, "rows_sent": 0}
    if passes is not None:
        moved = passes.select("no", "i", "slot", F.col("i").alias("block")).distinct().unionByName(passes.select("no", "i", "slot", F.col("j").alias("block")))
        pairs = passes.select("no", F.least("i", "j"), F.greatest("i", "j")).distinct()
        out |= {"pairs": pairs.count(), "rows_sent": moved.join(sizes, ["no", "block"]).agg(F.sum("n")).first()[0] or 0}
    return out


def top_comps(
    df: DataFrame, pool: Sequence[str], key: str, vec: str, k: int, block_rows: int | None = None
) -> DataFrame:
    """(pool, key, comp, score, rank): the k most similar other rows of the same pool; ids are unique in a pool.

    Exact; ties go to the lower id. Pools of one row give nothing. A task holds one block of a bounded number of vectors with its best so far
    while at most ``PASSING_BLOCKS`` others pass by, and returns at most k + 1 ids per vector; pairs are never emitted, and a group of
    equal vectors, however large, takes part once. On clustered data the rows sent grow about as the pool does (``comparison_load``);
    where all directions are alike nothing can be left out, and the square of the blocks is compared.
    """
    pool, block_rows = list(pool), block_rows or BLOCK_ROWS
    df = pin(df.select(*pool, key, vec))
    if df.groupBy(*pool).count().where(F.col("count") > min(block_rows, WHOLE_ROWS)).isEmpty():
        whole = _whole_pools(df.select(*pool, F.col(key).alias("id"), unit(vec).alias("vec")), pool, k)
        return whole.select(*pool, F.col("id").alias(key), "comp", "score", "rank")
    rows, pools, distinct = _numbered(df, pool, key, vec, k)
    best = _searched(distinct, k + 1, block_rows)
    lists = distinct.join(best, ["no", "id"]).select(F.struct("no", "vec").alias("same"), "best")
    mine = join_by_key(rows.select(F.struct("no", "vec").alias("same"), "no", "id"), pin(lists), ["same"], "inner")
    others = F.slice(F.filter("best", lambda b: b["comp"] != F.col("id")), 1, k)
    out = mine.withColumn("others", others).select("no", "id", F.posexplode("others").alias("at", "b"))
    out = out.join(lookup(pools, materialise=False), "no")
    score = (-F.col("b.minus")).alias("score")
    return out.select(*pool, F.col("id").alias(key), F.col("b.comp").alias("comp"), score, (F.col("at") + 1).cast("long").alias("rank"))
