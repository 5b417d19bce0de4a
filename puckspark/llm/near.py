"""Near-duplicate groups by HyperMinHash registers.

Every distinct word window falls into one of 256 registers by the top bits of its hash; a register
keeps its smallest value as a count of leading zeros and ten mantissa bits. Bands of registers
give candidate links, the share of equal registers (corrected for chance collisions) estimates the
similarity, and what passes is confirmed on the full sets of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.llm import text as T
from puckspark.llm.components import components
from puckspark.operators.sizing import lookup
from puckspark.session import pin

REGISTERS = 256
MANTISSA = 10
BAND = 6  # registers in a band; a link of similarity 0.85 is missed with probability (1 - 0.85^6)^42 < 1e-8
BLOCK = 256  # texts compared at once when a bucket is searched in full
BLOCK_WINDOWS = 1 << 21  # and their windows, about, unless one text has more
FINE = 1024  # one-byte registers for the search in full, three bits of leading zeros and five of mantissa
SIGMAS = 4  # how far below the threshold an estimate may lie and still be confirmed

_rng = np.random.default_rng(711)
_LENDER = _rng.random((REGISTERS, REGISTERS))
_BANDS = REGISTERS // BAND
_BAND_ODD = _rng.integers(0, 2**63, (_BANDS, BAND), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(windows: np.ndarray) -> np.ndarray:
    """Registers of one non-empty ascending set of hashes. An empty register takes the value of the filled
    one that ranks first in a fixed random order of its own, so that small sets compare like large ones."""
    place = (windows >> np.uint64(56)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    value = windows[first] & np.uint64((1 << 56) - 1)
    _, bits = np.frexp((value >> np.uint64(3)).astype(np.float64))
    zeros = np.where(value >> np.uint64(3) > 0, 53 - bits, 53).astype(np.uint64)
    tail = (value << (zeros + np.uint64(9))) >> np.uint64(64 - MANTISSA)
    out = np.zeros(REGISTERS, np.uint16)
    filled = place[first]
    out[filled] = (zeros << np.uint64(MANTISSA)) | tail
    empty = np.setdiff1d(np.arange(REGISTERS), filled, assume_unique=True)
    if len(empty):
        out[empty] = out[filled[np.argmin(_LENDER[np.ix_(empty, filled)], axis=1)]]
    return out


def fine_registers(windows: np.ndarray) -> np.ndarray:
    """More and shorter registers of one non-empty ascending set; 0 is an empty one. A set that is small against their number
    is told nearly window by window."""
    place = (windows >> np.uint64(54)).astype(np.int64)
    first = np.flatnonzero(np.diff(place, prepend=-1))
    value = (windows[first] >> np.uint64(1)) & np.uint64((1 << 53) - 1)
    _, bits = np.frexp(value.astype(np.float64))
    zeros = 53 - np.where(value > 0, bits, 0)
    tail = ((value << (zeros + 1).astype(np.uint64)) & np.uint64((1 << 53) - 1)) >> np.uint64(48)
    out = np.zeros(FINE, np.uint8)
    out[place[first]] = np.minimum(1 + np.minimum(zeros, 7) * 32 + tail.astype(np.int64), 255)
    return out


def fine_match(x: np.ndarray, others: np.ndarray, n: int, ns: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others may reach the threshold with x, n and ns being the sizes of the sets.

    The filled registers are a sample of the union without replacement, so its error shrinks with the part that is hidden.
    """
    filled = ((others > 0) | (x > 0)).sum(axis=1)
    same = ((others == x) & (x > 0)).sum(axis=1) / filled
    p, c = percent / 100, 1 / 96  # c: chance of two different smallest windows to agree
    union = np.maximum((n + ns) / (1 + p), filled + 1)
    error = np.sqrt(p * (1 - p) / filled * (1 - filled / union))
    return (same - c) / (1 - c) >= p - SIGMAS * error - 0.01


def chance(n: float, m: float) -> float:
    """Expected share of registers that agree although their smallest windows differ."""
    n, m = max(n, m), max(min(n, m), 1.0)
    ratio = n / m
    return 0.1699 / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2


def least_share(percent: int, union: np.ndarray | float) -> np.ndarray | float:
    """Smallest estimate that a link at the threshold reaches but for chance."""
    p = percent / 100
    return p - SIGMAS * np.sqrt(p * (1 - p) / np.minimum(REGISTERS, np.maximum(union, 1)))


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """One 64-bit key for each sketch and band."""
    parts = sketches[:, : _BANDS * BAND].reshape(len(sketches), _BANDS, BAND).astype(np.uint64) + np.uint64(1)
    return T.mix((parts * _BAND_ODD).sum(axis=2, dtype=np.uint64) + np.arange(_BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _windows(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int | None, np.ndarray]]:
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for row, words in T.document_words(batch.column(1)):
            yield ids[row], T.window_hashes(words, size)


def _rows(rows: Iterator[tuple], schema: pa.Schema, many: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == many:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_SKETCH = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sketch", pa.binary())])


def sketches(docs: DataFrame, size: int = T.SHINGLE_WORDS) -> DataFrame:
    """(id, n, hi, lo, sketch) of (id, text): number of distinct windows, a 128-bit print of the set, and the registers.
    An empty set has n = 0 and no sketch."""

    def run(batches):
        def rows():
            for i, w in _windows(batches, size):
                if len(w):
                    hi, lo = w.sum(dtype=np.uint64), T.mix(w ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)
                    yield i, len(w), int(hi.astype(np.int64)), int(lo.astype(np.int64)), registers(w).tobytes()
                else:
                    yield i, 0, 0, 0, None
        return _rows(rows(), _SKETCH)

    return docs.mapInArrow(run, "id long, n long, hi long, lo long, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node, n) for each band of each node."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(np.stack([np.frombuffer(x.as_buffer(), np.uint16) for x in batch.column(1)]))
                yield pa.RecordBatch.from_arrays([
                    pa.array(keys.view(np.int64).ravel()),
                    *(pa.array(np.repeat(batch.column(k).to_numpy(zero_copy_only=False), _BANDS)) for k in (0, 2)),
                ], names=["key", "node", "n"])

    return nodes.select("node", "sketch", "n").mapInArrow(run, "key long, node long, n long")


def _estimated(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose corrected estimate may reach the threshold."""
    left = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("na"))
    right = nodes.select(F.col("node").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("nb"))

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(v.as_py() for v in batch.column(k)), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
            na, nb = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in (4, 5))
            same = (x == y).mean(axis=1) - np.array([chance(*p) for p in zip(na, nb)])
            sized = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            ok = sized & (same >= least_share(percent, np.maximum(na, nb)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y", "na", "nb").mapInArrow(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, n, windows) of the documents in question, stored once: no later step reads texts again. The ids are broadcast if
    few, else the texts are shuffled to them."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("windows", pa.binary())])

    def run(batches):
        return _rows(((i, len(w), w.tobytes()) for i, w in _windows(batches, size) if len(w)), schema, 200)

    found = docs.join(lookup(ids), "id", "left_semi").select("id", "text").mapInArrow(run, "id long, n long, windows binary")
    return pin(found.dropDuplicates(["id"]))


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with 100 * intersection >= percent * union on their full sets."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                ok.append(_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("id").alias("a"), F.col("windows").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("windows").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _mixed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, node, blocks, label) of the members of buckets that hold more than one component, stored."""
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    mixed = named.groupBy("key").agg(F.min("label").alias("l"), F.max("label").alias("h")).where("l <> h")
    return pin(named.join(mixed.select("key"), "key"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns, whole numbers, of batches that are sorted by them; one at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        by = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1).tolist(), len(by)]
        if held and any(held[-1].column(k)[-1].as_py() != by[0, k] for k in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _joining_links(key: int, group: pa.Table, cross: bool, percent: int) -> list[tuple[int, int]]:
    """Links, confirmed on the full sets, that join the components of the rows of one bucket: fewer than there are components. A pair
    is left to the bucket of the first band it shares; with ``cross`` only pairs from two blocks count."""
    node, label, own, n = (group.column(c).to_numpy() for c in ("node", "label", "own", "n"))
    sets = [np.frombuffer(w.as_buffer(), np.uint64) for w in group.column("windows")]
    fine = np.stack([fine_registers(w) for w in sets])
    bands = band_keys(np.stack([np.frombuffer(s.as_buffer(), np.uint16) for s in group.column("sketch")])).view(np.int64)
    part = np.unique(label, return_inverse=True)[1]
    found = []
    for k in range(len(node) - 1):
        ok = (part[k + 1:] != part[k]) & (100 * np.minimum(n[k], n[k + 1:]) >= percent * np.maximum(n[k], n[k + 1:]))
        if cross:
            ok &= own[k + 1:] != own[k]
        at = np.flatnonzero(ok) + k + 1
        if not len(at):
            continue
        first = (bands[at] == bands[k]).argmax(axis=1)
        at = at[bands[k, first] == key]
        for m in at[fine_match(fine[k], fine[at], n[k], n[at], percent)] if len(at) else ():
            if part[m] != part[k] and _linked(sets[k], sets[m], percent):
                found.append((min(node[k], node[m]), max(node[k], node[m])))
                part[part == part[m]] = part[k]
    return found


def _rest(held: DataFrame, facts: DataFrame, percent: int, cross: bool) -> DataFrame:
    """Links (a, b) that join the components of a bucket, searched in full.

    The bucket is dealt into blocks, which are compared with themselves, and with ``cross`` each with every other. A pair of blocks
    is searched and its links confirmed inside one task, which holds no more than the two and returns fewer rows than they have.
    """
    held = held.withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    if cross:
        held = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("own <> other")
    else:
        held = held.withColumn("other", F.col("own"))
    dealt = held.join(facts, "node").select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label", "own", "n", "sketch", "windows")

    def run(batches):
        for group in _groups(batches, 3):
            found = _joining_links(group.column("key")[0].as_py(), group, cross, percent)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    spread = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return spread.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, size: int = T.SHINGLE_WORDS) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row.

    Two documents are linked when 100 * intersection >= percent * union of their sets of ``size``-word
    windows; a component is named by its smallest id, which is the one kept. Equal sets meet by their print,
    so copies never make pairs. In every band bucket all texts are first compared with the smallest id only;
    afterwards those that share a bucket but no component are compared in full, first inside blocks, then block against block, so no
    component inside a bucket is lost and a large group costs as many rows as it has texts, linked or just below the threshold. Null and empty texts have no windows and
    are linked with nothing. Rows that share an id count as one document; a row without an id is its own
    group with a null name, and is kept. Other columns are ignored.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    drawn = pin(sketches(own, size))
    classes = drawn.where("n > 0 and id is not null").groupBy("hi", "lo").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = pin(classes)
    bands = _bands(nodes)
    lead = bands.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"), F.min("node").alias("leader")).where("c > 1")
    blocks = F.ceil(F.greatest(F.col("c") / BLOCK, F.col("w") / BLOCK_WINDOWS)).alias("blocks")
    members = pin(bands.join(lead.select("key", "leader", blocks), "key"))
    stars = members.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    known = own.where("id is not null")
    sets = _sets(known, members.select(F.col("node").alias("id")).distinct(), size)
    links = pin(_confirmed(pin(_estimated(stars, nodes, percent)), sets, percent))
    labels = pin(components(links))
    held, facts = _mixed(members.select("key", "node", "blocks"), labels), None
    for cross in (False, True):
        if held.isEmpty():
            break
        if facts is None:
            wanted = held.select("node").distinct()
            facts = pin(sets.withColumnRenamed("id", "node").join(wanted, "node", "left_semi").join(nodes.select("node", "sketch"), "node"))
        more = pin(_rest(held, facts, percent, cross))
        if not more.isEmpty():
            links = links.union(more)
            labels = pin(components(links))
        if not cross:
            held = _mixed(held.where("blocks > 1").drop("label"), labels)
    repeated = drawn.where("n > 0 and id is not null").select("id", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"])
    if not labels.isEmpty():
        repeated = repeated.join(labels, "node", "left").withColumn("node", F.coalesce("component", "node"))
    named = repeated.groupBy("id").agg(F.min("node").alias("component"))
    out = drawn.select("id", "n").join(named, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
