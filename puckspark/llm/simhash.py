"""Near duplicates by SimHash: a binary trie of all fingerprints is joined with itself.

Two nodes of the trie are visited together; the bits in which their paths differ are added up, and a pair of nodes is left as
soon as they exceed the budget. The trie is walked three times, with the fingerprint's bits turned by a third each
time: two fingerprints at most two bits apart agree in at least one third, so each walk need only follow equal nodes through its
first third, where it is dealt out over tasks. A node of the last level dealt out that holds too many fingerprints is opened
further, pair by pair of its children, until every pair of nodes fits a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.llm.components import components
from puckspark.operators.sizing import lookup
from puckspark.operators.skew import join_by_key
from puckspark.session import pin

BITS = 64
SHINGLE_WORDS = 3
BUDGET = 2  # differing bits of linked fingerprints
SEED = 42
NODE_ROWS = 1 << 15  # fingerprints below one of a pair of nodes that a task visits
STEP = 4  # bits by which a node with more is opened at a time
CHUNK = 1 << 16  # shingles counted, and node pairs visited, at a time
_COMPARE = 16  # node pairs with at most so many pairs of fingerprints are compared directly


def fingerprint(text: str | None, size: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """The SimHash of a whole text: a bit is set if it is set in over half the hashes of its word shingles; no words: 0."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and 0x20, 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    ends = ends[size - 1:] if len(words) >= size else ends[-1:]
    starts, ends, n = starts[: len(ends)].tolist(), ends.tolist(), len(ends)
    counts, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for a in range(0, n, CHUNK):
        hashes = np.array([digest(line[s:e], seed) for s, e in zip(starts[a: a + CHUNK], ends[a: a + CHUNK])], ">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["id", "fp"])

    return own.mapInArrow(run, "id long, fp long")


# --- the walk inside a task -------------------------------------------------------------------


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _split(values: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where the children of nodes [low, high) of sorted values part at a bit that all paths share above."""
    top = (values[low] >> bit >> np.uint64(1) << np.uint64(1) | np.uint64(1)) << bit
    return np.clip(np.searchsorted(values, top), low, high)


def walk(values: np.ndarray, pairs: tuple[np.ndarray, ...], depth: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, positions) of all values at most ``budget`` bits apart below the given pairs of nodes.

    ``values`` are sorted unsigned longs; a node is a range [low, high) of them whose first ``depth`` bits agree; ``pairs`` is (low, high) of
    the first node, (low, high) of the second, and the number of bits in which their paths differ. A node may be paired with itself.
    Of many pairs only ``CHUNK`` are opened at a time, so memory does not follow their number.
    """
    stack = [(*pairs, depth)]
    while stack:
        level = stack.pop()
        if len(level[0]) > CHUNK:
            stack.append(tuple(x[CHUNK:] for x in level))
            level = tuple(x[:CHUNK] for x in level)
        a0, a1, b0, b1, differ, depth = level
        own = a0 == b0
        n = (a1 - a0) * (b1 - b0)
        near = (n <= _COMPARE) | (depth >= BITS)
        if near.any():
            x0, y0, w, m = a0[near], b0[near], (b1 - b0)[near], n[near]
            which = np.repeat(np.arange(len(m)), m)
            at = np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
            x, y = x0[which] + at // w[which], y0[which] + at % w[which]
            ok = (x < y) & (_popcount(values[x] ^ values[y]) <= budget)
            if ok.any():
                yield x[ok], y[ok]
            keep = ~near
            a0, a1, b0, b1, differ, depth, own = (v[keep] for v in (a0, a1, b0, b1, differ, depth, own))
        if not len(a0):
            continue
        bit = (BITS - 1 - depth).astype(np.uint64)
        am, bm = _split(values, a0, a1, bit), _split(values, b0, b1, bit)
        below = [
            (a0, am, b0, bm, differ, np.ones(len(a0), bool)), (am, a1, bm, b1, differ, np.ones(len(a0), bool)),
            (a0, am, bm, b1, differ + 1, np.ones(len(a0), bool)), (am, a1, b0, bm, differ + 1, ~own),  # of a node with itself, one way suffices
        ]
        opened = []
        for p, q, r, s, d, wanted in below:
            live = wanted & (q > p) & (s > r) & (d <= budget) & ~((p == r) & (q - p == 1))
            opened.append([v[live] for v in (p, q, r, s, d, depth + 1)])
        stack.append(tuple(np.concatenate(x) for x in zip(*opened)))


def _joined(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the trees of a and b; every member of ``parent`` points to its smallest, both before and after."""
    while True:
        x, y = parent[a], parent[b]
        apart = x != y
        if not apart.any():
            return
        a, b = np.maximum(x, y)[apart], np.minimum(x, y)[apart]
        np.minimum.at(parent, a, b)
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def _links(values: np.ndarray, pairs: tuple[np.ndarray, ...], depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """One link from every linked value to the smallest of its component among these pairs."""
    parent = np.arange(len(values))
    for a, b in walk(values, pairs, depth, budget):
        _joined(parent, a, b)
    at = np.flatnonzero(parent != np.arange(len(values)))
    return values[at], values[parent[at]]


def _turn(x, by: int):
    """Unsigned longs with their bits turned to the left."""
    return x if by == 0 else (x << np.uint64(by)) | (x >> np.uint64(BITS - by))


def _visit(rows: pa.Table, budget: int) -> pa.RecordBatch:
    """Links below whole tasks (turn, depth, a, b), each with the sorted values of its two nodes."""
    turn, depth, a, b = (rows.column(k).to_numpy() for k in ("turn", "depth", "a", "b"))
    values = rows.column("v").to_numpy().view(np.uint64)
    task = np.ones(len(values), bool)
    task[1:] = (turn[1:] != turn[:-1]) | (depth[1:] != depth[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(task)
    ends = np.append(starts[1:], len(values))
    out_a, out_b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    plain = (a[starts] == b[starts])
    # nodes paired with themselves: all of one turn at once, as their values rise through the table
    for t in np.unique(turn[starts]):
        pick = plain & (turn[starts] == t) & (ends - starts > 1)
        if pick.any():
            at = np.concatenate([np.arange(s, e) for s, e in zip(starts[pick], ends[pick])])
            size = (ends - starts)[pick]
            order = np.argsort(values[at], kind="stable")  # whole nodes change places at most
            low = np.searchsorted(values[at][order], values[starts[pick]])
            node = (low, low + size, low, low + size, np.zeros(len(size), np.int64))
            x, y = _links(values[at][order], node, depth[starts[pick]].astype(np.int64), budget)
            out_a.append(_turn(x, (BITS - int(t)) % BITS))
            out_b.append(_turn(y, (BITS - int(t)) % BITS))
    for k in np.flatnonzero(~plain):
        own, d, t = np.sort(values[starts[k]: ends[k]]), int(depth[starts[k]]), int(turn[starts[k]])
        first, second = np.uint64(a[starts[k]]), np.uint64(b[starts[k]])
        head = own >> np.uint64(BITS - d)
        cut = int(np.searchsorted(head, second))
        if not 0 < cut < len(own):
            continue
        one = lambda v: np.array([v], np.int64)
        node = (one(0), one(cut), one(cut), one(len(own)), _popcount(np.array([first ^ second])))
        x, y = _links(own, node, one(d), budget)
        out_a.append(_turn(x, (BITS - t) % BITS))
        out_b.append(_turn(y, (BITS - t) % BITS))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a).view(np.int64)), pa.array(np.concatenate(out_b).view(np.int64))], names=["a", "b"])


# --- dealing out the walk ---------------------------------------------------------------------


def _head(depth: int) -> Column:
    return F.shiftrightunsigned("v", BITS - depth)


def _opened(turned: DataFrame, full: DataFrame, depth: int, node_rows: int, budget: int) -> DataFrame:
    """(turn, depth, a, b) for the pairs of nodes below the overfull ones (turn, node), each node of which has at most ``node_rows`` values."""
    done = []
    pairs = full.select("turn", F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0).alias("differ"))
    while depth < BITS:
        wider = min(depth + STEP, BITS)
        parents = pairs.select("turn", F.col("a").alias("node")).union(pairs.select("turn", "b")).distinct()
        below = turned.withColumn("node", _head(depth)).join(lookup(parents), ["turn", "node"], "left_semi")
        nodes = pin(below.groupBy("turn", _head(wider).alias("node")).agg(F.count(F.lit(1)).alias("n")))
        up = F.shiftrightunsigned("node", wider - depth)
        first = nodes.select("turn", up.alias("a"), F.col("node").alias("a2"), F.col("n").alias("na"))
        second = nodes.select("turn", up.alias("b"), F.col("node").alias("b2"), F.col("n").alias("nb"))
        step = F.col("a2").bitwiseXOR(F.col("b2")).bitwiseAND(F.lit((1 << (wider - depth)) - 1))
        opened = (
            pairs.join(first, ["turn", "a"]).join(second, ["turn", "b"]).where("a <> b or a2 <= b2")
            .withColumn("differ", F.col("differ") + F.bit_count(step)).where(F.col("differ") <= budget)
            .select("turn", F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"), "differ", F.greatest("na", "nb").alias("n"))
        )
        opened = pin(opened)
        fits = (F.col("n") <= node_rows) if wider < BITS else F.lit(True)
        done.append(opened.where(fits).select("turn", F.lit(wider).alias("depth"), "a", "b"))
        pairs, depth = opened.where(~fits).drop("n"), wider
        if pairs.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return pin(out)


def linked(fps: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) at most ``budget`` bits apart, enough to keep connected what they connect.

    Every task returns one link a member of a component it sees, never all pairs. Values travel once for each of budget + 1 turns,
    and more often only below a node with more than ``node_rows`` values.
    """
    parts = budget + 1
    first = BITS // parts  # bits of a third
    turns = F.explode(F.array(*[F.lit(k * first) for k in range(parts)]))
    one = fps.select("fp", turns.alias("turn"))
    value = F.lit(None).cast("long")
    for k in range(parts):
        by = k * first
        rolled = F.col("fp") if by == 0 else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))
        value = F.when(F.col("turn") == by, rolled).otherwise(value)
    turned = one.select("turn", value.alias("v"))
    full = pin(turned.groupBy("turn", _head(first).alias("node")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > node_rows).drop("n"))
    tasks = turned.select("turn", F.lit(first).alias("depth"), _head(first).alias("a"), _head(first).alias("b"), "v")
    if not full.isEmpty():
        few = lookup(full.select("turn", F.col("node").alias("a")), materialise=False)
        pairs = _opened(turned, full, first, node_rows, budget)
        tasks = tasks.join(few, ["turn", "a"], "left_anti").select("turn", "depth", "a", "b", "v")
        for depth in [r[0] for r in pairs.select("depth").distinct().collect()]:  # at most BITS / STEP values
            here = lookup(pairs.where(F.col("depth") == depth), materialise=False)
            inside = turned.withColumn("node", _head(depth))
            left = inside.withColumnRenamed("node", "a").join(here, ["turn", "a"]).select("turn", "depth", "a", "b", "v")
            right = inside.withColumnRenamed("node", "b").join(here.where("a <> b"), ["turn", "b"]).select("turn", "depth", "a", "b", "v")
            tasks = tasks.unionByName(left).unionByName(right)
    task = ["turn", "depth", "a", "b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < 2 * node_rows:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            keys = [rows.column(k).to_numpy() for k in task]
            same = np.ones(rows.num_rows, bool)
            for k in keys:
                same &= k == k[-1]
            whole = rows.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0  # the last task may go on in the next batch
            if whole:
                yield _visit(rows.slice(0, whole).combine_chunks(), budget)
            held, size = rows.slice(whole).to_batches(), rows.num_rows - whole
        if size:
            yield _visit(pa.Table.from_batches(held).combine_chunks(), budget)

    dealt = tasks.repartition(*task).sortWithinPartitions(*task, "v")
    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``.

    Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; the shingles are all runs of three words, repeats
    included, or the whole text if it has fewer. Fingerprints at most ``budget`` bits apart are linked; ``component_id`` is the smallest id
    that links reach from the row, itself included.

    Null and empty texts have fingerprint 0, which is linked like any other. A null id counts for nothing in ``component_id``, which is
    null only if no row of the component has an id; rows that repeat an id or a text get a row each. Other columns are ignored; an
    empty table gives no rows.

    Equal fingerprints are joined first, by an aggregate of map-side minima, so copies meet in no task; only distinct fingerprints
    enter the trie. Rows then look their component up in a join that deals out hot fingerprints.
    """
    own = pin(fingerprints(docs, id_col, text_col))
    per = pin(own.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")))
    found = pin(components(pin(linked(per.select("fp"), budget, node_rows))))
    joined = pin(found.select(F.col("node").alias("fp"), "component").join(per, "fp").select("fp", "component", "least"))
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    linked_fps = join_by_key(joined.select("fp", "component"), least, ["component"]).select("fp", "component_id")
    alone = per.where("n > 1").select("fp", F.col("least").alias("component_id")).join(found.select(F.col("node").alias("fp")), "fp", "left_anti")
    table = pin(linked_fps.unionByName(alone))
    return join_by_key(own, table, ["fp"]).select("id", "fp", F.coalesce("component_id", "id").alias("component_id"))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
