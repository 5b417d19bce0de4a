"""The trie of all conversations' prefixes, by double arrays.

Conversations are dealt into shards by their first turn; a first turn with more turns than a shard holds is dealt further by conversation.
In a shard the turns get dense numbers and its paths are packed into a double array: the child of a node by turn t lies at BASE[node] + t
and names the node in CHECK. The arrays are walked for the nodes, which are named by a hash of all turns from the root; nodes that several
shards share are merged by that name, and sums over subtrees, made in each shard of what its conversations own, are merged likewise.

A path longer than ``BLOCK`` turns is cut: each block is a path of its own below a root named by the turns before, so
that no conversation, however long, has to fit a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.operators.ordered import running_total, sequence_number
from puckspark.operators.sizing import lookup
from puckspark.operators.skew import join_by_key
from puckspark.session import pin

SHARD_TURNS = 1 << 15
BLOCK = 4096
TRIES = 32  # free places tried for a node's children before they go behind all others
CHUNK_IDS = 8192  # conversation ids joined into one string at a time

_ROOT = b""
_NODE = "shard long, idx long, up long, id binary, up_id binary, depth long, size long, n long, conv long, path long, last boolean"


class DoubleArray:
    """A trie over dense symbols. Node 0 is the root; ``base[node] + symbol`` is its child if ``check`` there names the node."""

    def __init__(self, symbols: int):
        self.symbols = symbols
        self.base = np.zeros(symbols + 2, np.int64)
        self.check = np.full(symbols + 2, -1, np.int64)
        self.check[0] = 0  # the root's own place is taken
        self.top, self.free = 1, 1  # behind all places taken; no free place lies before ``free``

    def _room(self, upto: int) -> None:
        if upto > len(self.check):
            more = max(upto, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate((self.base, np.zeros(more, np.int64)))
            self.check = np.concatenate((self.check, np.full(more, -1, np.int64)))

    def add(self, node: int, symbols: np.ndarray) -> None:
        """Places all children of a node; ``symbols`` are distinct and rise."""
        while self.free < len(self.check) and self.check[self.free] >= 0:
            self.free += 1
        at, span = self.free, symbols - symbols[0]
        for _ in range(TRIES):
            self._room(at + int(span[-1]) + 1)
            if (self.check[at + span] < 0).all():
                break
            empty = np.flatnonzero(self.check[at + 1: at + 65] < 0)
            if not len(empty):
                at = self.top
                break
            at += 1 + int(empty[0])
        else:
            at = self.top
        self._room(at + int(span[-1]) + 1)
        self.base[node] = at - int(symbols[0])
        self.check[at + span] = node
        self.top = max(self.top, at + int(span[-1]) + 1)

    def child(self, nodes: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The children of many nodes; -1 where there is none."""
        at = self.base[nodes] + symbols
        there = (at > 0) & (at < len(self.check))
        out = np.where(there, at, 0)
        return np.where(there & (self.check[out] == nodes), out, -1)


def pack(symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray, n_symbols: int) -> tuple[DoubleArray, list[tuple[np.ndarray, np.ndarray]]]:
    """The double array of many paths (slices of ``symbols``), and per depth the paths that reach it and their nodes there."""
    trie, paths = DoubleArray(n_symbols), np.arange(len(starts))
    at, levels, depth = np.zeros(len(starts), np.int64), [], 0
    levels.append((paths, at))
    while True:
        on = lengths[paths] > depth
        paths, at = paths[on], at[on]
        if not len(paths):
            return trie, levels
        step = symbols[starts[paths] + depth]
        edges = np.unique(at * n_symbols + step)
        parents, steps = edges // n_symbols, edges % n_symbols
        firsts = np.flatnonzero(np.append(True, parents[1:] != parents[:-1]))
        for a, b in zip(firsts, np.append(firsts[1:], len(edges))):
            trie.add(int(parents[a]), steps[a:b])
        at = trie.child(at, step)
        depth += 1
        levels.append((paths, at))


def _shard_nodes(table: pa.Table) -> pa.Table:
    """Nodes of one shard, one row each, and one more row (``path``) for the place where every path ends."""
    conv, depth, size, turns = (table.column(k).to_numpy() for k in ("conv", "depth", "size", "turns"))
    keys = table.column("key").combine_chunks().dictionary_encode()
    roots, stops = table.column("root").to_pylist(), table.column("stop").to_pylist()
    shard, block = table.column("shard")[0].as_py(), table.column("block").to_numpy()
    names = keys.dictionary.to_pylist()
    key = keys.indices.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((depth, conv, block))
    conv, depth, size, turns, key, block = (x[order] for x in (conv, depth, size, turns, key, block))
    first = np.flatnonzero(np.append(True, (conv[1:] != conv[:-1]) | (block[1:] != block[:-1])))
    lengths = np.diff(np.append(first, len(conv)))
    lengths = np.where(depth[first] == 0, 0, lengths)  # a conversation without turns has one row, of depth 0
    out: dict[str, list] = {f.split()[0]: [] for f in _NODE.split(", ")}

    def put(idx, up, id_, up_id, depth_, size_, n, conv_, path, last):
        for k, v in zip(out, (shard, idx, up, id_, up_id, depth_, size_, n, conv_, path, last)):
            out[k].append(v)

    base = 0
    root_of = [roots[order[a]] for a in first]
    for root in sorted({r or _ROOT for r in root_of}):
        mine = np.flatnonzero([(r or _ROOT) == root for r in root_of]) if root or any(root_of) else np.arange(len(first))
        starts, size_of = first[mine], lengths[mine]
        trie, levels = pack(key, starts, size_of, max(len(names), 1))
        top = int(max(trie.top, 1))
        n, least = np.zeros(top, np.int64), np.full(top, np.iinfo(np.int64).max)
        for paths, at in levels:
            np.add.at(n, at, 1)
            np.minimum.at(least, at, conv[starts[paths]])
        from_depth = int(max(depth[starts[0]] - 1, 0))
        name = {0: root}
        put(base, None, root, None, from_depth, 0 if root == _ROOT else None, int(n[0]) if root == _ROOT else 0, int(least[0]), None, None)
        for d, (paths, at) in enumerate(levels[1:], 1):
            slots, one = np.unique(at, return_index=True)
            for slot, p in zip(slots.tolist(), paths[one].tolist()):
                row, up = int(starts[p]) + d - 1, int(trie.check[slot])
                stop = stops[order[row]]
                name[slot] = stop if stop is not None else hashlib.sha256(name[up] + names[key[row]]).digest()
                put(base + slot, base + up, name[slot], name[up], from_depth + d, int(size[row]), int(n[slot]), int(least[slot]), None, None)
        for d, (paths, at) in enumerate(levels):
            over = size_of[paths] == d
            for p, slot in zip(paths[over].tolist(), at[over].tolist()):
                whole = from_depth + d == turns[starts[p]]
                put(base + slot, None, name[slot], None, from_depth + d, None, 0, int(conv[starts[p]]), int(block[starts[p]]), bool(whole))
        base += top
    types = {"id": pa.binary(), "up_id": pa.binary(), "last": pa.bool_()}
    return pa.table({k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()})


def _shard_sums(table: pa.Table) -> pa.Table:
    """For every node of a shard the sums over its subtree there of what the shard owns; and the conversation of its parent."""
    idx, up, depth = (table.column(k).combine_chunks() for k in ("idx", "up", "depth"))
    idx, depth = idx.to_numpy(), depth.to_numpy()
    inner = up.is_valid().to_numpy(zero_copy_only=False)
    up = up.fill_null(-1).to_numpy()
    place = np.argsort(idx)
    above = np.where(inner, place[np.minimum(np.searchsorted(idx[place], np.maximum(up, 0)), len(idx) - 1)], -1)
    leaves, saved, conv = (table.column(k).to_numpy().copy() for k in ("leaves", "saved", "conv"))
    order = np.argsort(-depth, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(depth[order]) != 0))
    for a, b in zip(cuts, np.append(cuts[1:], len(order))):  # deepest first
        rows = order[a:b][inner[order[a:b]]]
        np.add.at(leaves, above[rows], leaves[rows])
        np.add.at(saved, above[rows], saved[rows])
    # the root of a later block is only there to name its children's parent: the end of the block before it counts
    later = ~inner & (depth > 0)
    leaves[later] = saved[later] = 0
    parent = pa.array(np.where(inner, conv[above], 0), pa.int64(), mask=~inner)
    return pa.table({"id": table.column("id"), "parent": parent, "leaves": pa.array(leaves), "saved": pa.array(saved)})


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, depth, key, size): every conversation's turns numbered from 1 by turn, null first, then by role and text, which tells equal turn
    numbers apart. ``key`` is the SHA-256 of role and text, null counting as empty; ``size`` the code points of the text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    key = F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256))
    own = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), F.length(text).cast("long").alias("size"), key.alias("key"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")]
    return sequence_number(own, ["conv"], order, "depth").select("conv", "depth", "key", "size")


def _named_blocks(paths: DataFrame, block: int) -> DataFrame:
    """(conv, block, root, stop): names of the nodes at which the blocks of long conversations begin and end.

    A name is made of the sum, over the blocks before, of a hash of the block's turns and its number: sums of one
    group may be made in parts, so a conversation of any length is not walked by one task.
    """
    turn = F.struct("depth", "key")
    whole = paths.groupBy("conv", "block").agg(F.sha2(F.concat_ws("", F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.hex(t["key"]))).cast("binary"), 256).alias("print"), F.count(F.lit(1)).alias("n"))
    high = F.shiftrightunsigned(F.xxhash64("print", "block"), 1).cast("decimal(38,0)") * F.lit(1 << 32).cast("decimal(10,0)")
    low = F.shiftrightunsigned(F.xxhash64("block", "print", F.lit(7)), 32).cast("decimal(38,0)")
    summed = running_total(whole.withColumn("_value", (high + low).cast("decimal(38,0)")), ["conv"], ["block"], F.col("_value"), "_upto")
    name = lambda s, b: F.unhex(F.sha2(F.concat_ws(":", s.cast("string"), b.cast("string")).cast("binary"), 256))
    before = F.col("_upto") - F.col("_value")
    return summed.select(
        "conv", "block", F.when(F.col("block") > 0, name(before, F.col("block"))).alias("root"),
        F.when(F.col("n") == block, name(F.col("_upto"), F.col("block") + 1)).alias("stop"))


def _digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256) of the nodes at which conversations end: the digest of their ids, ascending and comma-joined.

    Ids are first joined into strings where they lie in order, and the digest of a node then runs over these strings as a stream.
    """
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, conv = batch.column("id").to_pylist(), batch.column("conv").to_pylist()
            rows, a = [], 0
            while a < len(ids):
                b = a + 1
                while b < len(ids) and ids[b] == ids[a] and b - a < CHUNK_IDS:
                    b += 1
                rows.append((ids[a], conv[a], ",".join(map(str, conv[a:b]))))
                a = b
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string()))], names=["id", "conv", "said"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            done = []
            for id_, said in zip(batch.column("id").to_pylist(), batch.column("said").to_pylist()):
                if id_ != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = id_, hashlib.sha256(said.encode())
                else:
                    state.update(b"," + said.encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate((pa.binary(), pa.string()))], names=["id", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([state.hexdigest()])], names=["id", "ends_sha256"])

    strings = ends.repartitionByRange("id", "conv").sortWithinPartitions("id", "conv").mapInArrow(join, "id binary, conv long, said string")
    return strings.repartition("id").sortWithinPartitions("id", "conv").mapInArrow(digest, "id binary, ends_sha256 string")


def _with_later(full: DataFrame, ends: DataFrame, merged: DataFrame, block: int) -> DataFrame:
    """Adds to the end of every cut path what its conversation owns in its later blocks."""
    owned = merged.join(ends.select("conv").distinct(), "conv", "left_semi").groupBy("conv", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / block).alias("path")).agg(
        F.sum("leaf").alias("leaf"), F.sum("worth").alias("worth"))
    zero, nothing = F.lit(0).cast("long"), F.lit(None).cast("long")
    rows = ends.select("conv", "path", zero.alias("kind"), "shard", "idx", zero.alias("leaf"), zero.alias("worth")).unionByName(
        owned.select("conv", "path", F.lit(1).cast("long").alias("kind"), nothing.alias("shard"), nothing.alias("idx"), "leaf", "worth"))
    order = [F.col("path").desc(), F.col("kind")]
    rows = running_total(pin(rows), ["conv"], order, F.col("leaf"), "later_leaves")
    rows = running_total(pin(rows), ["conv"], order, F.col("worth"), "later_saved")
    added = rows.where("kind = 0").groupBy("shard", "idx").agg(F.sum("later_leaves").alias("_l"), F.sum("later_saved").alias("_s"))
    both = full.join(added, ["shard", "idx"], "left")
    return both.withColumns({"leaves": F.col("leaves") + F.coalesce("_l", F.lit(0)), "saved": F.col("saved") + F.coalesce("_s", F.lit(0))}).drop("_l", "_s")


def _shards(paths: DataFrame, shard_turns: int, block: int) -> DataFrame:
    """Adds ``shard``: paths that begin alike share one, unless they hold more turns than a shard should."""
    start = paths.where((F.col("depth") - 1) % block <= 0).select("conv", "block", F.xxhash64(F.coalesce("root", F.lit(b"")), F.coalesce("key", F.lit(b""))).alias("_start"))
    sizes = paths.groupBy("conv", "block").agg(F.count(F.lit(1)).alias("_n"))
    begun = pin(start.join(sizes, ["conv", "block"]))
    per = pin(begun.groupBy("_start").agg(F.sum("_n").alias("_all")))
    total = per.agg(F.sum("_all")).first()[0] or 0
    shards = max(1, -(-total // shard_turns))
    large = lookup(per.where(F.col("_all") > shard_turns))
    dealt = begun.join(large, "_start", "left")
    parts = F.ceil(F.coalesce("_all", F.lit(0)) / F.lit(shard_turns)).cast("long")
    shard = F.when(F.col("_all").isNull(), F.pmod(F.col("_start"), F.lit(shards))).otherwise(F.xxhash64("_start", F.pmod(F.xxhash64("conv", "block"), parts)))
    return paths.join(dealt.select("conv", "block", shard.alias("shard")), ["conv", "block"])


def prefix_trie(paths: DataFrame, shard_turns: int = SHARD_TURNS, block: int = BLOCK) -> DataFrame:
    """One row per node: conv (smallest member), depth, parent (its parent's conv), n_convs, n_children, n_leaves, saved, ends_sha256.

    ``paths`` are rows (conv, depth, key, size): a conversation's turns numbered from 1, and one row of depth 0, with null
    key and size, for one without turns. A node is a distinct sequence of first keys; ``saved`` sums (n_convs - 1) * size over
    its subtree. The root has depth 0 and no parent. An empty table gives no rows.

    Shards are made by a bounded number of turns; shared nodes are merged by name. What several conversations own in a
    subtree is added up in the shard of the smallest of them, so every node counts once. A task holds one shard of about ``shard_turns``
    turns, or one block of ``block`` turns of one conversation if that is more.
    """
    counted = pin(paths.groupBy("conv").agg(F.max("depth").alias("turns")))
    longest = counted.agg(F.max("turns")).first()[0] or 0
    own = join_by_key(paths, counted, ["conv"], "inner").withColumn("block", F.floor(F.greatest(F.col("depth") - 1, F.lit(0)) / block))
    if longest >= block:
        names = _named_blocks(own.where(F.col("turns") >= block), block)
        own = own.join(names, ["conv", "block"], "left").withColumn("stop", F.when(F.col("depth") % block == 0, F.col("stop")))
    else:
        own = own.withColumns({"root": F.lit(None).cast("binary"), "stop": F.lit(None).cast("binary")})
    rows = _shards(pin(own), shard_turns, block).select("shard", "conv", "block", "depth", "key", "size", "turns", "root", "stop")
    found = pin(rows.groupBy("shard").applyInArrow(_shard_nodes, _NODE))
    nodes, ends = found.where("path is null"), found.where("path is not null")

    # merged by name: what holds for a node in all shards
    owner = F.min(F.when(F.col("n") > 0, F.struct("conv", "shard")))
    merged = pin(nodes.groupBy("id").agg(
        F.max("depth").alias("depth"), F.max("size").alias("size"), F.sum("n").alias("n_convs"), F.max("up_id").alias("up_id"), owner.alias("first")))
    children = merged.where("up_id is not null").groupBy(F.col("up_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    merged = merged.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    merged = pin(merged.select(
        "id", "depth", "n_convs", "n_children", F.col("first.conv").alias("conv"), F.col("first.shard").alias("owner"),
        (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.coalesce("size", F.lit(0))).alias("worth")))

    # summed over subtrees: every node counts in the shard of its smallest member
    mine = (F.col("owner") == F.col("shard")) & (F.col("n") > 0)
    full = nodes.select("shard", "idx", "up", "id", "n", F.col("depth").alias("_d")).join(merged, "id").select(
        "shard", "idx", "up", "id", F.col("_d").alias("depth"), "conv",
        F.when(mine, F.col("leaf")).otherwise(F.lit(0)).cast("long").alias("leaves"), F.when(mine, F.col("worth")).otherwise(F.lit(0)).cast("long").alias("saved"))
    if longest > block:
        full = _with_later(full, ends.where("not last"), merged, block)
    sums = full.groupBy("shard").applyInArrow(_shard_sums, "id binary, parent long, leaves long, saved long")
    total = sums.groupBy("id").agg(F.max("parent").alias("parent"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
    said = _digests(ends.where("last").select("id", "conv"))
    empty = hashlib.sha256(b"").hexdigest()
    return merged.join(total, "id").join(said, "id", "left").select(
        "conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))
