"""The prefix trie against a dictionary of all prefixes, also with small shards and cut paths."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from puckspark.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string"


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            key = hashlib.sha256(f"{len(role or '')}:{role or ''}:{text or ''}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", key, text or ""))
    own = {c: [(r, t) for _, r, _, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def plain(paths):
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    children, ends = {}, {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    for c, path in paths.items():
        ends.setdefault(tuple(path), []).append(c)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(who) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(children.get(node, [])), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, who in members.items())


def result(df):
    return sorted(tuple(r[c] for c in ("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256")) for r in df.collect())


def sample(seed, n):
    rng, rows = random.Random(seed), []
    for c in range(n):
        for turn in range(rng.randrange(1, 9)):
            rows.append((c, turn, rng.choice(["user", "assistant"]), rng.choice(["hi", "é漢", "", "much longer"])))
    return rows


def test_query_is_as_its_contract_reads(spark, tmp_path):
    odd = [(None, 1, "user", "x"), (250, None, None, None), (250, 1, "user", None), (250, 1, "user", "b"), (250, 1, "user", "b"), (250, 3, "a", "b"), (250, 4, "a", "c"), (250, 4, "", "c"), (999, 0, "user", "hi")]
    rows = sample(1, 130) + odd
    spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("clash") for c in ("conv", "depth", "key", "shard", "id")}).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == plain(rebuilt(rows))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"]


def test_turns_are_told_apart_by_role_and_text(spark):
    df = spark.createDataFrame([(1, 0, "a", "1:b"), (2, 0, "a1:", "b"), (3, 0, None, "x"), (4, 0, "", "x")], TURNS)
    keys = {r.conv: bytes(r.key) for r in prefix_trie.ordered_turns(df).collect()}
    assert len(set(keys.values())) == 3 and keys[3] == keys[4]


@pytest.mark.parametrize("shard_turns, block", [(1 << 15, 4096), (25, 4096), (25, 3), (200, 4)])
def test_shards_and_cut_paths_give_one_trie(spark, shard_turns, block):
    rng = random.Random(shard_turns + block)
    paths = {}
    for c in range(60):
        path = [("u", rng.choice("ab"))] if c % 3 else [("u", "hot")]
        path += [("u", rng.choice("ab")) for _ in range(rng.randrange(9))]
        paths[c] = path
    paths |= {100 + i: paths[i] for i in range(0, 60, 3)}
    paths |= {200 + i: [("u", "hot")] * (40 + i) for i in range(3)} | {300: [], 301: []}
    key = lambda t: hashlib.sha256(repr(t).encode()).digest()
    rows = [(c, d, bytearray(key(t)), len(t[1])) for c, p in paths.items() for d, t in enumerate(p, 1)] + [(c, 0, None, None) for c, p in paths.items() if not p]
    df = spark.createDataFrame(rows, "conv long, depth long, key binary, size long").repartition(4)
    assert result(prefix_trie.prefix_trie(df, shard_turns, block)) == plain(paths)


def test_no_conversations(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], "conv long, depth long, key binary, size long")).isEmpty()


def test_double_array_holds_every_path():
    rng = np.random.default_rng(3)
    paths = [rng.zipf(1.4, rng.integers(0, 12)) % 500 for _ in range(800)]
    lengths = np.array([len(p) for p in paths])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    trie, levels = prefix_trie.pack(np.concatenate(paths).astype(np.int64), starts, lengths, 500)
    node_of = {}
    for d, (which, at) in enumerate(levels):
        for p, slot in zip(which.tolist(), at.tolist()):
            assert node_of.setdefault(slot, tuple(paths[p][:d])) == tuple(paths[p][:d])
    assert len(node_of) == len({tuple(p[:d]) for p in paths for d in range(len(p) + 1)})
    for slot, path in node_of.items():
        if path:
            assert node_of[int(trie.check[slot])] == path[:-1] and trie.base[trie.check[slot]] + path[-1] == slot
    assert (trie.child(np.zeros(500, np.int64), np.arange(500)) >= 0).sum() == len({p[0] for p in paths if len(p)})
