"""SimHash groups against a comparison of all fingerprints."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from puckspark.llm import queries, simhash

WORDS = [f"w{i}" for i in range(200)]


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reached(values, ids, budget=2):
    """Smallest id that links reach from every value."""
    out = {}
    for v in values:
        if v in out:
            continue
        seen, todo = {v}, [v]
        while todo:
            x = todo.pop()
            near = [y for y in values if y not in seen and bin(x ^ y).count("1") <= budget]
            seen.update(near)
            todo += near
        known = [i for y in seen for i in ids[y] if i is not None]
        out.update({y: min(known, default=None) for y in seen})
    return out


def clustered(seed, n):
    rng = np.random.default_rng(seed)
    base = [int(x) for x in rng.integers(0, 2**63, n)] + [0, 2**64 - 1]
    out = set(base)
    for b in base[: n // 2]:
        for _ in range(5):
            x = b
            for _ in range(rng.integers(0, 4)):
                x ^= 1 << int(rng.integers(0, 64))
            out.add(x)
    for _ in range(150):  # many that share their first 40 bits
        x = base[0]
        for _ in range(rng.integers(0, 6)):
            x ^= 1 << int(rng.integers(0, 24))
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("node_rows", [1 << 15, 30])
def test_links_connect_what_is_near(spark, node_rows):
    values = clustered(4, 60)
    signed = {v: int(np.array(v, np.uint64).view(np.int64)) for v in values}
    df = spark.createDataFrame([(s,) for s in signed.values()], "fp long").repartition(3)
    links = simhash.linked(df, node_rows=node_rows).collect()
    back = {s: v for v, s in signed.items()}
    groups = {v: {v} for v in values}
    for a, b in links:
        one, other = groups[back[a]], groups[back[b]]
        if one is not other:
            one |= other
            groups.update({v: one for v in other})
    want = reached(values, {v: [k] for k, v in enumerate(values)})
    place = {v: k for k, v in enumerate(values)}
    assert {v: min(place[x] for x in g) for v, g in groups.items()} == want


def test_walk_returns_near_pairs_only():
    values = np.array(clustered(8, 40), np.uint64)
    one = lambda x: np.array([x], np.int64)
    got = set()
    for a, b in simhash.walk(values, (one(0), one(len(values)), one(0), one(len(values)), one(0)), one(0), 2):
        pairs = set(zip(a.tolist(), b.tolist()))
        assert not pairs & got
        got |= pairs
    assert got == {(i, j) for j in range(len(values)) for i in range(j) if bin(int(values[i]) ^ int(values[j])).count("1") <= 2}


def test_query_is_as_its_contract_reads(spark, tmp_path):
    rng = random.Random(2)
    prose = lambda n: [rng.choice(WORDS) for _ in range(n)]
    rows, k = [], 0
    for _ in range(12):
        words = prose(rng.randrange(150, 400))
        for _ in range(4):
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(WORDS)
            rows.append((k, " ".join(words)))
            k += 1
    same = " ".join(prose(30))
    rows += [(1000 + i, same) for i in range(60)] + [(None, same)] * 20 + [(None, "only here"), (None, "only here"), (50, "One TWO"), (51, "one\ttwo"), (51, "one two\n"), (52, None), (53, ""), (None, " \n"), (54, "É漢 é"), (55, " ".join(prose(70_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("fp", "id", "component", "n", "least")})
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op11_simhash_trie"](spark, str(tmp_path)).collect()), key=repr)
    prints = [plain_fingerprint(t) for _, t in rows]
    ids = {}
    for (i, _), p in zip(rows, prints):
        ids.setdefault(p, []).append(i)
    least = reached(sorted(ids), ids)
    assert got == sorted(((i, f"{p:016x}", least[p]) for (i, _), p in zip(rows, prints)), key=repr)
    assert simhash.simhash_groups(df.limit(0)).isEmpty()
