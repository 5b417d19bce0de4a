"""Periodic runs against a scan of every period, and the query against a plain reading of its contract."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from puckspark.llm import periodic, queries


def scanned(words, least):
    """All runs, by trying every period at every place."""
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)  # the smallest period of a stretch comes first
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def sample(rng, kind):
    if kind == 0:
        return [rng.randrange(2) for _ in range(rng.randrange(60))]
    if kind == 1:
        return sum(([rng.randrange(3) for _ in range(rng.randrange(1, 7))] * rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))), [])
    if kind == 2:  # Fibonacci words hold most runs for their length
        a, b = [0], [0, 1]
        for _ in range(rng.randrange(3, 8)):
            a, b = b, b + a
        return b[rng.randrange(5):]
    u = [rng.randrange(2) for _ in range(rng.randrange(1, 5))]
    return (u * rng.randrange(1, 12) + [rng.randrange(2) for _ in range(rng.randrange(3))] + u * rng.randrange(1, 12)) * rng.randrange(1, 4)


def test_all_runs_are_found():
    rng = random.Random(5)
    for trial in range(1200):
        words = sample(rng, trial % 4)
        for least in (2, 12):
            got = [x.tolist() for x in periodic.find_periods(np.array(words, np.int64), least)]
            assert list(zip(*got)) == scanned(words, least), words


def test_factors_are_equal_where_words_are():
    rng = random.Random(1)
    words = [rng.randrange(3) for _ in range(80)]
    for k, level in enumerate(periodic.basic_factors(np.array(words))):
        m = 1 << k
        for i in range(len(words) - m + 1):
            for j in range(i + 1, len(words) - m + 1):
                assert (level[i] == level[j]) == (words[i: i + m] == words[j: j + m])


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = scanned(words, 12)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(((-size, s, q) for s, size, q in runs), default=None)
    first = (None,) * 4 if best is None else (best[1], -best[0], best[2], 1000 * -best[0] // best[2])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *first, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_is_as_its_contract_reads(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(120))), "clash", "clash") for i in range(150)]
    rows += [(None, "x y " * 20, "", ""), (None, None, "", ""), (7, "x  y\tx y x y x y x y x y x y\n", "", ""), (7, "X x " * 9, "", ""), (8, None, "", ""), (9, " \n ", "", ""), (9, "", "", ""),
             (10, "é漢 😀 " * 8, "", ""), (1101, " ".join(f"w{i % 5000}" for i in range(30_000)) + " end", "", "")]
    spark.createDataFrame(rows, "doc_id long, text string, runs string, words string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in queries.QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect()), key=repr)
    long = [r for r in got if r[0] == 1101]
    assert len(long) == 1 and long[0][1] >= 1 and (zlib.crc32(b"1101") % 10 == 0 or long[0][2:5] == (0, 30_000, 5000))
    want = sorted((plain(i, t) for i, t, _, _ in rows if i != 1101), key=repr)
    assert [r for r in got if r[0] != 1101] == want
    assert sum(1 for r in want if r[1]) > 5 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(150))


def test_words_and_runs_of_odd_documents(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a " * 12), (3, "a " * 12), (None, "b c " * 6)], "doc_id long, text string").withColumn("id", F.lit("clash"))
    got = sorted((tuple(r)[:2] + (len(r.runs), r.collapsed) for r in periodic.periodic_runs(df).collect()), key=repr)
    assert got == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (3, 12, 1, "a"), (3, 12, 1, "a"), (None, 12, 1, "b c")], key=repr)
    assert periodic.periodic_runs(df.limit(0)).isEmpty()
