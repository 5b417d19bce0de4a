"""The eleven queries on the smallest data, next to plain Python versions of their contracts."""

import collections
import hashlib
import math
import re
import zlib

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def rows(spark, name, folder=FOLDER):
    return {r["doc_id"]: r for r in entry.queries()[name](spark, folder).collect()}


def test_op1_equals_the_tokenizer_on_whole_texts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, start, got = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, rows(spark, "op1_token_files")
    for i in sorted(docs):
        ids = [*tokenizer.encode(docs[i].text or "", add_special_tokens=False).ids, 1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)))
        start += len(ids)
    assert len(got) == len(docs)


def test_op2_groups(spark, docs):
    groups = collections.defaultdict(list)
    for i, r in docs.items():
        groups[r.text or ""].append(i)
    got = rows(spark, "op2_exact_copies")
    for text, ids in groups.items():
        for i in ids:
            assert tuple(got[i]) == (i, max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    assert len(got) == len(docs)


def test_op3_counts(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    from puckspark.llm.token_counts import sentencepiece_vocabulary

    vocabulary, unknown = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    tokenizer = Tokenizer(models.Unigram(vocabulary, unk_id=unknown, byte_fallback=False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    got = rows(spark, "op3_unigram_counts")
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(tokenizer.encode(r.text or "").ids) for i, r in docs.items()}


def test_op4_base_and_gain(spark, docs):
    tokens = {i: [*WORD.findall(ascii_lower(r.text or "")), None] for i, r in docs.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in docs}
    counts = collections.Counter(t for i in docs if not held[i] for t in tokens[i])
    n, v = sum(counts.values()), len(counts)
    got = rows(spark, "op4_recurrent_scores")
    for i in docs:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(tokens[i]), sum(counts[t] > 0 for t in tokens[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[i]), rel=1e-9)
        assert r.score < 0
    assert sum(got[i].score for i in docs if held[i]) > sum(got[i].base_score for i in docs if held[i])
    assert len(got) == len(docs)


def test_op5_base_spans(spark):
    folder = "/root/testdata/sf0.01"  # the smallest data hold no secrets
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got, some = rows(spark, "op5_secret_spans", folder), 0
    for i, r in docs.items():
        text = r.text or ""
        spans = [("assign", m) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [("access", m) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [("hex", m) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        count = collections.Counter(k for k, _ in spans)
        spans.sort(key=lambda s: (s[1].start(), ["assign", "access", "hex"].index(s[0])))
        joined = ",".join(f"{k}:{m.start()}:{m.end()}" for k, m in spans)
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (count["assign"], count["access"], count["hex"])
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(joined.split(",")) <= set(got[i].spans.split(","))
        some += len(spans)
    assert some and len(got) == len(docs)


def shingles(text):
    words = WORD.findall(ascii_lower(text or ""))
    return {tuple(words)} if 0 < len(words) < 5 else {tuple(words[k: k + 5]) for k in range(len(words) - 4)}


def groups(sets, percent):
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_op6_components(spark, docs):
    sets = {i: shingles(r.text) for i, r in docs.items()}
    label = groups(sets, 85)
    got = rows(spark, "op6_hyperminhash_groups")
    assert {i: tuple(r) for i, r in got.items()} == {i: (i, len(sets[i]), label[i], label[i] == i) for i in docs}
    assert len(set(label.values())) < len(docs)


def test_op7_targets(spark, docs):
    got = rows(spark, "op7_source_mix")
    size = {i: len(WORD.findall(r.text or "")) for i, r in docs.items()}
    of = collections.Counter()
    for i, r in docs.items():
        of[r.source] += size[i]
    order = sorted(of, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(of.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * of[s]}
        if not over:
            break
        for s in over:
            target[s] = 2 * of[s]
            left -= target[s]
        free -= over
    target |= {s: weight[s] * level for s in free}
    taken = collections.Counter()
    for i, r in got.items():
        assert (r["size"], r.source_size) == (size[i], of[docs[i].source])
        assert r.target == pytest.approx(target[docs[i].source], rel=1e-9)
        assert 0 <= r.taken <= 2 * size[i]
        taken[docs[i].source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert len(got) == len(docs)
    assert {i: r.taken for i, r in got.items()} == {i: r.taken for i, r in rows(spark, "op7_source_mix").items()}


def test_op8_windows(spark, docs):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    grams = collections.defaultdict(set)
    for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        words = word.findall(ascii_lower(r.text or ""))
        n = min(10, len(words))
        for k in range(len(words) - n + 1):
            if n:
                grams[tuple(words[k: k + n])].add(str(r.item_id))
    got, some = rows(spark, "op8_benchmark_leaks"), 0
    for i, r in docs.items():
        words, hit, items = word.findall(ascii_lower(r.text or "")), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(words) - n + 1):
                if (found := grams.get(tuple(words[k: k + n]))):
                    hit |= set(range(k, k + n))
                    items |= found
        want = (i, len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
        assert tuple(got[i]) == want
        some += bool(hit)
    assert some and len(got) == len(docs)


def test_op9_shards(spark, docs):
    got = rows(spark, "op9_sampled_splitters")
    load, slots, of_text = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for i, r in got.items():
        raw = (docs[i].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        of_text[raw].add(r.shard)
    assert set(load) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in of_text.values())
    assert max(load.values()) < 1.05 * min(load.values())


def test_op10_columns(spark, docs):
    got = rows(spark, "op10_toxic_segments")
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert set(got) == set(docs)


def test_op10_held_out(spark):
    """On enough labels, toxic documents that the fit has not seen are found and clean ones are left alone."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    seen = [(labels[r.doc_id], r.predicted) for r in entry.queries()["op10_toxic_segments"](spark, folder).where("held_out").collect() if r.doc_id in labels]
    bad, good = [p for y, p in seen if y == 1], [p for y, p in seen if y == 0]
    assert sum(bad) > 0.85 * len(bad) and sum(good) < 0.02 * len(good)
