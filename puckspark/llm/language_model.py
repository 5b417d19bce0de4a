"""Document log-likelihood under a gated recurrent language model with class-factored output.

Frequent words are symbols of their own; the others share symbols by their last letters, and a word's share of such a
symbol follows its count. So every word, seen or not, has a probability, and the parts that a task must hold (symbols,
parameters, the table of frequent words) have a fixed size, while all counts are kept in a distributed table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.llm import gru
from puckspark.llm import text as T
from puckspark.operators.ordered import sequence_number
from puckspark.operators.skew import hot_keys
from puckspark.session import pin

OWN = 768  # symbols of single words, the end of a document among them
SHARED = 256  # symbols that words with like endings share
FREQUENT = 1 << 18  # words whose counts every task holds; the others' counts are joined
ROUNDS = 4  # shares of the training documents after each of which the parameters are averaged
PART_WORDS = 1 << 21  # words that train one copy of the parameters in a round, until there are as many parts as PARTS
PARTS = 4096
GROUP = 1 << 22  # words scored or trained on at a time
SUMMANDS = 16  # rows of parameter sums that reach the driver
END = int(T.mix(np.array([0xE17D], np.uint64))[0])


def document_tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, word hashes, shared symbol of each word) with the end token last."""
    for first, raw, rows in T.byte_chunks(texts):
        starts, ends, upto = T.word_spans(raw, rows)
        hashes = T.word_hashes(raw, starts, ends)[0]
        tail = np.zeros(len(starts), np.int64)
        for back, weight in ((1, 1), (2, 131), (3, 31337)):
            at = ends - back
            tail += np.where(at >= starts, T.lowered(raw[np.maximum(at, 0)]).astype(np.int64) + 1, 0) * weight
        shared = (tail * 2654435761 >> 7) % SHARED
        for i in range(len(rows) - 1):
            a, b = upto[i], upto[i + 1]
            yield first + i, np.append(hashes[a:b], np.uint64(END)), np.append(shared[a:b], 0)


@dataclass
class Vocabulary:
    """What every task holds: frequent words with their counts and symbols, and the totals of shared symbols."""

    total: int
    distinct: int
    words: np.ndarray = field(repr=False)  # hashes, ascending
    counts: np.ndarray = field(repr=False)
    symbols: np.ndarray = field(repr=False)
    shared: np.ndarray = field(repr=False)  # symbol of each group of like endings
    rest: np.ndarray = field(repr=False)  # 0.5 * (words + 1) + occurrences of each group, single words apart
    sizes: np.ndarray = field(repr=False)  # occurrences by symbol
    end: int = 0

    def lookup(self, hashes: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place among the frequent words or -1, symbol, whether the symbol is shared)."""
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        found = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        symbol = np.where(found, self.symbols[at] if len(self.words) else 0, self.shared[shared])
        symbol = np.where(hashes == np.uint64(END), self.end, symbol)
        own = np.ones(len(self.sizes), bool)
        own[self.shared] = False
        return np.where(found, at, -1), symbol, ~own[symbol]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, shared, c) of (id, text): occurrences of every word and of the end token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(held: list) -> pa.RecordBatch:
            h, s = (np.concatenate(x) for x in zip(*held))
            word, first, n = np.unique(h, return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(s[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["word", "shared", "c"])

        held, size = [], 0
        for batch in batches:
            for _, hashes, shared in document_tokens(batch.column(1)):
                held.append((hashes, shared))
                size += len(hashes)
                if size >= GROUP:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    return docs.mapInArrow(run, "word long, shared int, c long").groupBy("word").agg(F.first("shared").alias("shared"), F.sum("c").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Built from all counts; at most FREQUENT words and SHARED totals reach the driver."""
    total, distinct = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    top = counts.orderBy(F.desc("c"), "word").limit(FREQUENT).toPandas()
    hashes, c, shared = top["word"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64), top["shared"].to_numpy(np.int64)
    is_end = hashes == np.uint64(END)
    single = np.cumsum(~is_end) <= OWN - 1  # the most frequent words besides the end
    single |= is_end
    sums = {r[0]: (r[1], r[2]) for r in counts.where(F.col("word") != int(np.uint64(END).astype(np.int64))).groupBy("shared").agg(F.sum("c"), F.count(F.lit(1))).collect()}
    held, words = np.zeros(SHARED), np.zeros(SHARED)
    for k, (n, v) in sums.items():
        held[k], words[k] = n, v
    own = single & ~is_end
    np.subtract.at(held, shared[own], c[own])
    np.subtract.at(words, shared[own], 1)
    # symbols by falling counts, so that classes hold words of like frequency
    raw = np.zeros(OWN + SHARED)
    raw[0] = c[is_end].sum()
    raw[1: 1 + own.sum()] = c[own]
    raw[OWN:] = held
    place = np.empty(len(raw), np.int64)
    place[np.argsort(-raw, kind="stable")] = np.arange(len(raw))
    symbols = place[OWN + shared]
    symbols[own] = place[1: 1 + own.sum()]
    symbols[is_end] = place[0]
    order = np.argsort(hashes)
    return Vocabulary(int(total or 0), int(distinct), hashes[order], c[order], symbols[order], place[OWN:], held + 0.5 * (words + 1), np.sort(raw)[::-1], int(place[0]))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[np.ndarray]]]:
    """Batches whose last column is ``symbols``, and the symbols of all their rows, until they hold about GROUP words; a longer document
    is in a group with what came before."""
    held, symbols, size = [], [], 0
    for batch in batches:
        at = 0
        for i, raw in enumerate(batch.column(batch.num_columns - 1)):
            symbols.append(np.frombuffer(raw.as_py(), np.int16))
            size += len(symbols[-1])
            if size >= GROUP:
                yield [*held, batch.slice(at, i + 1 - at)], symbols
                held, symbols, size, at = [], [], 0, i + 1
        if at < batch.num_rows:
            held.append(batch.slice(at))
    if symbols:
        yield held, symbols


def look_up(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """(row, id, learn, n_tokens, n_known, base, inner, rare, times, symbols) of (id, learn, text): a row number, sums over the frequent
    words, the words that are not among them with their occurrences, and the symbols as 16-bit integers."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    schema = "row long, id long, learn boolean, n_tokens long, n_known long, base double, inner double, rare array<long>, times array<int>, symbols binary"
    names = ["row", "id", "learn", "n_tokens", "n_known", "base", "inner", "rare", "times", "symbols"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, row = shipped.value, TaskContext.get().partitionId() << 36
        logs = np.append(np.log10(words.counts + 0.5), 0.0)
        rest = np.zeros(len(words.sizes))
        rest[words.shared] = np.log10(words.rest)

        def packed(rows: list) -> pa.RecordBatch:
            part = list(zip(*rows))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in c]))), pa.int32()), pa.array(np.concatenate(c))) for c in part[7:9]]
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            return pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(part, kinds)), *lists, pa.array(part[9], pa.binary())], names=names)

        for batch in batches:
            ids, learn = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows, size = [], 0
            for i, hashes, shared in document_tokens(batch.column(2)):
                at, symbol, grouped = words.lookup(hashes, shared)
                rare, times = np.unique(hashes[at < 0], return_counts=True)
                log = logs[at]
                rows.append((row, ids[i], learn[i], len(hashes), int((at >= 0).sum()), float(log.sum()), float(log[grouped].sum() - rest[symbol[grouped]].sum()),
                             rare.view(np.int64), times.astype(np.int32), symbol.astype(np.int16).tobytes()))
                row, size = row + 1, size + len(hashes)
                if len(rows) >= 2000 or size >= GROUP:
                    yield packed(rows)
                    rows, size = [], 0
            if rows:
                yield packed(rows)

    return docs.mapInArrow(run, schema)


def train(told: DataFrame, words: Vocabulary, rounds: int = ROUNDS) -> gru.Params:
    """One pass over all rows of (row, id, symbols) in ``rounds``; ``told`` should be stored. In a round each of a number of parts trains the
    same parameters on its documents, and their mean, weighted by words, starts the next.

    The part of a document follows from a hash of its id and symbols, and the number of parts from the number of words, so the same
    documents give the same parameters however they are dealt over tasks and files. Documents alike in both share a part, unless
    they make up over one in 200 rows: those copies are numbered and dealt over parts by number.
    """
    spark = told.sparkSession
    params, end = gru.start(words.sizes), words.end
    parts = int(min(PARTS, max(1, words.total // (rounds * PART_WORDS))))
    marked = told.select(F.xxhash64("id", "symbols").alias("print"), "row", "symbols")
    hot = hot_keys(marked, ["print"])
    dealt = marked.withColumn("copy", F.lit(0).cast("long"))
    if not hot.isEmpty():  # fewer keys than one in HOT_SHARE rows
        copies = sequence_number(marked.join(F.broadcast(hot), "print"), ["print"], ["row"], "copy")
        dealt = dealt.join(F.broadcast(hot), "print", "left_anti").unionByName(copies.withColumn("copy", F.pmod("copy", F.col("_parts").cast("long"))).drop("_parts"))
    dealt = dealt.withColumn("deal", F.pmod(F.xxhash64("print", "copy"), F.lit(rounds * parts)))
    for k in range(rounds):
        given = spark.sparkContext.broadcast(gru.pack(params))

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            p, n = gru.unpack(given.value, gru.start(np.ones(OWN + SHARED))), 0
            for _, symbols in _groups(batches):
                n += gru.train(p, symbols, end)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([(np.frombuffer(gru.pack(p), np.float32) * np.float64(n)).tobytes()])], names=["n", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, sums = 0, None
            for batch in batches:
                for m, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    n, sums = n + m, np.frombuffer(raw, np.float64) + (0 if sums is None else sums)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tobytes()])], names=["n", "sums"])

        own = dealt.where(F.pmod("deal", F.lit(rounds)) == k).select(F.floor(F.col("deal") / rounds).cast("int").alias("part"), "print", "symbols")
        trained = own.repartitionById(parts, F.col("part")).sortWithinPartitions("print").select("symbols").mapInArrow(run, "n long, sums binary")
        got = trained.repartition(SUMMANDS, F.xxhash64("sums")).mapInArrow(add, "n long, sums binary").collect()
        if got:
            mean = sum(np.frombuffer(r[1], np.float64) for r in got) / sum(r[0] for r in got)
            params = gru.unpack(mean.astype(np.float32).tobytes(), params)
    return params


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_on: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Learns from the documents whose id satisfies ``train_on`` (default: all). Tokens are the words and one end; ``base_score`` is the
    smoothed unigram log10 probability, ``score`` that of the recurrent model, over the whole document. Null and empty texts are
    the end token alone. Without training documents all words are alike. Rows that repeat an id are each scored; a null id is not
    trained on unless ``train_on`` says so. Other columns are ignored.

    A task holds about GROUP words, the longest document, and the fixed-size tables. Counts of words beyond the FREQUENT are joined
    by word, each of them rare. Symbols are stored once, 2 bytes a word; training and scoring read them in place of the texts.
    """
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.withColumn("learn", F.lit(True) if train_on is None else F.coalesce(train_on(F.col("id")), F.lit(False)))
    counts = pin(count_words(own.where("learn")))
    words = vocabulary(counts)
    told = pin(look_up(own.select("id", "learn", "text"), words))
    params = train(told.where("learn"), words)
    shipped, end = docs.sparkSession.sparkContext.broadcast(gru.pack(params)), words.end
    kept = ["row", "id", "n_tokens", "n_known", "base", "inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = gru.unpack(shipped.value, gru.start(np.ones(OWN + SHARED)))
        for held, symbols in _groups(batches):
            model, at = gru.score(p, symbols, end), 0
            for batch in held:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(model[at: at + batch.num_rows])], names=[*kept, "model"])
                at += batch.num_rows

    scored = pin(told.select(*kept, "symbols").mapInArrow(run, "row long, id long, n_tokens long, n_known long, base double, inner double, model double"))
    rare = told.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    # the end token is always frequent unless nothing was learned, when it counts like an unseen word
    joined = rare.join(counts.select("word", "c"), "word", "left")
    sums = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("also"))
    # what a rare word's share of its shared symbol is divided by
    lower = F.log10(F.lit(words.total + 0.5 * (words.distinct + 1)))
    out = scored.join(sums, "row", "left").withColumn("more", F.coalesce("more", F.lit(0.0))).withColumn("also", F.coalesce("also", F.lit(0)))
    return out.select(
        "id", "n_tokens", (F.col("n_known") + F.col("also")).cast("long").alias("n_known"), F.lit(words.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * lower).alias("base_score"),
        (F.col("model") / F.lit(float(np.log(10))) + F.col("inner") + F.col("more")).alias("score"),
    )
