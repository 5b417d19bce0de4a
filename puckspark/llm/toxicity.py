"""Toxic passages as maximum-scoring segments of token log-odds.

Labelled documents give each word, and each beginning of a word, a log-odds weight under a Dirichlet prior that follows its
overall frequency. Words are runs of letters and digits, A-Z counted as a-z. Along a document every word scores its weight, unknown words a small negative one; the
segments of maximal score are found in one pass, and a segment's score is judged by the extreme-value law of
random segments in a text of that length. The evidence of all segments is calibrated on the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from puckspark.llm import text as T
from puckspark.session import pin

FIT_ROWS = 40_000  # labelled documents the model is fitted on at most, taken by a hash of the id
FLAT, PRIOR = 0.5, 50.0  # Dirichlet prior of a unit: a flat part, and a part in proportion to its overall share
MIN_Z = 4.0  # signed root of the likelihood ratio; units below it count as unknown
STEMS = (6, 5, 4)  # bytes; a word without a weight of its own takes that of its longest known beginning
SIGNIFICANT = 0.001  # share of clean documents of its length with a segment as good, below which a passage is reported


def segments(at: np.ndarray, gain: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal segments, as (first, last, score), of a sequence that scores ``gain`` at the positions ``at`` and ``rest`` < 0
    elsewhere. Linear in ``at``: positions between them only add a multiple of ``rest``.

    A candidate keeps the total before it (left) and through it (right). A new one looks back for the nearest candidate
    whose left is lower; unless that one's right is at least its own, the two and all between merge.
    """
    if not len(at):
        return []
    through = np.cumsum(gain) + rest * (at - np.arange(len(at)))
    before = through - gain
    kept: list[tuple[int, int, float, float]] = []
    for p, g, left, right in zip(at.tolist(), gain.tolist(), before.tolist(), through.tolist()):
        if g <= 0:
            continue
        first = p
        while True:
            k = len(kept) - 1
            while k >= 0 and kept[k][2] >= left:
                k -= 1
            if k < 0 or kept[k][3] >= right:
                kept.append((first, p, left, right))
                break
            first, _, left, _ = kept[k]
            del kept[k:]
    return [(a, b, right - left) for a, b, left, right in kept]


def _units(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, hashes of its words and of their beginnings)."""
    for first, raw, rows in T.byte_chunks(texts):
        starts, ends, upto = T.word_spans(raw, rows, T.PUNCTUATION)
        hashes = T.word_hashes(raw, starts, ends, STEMS)
        for i in range(len(rows) - 1):
            yield first + i, [h[upto[i]: upto[i + 1]] for h in hashes]


class Lexicon:
    """Hashes of words and beginnings, their weights, the weight of other words, and the law of random segments."""

    def __init__(self, words: dict[int, float], rest: float, decay: float, scale: float = 1.0):
        order = sorted(words)
        self.hashes, self.weights = np.array(order, np.uint64), np.array([words[w] for w in order])
        self.rest, self.decay, self.scale = rest, decay, scale

    def passages(self, units: list[np.ndarray]) -> list[tuple[int, int, float]]:
        """Maximal segments of one document, best first."""
        if not len(self.hashes) or not len(units[0]):
            return []
        gain = np.zeros(len(units[0]))
        for hashes in units:  # the whole word first, then ever shorter beginnings
            near = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            gain = np.where((gain == 0) & (self.hashes[near] == hashes), self.weights[near], gain)
        at = np.flatnonzero(gain)
        return sorted(segments(at, gain[at], self.rest), key=lambda s: (-s[2], s[0]))

    def chance(self, score: float, n: int) -> float:
        """Probability of a segment of at least this score in n random words: 1 - exp(-K n exp(-decay * score))."""
        return float(-np.expm1(-self.scale * max(n, 1) * np.exp(-self.decay * score)))

    def features(self, scores: list[float], n: int) -> list[float]:
        """What the calibration sees of the scores of a document's segments, best first, and its number of words: the best segment in units
        of the law, less log of the length; significant segments; their total; the best score."""
        if not len(scores):
            return [0.0, 0.0, 0.0, 0.0]
        best = self.decay * scores[0] - np.log(self.scale * n)
        sure = [s for s in scores if self.chance(s, n) < SIGNIFICANT]
        return [max(0.0, float(best)), float(np.log1p(len(sure))), float(np.log1p(sum(sure))), float(np.log1p(scores[0]))]

    def read(self, units: list[np.ndarray]) -> list[float]:
        """Features of one document."""
        return self.features([s for _, _, s in self.passages(units)], len(units[0]))


def fitted_scale(best: Column, n: Column, decay: float, least: float) -> Column:
    """K of the law at its greatest likelihood, an aggregate over clean documents with their best segments (null: no segment).

    That a document of n words has no segment better than s has chance exp(-K n exp(-decay * s)). One with a best segment adds that law's
    density to the likelihood, one without the chance of none above ``least``, the least weight; so K is the number of the
    former over the sum of n exp(-decay * s) of all. Without any of them, half a document is put in.
    """
    return F.greatest(F.count(best), F.lit(0.5)) / F.sum(F.greatest(n, F.lit(1)) * F.exp(-F.lit(decay) * F.coalesce(best, F.lit(least))))


def _decay(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(x * weight)) = 1, which a negative mean weight guarantees."""
    low, high = 1e-6, 1e-6
    while (shares * np.exp(np.minimum(high * weights, 500))).sum() <= 1 and high < 1e3:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (shares * np.exp(np.minimum(mid * weights, 500))).sum() <= 1 else (low, mid)
    return high


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, train) -> DataFrame:
    marks = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    marks = marks.where(train(F.col("id"))) if train is not None else marks
    n = marks.count()
    if n > FIT_ROWS:
        marks = marks.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < int(1_000_000 * FIT_ROWS / n))
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, batch.num_rows), np.int64)
            for row, words in T.document_words(batch.column(1)):
                windows = T.window_hashes(words)
                for k in range(2):  # sums of two mixings of the distinct windows: 128 bits in all
                    sums[k, row] = T.mix(windows ^ np.uint64(k)).sum(dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[0]), pa.array(sums[1])], names=["id", "text", "y", "p", "q"])

    rows = pin(own.join(marks, "id").select("id", "text", "y").mapInArrow(printed, "id long, text string, y int, p long, q long"))
    # copies would pass for independent evidence: of texts with the same set of windows and the same label, the smallest id stays
    first = rows.groupBy("p", "q", "y").agg(F.min("id").alias("id"))
    return rows.join(first, ["p", "q", "y", "id"]).select("id", "text", "y").dropDuplicates(["id", "y"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the last one constant, of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train=None) -> tuple[Lexicon, np.ndarray]:
    """Lexicon and calibration weights from the labelled documents that ``train`` (a column function of the id) admits.

    At most about ``FIT_ROWS`` labelled documents are used, and of those with the same label and the same set of word windows one, so word counts and features are bounded; words that the
    labels tell little about are left out. An id labelled twice counts with its larger label, a null label not at all. Without
    documents of both labels the lexicon is empty and every score is the share of the label, or 0.5.
    """
    rows = _labelled(docs, labels, id_col, text_col, label_col, train)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            held: list[list[np.ndarray]] = [[], []]
            for row, units in _units(batch.column(0)):
                # a unit counts once in a document, so that one long text can't fix its weight
                held[int(y[row] > 0)].append(np.unique(np.concatenate(units)))
            for label, parts in enumerate(held):
                if parts:
                    word, n = np.unique(np.concatenate(parts), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(np.full(len(word), label, np.int32)), pa.array(n.astype(np.int64))], names=["word", "y", "n"])

    counts = rows.select("text", "y").mapInArrow(counted, "word long, y int, n long")
    words = pin(counts.groupBy("word").agg(F.sum(F.when(F.col("y") > 0, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") > 0, 0).otherwise(F.col("n"))).alias("good")))
    bad, good = (float(v or 0) for v in words.agg(F.sum("bad"), F.sum("good")).first())
    size = dict(rows.groupBy("y").count().collect())
    if not bad or not good:
        return Lexicon({}, -1.0, 1.0, 1.0), np.array([0.0, 0, 0, 0, 0.0 if not size else 30.0 if max(size) > 0 else -30.0])
    prior = F.lit(FLAT) + (F.col("bad") + F.col("good")) * F.lit(PRIOR / (bad + good))
    odds = F.log((F.col("bad") + prior) / (bad - F.col("bad") + PRIOR)) - F.log((F.col("good") + prior) / (good - F.col("good") + PRIOR))
    part = F.lit(bad / (bad + good))
    ratio = F.col("bad") * F.log(F.col("bad") / ((F.col("bad") + F.col("good")) * part)) + F.when(
        F.col("good") > 0, F.col("good") * F.log(F.col("good") / ((F.col("bad") + F.col("good")) * (1 - part)))).otherwise(0.0)
    sure = (F.col("bad") > (F.col("bad") + F.col("good")) * part) & (2 * ratio >= MIN_Z**2)
    told = words.where(sure).select("word", odds.alias("w"), (F.col("bad") + F.col("good")).alias("c"), "good").collect()
    lexicon = {int(np.int64(r[0]).astype(np.uint64)): float(r[1]) for r in told}
    weights = np.array([r[1] for r in told])
    shares = np.array([r[3] + 0.5 for r in told]) / (good + 1)
    # other words: what their total share tells, and at least so low that the mean weight is negative
    mass_bad = sum(r[2] - r[3] for r in told) / bad
    mass_good = sum(r[3] for r in told) / good
    rest = float(np.log(max(1 - mass_bad, 1e-6) / max(1 - mass_good, 1e-6)))
    mean = float((weights * shares).sum())
    rest = min(rest, -2 * mean / max(1 - shares.sum(), 1e-3), -0.01)
    decay = _decay(np.append(weights, rest), np.append(shares, max(1 - shares.sum(), 1e-3)))
    law = Lexicon(lexicon, rest, decay)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, scores = np.zeros(batch.num_rows, np.int64), [[]] * batch.num_rows
            for row, units in _units(batch.column(0)):
                n[row], scores[row] = len(units[0]), [s for _, _, s in law.passages(units)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n), pa.array(scores, pa.list_(pa.float64()))], names=["y", "n", "scores"])

    found = pin(rows.select("text", "y").mapInArrow(measured, "y int, n long, scores array<double>"))
    least = float(weights[weights > 0].min()) if (weights > 0).any() else 0.0
    law.scale = found.where("y <= 0").agg(fitted_scale(F.get("scores", F.lit(0)), F.col("n"), decay, least)).first()[0]

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = [law.features(s, n) for s, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], names=["y", "f"])

    features = found.mapInArrow(featured, "y int, f array<double>").groupBy("y", "f").agg(F.count(F.lit(1)).alias("c")).collect()
    x, y = np.array([r[1] for r in features]), np.array([float(r[0] > 0) for r in features])
    c = np.array([r[2] for r in features])
    return law, _logistic(np.repeat(x, c, axis=0), np.repeat(y, c))


def score(docs: DataFrame, law: Lexicon, calibration: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, passages) of every row; passages are (first word, last word, score, chance) of the significant segments,
    in order of the text. Null and empty texts have no passage and score like a text without any. Other columns are ignored."""
    spark: SparkSession = docs.sparkSession
    model = spark.sparkContext.broadcast((law, np.asarray(calibration)))  # bounded by FIT_ROWS
    schema = "id long, score double, passages array<struct<first:int,last:int,score:double,chance:double>>"
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law, w = model.value
        for batch in batches:
            scores, found = np.zeros(batch.num_rows), [[]] * batch.num_rows
            for row, units in _units(batch.column(1)):
                scores[row] = 1 / (1 + np.exp(-np.clip(np.dot(law.read(units), w[:-1]) + w[-1], -30, 30)))
                sure = [(a, b, s, law.chance(s, len(units[0]))) for a, b, s in law.passages(units)]
                found[row] = [dict(zip(("first", "last", "score", "chance"), s)) for s in sorted(sure) if s[3] < SIGNIFICANT]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array(found, kind)], names=["id", "score", "passages"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def scored_rows(docs: DataFrame, law: Lexicon, calibration: np.ndarray, text_col: str = "text") -> DataFrame:
    """(doc, score) of every row: all its columns as a struct, so that what is decided by the score holds for the row, whatever its id."""
    model = docs.sparkSession.sparkContext.broadcast((law, np.asarray(calibration)))  # bounded by FIT_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        law, w = model.value
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for row, units in _units(batch.column(0).field(text_col)):
                scores[row] = 1 / (1 + np.exp(-np.clip(np.dot(law.read(units), w[:-1]) + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc", "score"])

    return docs.select(F.struct("*").alias("doc")).mapInArrow(run, ST.StructType().add("doc", docs.schema).add("score", "double"))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train=None) -> DataFrame:
    """``fit`` on the labelled documents and ``score`` all."""
    return score(docs, *fit(docs, labels, id_col, text_col, label_col, train), id_col, text_col)
