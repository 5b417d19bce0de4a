"""Token counts by a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character of a word; dynamic programming keeps
the best score and its number of pieces. Ties follow the tokenizers library: pieces are tried by their start, and a later
one replaces the best only with a higher score. A character that no piece covers alone may be unknown, at ten below the lowest score;
neighbouring unknown characters count as one token.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 300_000
Vocabulary = list[tuple[str, float]]

_workers: dict[str, "Counter"] = {}


def sentencepiece_vocabulary(path: str) -> tuple[Vocabulary, int]:
    """Pieces with scores, and the place of the unknown piece; control and byte pieces are not part of a text's pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i)]
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids], ids.index(model.unk_id())


class Counter:
    """Counts for words that stand after a space mark."""

    def __init__(self, vocabulary: Vocabulary, unknown: int):
        self.automaton, self.cache = ahocorasick.Automaton(), {}
        for place, (piece, score) in enumerate(vocabulary):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, place == unknown))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY

    def word(self, word: str) -> tuple[int, float]:
        """(tokens, score) of the best path."""
        n = len(word)
        best, count, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches: Iterator = self.automaton.iter(word)
        match = next(matches, None)
        for end in range(1, n + 1):
            top, from_, unk, single = None, 0, False, False
            while match is not None and match[0] == end - 1:  # longest first, so by ascending start
                size, score, is_unknown = match[1]
                start = end - size
                if top is None or best[start] + score > top:
                    top, from_, unk = best[start] + score, start, is_unknown
                single = single or size == 1
                match = next(matches, None)
            if not single and (top is None or best[end - 1] + self.unknown > top):
                top, from_, unk = best[end - 1] + self.unknown, end - 1, True
            best[end], open_run[end] = top, unk
            count[end] = count[from_] + (not (unk and open_run[from_]))
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        """(tokens, score) of a text whose spaces become marks, one mark being put before it unless it begins with one."""
        if not text:
            return 0, 0.0
        words = text.replace(SPACE, " ").split(" ")
        if not words[0]:
            words = words[1:]
        cache, total, score = self.cache, 0, 0.0
        for w in words:
            got = cache.get(w)
            if got is None:
                if len(cache) >= CACHED_WORDS:
                    cache.clear()
                got = cache[w] = self.word(SPACE + w)
            total += got[0]
            score += got[1]
        return total, score


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, score) of every row: tokens of the whole text by the unigram vocabulary of the file, and the sum of their scores.

    Null and empty texts have none. Every row is counted alone, so repeated rows and ids are repeated; other columns are ignored. A worker
    holds the vocabulary, one batch and a bounded table of words already counted; a word without spaces needs memory for its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary_path not in _workers:
            _workers[vocabulary_path] = Counter(*sentencepiece_vocabulary(vocabulary_path))
        counter = _workers[vocabulary_path]
        for batch in batches:
            got = [counter.text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in got], pa.int64()), pa.array([s for _, s in got], pa.float64())], names=["id", "n_tokens", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, n_tokens long, score double")
