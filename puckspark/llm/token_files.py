"""Token ids of documents as files of range-coded blocks.

A file is Parquet; each row is a group of whole documents in ascending id order: their ids and lengths, the payload of all blocks,
the end and checksum of every block. Documents follow one another without separators, blocks are cut regardless of them.
"""

from __future__ import annotations

import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from puckspark.llm import range_coder

GROUP_IDS = 1 << 23  # ids after which a group ends; a longer document is a group of its own
CACHED_WORDS = 500_000  # words a Python worker remembers; beyond them only those of the slice it is at
SLICE_BYTES = 1 << 24  # bytes of text cut into pieces at a time; a longer document is taken alone

_FILE = pa.schema([
    ("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("n", pa.int64()),
    ("wide", pa.bool_()), ("payload", pa.binary()), ("ends", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())),
])
_FILE_DDL = "part int, seq int, doc_ids array<long>, lengths array<int>, n long, wide boolean, payload binary, ends array<long>, sums array<long>"

# A text of which nothing matches _ODD may be cut between punctuation and letters or digits, others at ASCII white space only.
_ODD = r"[^\t-\r -~À-ÖØ-öø-ÿ]|'|<\|"
_SPACE = " \t\n\r\x0b\x0c"
_SPACES, _SIGN, _WORD = range(3)  # kinds of bytes
_KIND = bytes(_SPACES if chr(b) in _SPACE else _SIGN if chr(b) in string.punctuation else _WORD for b in range(256))
_workers: dict[str, "WordIds"] = {}


class WordIds:
    """Ids of texts by a tokenizer whose tokens never cross white space: pieces of text are looked up, and new ones are
    encoded by the library.

    The pieces are found out from the tokenizer: if it splits letters from punctuation, those are looked up apart, and if it ignores
    case, so are ASCII texts. A text with other than Latin letters, with apostrophes or with the brackets of a special token is cut
    at white space only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        one = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if one("quick, fox") != one("quick,") + one("fox"):
            raise ValueError("tokens of this tokenizer may cross white space")
        self.fine = one("(quick-fox),jumps.") == [i for p in ("(", "quick", "-", "fox", "),", "jumps", ".") for i in one(p)]
        self.lower = one("Quick FOX") == one("quick fox")
        self.mark = one(",")[0] if len(one(",")) == 1 else None
        probes = [*"abcdefghijklmnopqrstuvwxyz", "quick", "fox", "jumps", "thequickbrownfox", "qzxjvwkfpm"]
        self.plain = self.lower and all(one(p) == [t.id for t in self.tokenizer.model.tokenize(p)] for p in probes)

    def _learn(self, pieces: list[str]) -> None:
        """Adds pieces to the known ones. Lower-case a-z goes straight to the library's model if that makes no difference; other words
        travel as one text with a comma after each, which is not part of any; the rest one by one."""
        known, words, rest = self.known, [], []
        if self.plain:
            encode = self.tokenizer.model.tokenize
            for p in pieces:
                if p.isascii() and p.isalpha() and p.islower():
                    ids = [t.id for t in encode(p)]
                    known[p] = struct.pack(f"<{len(ids)}I", *ids)
                else:
                    rest.append(p)
            pieces = rest
        if self.mark is not None:
            words = [p for p in pieces if p.isalnum()]
            pieces = [p for p in pieces if not p.isalnum()]
        for a in range(0, len(words), 10_000):
            batches = [words[b: b + 100] for b in range(a, min(a + 10_000, len(words)), 100)]
            encoded = self.tokenizer.encode_batch_fast([" , ".join([*batch, ""]) for batch in batches], add_special_tokens=False)
            for batch, e in zip(batches, encoded):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(ids == self.mark).tolist()
                if len(ends) != len(batch):
                    pieces += batch
                    continue
                raw, begin = ids.tobytes(), 0
                for p, end in zip(batch, ends):
                    known[p], begin = raw[4 * begin: 4 * end], end + 1
        for a in range(0, len(pieces), 10_000):
            batch = pieces[a: a + 10_000]
            for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)):
                known[p] = np.array(e.ids, "<u4").tobytes()

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All texts as pieces, each with the white space before it, and where in them every text ends."""
        at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset: texts.offset + len(texts) + 1]
        first, at = at[0], at - at[0]
        data = bytearray(memoryview(texts.buffers()[2])[first: first + at[-1]])
        kind = np.frombuffer(data.translate(_KIND), np.uint8)
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False) if self.fine else np.ones(len(texts), bool)
        for i in np.flatnonzero(odd):
            own = kind[at[i]: at[i + 1]]
            own[own == _SIGN] = _WORD
        if self.lower:
            lowered = data.lower()  # of A-Z only
            for i in np.flatnonzero(~pc.string_is_ascii(texts).to_numpy(zero_copy_only=False)):
                lowered[at[i]: at[i + 1]] = data[at[i]: at[i + 1]]
            data = lowered
        begins = np.zeros(len(kind) + 1, bool)
        np.logical_and(kind[1:] != kind[:-1], kind[:-1] != _SPACES, out=begins[1:-1])
        begins[at] = True  # the last one is the end of all
        cuts = np.flatnonzero(begins)
        pieces = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data))
        return pieces, np.searchsorted(cuts, at[1:])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each has; null counts as empty."""
        texts = texts.fill_null("").cast(pa.large_string())
        if not len(texts) or not pc.sum(pc.binary_length(texts)).as_py():
            return np.zeros(0, "<u4"), np.zeros(len(texts), np.int64)
        pieces, text_ends = self._cut(texts)
        pieces = pieces.dictionary_encode()
        which = pieces.indices.to_numpy()
        distinct = pc.ascii_trim(pieces.dictionary, characters=_SPACE).to_numpy(zero_copy_only=False).tolist()
        known = self.known
        found = list(map(known.get, distinct))
        missing = [k for k, ids in enumerate(found) if ids is None]
        self._learn(list({distinct[k] for k in missing}))
        for k in missing:
            found[k] = known[distinct[k]]
        if len(known) > CACHED_WORDS:
            self.known = dict(zip(distinct, found))
        n = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(n) - n
        n = n.take(which)
        ends = np.cumsum(n)
        at = np.repeat(begins.take(which) - ends + n, n)
        at += np.arange(len(at))
        return np.frombuffer(b"".join(found), "<u4").take(at), np.diff(np.concatenate(([0], ends)).take(text_ends), prepend=0)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of every text."""
        flat, n = self.ids(pa.array(texts, pa.string()))
        raw, ends = flat.tobytes(), np.cumsum(n)
        return [raw[4 * a: 4 * b] for a, b in zip((ends - n).tolist(), ends.tolist())]


def _worker(path: str) -> WordIds:
    """One per Python worker, kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in slices of about SLICE_BYTES of text."""
    sizes = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(int(np.searchsorted(sizes, (int(sizes[a - 1]) if a else 0) + SLICE_BYTES, "right")), a + 1)
        yield batch.slice(a, b - a)
        a = b


def _with_end(flat: np.ndarray, n: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after every text's own."""
    n = n + 1
    ends = np.cumsum(n) - 1
    own = np.ones(len(flat) + len(n), bool)
    own[ends] = False
    out = np.full(len(own), end_id, "<u4")
    out[own] = flat
    return out, n


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, appends ``end_id``, and writes the files to ``path`` in ascending id order.

    Null and empty texts give the end id alone. Documents without an id come first; rows that repeat an id lie side by side, in order
    of their texts. Other columns are ignored; an empty table gives no rows. A task holds one group of ids, a slice of
    texts and the words it remembers, or the longest document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, lengths, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def group() -> pa.RecordBatch:
            flat, n = np.concatenate(parts), np.concatenate(lengths)
            wide = bool(len(flat)) and int(flat.max()) > 0xFFFF
            payload, ends, sums = range_coder.encode(flat, wide=wide)
            row = (part, seq, list(ids), n, len(flat), wide, payload, ends, sums)
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _FILE)], schema=_FILE)

        for batch in batches:
            for piece in _slices(batch):
                flat, n = _with_end(*_worker(tokenizer).ids(piece.column(1)), end_id)
                own, ends, a = piece.column(0).to_pylist(), np.cumsum(n), 0
                while a < len(own):
                    before = int(ends[a - 1]) if a else 0
                    b = min(int(np.searchsorted(ends, before + GROUP_IDS - held)) + 1, len(own))
                    ids += own[a:b]
                    lengths.append(n[a:b])
                    parts.append(flat[before: int(ends[b - 1])])
                    held, a = held + int(ends[b - 1]) - before, b
                    if held >= GROUP_IDS:
                        yield group()
                        seq, ids, lengths, parts, held = seq + 1, [], [], [], 0
        if parts:
            yield group()

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spread = own.repartitionByRange("id").sortWithinPartitions("id", "text")
    spread.mapInArrow(run, _FILE_DDL).write.parquet(path)


def decoded(row: dict) -> np.ndarray:
    """All ids of one row of a file."""
    return range_coder.decode(row["payload"], np.array(row["ends"], np.int64), np.array(row["sums"], np.int64), row["n"], wide=row["wide"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document of the files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                flat, at = decoded(row), np.concatenate(([0], np.cumsum(row["lengths"])))
                ids = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), ids], names=["doc_id", "ids"])

    return spark.read.parquet(path).mapInArrow(run, "doc_id long, ids array<long>")


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the decoded files; start counts the ids of all documents before."""
    schema = "part int, seq int, doc_id long, inside long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw, n = memoryview(decoded(row).astype("<u4")).cast("B"), np.array(row["lengths"], np.int64)
                at = np.concatenate(([0], np.cumsum(n)))
                sums = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), row["part"], np.int32)), pa.array(np.full(len(n), row["seq"], np.int32)), pa.array(row["doc_ids"], pa.int64()),
                    pa.array(at[:-1]), pa.array(n), pa.array(sums, pa.int64()),
                ], names=["part", "seq", "doc_id", "inside", "n_tokens", "ids_crc32"])

    files = spark.read.parquet(path)
    groups = files.select("part", "seq", "n")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = groups.groupBy("part").agg(F.sum("n").alias("n")).withColumn("ahead", before(W.orderBy("part"))).drop("n")  # a row per file
    starts = groups.withColumn("inner", before(W.partitionBy("part").orderBy("seq"))).join(parts, "part").select("part", "seq", (F.col("ahead") + F.col("inner")).alias("ahead"))
    return files.mapInArrow(run, schema).join(starts, ["part", "seq"]).select("doc_id", (F.col("ahead") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
