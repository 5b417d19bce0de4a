"""Secrets in texts: fixed patterns, and strings that zstandard can't shorten in a sensitive context.

The novelty of a candidate is what it adds to the compressed size of the code around it, when the
compressor is primed with a dictionary of identifiers and of the code before. Identifiers, words and repeated values
add little; a random key adds nearly its own entropy.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns, and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

IDENTIFIERS = (
    "abstract access account address admin alias allow amount append apply argument array async attribute author authorization await base batch begin "
    "bearer boolean bucket buffer build byte cache call catch channel character class client code column command comment commit config configuration "
    "connect connection const constant constructor container content context continue cookie copy count create credential cursor data database date "
    "debug decode default define delete description device dict directory display document domain double download driver element email enable encode "
    "encoding endpoint engine entity entry enum environment error event example exception execute export extends factory false field file filter final "
    "finally float folder format function generate get global group handler hash header height host hostname http https identifier image implements import "
    "include index init input insert instance integer interface internal item iterator json key label language length level library license limit line link "
    "list listener load local location lock log logger login long main manager map match max memory merge message metadata method min mode model module name "
    "namespace network new node none null number object offset open operator option order output override package page param parameter parent parse password "
    "path pattern payload permission pointer policy port position prefix primary print private process profile project property protected protocol provider "
    "proxy public publish query queue random range read record redirect reference region register release remote remove rename replace repository request "
    "require resource response result return role root route row run save schema scope script search secret section select send sequence server service "
    "session set setting shared short signature size sort source split start state static status stop store stream string struct style submit super switch "
    "sync system table tag target task template test text thread time timeout timestamp title token tool total transaction transform true tuple type undefined "
    "unicode unique unit update upload url user username utf validate value variable vector version view virtual void wait warning website while width window "
    "worker write xml yaml zone abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 localhost www.example.com"
)

CONTEXT = re.compile(r"secret|token|passw|passphrase|api_?key|access|auth|bearer|credential|private|signature|cookie|akia|key", re.A | re.I)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=~-]{16,}", re.A)
PIECE = 512  # characters of a long candidate that are compressed at once
BEFORE = 48  # characters before a candidate in which a word of CONTEXT makes it sensitive
AROUND = 256  # characters of code before it that prime the compressor as well
NOVEL = 0.77  # compressed bytes added per character from which a string that is built like a name is incompressible
DRAWS = 6  # random strings of its own alphabet that any other candidate is compared with, in its place
SHARE = 0.9  # part of what one of them adds that is enough


class Novelty:
    """Marginal compressed size of a string after a piece of code."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 19):
        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.packer = zstandard.ZstdCompressor(level=level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False)

    def added(self, code: str, candidate: str) -> int:
        code = IDENTIFIERS[-AROUND:] + "\n" + code  # a short piece would be stored without coding its bytes
        before = self.packer.compress(code.encode(errors="replace"))
        return len(self.packer.compress((code + candidate).encode(errors="replace"))) - len(before)

    def total(self, code: str, candidate: str) -> int:
        """``added`` over pieces of near equal length, each after what stands before it."""
        text, n = code + candidate, -(-len(candidate) // PIECE)
        cuts = [len(code) + len(candidate) * k // n for k in range(n + 1)]
        return sum(self.added(text[max(0, a - AROUND): a], text[a:b]) for a, b in zip(cuts, cuts[1:]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the fixed patterns find, each kind from the left without overlap."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def like_a_name(word: str) -> bool:
    """Letters in long runs, as in words, rather than mixed with digits and capitals."""
    plain = re.sub(r"[^A-Za-z0-9]", "", word)
    both = re.search("[a-z]", plain) and re.search("[A-Z]", plain)
    return len(re.findall(r"[a-z]+|[A-Z]+|[0-9]+", plain)) * (2.4 if both else 5) < len(plain)


def drawn(word: str, dice: random.Random) -> str:
    """A random string built like the word: a digit for a digit, a letter for a letter (a to f, if it has no other), the rest kept."""
    low = "abcdef" if not re.search("[G-Zg-z]", word) else string.ascii_lowercase
    kinds = [(set(s), s) for s in (string.digits, low, low.upper())]
    return "".join(next((dice.choice(s) for held, s in kinds if c in held), c) for c in word)


def is_novel(before: str, word: str, novelty: Novelty, threshold: float = NOVEL) -> bool:
    """Whether the word adds about as much as a random string of its alphabet does in the same place, be that hex or base64 and the text
    around it code or prose. Names share long runs of letters with neither, so for them the bytes a character count."""
    added = novelty.total(before, word)
    if like_a_name(word):
        return added >= threshold * len(word)
    dice = random.Random(word)
    return any(added >= SHARE * novelty.total(before, drawn(word, dice)) for _ in range(DRAWS))


def novel_spans(text: str, known: list[tuple[int, int, str]], novelty: Novelty, threshold: float = NOVEL) -> list[tuple[int, int, str]]:
    """Candidates near a sensitive word that hold digits and letters and do not compress: whole runs, however long, that the known
    spans don't cover. What stands before the value of an assignment in its run is the name, and counts as covered."""
    out = []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        word = m.group()
        if not (re.search(r"\d", word) and re.search(r"[A-Za-z]", word)):
            continue
        if not CONTEXT.search(text, max(0, start - BEFORE), start):
            continue
        upto = start
        for a, b in sorted((start if kind == "assign" else a, b) for a, b, kind in known if a < end and start < b):
            upto = max(upto, b) if a <= upto else upto
        if upto >= end:
            continue
        if is_novel(text[max(0, start - AROUND): start], word, novelty, threshold):
            out.append((start, end, "novel"))
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = NOVEL) -> DataFrame:
    """(id, spans) of every row; spans are (start, end, kind, value) by start and then in the order of ``KINDS``, in
    code points, the end exclusive. Null and empty texts have none; repeated rows are each reported; other columns are ignored."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            found = []
            for value in batch.column(1):
                text = value.as_py() or ""
                known = base_spans(text)
                every = sorted(known + novel_spans(text, known, novelty, threshold), key=lambda s: (s[0], KINDS.index(s[2])))
                found.append([{"start": a, "end": b, "kind": k, "value": text[a:b]} for a, b, k in every])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["id", "spans"])

    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "id long, spans array<struct<start:int,end:int,kind:string,value:string>>")


def joined(spans, kinds: tuple[str, ...] = KINDS):
    """kind:start:end of the spans of these kinds, comma-joined."""
    wanted = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(wanted, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
