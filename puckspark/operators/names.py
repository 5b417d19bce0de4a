"""A table of the parts of folded names, built once per dimension, so that a lookup compares only names that may match.

A name folds to plain small letters where every character is ASCII or a Latin letter with marks. Two such names are equal
without case and accents exactly when their folds are, so a name that contains a text also contains all parts of the text's
fold. Names with any other character (ligatures, other scripts, loose marks) are candidates for every text, and a text with
one is compared with all names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = 3  # characters of the longest part
GRAM, FOLDED, ODD = "_gram", "_folded", "_odd"
_PLAIN = r"\A[ -~]*\z"


def _folds() -> dict[str, str]:
    """Capitals, and the Latin letters that decompose into an ASCII letter and marks, with their small letter."""
    out = {chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)}
    for code in range(0xC0, 0x1F00):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base.isascii() and base.isalpha():
            out[chr(code)] = base.lower()
    return out


FOLDS = _folds()


def folded_name(c: Column) -> Column:
    return F.translate(c, "".join(FOLDS), "".join(FOLDS.values()))


def name_parts(df: DataFrame, name: str, keep: Sequence[str]) -> DataFrame:
    """(name, keep, _gram, _folded, _odd): each row under every distinct part of one to three characters of its folded name, and once
    under the empty part; ``_odd`` names stand under the empty part alone. Rows without a name match nothing and are left out.

    Laid out by part, so that a reader of the stored table is led to one part by the files' statistics; a frequent part is
    spread over several files by its names.
    """
    rows = df.where(F.col(name).isNotNull()).select(name, *keep, folded_name(F.col(name)).alias(FOLDED))
    rows = rows.withColumn(ODD, ~F.col(FOLDED).rlike(_PLAIN))
    n, none = F.length(FOLDED), F.array().cast("array<string>")
    cut = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(F.col(FOLDED), i, F.lit(k)))).otherwise(none)
    parts = F.when(F.col(ODD), none).otherwise(F.array_distinct(F.concat(*[cut(k) for k in range(1, PART + 1)])))
    rows = rows.withColumn(GRAM, F.explode(F.concat(F.array(F.lit("")), parts)))
    order = [F.col(GRAM), F.col(ODD).desc(), F.col(FOLDED)]
    return rows.repartitionByRange(*order, *keep).sortWithinPartitions(*order)


def candidates(parts: DataFrame, name: str, query: str) -> DataFrame:
    """(name, keep) of the rows whose name may contain ``query`` without case or accents: all that do, and some odd names.

    ``parts`` is the stored table of ``name_parts``. Only the query's rarest part is read, besides the odd names.
    """
    folded = query.translate(str.maketrans(FOLDS))
    if not folded or not re.fullmatch("[ -~]*", folded):
        hit = F.col(GRAM) == ""
    else:
        grams = sorted({folded[i: i + PART] for i in range(max(1, len(folded) - PART + 1))})
        if len(grams) > 1:
            known = {r[0]: r[1] for r in parts.where(F.col(GRAM).isin(grams)).groupBy(GRAM).count().collect()}  # a row for each part of the query
            grams.sort(key=lambda g: known.get(g, 0))
        fits = (F.col(GRAM) == grams[0]) & F.contains(FOLDED, F.lit(folded))
        hit = F.col(GRAM).isin(grams[0], "") & (fits | (F.col(GRAM) == "") & F.col(ODD))
    return parts.where(hit).drop(GRAM, FOLDED, ODD)
