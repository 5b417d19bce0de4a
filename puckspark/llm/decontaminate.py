"""Benchmark passages in training documents, found by a broadcast set of word windows.

DataFrame functions only. A word is a run of a-z, 0-9 and characters beyond ASCII, A-Z counted as
a-z. A benchmark item gives its windows of ten words; a shorter item is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.llm.rows import row_keyed
from puckspark.operators.sizing import lookup
from puckspark.session import pin

WINDOW = 10
MAX_BROADCAST_WINDOWS = 100_000  # beyond this many windows the lookup is a shuffled join
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    small = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(small, F.lit(_WORD), F.lit(0))


def _starts(words: Column, k: int) -> Column:
    """Positions, from 1, at which a window of k words begins."""
    return F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - (k - 1))).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, n, gram, h): the distinct windows of every item that has words; n is the number of words of the window."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("words")).where("size(words) > 0")
    cut = items.withColumn("n", F.least(F.lit(size), F.size("words")))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)
    grams = cut.select("item", "n", "words", F.explode(starts).alias("at")).select("item", "n", F.slice("words", F.col("at"), F.col("n")).alias("gram"))
    return grams.withColumn("h", F.xxhash64("gram")).distinct()


def _looked_up(base: DataFrame, hashes: dict[int, list[int]]) -> DataFrame:
    """Adds the windows whose hash is in the given sets, which travel with the plan to every task."""
    return base.withColumn("hits", F.concat(*[_found(k, values) for k, values in hashes.items()]))


def _found(k: int, values: list[int]) -> Column:
    words = F.col("words")
    at = F.filter(_starts(words, k), lambda i: F.xxhash64(F.slice(words, i, k)).isin(values))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(k).alias("n")))


def _all(k: int) -> Column:
    words = F.col("words")
    return F.transform(_starts(words, k), lambda i: F.struct(i.alias("at"), F.lit(k).alias("n"), F.xxhash64(F.slice(words, i, k)).alias("h")))


def _joined(base: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """The same by a shuffled join, for a benchmark too large to send to every task."""
    spread = base.select("_row", F.explode(F.concat(*[_all(k) for k in lengths])).alias("w")).select("_row", "w.*")
    hits = spread.join(grams.select("h", "n").distinct(), ["h", "n"], "left_semi").groupBy("_row").agg(F.collect_list(F.struct("at", "n")).alias("hits"))
    return base.join(hits, "_row", "left")


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit (words inside a window of an item), items (their ids as sorted strings),
    spans (first and last word of every window found, from 1).

    Every window of a document is looked up by hash in the set of the benchmark's windows, which is sent to all tasks
    after it was counted; beyond ``max_broadcast`` windows the lookup is a shuffled join. Every hit is then verified
    word by word. Null and empty texts have no words; items without words are ignored; hits of an item without id
    count, but the id is not listed. Rows that repeat an id get one row each. Other columns are ignored.
    """
    grams = pin(benchmark_windows(benchmark, item_id_col, item_text_col, size))
    few = grams.count() <= max_broadcast
    lengths = sorted(r[0] for r in grams.select("n").distinct().collect())  # at most ``size`` values
    base = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"), words_of(text_col).alias("words"))
    if not lengths:
        seen = base.withColumn("hits", F.array().cast("array<struct<at:int,n:int>>"))
    elif few:
        hashes: dict[int, list[int]] = {k: [] for k in lengths}
        for n, h in grams.select("n", "h").distinct().collect():  # at most ``max_broadcast`` rows
            hashes[n].append(h)
        seen = _looked_up(base, hashes)
    else:
        seen = _joined(base, grams, lengths)
    cut = F.transform("hits", lambda w: F.struct(w["at"].alias("at"), w["n"].alias("n"), F.slice("words", w["at"], w["n"]).alias("gram")))
    hits = seen.select("_row", "id", F.size("words").alias("n_words"), F.explode_outer(cut).alias("w")).select("_row", "id", "n_words", "w.*")
    table = grams.select("item", "gram", F.lit(True).alias("found"))
    checked = hits.join(F.broadcast(table) if few else table, "gram", "left")
    span = F.when(F.col("found"), F.struct("at", (F.col("at") + F.col("n") - 1).alias("upto")))
    per_row = checked.groupBy("_row", "id", "n_words").agg(F.collect_set(span).alias("spans"), F.collect_set(F.when(F.col("found"), F.col("item"))).alias("items"))
    inside = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["upto"]))))
    return per_row.select("id", "n_words", F.size(inside).alias("n_hit"), F.array_sort("items").alias("items"), F.array_sort("spans").alias("spans"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay. Every row is judged by its own text, also one
    without an id or with the id of others."""
    keyed = row_keyed(docs)
    rows = keyed.select("row", F.col("doc")[text_col].alias("text"))
    bad = find_leaks(rows, benchmark, "row", "text", **options).where("n_hit > 0").select(F.col("id").alias("_leaked"))
    return keyed.join(lookup(bad), F.col("row") == F.col("_leaked"), "left_anti").select("doc.*")


def cut_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with every word inside a benchmark window removed from the text; documents without a hit are
    unchanged, letter by letter. Every row is judged and cut by itself, also one without an id or with the id of others."""
    keyed = row_keyed(docs)
    rows = keyed.select("row", F.col("doc")[text_col].alias("text"))
    found = find_leaks(rows, benchmark, "row", "text", **options).where("n_hit > 0").select(F.col("id").alias("_leaked"), F.col("spans").alias("_spans"))
    joined = keyed.join(lookup(found), F.col("row") == F.col("_leaked"), "left")
    whole = F.col("doc")[text_col]
    pieces = F.regexp_extract_all(whole, F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+[^0-9A-Za-z\x{80}-\x{10FFFF}]*"), F.lit(0))
    kept = F.filter(
        F.transform(pieces, lambda p, i: F.struct(p.alias("p"), (i + 1).alias("i"))),
        lambda x: ~F.exists("_spans", lambda s: (s["at"] <= x["i"]) & (x["i"] <= s["upto"])),
    )
    text = F.when(F.col("_spans").isNotNull(), F.array_join(F.transform(kept, lambda x: x["p"]), "")).otherwise(whole)
    return joined.select(*[text.alias(c) if c == text_col else F.col("doc")[c].alias(c) for c in docs.columns])
