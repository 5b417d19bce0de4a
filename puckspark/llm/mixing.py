"""Mixing sources to target weights by Efraimidis-Spirakis keys. DataFrame functions only.

A source whose target is more than its own size is first taken whole as often as fits (complete
epochs); what is left of the target is filled by a weighted draw without replacement: documents in
ascending order of an exponential key, -ln(u) / weight, until their sizes sum up to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from puckspark.llm.rows import row_keyed
from puckspark.operators.ordered import sequence_number
from puckspark.operators.skew import join_by_key
from puckspark.session import pin

SEED = 17
BUCKET_ROWS = 100_000  # rows of a source's key histogram bucket that one task orders, on average


def word_count(text: str) -> Column:
    """Runs of characters other than space and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ordered_sources(sizes: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Adds ``weight`` to one row per source: the given weights in turn, by code points, null last."""
    place = F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1
    return sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int")))


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): ``share`` of all sizes dealt out by weight, at most ``most`` times
    the source's size; the excess goes to the others by weight, as often as needed.

    Each round fixes the sources above their limit; the totals that a round needs are one aggregate row.
    """
    level, fixed = None, -1
    cap = F.col("source_size") * F.lit(most)
    while True:
        over = F.lit(False) if level is None else cap <= F.col("weight") * F.lit(level)
        total, done, weight, n = sources.agg(
            F.sum("source_size"), F.sum(F.when(over, cap).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))), F.count(F.when(over, 1)),
        ).first()
        if level is not None and n == fixed or not weight:
            break
        level, fixed = (min(share, most) * float(total or 0) - done) / weight, n
    top = math.inf if level is None or (share >= most) else level
    return sources.withColumn("target", cap if top == math.inf else F.least(cap, F.col("weight") * F.lit(top)))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, quality: Column | None = None,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = SEED,
    row_col: str | None = None, apart: tuple[str, ...] = (),
) -> DataFrame:
    """(id, size, source, source_size, target, taken, epochs) for every row of ``docs``, and its ``row`` if ``row_col`` names one.

    ``taken`` is epochs * size plus, where the draw selects the document, its size; the last document drawn from a
    source is taken only as far as the target needs. ``quality`` is a document's weight in the draw (default 1; null
    counts as 1, zero and less as a millionth). The key depends on id, size and seed, so a rerun agrees; rows that
    repeat id and size share a key and are drawn one after the other, in either order with the same result; columns named in
    ``apart`` join the key, to tell such rows apart. Null sources form
    one source, placed last. Empty documents have size 0 and nothing is taken; with no documents there are no rows.

    The target point of each source is found in a histogram of its keys; only the one bucket that holds it
    is ordered, so a source with most of the rows is neither sorted nor held in one task.
    """
    own = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
        (word_count("text") if size is None else size).cast("long").alias("size"),
        F.greatest(F.coalesce(F.lit(1.0) if quality is None else quality.cast("double"), F.lit(1.0)), F.lit(1e-6)).alias("q"),
        *([] if row_col is None else [F.col(row_col).alias("row")]), *[F.col(c).alias(f"apart_{k}") for k, c in enumerate(apart)],
    )
    more = [f"apart_{k}" for k in range(len(apart))]
    ties = [] if row_col is None else ["row"]
    code = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    unit = (F.shiftrightunsigned(F.xxhash64("id", "size", F.lit(seed), *more), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    own = own.withColumn("s", code).withColumn("key", -F.log(unit) / F.col("q"))
    own = pin(own.drop("q", *more))
    rows = own.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"), F.first("source").alias("source"))
    aimed = targets(pin(ordered_sources(rows, weights)), share, most)
    aimed = aimed.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    aimed = pin(aimed.withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")))
    largest = aimed.agg(F.max("n")).first()[0] or 0
    # The logarithm of a key has a density of at most 0.37, shifted by the logarithm of its weight.
    steps = max(16, math.ceil(largest / BUCKET_ROWS))
    placed = own.withColumn("b", F.greatest(F.lit(0), F.floor((F.log("key") + 60) * steps)).cast("long"))
    filled = placed.groupBy("s", "b").agg(F.sum("size").alias("held"))
    before = filled.withColumn("before", F.sum("held").over(W.partitionBy("s").orderBy("b").rowsBetween(W.unboundedPreceding, -1)))
    before = before.withColumn("before", F.coalesce("before", F.lit(0).cast("long")))
    cut = (
        before.join(aimed.select("s", "rest"), "s").where("before <= rest and rest < before + held")
        .select("s", F.col("b").alias("cut"), "before")
    )
    plan = pin(aimed.drop("n", "weight").join(cut, "s", "left").withColumn("cut", F.coalesce("cut", F.when(F.col("rest") > 0, F.lit(2**62)).otherwise(F.lit(-1)))))
    marked = placed.join(plan.drop("source"), "s")
    inside = marked.where("b = cut").withColumn(
        "upto", F.sum("size").over(W.partitionBy("s").orderBy("key", "id", "size", *ties).rowsBetween(W.unboundedPreceding, 0)) + F.col("before"))
    inside = inside.withColumn("drawn", F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("upto") + F.col("size")))).drop("upto")
    outside = marked.where("b <> cut").withColumn("drawn", F.when(F.col("b") < F.col("cut"), F.col("size")).otherwise(F.lit(0)))
    out = inside.unionByName(outside)
    return out.select("id", "size", "source", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("drawn")).cast("long").alias("taken"), "epochs", *ties)


def quality_weights(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, quality_weight), one row per id: documents labelled as good quality weigh twice, as poor half. The larger of several labels counts."""
    best = labels.groupBy(id_col).agg(F.max("quality").alias("quality"))
    return best.select(id_col, F.when(F.col("quality") > 0, 2.0).when(F.col("quality") <= 0, 0.5).otherwise(1.0).alias("quality_weight"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", labels: DataFrame | None = None, **options) -> DataFrame:
    """``docs`` as the mix takes them: a document of which at least half of a further copy is taken appears that many times,
    one of which less is taken not at all. All columns stay.

    Every row is drawn for itself, also one without an id or with the id of others. Its key depends on id, text and
    its number among the rows that share both, so a rerun agrees. ``labels`` (id, quality) give the ``quality_weights``
    of the draw; rows whose id has none, or that have no id, weigh 1.
    """
    keyed = row_keyed(docs)
    doc = F.col("doc")
    rows = keyed.select("row", doc[id_col].alias("id"), doc[source_col].alias("source"), doc["text"].alias("text"))
    rows = pin(rows.select("row", "id", "source", word_count("text").alias("words"), F.xxhash64("text").alias("print")))  # texts don't travel
    rows = sequence_number(rows, ["id", "print"], ["row"], "nth")
    if labels is not None:
        weights = quality_weights(labels, id_col)
        rows = join_by_key(pin(rows), weights.select(F.col(id_col).alias("id"), "quality_weight"), ["id"])
        options["quality"] = F.col("quality_weight")
    got = mix_sources(rows, "id", size=F.col("words"), row_col="row", apart=("print", "nth"), **options)
    got = got.where("taken > 0").select("row", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies")).where("copies > 0")
    return keyed.join(got, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
