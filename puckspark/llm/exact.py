"""Exact duplicates by a 128-bit content hash, with a comparison of bytes against collisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from puckspark.operators.sizing import lookup
from puckspark.operators.skew import join_by_key
from puckspark.session import pin


def content_hash(text: Column) -> Column:
    return F.md5(text.cast("binary"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=None, keep: str = "smallest", hash_of=content_hash) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Rows are grouped by a 128-bit hash of the text after ``normalise`` (a column function; default: no change). Of each group the
    row with the smallest or largest id (``keep``) is kept. Every other row of the group is compared byte by byte with the kept
    row's text; rows that differ have collided and are grouped again by the text itself. Null counts as the empty text. A null id is
    never kept where the group has another; rows that repeat id and text are all counted and marked alike. Other columns are ignored.

    Only hashes and ids are aggregated, map-side first. Groups of two or more are broadcast to the texts if they were counted to be few,
    else the texts travel to them once. The rows of a hash that many rows share are then dealt over parts, each with
    the kept text, so a group with a third of all rows is not gathered in one task.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = text if normalise is None else normalise(text)
    best = {"smallest": F.min, "largest": F.max}[keep]
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    hashed = own.select("id", "text", hash_of(F.col("text")).alias("h"))
    heads = pin(hashed.select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "h"))
    groups = heads.groupBy("h").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
    many = pin(groups.where("n > 1"))
    members = pin(hashed.join(lookup(many.select("h", "keep_id"), materialise=False), "h"))
    # one row for each group: the text that the others are compared with
    first = members.where(F.col("id").eqNullSafe(F.col("keep_id"))).groupBy("h").agg(F.min("text").alias("kept_text"))
    compared = join_by_key(members, first, ["h"], "inner")
    odd = pin(compared.where("text <> kept_text").select("id", "h", "text"))
    ids = heads.join(many, "h", "left").select("id", "text_sha256", "h", F.coalesce("n", F.lit(1)).cast("long").alias("n"), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"))
    if not odd.isEmpty():
        ids = _collided(heads, hashed, odd, best, ids)
    return ids.select(
        F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _collided(heads: DataFrame, hashed: DataFrame, odd: DataFrame, best, ids: DataFrame) -> DataFrame:
    """Groups by the whole text for the hashes that more than one text has."""
    bad = odd.select("h").distinct()
    texts = hashed.join(bad, "h", "left_semi")
    exact = texts.groupBy("h", "text").agg(F.count(F.lit(1)).alias("n"), best("id").alias("keep_id"))
    again = texts.join(exact, ["h", "text"]).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), "h", F.col("n").cast("long").alias("n"), "keep_id")
    return ids.join(bad, "h", "left_anti").select("id", "text_sha256", "h", "n", "keep_id").unionByName(again)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that are not kept; all columns stay. Ids must be unique and not null."""
    away = exact_groups(docs, id_col, text_col, **options).where(~F.col("kept")).select(F.col(id_col).alias("_away"))
    return docs.join(away, docs[id_col] == away["_away"], "left_anti")
