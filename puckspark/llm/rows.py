"""A number for every row, so that decisions hold for rows and not for the ids they may lack or share."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from puckspark.operators.sizing import lookup
from puckspark.session import pin

FILE_BITS = 40  # bits of a row's place in its file
_ONE_ROW_EACH = ("Project", "Filter", "SubqueryAlias", "LogicalRelation")  # plans that hold a row of a file once at most


def row_keyed(df: DataFrame) -> DataFrame:
    """(row, doc): a number of its own for every row, and all its columns as a struct, so that no name clashes.

    A frame read from files, with no more than columns and filters chosen since, is numbered by file and place, which every later
    scan and every retried task finds again; nothing is written. Other frames are numbered and written once.
    """
    kinds = [n["class"].rsplit(".", 1)[-1] for n in json.loads(df._jdf.queryExecution().analyzed().toJSON())]
    stored = None
    if set(kinds) <= set(_ONE_ROW_EACH):
        try:
            stored = df.select("_metadata.file_path", "_metadata.row_index").columns
        except AnalysisException:  # files of a kind that shows no places
            stored = None
    if stored is None:
        return pin(df.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")))
    placed = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc"))
    files = pin(placed.select("_file").distinct().coalesce(1).withColumn("_no", F.monotonically_increasing_id()))  # a row per file
    return placed.join(lookup(files, materialise=False), "_file").select((F.shiftleft("_no", FILE_BITS) + F.col("_at")).alias("row"), "doc")
