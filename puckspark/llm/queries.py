"""The operators of this subpackage as queries over whole tables, with SQL where it can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from puckspark.llm import decontaminate, exact, language_model, mixing, near, periodic, prefix_trie, secrets, sharding, simhash, token_counts, token_files, toxicity
from puckspark.llm.ship import with_code
from puckspark.operators.skew import join_by_key
from puckspark.session import pin, shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return add


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return with_code(spark).read.parquet(f"{folder}/{name}.parquet")


def _remainder(id_col: Column, n: int) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % n


@_query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token_files/{uuid.uuid4().hex}"
    token_files.write_tokens(_read(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.document_index(spark, path)


_OP2_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


@_query("op2_exact_copies", _OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return exact.exact_groups(_read(spark, folder, "documents"), keep="largest")


@_query("op3_unigram_counts")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    got = token_counts.count_tokens(_read(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return got.withColumnRenamed("id", "doc_id")


@_query("op4_recurrent_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    got = language_model.score_documents(_read(spark, folder, "documents"), train_on=lambda i: _remainder(i, 5) != 1)
    return got.select(F.col("id").alias("doc_id"), (_remainder(F.col("id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query("op5_secret_spans")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.find_secrets(_read(spark, folder, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), number("assign"), number("access"), number("hex"),
        F.sha2(secrets.joined(F.col("spans"), secrets.KINDS[:3]), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"),
    )


_OP6_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i+4], ' ')) END) AS set FROM w),
e AS (SELECT doc_id, hash(unnest(set)) AS g FROM s),
n AS (SELECT doc_id, CAST(len(set) AS BIGINT) AS n_shingles FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y
      WHERE 100 * common >= 85 * (na.n_shingles + nb.n_shingles - common)),
u AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT r.x, u.y FROM r JOIN u ON r.y = u.x)
SELECT doc_id, n_shingles, c AS component_id, doc_id = c AS kept
FROM n JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) ON doc_id = x
"""


@_query("op6_hyperminhash_groups", _OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return near.near_groups(_read(spark, folder, "documents"), percent=85)


@_query("op7_source_mix")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Documents labelled as good quality weigh twice, as poor half."""
    weights = mixing.quality_weights(_read(spark, folder, "labels"))
    docs = _read(spark, folder, "documents").select("doc_id", "source", mixing.word_count("text").alias("words"), F.xxhash64("text").alias("print"))
    docs = join_by_key(pin(docs), weights, ["doc_id"])  # texts don't travel to the labels
    return mixing.mix_sources(docs, size=F.col("words"), quality=F.col("quality_weight"), apart=("print",)).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "epochs")


_OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
g AS (SELECT DISTINCT item_id, n, array_to_string(words[i:i+n-1], ' ') AS gram FROM
      (SELECT item_id, words, least(10, len(words)) AS n, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS i FROM b WHERE len(words) > 0)),
k AS (SELECT DISTINCT n FROM g),
t AS (SELECT doc_id, n, pos, array_to_string(words[pos:pos+n-1], ' ') AS gram FROM
      (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS pos FROM d, k WHERE len(words) >= n)),
h AS (SELECT t.doc_id, t.pos, t.n, g.item_id FROM t JOIN g USING (n, gram)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM h) GROUP BY 1),
i AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
      (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN i USING (doc_id)
"""


@_query("op8_benchmark_leaks", _OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.find_leaks(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("n_words").cast("long").alias("n_words"), F.col("n_hit").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@_query("op9_sampled_splitters")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    got = sharding.assign_shards(_read(spark, folder, "documents"), shards=8)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query("op10_toxic_segments")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _read(spark, folder, "documents"), _read(spark, folder, "labels")
    got = toxicity.score_toxicity(docs, labels, train=lambda i: _remainder(i, 4) != 2)
    return got.select(
        F.col("id").alias("doc_id"), (_remainder(F.col("id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"),
    )


@_query("op11_simhash_trie")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    got = simhash.simhash_groups(_read(spark, folder, "documents"))
    return got.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def _with_repetitions(docs: DataFrame) -> DataFrame:
    """A tenth of the documents with its end replaced by repetitions, as the contract of op12 has it; others word by word as they are."""
    words, h = F.col("words"), F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n, g = F.size("words").cast("long"), F.floor(F.col("h") / 10)
    a = F.when(n > 0, g % F.greatest(n, F.lit(1)))
    p = 1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))
    at = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")
    own = docs.select("doc_id", "text", h.alias("h")).withColumn("g", g)
    picked = own.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).otherwise(F.array().cast("array<string>")))
    picked = picked.withColumn("a", a).withColumn("p", p)
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(words, at(i))), " ")
    return picked.select("doc_id", F.when(n > 0, again).otherwise(F.col("text")).alias("text"))


@_query("op12_periodic_runs")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.periodic_runs(_with_repetitions(_read(spark, folder, "documents"))).withColumn("best", periodic.longest_run())
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    whole = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise(F.lit(""))
    best = F.col("best")
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(whole.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def _with_shared_openings(turns: DataFrame) -> DataFrame:
    """Paths of all conversations, each begun with turns of the first of its hundred, as the contract of op13 has it."""
    own = pin(prefix_trie.ordered_turns(turns))
    lengths = own.groupBy("conv").agg(F.max("depth").alias("turns"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    convs = pin(lengths.select("conv", "turns", h.alias("h"), (F.col("conv") - F.col("conv") % 100).alias("start")))
    starts = convs.join(lengths.select(F.col("conv").alias("start"), F.col("turns").alias("there")), "start", "left")
    starts = pin(starts.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))).select("conv", "turns", "h", "start", "taken"))
    opening = own.where("depth <= 5").select(F.col("conv").alias("start"), "depth", "key", "size")
    lent = starts.where("taken > 0").select("conv", "start", "taken").join(opening, "start").where("depth <= taken").select("conv", "depth", "key", "size")
    rest = join_by_key(own, starts.select("conv", "h", "taken"), ["conv"], "inner").where("depth > h").select("conv", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "key", "size")
    bare = starts.where("taken = 0 and turns <= h").select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("size"))
    return pin(lent.unionByName(rest).unionByName(bare))


_OP13_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
        sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), ':', coalesce(text, '')))) AS d FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS first, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1),
        lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.d, t.role, t.text FROM c JOIN t ON t.conv_id = c.first AND t.d <= c.h
      UNION ALL SELECT c.conv_id, 1, t.d, t.role, t.text FROM c JOIN t USING (conv_id) WHERE t.d > c.h),
l AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY part, d) AS path FROM r GROUP BY 1),
w AS (SELECT c.conv_id, coalesce(path, []) AS path FROM c LEFT JOIN l USING (conv_id)),
p AS (SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM w),
m AS (SELECT conv_id, depth, path[1:depth] AS node, len(path) = depth AS over FROM p),
n AS (SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
k AS (SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
v AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node[depth].text) END AS worth FROM n LEFT JOIN k USING (node)),
u AS (SELECT node[1:up] AS node, worth, n_children FROM (SELECT node, worth, n_children, unnest(range(0, depth + 1)) AS up FROM v)),
s AS (SELECT node, sum(worth) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM u GROUP BY 1)
SELECT v.conv_id, CAST(v.depth AS BIGINT) AS depth, b.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, v.ends_sha256
FROM v JOIN s USING (node) LEFT JOIN n b ON v.depth > 0 AND b.node = v.node[1:v.depth - 1]
"""


@_query("op13_prefix_trie", _OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    got = prefix_trie.prefix_trie(_with_shared_openings(_read(spark, folder, "conversations")))
    return got.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")
