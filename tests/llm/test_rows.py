"""Stages decide row by row: rows without an id, and rows that share one."""

import collections

from pyspark.sql import functions as F

import corpus_pipeline
from puckspark.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 9973}" for i in range(n))


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def labelled(spark, folder, rows=()):
    spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_mixing_takes_rows_not_ids(spark, tmp_path):
    rows = [(None, words(i, 10), "en", "a", 0) for i in range(30)] + [(5, words(50, 10), "en", "a", 0)] * 20 + [(i, words(i, 10), "en", "a", 0) for i in range(100, 150)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    out = stage("mixing")(spark, df, labelled(spark, tmp_path)).collect()
    # one source, 1.5 times its words: every row once, half of them twice
    assert abs(len(out) - 150) <= 1
    given, got = (collections.Counter((r[0], r[1]) for r in x) for x in (rows, out))
    assert set(got) == set(given) and all(given[k] <= got[k] <= 2 * given[k] for k in given)
    ids = collections.Counter(r.doc_id for r in out)
    assert 30 < ids[None] < 60 and 20 < ids[5] < 40
    again = collections.Counter((r[0], r[1]) for r in mixing.mixed_documents(df.repartition(7)).collect())
    assert again == collections.Counter((r[0], r[1]) for r in mixing.mixed_documents(df).collect())
    assert stage("mixing")(spark, df.where(F.lit(False)), str(tmp_path)).isEmpty()


def test_toxic_rows_go_alone(spark, tmp_path):
    bad = [(i, "vile slur " * 5 + words(i, 8), "en", "a", 0) for i in range(200, 240)]
    good = [(i, words(i, 18).replace("w", "x"), "en", "a", 0) for i in range(300, 360)]  # no word of the toxic ones
    odd = [(None, "vile slur " * 5 + words(1, 8), "en", "a", 0), (7, "vile slur " * 5 + words(2, 8), "en", "a", 0)]
    clean = [(None, words(i, 18).replace("w", "x"), "en", "a", 0) for i in range(20)] + [(7, words(400, 18).replace("w", "x"), "en", "a", 0)]
    folder = labelled(spark, tmp_path, [(r[0], 1, int(r in bad)) for r in bad + good])
    out = stage("toxicity")(spark, spark.createDataFrame(bad + good + odd + clean, DOCS), folder)
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(good + clean)


def test_leaking_rows_go_alone(spark, tmp_path):
    leak = words(3, 12)
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd = [(None, f"a {leak} b", "en", "a", 0), (7, f"{leak} b", None, "a", 0)]
    clean = [(None, words(i, 18).replace("w", "x"), "en", "a", 0) for i in range(10, 30)] + [(7, words(40, 18).replace("w", "x"), "en", "a", 0), (7, None, "en", "a", 0)]
    out = stage("decontamination")(spark, spark.createDataFrame(odd + clean, DOCS), str(tmp_path))
    assert collections.Counter(map(tuple, out.collect())) == collections.Counter(clean)


def test_one_row_of_every_group_stays(spark):
    near = words(1, 60)
    rows = [(None, near, "en", "a", k) for k in range(30)] + [(9, near + " end", "en", "a", k) for k in range(5)] + [(4, near, "en", "b", 0)]
    rows += [(None, words(2, 40), "en", "a", 0)] * 3 + [(6, words(3, 40), "en", "a", 0)] * 4 + [(6, words(5, 40), "en", "a", 0)]
    empty = [(None, "", "en", "a", 0)] * 2 + [(8, None, "en", "a", 0)] * 2
    out = stage("near_duplicates")(spark, spark.createDataFrame(rows + empty, DOCS).repartition(4), "").collect()
    want = [(4, near, "en", "b", 0), (None, words(2, 40), "en", "a", 0), (6, words(3, 40), "en", "a", 0), (6, words(5, 40), "en", "a", 0)]
    assert collections.Counter(map(tuple, out)) == collections.Counter(want + empty)


def test_mixing_stage_prefers_quality(spark, tmp_path):
    df = spark.createDataFrame([(i, words(i, 10), "en", "a", 0) for i in range(600)] + [(None, words(i, 10), "en", "a", 0) for i in range(600, 800)], DOCS)
    folder = labelled(spark, tmp_path, [(i, i % 2, 0) for i in range(600)] + [(3, None, 0), (None, 1, 0)])
    out = collections.Counter(r.text for r in stage("mixing")(spark, df, folder).collect())
    twice = [sum(out[words(i, 10)] == 2 for i in part) / len(part) for part in (range(1, 600, 2), range(600, 800), range(0, 600, 2))]
    assert sum(out.values()) in (1199, 1200, 1201) and twice[0] > 0.6 > twice[1] > 0.35 and twice[2] < 0.35


def loads(rows):
    out = dict.fromkeys(range(8), 0)
    for r in rows:
        out[r.shard] += len((r.text or "").encode()) + 1
    return list(out.values())


def test_shards_follow_texts_not_ids(spark, tmp_path):
    rows = [(None, words(i % 40, 20), "en", "a", i) for i in range(400)] + [(i, words(100 + i, 20), "en", "a", i) for i in range(100)]
    rows += [(7, words(300 + i, 20), "en", "a", i) for i in range(60)] + [(None, None, None, None, None)] * 3
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/docs")
    for df in (spark.read.parquet(f"{tmp_path}/docs"), spark.createDataFrame(rows, DOCS).repartition(3)):
        out = stage("sharding")(spark, df, "").collect()
        assert collections.Counter(tuple(r)[:5] for r in out) == collections.Counter(rows)
        of_text = collections.defaultdict(set)
        for r in out:
            of_text[r.text].add(r.shard)
        assert all(len(s) == 1 for s in of_text.values())
        assert max(loads(out)) < 1.25 * min(loads(out))  # a text's ten copies are 2 % of all and stay together
        for s in range(8):
            assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_a_group_larger_than_a_shard_is_divided_evenly(spark):
    rows = [(None, "x" * 99, "en", "a", i) for i in range(900)] + [(None, words(i, 17)[:99].ljust(99, "z"), "en", "a", i) for i in range(300)]
    out = stage("sharding")(spark, spark.createDataFrame(rows, DOCS).repartition(6), "").collect()
    assert len(out) == 1200 and max(loads(out)) < 1.05 * min(loads(out))


def test_rows_of_files_keep_their_numbers(spark, tmp_path):
    from puckspark.llm.rows import row_keyed
    spark.range(1000).selectExpr("id", "'clash' as _file", "'clash' as row", "'clash' as doc").repartition(7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    keyed = row_keyed(df.where("id % 3 = 0"))
    once = {r["row"]: r.doc.id for r in keyed.collect()}
    again = {r["row"]: r.doc.id for r in keyed.select("row", "doc").repartition(3).collect()}
    assert once == again and len(once) == 334 and sorted(once.values()) == list(range(0, 1000, 3))
    assert len({r["row"] for r in row_keyed(df.union(df)).collect()}) == 2000


def test_spans_are_cut_row_by_row(spark):
    from puckspark.llm import decontaminate
    leak = words(3, 12)
    benchmark = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(5, f"x1 {leak} x2", "en", "a", 0), (5, "x3 x4", "en", "a", 0), (None, f"{leak}, x5", "en", "a", 0), (None, None, "en", "a", 0)]
    out = decontaminate.cut_leaks(spark.createDataFrame(rows, DOCS), benchmark)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(5, "x1 x2"), (5, "x3 x4"), (None, "x5"), (None, None)], key=repr)
