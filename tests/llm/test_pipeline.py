"""The pipeline against plain Python over the same rows."""
import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from fbrank.llm import decontaminate, quality, queries, setsketch
from tests.llm.test_near_duplicates import slow_near
from tests.llm.test_text_scans import slow_contamination

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    docs = queries.table(spark, SF, "documents")
    model = quality.learn(docs, queries.table(spark, SF, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i, r in rows.items() if model.score(np.array([quality.features(r.text.encode())]))[0] >= quality.KEEP]
    near = slow_near([(i, rows[i].text) for i in good], 80)
    once = [i for i in good if near[i][1] == i]
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = [d for d, _, hit, *_ in slow_contamination([(i, rows[i].text) for i in once], items) if not hit]
    at, want = docs, (good, once, clean)
    for (_, stage), ids in zip(corpus_pipeline.STAGES, want, strict=False):
        out = stage(spark, at, SF)
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r.doc_id for r in got) == sorted(ids)
        assert all(tuple(r) == tuple(rows[r.doc_id]) for r in got)
        at = spark.createDataFrame(got, docs.schema)
    final = corpus_pipeline.run(spark, SF)
    assert final.columns[:-1] == docs.columns
    kept = {r.doc_id for r in final.collect()}
    assert kept and kept <= set(clean)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, found int, kept_id int, mixed int"
    text = " ".join(random.Random(1).choices("abcdefgh", k=50))
    rows = [(1, text, "en", "src0", 1, 1, 1, 1), (1, text, "en", "src0", 1, 1, 1, 1), (None, None, None, None, None, None, None, None), (2, "", "xx", "", 0, 0, 0, 0)]
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        at = df
        for _, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, SF)
            assert at.columns[: len(df.columns)] == df.columns
        assert at.count() <= 4


def test_reused_ids_and_long_texts_lose_nothing(spark):
    rng = random.Random(6)
    words = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    a, b = words(100), words(100)
    near = " ".join([*b[:-1], "other"])
    long = " ".join(words(200_000))
    blank = [(50, ""), (50, " "), (50, ""), (51, None), (51, None)]
    for first in ((1, " ".join(a)), (1, " ".join(b))):
        rows = [first, (1, " ".join(b)), (1, " ".join(a)), (101, near), (102, near.upper()), (7, long), (8, long + " more"), (None, near), *blank]
        df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept_mark string").repartition(4)
        out = setsketch.drop_near_duplicates(df)
        assert out.columns == df.columns
        got = [(r.doc_id, r.text) for r in out.collect()]
        want = [(1, " ".join(a)), (1, " ".join(b)), (7, long), (None, near), (50, ""), (50, " "), (51, None)]
        assert sorted(got, key=str) == sorted(want, key=str)
    rows = [(5, " ".join(a)), (5, " ".join(a).upper()), (5, " ".join([*a[:-1], "x"])), (4, " ".join(b))]  # one id, one group, three texts
    got = setsketch.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == [4, 5]


def test_queries_are_registered():
    from __spark_entry__ import oracle_sql, queries as registered

    names = registered()
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLE) <= set(oracle_sql())
    assert [k.split("_")[0] for k in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_decontamination_keeps_extra_columns(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string").withColumn("found", F.lit(1)).withColumn("found_", F.lit(2))
    b = spark.createDataFrame([(1, "y")], "item_id long, text string")
    assert decontaminate.decontaminate(df, b).columns == df.columns
