"""The stored text index: found by content, joined where it lies."""
import pyarrow as pa
from pyspark.sql import functions as F

from fbrank.operators import sparse as sp
from fbrank.sources.index import stored_index

DOCS = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 9))) for i in range(80)]


def _docs(spark, rows):
    return spark.createDataFrame(rows, "docid long, text string")


def test_stored_index_equals_a_fresh_one(spark, tmp_path):
    docs = _docs(spark, DOCS)
    found, fresh = stored_index(docs, str(tmp_path)), sp.build_index(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for part in ("postings", "df", "doclen", "stats", "stop"):
        a, b = getattr(found.index, part), getattr(fresh, part)
        assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(a.columns))), part
    w = sp.doc_weights(fresh)
    assert rows(found.weights.select("term", "docid", F.round("w", 12))) == rows(w.select("term", "docid", F.round("w", 12)))


def test_index_goes_by_content(spark, tmp_path):
    first = stored_index(_docs(spark, DOCS), str(tmp_path))
    assert stored_index(_docs(spark, DOCS[::-1]).repartition(3), str(tmp_path)).key == first.key
    changed = stored_index(_docs(spark, [(0, "new words"), *DOCS[1:]]), str(tmp_path))
    assert changed.key != first.key and changed.index.postings.filter("term = 'new'").count() == 1
    assert stored_index(_docs(spark, [*DOCS, DOCS[0]]), str(tmp_path)).key != first.key  # a repeated row is another collection
    assert first.index.postings.filter("term = 'new'").count() == 0 and stored_index(_docs(spark, DOCS).limit(0), str(tmp_path)).index.postings.count() == 0


def test_another_session_finds_the_index_and_lost_jobs_leave_none(spark, tmp_path):
    first = stored_index(_docs(spark, DOCS), str(tmp_path), vectors=True)
    n = first.index.postings.count()
    for by in ("term", "docid"):
        spark.sql(f"DROP TABLE text_index_{first.key}_{by}")  # what a new session knows
    again = stored_index(_docs(spark, DOCS), str(tmp_path), vectors=True)
    assert again.index.postings.count() == again.index.by_doc.count() == n
    (tmp_path / first.key / "done" / "_SUCCESS").unlink()
    assert stored_index(_docs(spark, DOCS), str(tmp_path)).index.postings.count() == n and (tmp_path / first.key / "done" / "_SUCCESS").exists()


def test_a_term_join_leaves_the_postings_in_their_buckets(spark, tmp_path):
    found = stored_index(_docs(spark, DOCS), str(tmp_path))
    q = spark.createDataFrame([(1, f"w{i}", 1.0) for i in range(9)], "qid long, term string, weight double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sp.bm25_search(q, found.index, 10, weights=found.weights)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[plan.index("SortMergeJoin"):]
    assert "Bucketed: true" in scan and scan.count("Exchange ") == 1  # the query terms


def test_feedback_documents_go_to_the_stored_vectors(spark, tmp_path):
    docs = _docs(spark, DOCS)
    found, fresh = stored_index(docs, str(tmp_path), vectors=True), sp.build_index(docs)
    fb = spark.createDataFrame([(1, 3), (1, 4), (2, 70), (2, 9999)], "qid long, docid long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for mode in ("tf", "bm25"):
            mean = sp.mean_feedback(fb, found.index, mode=mode)
            assert "Bucketed: true" in mean._jdf.queryExecution().executedPlan().toString()
            rows = lambda df: sorted((r.qid, r.term, round(r.weight, 9)) for r in df.collect())
            assert rows(mean) == rows(sp.mean_feedback(fb, fresh, mode=mode)) != []
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_document_rows_hold_the_counts_of_all_texts_of_an_id(spark, monkeypatch):
    monkeypatch.setattr(sp, "TOKENS_AT_ONCE", 3)
    rows = [(2, "b a b"), (1, None), (3, ""), (2, "c a"), (None, "x"), (4, "Ä ä z9")]
    found = sp.document_terms(_docs(spark, rows), 2).collect()
    assert sorted((r.docid, r.terms, r.tfs) for r in found) == [(1, [], []), (2, ["a", "b", "c"], [2, 2, 1]), (3, [], []), (4, ["z9", "ä"], [1, 2])]
    pieces = [b for b in sp._count_terms(iter(pa.RecordBatch.from_pydict({"docid": [1, 2, 2], "terms": [["a"], ["b", "b", "c", "d"], ["b"]]}).slice(i, 1) for i in range(3)))]
    assert [r for b in pieces for r in b.to_pylist()] == [dict(docid=1, terms=["a"], tfs=[1]), dict(docid=2, terms=["b", "c", "d"], tfs=[3, 1, 1])]


def test_documents_are_scored_where_they_are_scanned(spark, tmp_path, monkeypatch):
    docs = _docs(spark, [*DOCS, (None, "w1 w2"), (80, None), (81, DOCS[5][1])])
    found, fresh = stored_index(docs, str(tmp_path), vectors=True, by_term=False), sp.build_index(docs)
    rows = lambda df: sorted(map(tuple, df.collect()))
    for part in ("df", "stats", "stop"):
        a, b = getattr(found.index, part), getattr(fresh, part)
        assert rows(a.select(sorted(a.columns))) == rows(b.select(sorted(b.columns))), part
    w = sp.doc_weights(fresh).select("term", "docid", F.round("w", 12))
    assert rows(found.weights.select("term", "docid", F.round("w", 12))) == rows(w)
    q = spark.createDataFrame([(q, f"w{(q * 7 + i) % 25}", 1.0 + i) for q in range(9) for i in range(4)] + [(0, "", 1.0), (1, "w1", -1.0)], "qid long, term string, weight double")
    want = [(r.qid, r["rank"], r.docid, round(r.score, 9)) for r in sp.bm25_search(q, fresh, 6).orderBy("qid", "rank").collect()]
    assert len(want) == 54
    plan = sp.bm25_search(q, found.index, 6, weights=found.weights)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and plan.count("Exchange ") == 1  # the hits by topic: no sum of a (query, document) pair is shuffled
    for layout in (dict(), dict(SCORE_CELLS=30, TOKENS_AT_ONCE=20), dict(BLOCK_BYTES=1), dict(QUERY_TERMS=0)):
        with monkeypatch.context() as m:
            for name, value in layout.items():
                m.setattr(sp, name, value)
            got = sp.bm25_search(q, found.index, 6, weights=found.weights).orderBy("qid", "rank").collect()
        assert [(r.qid, r["rank"], r.docid, round(r.score, 9)) for r in got] == want, layout
    assert sp.bm25_search(q.limit(0), found.index, 6).count() == 0
