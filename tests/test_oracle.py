"""Registered queries against their DuckDB oracle on the smallest scale."""
import duckdb
import pytest

from conftest import SF001

KEYS = ["dense_topk", "prf_dense_rocchio_run", "bm25_topk", "feedback_swapped", "feedback_donor", "eval_summary",
        "dense_rocchio_vec", "encode_hashed", "max_passage", "qrels_scan", "binary_topk_rerank", "prf_text_dense_run"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ["embeddings", "benchmark", "documents", "labels"]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    from __spark_entry__ import oracle_sql, queries
    from tools.oracle_check import digest

    df = queries()[key](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(oracle_sql()[key])
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    assert len(rows) == len(orows)
    assert digest(rows, df.columns)[0] == digest(orows, res.columns)[0]


def test_entry_runs(spark):
    from __spark_entry__ import entry

    assert entry(spark).count() > 0


def test_swapped_grid_is_whole_and_matches_oracle(spark, monkeypatch):
    from fbrank import catalog, oracle
    from tools.oracle_check import digest

    sf = "/root/testdata/sf0.01"
    trials, batched = catalog._swapped_grid(spark, catalog.Ctx(spark, sf))
    assert {(r.seed, r.nsplit, r.total_prf_docs, r.topics) for r in trials.collect()} == {(s, n, t, x) for s in catalog.sw.DEFAULT_SEEDS for n in range(10) for t in (100, 1000) for x in ("even", "odd")}
    assert trials.count() == 400 and batched.count() == 40 and {r[0] for r in batched.select("batch_size").distinct().collect()} == {64}
    monkeypatch.setitem(catalog.SWAP_GRID, "batch", 5)  # at this scale no batch of 64 has a valid shift
    c = duckdb.connect()
    for t in ["embeddings", "benchmark", "documents", "labels"]:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sql = oracle.build()
    for key in ("sweep_dense_swapped_grid", "sweep_dense_swapped_unsatisfied"):
        df = catalog.QUERIES[key](spark, sf)
        res = c.sql(sql[key])
        rows = [tuple(r) for r in df.collect()]
        assert rows and digest(rows, df.columns)[0] == digest(res.fetchall(), res.columns)[0]
