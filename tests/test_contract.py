"""The driver contract: every oracle key is a registered query, names are stable."""
import inspect


from fbrank import catalog


def test_every_oracle_key_is_a_query():
    from __spark_entry__ import oracle_sql, queries

    q, sql = queries(), oracle_sql()
    assert set(sql) <= set(q)
    assert {k for k in catalog.QUERIES if k not in sql} == set()  # rows-only: PCA sign/numeric freedom
    for name, fn in q.items():
        assert callable(fn) and len(inspect.signature(fn).parameters) == 2, name


def test_oracle_sql_is_text():
    from __spark_entry__ import oracle_sql

    for name, text in oracle_sql().items():
        assert text.lstrip().upper().startswith(("WITH", "SELECT")), name


def test_a_missing_package_takes_no_other_query_with_it():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=300)
    names, sql = (set(line.split()) for line in ran.stdout.strip().splitlines()[-2:])
    assert names >= set(catalog.QUERIES) and sql >= set(catalog.QUERIES), ran.stderr
    assert "pipeline" not in names
    assert "ahocorasick" in ran.stderr or not os.path.exists(os.path.join(root, "corpus_pipeline.py"))
