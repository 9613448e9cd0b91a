import os
import tempfile

from fbrank.sources import runs as rf

SAMPLE = "".join(f"topic{t} Q0 doc{10 * t + r} {r} {3.0 - t / 4 - r * 1e-6:.6f} own\n" for t in (1, 2) for r in (1, 2, 3))


def test_run_file_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="fbrank-run-")
    src = os.path.join(d, "run.txt")
    with open(src, "w") as f:
        f.write(SAMPLE)
    run = rf.read_run(spark, src)
    assert run.count() == 6
    out = os.path.join(d, "out")
    rf.write_run(run, out, tag="own", partitions=1)
    lines = [r["value"] for r in spark.read.text(out).collect()]
    assert "\n".join(lines) + "\n" == SAMPLE


def test_msmarco_format(spark):
    hits = spark.createDataFrame([(1, 7, 1, 0.5)], "qid long, docid long, rank int, score double")
    assert rf.format_run(hits, fmt="msmarco").first()["line"] == "1\t7\t1"


def test_qrels_roundtrip(spark):
    q = spark.createDataFrame([(1, 2, 3)], "qid long, docid long, rel int")
    p = os.path.join(tempfile.mkdtemp(prefix="fbrank-qrels-"), "q")
    rf.write_qrels(q, p)
    r = rf.read_qrels(spark, p).first()
    assert (r["qid"], r["docid"], r["rel"]) == ("1", "2", 3)


def test_folder_of_trec_files(spark):
    d = tempfile.mkdtemp(prefix="fbrank-runs-")
    for name in ("run.100.10.3.0.42.trec", "run.100.10.3.1.42.trec", "notes.txt"):
        with open(os.path.join(d, name), "w") as f:
            f.write(SAMPLE)
    got = {r["run_name"]: r["count"] for r in rf.read_runs(spark, d).groupBy("run_name").count().collect()}
    assert got == {"run.100.10.3.0.42.trec": 6, "run.100.10.3.1.42.trec": 6}
