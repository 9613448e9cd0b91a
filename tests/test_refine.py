import pytest

from fbrank.operators import sparse as sp
from fbrank.operators.refine import mean_pool, refine_average, refine_rocchio


def test_dense_rocchio(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qv array<double>")
    fb = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [0.0, 3.0])], "qid long, fb_pos int, vec array<double>")
    out = refine_rocchio(q, fb, alpha=0.4, beta=0.6, topk=3).first()["qv"]
    assert out == pytest.approx([0.4, 1.2])


def test_dense_rocchio_negative_and_empty(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0])], "qid long, qv array<double>")
    fb = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [2.0, 0.0])], "qid long, fb_pos int, vec array<double>")
    out = {r["qid"]: r["qv"] for r in refine_rocchio(q, fb, alpha=1, beta=1, gamma=0.5, topk=1, bottomk=1).collect()}
    assert out[1] == pytest.approx([1 - 1.0, 1.0])
    assert out[2] == pytest.approx([0.0, 2.0])  # no feedback: alpha * q


def test_dense_average(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qv array<double>")
    fb = spark.createDataFrame([(1, 0, [0.0, 1.0]), (1, 1, [2.0, 2.0])], "qid long, fb_pos int, vec array<double>")
    assert refine_average(q, fb).first()["qv"] == pytest.approx([1.0, 1.0])


def test_sparse_rocchio(spark):
    q = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "qid long, term string, weight double")
    fb = spark.createDataFrame([(1, "y", 3.0), (1, "z", 2.0)], "qid long, term string, weight double")
    out = {r["term"]: r["weight"] for r in sp.refine_terms(q, fb, alpha=1.0, beta=0.75).collect()}
    assert out == pytest.approx({"x": 1.0, "y": 4.25, "z": 1.5})


def test_sparse_rocchio_zero_alpha_drops_query_terms(spark):
    q = spark.createDataFrame([(1, "x", 1.0)], "qid long, term string, weight double")
    fb = spark.createDataFrame([(1, "z", 2.0)], "qid long, term string, weight double")
    assert [r["term"] for r in sp.refine_terms(q, fb, alpha=0.0, beta=1.0).collect()] == ["z"]


def test_mean_feedback_divides_by_all_feedback_docs(spark):
    docs = spark.createDataFrame([(1, "y y z z z z"), (2, "y y y y"), (3, "w w")], "docid long, text string")
    idx = sp.build_index(docs)
    fb = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "qid long, fb_pos int, docid long")
    out = {r["term"]: r["weight"] for r in sp.mean_feedback(fb, idx).collect()}
    # y occurs in 2 of 3 docs (> half) -> stop word; z: 4 / 2 feedback docs
    assert out == pytest.approx({"z": 2.0})


def test_mean_pool_l2(spark):
    df = spark.createDataFrame([(1, [3.0, 0.0]), (1, [3.0, 8.0])], "g int, vec array<double>")
    assert mean_pool(df, ["g"]).first()["vec"] == pytest.approx([0.6, 0.8])


def test_fitted_pca_is_a_matrix(spark):
    import numpy as np
    from fbrank.operators.encode import apply_matrix, pca_apply, pca_fit

    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(40, 5)) * [5, 3, 1, 1, 1])], "docid long, vec array<double>")
    model = pca_fit(df, 2)
    m = model.pc.toArray().T
    matrix = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "component int, row array<double>")
    a, b = ({r.docid: r.vec for r in x.collect()} for x in (pca_apply(df, model, "vec"), apply_matrix(df, "vec", matrix)))
    assert all(np.allclose(a[i], b[i]) for i in a)


def test_encoders_are_chosen_by_class_then_by_keyword(spark):
    import numpy as np
    import pytest
    from fbrank.operators.encode import EncoderClass, MatrixEncoder, choose_encoder, encode_batches, encode_named

    def length_of(factor):
        return lambda name: lambda: (lambda texts: np.array([[len(t) * factor, 4.0] for t in texts]))

    classes = {"one": EncoderClass(length_of(1.0)), "sentence": EncoderClass(length_of(3.0), pool=True), "auto": EncoderClass(length_of(0.0))}
    assert choose_encoder(classes, "some/Sentence-model") is classes["sentence"]
    assert choose_encoder(classes, "some/sentence-model", "one") is classes["one"]
    assert choose_encoder(classes, "other") is classes["auto"]
    with pytest.raises(ValueError):
        choose_encoder(classes, "x", "two")
    rows = [(1, "a"), (2, None), (3, "x" * 50_000), (3, "x" * 50_000), (4, "")]
    df = spark.createDataFrame(rows, "qid long, title string").repartition(3)
    got = sorted((r.qid, r.qv) for r in encode_batches(df, length_of(1.0)(""), batch_size=2).collect())
    assert got == [(1, [1.0, 4.0]), (2, [0.0, 4.0]), (3, [50000.0, 4.0]), (3, [50000.0, 4.0]), (4, [0.0, 4.0])]
    pooled = {r.qid: r.qv for r in encode_named(df, classes, "a-sentence-b", prefix="").collect()}
    assert np.allclose(pooled[1], [0.6, 0.8]) and np.allclose(pooled[4], [0, 1])
    assert encode_batches(df.limit(0), length_of(1.0)("")).count() == 0
    m = MatrixEncoder([[1.0, 0.0], [0.0, 2.0]])
    assert np.allclose(np.linalg.norm(m(["some words here", ""]), axis=1), [1, 0])
