import numpy as np
import pytest

from heronq.llm import nbsvm, ordinal, queries
from heronq.llm.common import utf8
from heronq.llm.training import held_out, labelled_sample
from tests.llm.cases import ODD_TEXTS, odd_documents


@pytest.fixture(scope="module")
def sf01(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.1")


def outcomes(spark, scored, sf, label, predicted):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in scored.collect() if r.held_out and r.doc_id in labels]
    return [(labels[r.doc_id], r[predicted]) for r in rows]


def test_quality_on_rows_held_out(spark, sf01):
    import zlib

    got = queries.op5_quality_classifier(spark, sf01).cache()
    assert got.count() == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.limit(500).collect())
    pairs = outcomes(spark, got, sf01, "quality", "predicted")
    good, bad = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_toxicity_on_rows_held_out(spark, sf01):
    got = queries.op6_toxicity(spark, sf01).cache()
    assert got.count() == 10_000
    pairs = outcomes(spark, got, sf01, "toxic", "toxic")
    clean, toxic = [p for y, p in pairs if y == 0], [p for y, p in pairs if y == 1]
    assert sum(clean) <= 0.01 * len(clean) and sum(toxic) >= 0.75 * len(toxic)
    assert all(0 <= r.severity <= ordinal.GRADES and r.kept == (r.toxic == 0) for r in got.limit(500).collect())


def test_odd_rows_and_missing_labels(spark):
    docs = odd_documents(spark)
    ids = [i * 3 for i in range(len(ODD_TEXTS))]
    some = spark.createDataFrame([(i, k % 2, int(k % 3 == 0), "x") for k, i in enumerate(ids)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 0, 0, "x"), (10**9, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    for labels in (some, some.limit(0), some.where("quality = 1 and toxic = 1")):
        scores = nbsvm.classify(docs, labels).collect()
        assert sorted(r.doc_id for r in scores) == ids and all(0 <= r.score <= 1 for r in scores)
        grades = ordinal.toxicity(docs, labels).collect()
        assert sorted(r.doc_id for r in grades) == ids and all(0 <= r.severity <= ordinal.GRADES for r in grades)
        assert nbsvm.accepted(docs, labels, threshold=0.0).count() == ordinal.harmless(docs, labels, threshold=2.0).count() == len(ids)
        assert nbsvm.accepted(docs, labels).columns == docs.columns
    assert nbsvm.classify(docs.limit(0), some).count() == ordinal.toxicity(docs.limit(0), some).count() == 0


def test_held_out_rows_are_never_sampled(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    sample = labelled_sample(labels, "quality", 50)
    assert sample.where(held_out()).count() == 0 and sample.where("y = 1").count() == sample.where("y = 0").count() == 50


def test_dual_descent_finds_the_hinge_optimum():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((80, 5))
    y = np.where(x[:, 0] + 0.3 * rng.standard_normal(80) > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w, b = nbsvm.dual_coordinate_descent(rows, y, np.ones(80), 5, epochs=2000, tolerance=1e-6)

    def loss(w, b):
        return (w @ w + b * b) / 2 + np.maximum(0, 1 - y * (x @ w + b)).sum()

    best = loss(w, b)
    assert all(best <= loss(w + 0.01 * rng.standard_normal(5), b + 0.01 * rng.standard_normal()) + 1e-9 for _ in range(300))


def test_ordinal_thresholds_are_ordered_and_shared():
    rng = np.random.default_rng(1)
    z = rng.standard_normal(3000)
    grade = np.searchsorted([-0.5, 0.4, 1.5], z + 0.3 * rng.logistic(size=3000))
    w, theta = ordinal.fit_ordinal(3000, np.arange(3000), np.zeros(3000, np.int64), z, grade, np.ones(3000), 1, ridge=0.0, steps=1500)
    assert (np.diff(theta) > 0).all()
    assert np.allclose(theta / w[0], [-0.5, 0.4, 1.5], atol=0.12)


def test_tokens_are_words_and_beginnings_in_lower_case():
    import pyarrow as pa

    a = ordinal.tokens(*utf8(pa.array(["ÉTÉ, (Idiot)!", "été idiot"])))
    rows, hashes, n = a
    assert n.tolist() == [2, 2] and sorted(hashes[rows == 0]) == sorted(hashes[rows == 1])
    assert (rows == 0).sum() == 2 + 2 + 3  # words; beginnings é ét; id idi idio
