import zlib

import numpy as np

from txnwatch.llm.passages import FEATURES, Network, Settings, encode, quality_scores

FOLDER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    quality = {r.doc_id: r.quality for r in labels.collect()}
    out = quality_scores(docs, labels).collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in quality]
    assert sum(r.predicted == quality[r.doc_id] for r in held) >= 0.95 * len(held)


def test_gradients():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, FEATURES)), np.array([0, 4, 5]), np.array([1.0, 0.0, 1.0])
    net = Network(0.5, np.zeros(FEATURES), np.ones(FEATURES), Settings(hidden=3))
    net.p["c"] = rng.normal(size=3)

    def loss():
        z = net.forward(x, first)[0]
        return float((np.log1p(np.exp(z)) - y * z).sum())

    z, state = net.forward(x, first)
    grad = net.gradients(1 / (1 + np.exp(-z)) - y, state)
    for name, w in net.p.items():
        for at in list(np.ndindex(w.shape))[:5]:
            old = w[at]
            w[at] = old + 1e-5
            up = loss()
            w[at] = old - 1e-5
            down = loss()
            w[at] = old
            assert abs((up - down) / 2e-5 - grad[name][at]) < 1e-5


def test_every_passage_counts():
    assert encode(None).shape == encode(b"").shape == encode(b" \n").shape == (1, FEATURES)
    assert encode(b"w " * 64).shape[0] == 1 and encode(b"w " * 65).shape[0] == 2


def test_edge_cases(spark):
    shape, marks = "doc_id long, text string, score int", "doc_id long, quality int, toxic int"
    docs = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "x " * 40000, 1), (None, "a", 1), (3, "x " * 40000, 1)], shape)
    for rows, want in ([], 0.5), ([(1, 1, 0), (1, 1, 0), (2, None, 0), (None, 0, 0)], 1.0):
        out = quality_scores(docs, spark.createDataFrame(rows, marks)).collect()
        assert len(out) == 5 and all(r.score == want for r in out)
    some = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, 0, 0), (7, 1, 0), (8, 0, 0)], marks)
    out = quality_scores(docs, some).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality_scores(spark.createDataFrame([], shape), some).collect() == []
