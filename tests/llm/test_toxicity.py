import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import toxicity
from paperloom.llm.text import Texts

TEXTS = ["one two three", "", "four", "five six", "one one one two", "", "Seven eight nine ten eleven"]


def plain_logit(net, enc, t):
    words = enc.word[enc.first[t] : enc.first[t + 1]]
    x = [net.e[enc.rows[w]].sum(0) for w in words]
    h = []
    for i, width in enumerate(toxicity.WIDTHS):
        ys = []
        for at in range(max(1, len(x))):
            y = net.b[i].copy()
            for k in range(width):
                if at + k < len(x):
                    y += x[at + k] @ net.w[toxicity._STARTS[i] + k]
            ys.append(y)
        h.append(np.maximum(np.max(ys, 0), 0))
    return np.concatenate(h) @ net.v + net.c


def test_network():
    net = toxicity.Network()
    net.b += 0.1
    enc = toxicity.Encoded(Texts(pa.array(TEXTS)))
    got = net.logits(enc)
    for t in range(len(TEXTS)):
        assert got[t] == pytest.approx(plain_logit(net, enc, t), abs=1e-4)
    alone = [float(net.logits(toxicity.Encoded(Texts(pa.array([t]))))[0]) for t in TEXTS]
    assert alone == pytest.approx(got.tolist(), abs=1e-4)


def test_learns_a_stem():
    rng = np.random.default_rng(5)
    clean = [" ".join(f"w{i}" for i in rng.integers(0, 300, 30)) for _ in range(240)]
    texts = [t + (f" badstem{k}" if k % 2 else "") for k, t in enumerate(clean)]
    toxic = np.arange(240) % 2.0
    enc = toxicity.Encoded(Texts(pa.array(texts)))
    net = toxicity.Network()
    net.train(enc, toxic, steps=150)
    fresh = toxicity.Encoded(Texts(pa.array(["w1 w2 badstemxyz w3", "w1 w2 w3 w4"])))
    a, b = net.logits(fresh)
    assert a > b + 2


def test_best_cut():
    raw = np.array([0.9, 0.8, 0.7, 0.2, 0.1] * 10)
    toxic = np.array([1, 1, 0, 0, 0] * 10)
    assert toxicity.best_cut(raw, toxic, np.ones(50), 0.5) == pytest.approx(0.75)
    assert toxicity.best_cut(raw[:5], toxic[:5], np.ones(5), 0.4) == 0.4


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a", None, 1), (None, None, "en", 2), (1, "a", None, 1)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.report(docs, labels).collect()] == [(0.0, 0)] * 3
    assert toxicity.report(docs.where("doc_id = 5"), labels).count() == 0


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = sum(r.toxic and r.predicted for r in rows)
    assert hit >= 0.9 * sum(r.toxic for r in rows)
    assert hit >= 0.9 * sum(r.predicted for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)


def test_joined():
    whole = toxicity.Encoded(Texts(pa.array(TEXTS)))
    parts = toxicity.Encoded.joined([toxicity.Encoded(Texts(pa.array(TEXTS[a:b]))) for a, b in ((0, 3), (3, 4), (4, 7))])
    for name in ("keys", "rows", "word", "first"):
        assert np.array_equal(getattr(whole, name), getattr(parts, name)), name


def test_learns_from_every_document(spark):
    rng = np.random.default_rng(6)
    rows = [(k, " ".join(f"w{i}" for i in rng.integers(0, 300, 20)) + (f" badstem{k}" if k % 2 else ""), "en") for k in range(600)]
    rows.append((600, "langer " * 30_000, "long"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(601)], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, shard=200)
    assert net.langs == ["en", "long"]
    row = toxicity.Encoded(Texts(pa.array(["langer"]))).rows[0, 0]
    assert net.lang_log[row, 1] == pytest.approx(np.log(30_000.1 / (30_000 + 0.1 * toxicity.ROWS)), abs=1e-4)
    a, b = net.scores(Texts(pa.array(["w1 w2 badstemxyz w3", "w1 w2 w3 w4"])))
    assert a >= toxicity.THRESHOLD > b
    again = toxicity.fit(docs.repartition(3), labels, shard=200)
    assert np.array_equal(net.e, again.e)
    assert (net.cut, net.cuts.tolist()) == (again.cut, again.cuts.tolist())
