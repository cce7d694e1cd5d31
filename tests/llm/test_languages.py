import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import languages
from paperloom.llm.text import Texts


def plain_trigrams(text):
    raw = bytes(b if b >= 128 or 97 <= b < 123 else b + 32 if 65 <= b < 91 else 32 for b in (text or "").encode())
    raw = b" " + raw + b" "
    grams = (raw[k : k + 3] for k in range(len(raw) - 2))
    return Counter((int.from_bytes(g, "big") * 2654435761 % 2**32) >> (32 - languages.BITS) for g in grams if b"  " not in g)


TEXTS = [None, "", " ", "a", "ab", "Été à l'eau 12", "a  b\n\nc", "北京", "!?", "The end. The end!", " x", "y "]


def test_trigrams():
    of, bucket = languages.trigrams(Texts(pa.array(TEXTS)))
    for k, t in enumerate(TEXTS):
        assert Counter(bucket[of == k].tolist()) == plain_trigrams(t), t


def test_mixture():
    """Against expectation maximisation of one text at a time."""
    rng = np.random.default_rng(1)
    model = languages.Mixture(["p", "q", "r"], rng.gamma(0.05, 50, (3, 1 << languages.BITS)))
    texts = ["some text of letters", "another one", "x", "mixed ünd lettres"]
    picked, shares, top = model.infer(Texts(pa.array(texts)))
    for t, text in enumerate(texts):
        grams = plain_trigrams(text)
        p = np.array([model.p[b] for b in grams], float)
        n = np.array(list(grams.values()), float)
        pi = np.full(3, 1 / 3)
        for _ in range(languages.ROUNDS):
            q = p * pi
            pi = (q / q.sum(1, keepdims=True) * n[:, None]).sum(0) / n.sum()
        assert top[t] == pytest.approx(pi[picked[t][0]], rel=1e-3)
        assert sum(shares[t]) == pytest.approx(1, abs=1e-5)


def test_small(spark):
    rows = [(k, "the cat and the dog went over the hill", "en", "x") for k in range(8)] + [(k + 8, "der Hund und die Katze liefen über den Berg", "de", "x") for k in range(8)]
    rows += [(20, None, "en", "x"), (21, "", None, "x"), (22, "123 !?", "de", "x"), (23, "the dog and the hill " * 40 + "der Hund und die Katze über den Berg " * 30, None, "x"), (None, "und der Hund", None, "x"), (23, "the dog", None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = [(r.doc_id, r) for r in languages.report(docs).collect()]
    assert len(got) == len(rows)
    by = dict(got[:-1])
    assert by[20].lang_pred == by[21].lang_pred == by[22].lang_pred == "und" and by[22].score == 0
    assert by[None].lang_pred == "de" and by[None].held_out is False
    mixed = next(r for i, r in got if i == 23 and len(r.langs) > 1)
    assert set(mixed.langs) == {"en", "de"} and 0.3 < mixed.shares[1] < 0.7
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got if i is not None)
    assert all(by[k].lang_pred == ("en" if k < 8 else "de") and by[k].langs == [by[k].lang_pred] for k in range(16))


def test_unlearned(spark):
    docs = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in languages.report(docs).collect()] == [("und", 0.0)]
    assert languages.report(docs.where("doc_id = 2")).count() == 0


def test_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = languages.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_many_languages(spark):
    """A text in equal parts of six languages has all six."""
    rng = random.Random(5)
    letters = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx", "yzéà"]
    speak = lambda k, n: " ".join("".join(rng.choice(letters[k]) for _ in range(rng.randint(3, 7))) for _ in range(n))
    train = [(k, f"l{k}", speak(k, 400)) for k in range(len(letters))]
    model = languages.fit(spark.createDataFrame(train, "doc_id long, lang string, text string"))
    mixed = spark.createDataFrame([(1, " ".join(speak(k, 200) for k in range(6))), (2, speak(6, 200))], "doc_id long, text string")
    got = {r.doc_id: r for r in languages.predicted(mixed, model, ["doc_id"]).collect()}
    assert sorted(got[1].langs) == [f"l{k}" for k in range(6)] and got[2].langs == ["l6"]
    assert sum(got[1].shares) > 0.99 and min(got[1].shares) > 0.1
