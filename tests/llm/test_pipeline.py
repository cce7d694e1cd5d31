from collections import Counter

import corpus_pipeline
from paperloom.llm import lines

from . import test_decontaminate, test_jaccard, test_lines, test_packing, test_quality


def survivors(rows, items):
    """doc_id and text after the first four stages, by the operators' brute-force versions. rows: (doc_id, text, lang, source)"""
    _, kept = test_quality.verdicts([(lang, source, text) for _, text, lang, source in rows])
    left = [(d, t) for (d, t, *_), k in zip(rows, kept) if k]
    rest = []
    for (d, t), gone in zip(left, test_lines.brute(left, lines.MIN_WORDS)):
        text = "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)
        if not gone or len(text.split()) >= 50:
            rest.append((d, text))
    first = {g for *_, g in test_jaccard.brute(rest)}
    rest = [r for r in rest if r[0] in first]
    dirty = {r[0] for r in test_decontaminate.brute(rest, items) if r[4]}
    return {d: t for d, t in rest if d not in dirty}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = survivors([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()], items)
    state = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = corpus_pipeline.stored(stage(spark, state, sf))
        assert state.columns == docs.columns, name
    got = state.collect()
    assert {r.doc_id: r.text for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)
    packed = corpus_pipeline.run(spark, sf).collect()
    length = {r.bin: r.bin_length for r in packed}
    test_packing.sound([(r.bin, r.offset, r.size) for r in packed if r.bin is not None], length.get)
    own = Counter()
    for r in packed:
        own[r.doc_id] += r.size or 0
    assert own == {d: len(t.split()) for d, t in want.items()}


def test_odd_rows(spark, tmp_path):
    good = " ".join(f"word{k}" for k in range(80))
    rows = [(1, good, "en", "a", 0), (1, good, "en", "a", 0), (None, good + " tail", None, None, None), (3, None, "en", "a", None), (4, "", None, "a", 0), (5, "é " * 70_000, "fr", None, 1), (6, "\n".join(f"other{k} words{k * 7}" for k in range(90)), "en", "b", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "6"]


def test_clashing_names(spark, tmp_path):
    """Columns named as what the stages make of their own stay as they are."""
    texts = [" ".join(f"w{(k * k + (k + 1) * j) % 997}" for j in range(90)) for k in range(5)]
    rows = [(k, t, "en", "a", len(t), 7 * k, f"x{k}", k) for k, t in enumerate([*texts, texts[0] + "\n" + texts[1], texts[2]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_deleted long, n_lines string, group long")
    for names in (docs.columns, ["doc_id", "text", "lang", "source", "n_chars", "d1", "key_hash", "gone"], ["doc_id", "text", "lang", "source", "n_chars", "runs", "c0", "items"]):
        state = docs.toDF(*names)
        state.select("doc_id").write.mode("overwrite").parquet(f"{tmp_path}/x.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            state = corpus_pipeline.stored(stage(spark, state, str(tmp_path)))
            assert state.columns == names, name
        assert sorted(tuple(r) for r in state.collect()) == [tuple(r) for r in rows[:5]]
        assert corpus_pipeline.STAGES[-1][1](spark, state, str(tmp_path)).count() == 5


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
