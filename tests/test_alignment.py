"""Sentences on assembled items, against a plain version, and how many of all fitting pairs the candidates hold."""

import random
import re
import time

from pyspark.sql import Row
from pyspark.sql import functions as F

from paperloom.operators import alignment
from paperloom.plans import relations, reports


def plain_fit(query, text):
    """(distance, start, end): each cell holds its distance and the latest start that has it."""
    row = [(0, -j) for j in range(len(text) + 1)]
    for i, c in enumerate(query, 1):
        new = [(i, 0)]
        for j in range(1, len(text) + 1):
            new.append(min((row[j - 1][0] + (text[j - 1] != c), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[j - 1][0] + 1, new[j - 1][1])))
        row = new
    best = min(range(len(row)), key=lambda j: (row[j][0], j))
    return row[best][0], -row[best][1], best


def test_long_texts_fit_quickly():
    """A step of the fit takes all characters of the text as bits, not as numbers."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    text = [rng.choice(words) for _ in range(20_000)]
    query = " ".join([*text[9_000:9_030], "zz", *text[9_030:9_070]])
    before = time.monotonic()
    found = {alignment.fit_long(query, " ".join(text)) for _ in range(12)}
    assert time.monotonic() - before < 2
    start = len(" ".join(text[:9_000])) + 1
    assert found == {(3, start, start + len(query) - 3)}


def plain(sentence, items):
    """items: (page, index, text, eol), in order. White space runs are one space; that is all there is to normalise here."""
    query = " ".join(sentence.split())
    if not query:
        return ("unmapped", "empty_sentence", 0.0, 0, 0, False, None, None, [])
    if not items:
        return ("unmapped", "no_candidates", 0.0, len(query), len(query), False, None, None, [])
    raw, owner, last = "", [], None
    for item in items:
        if last:
            gap = "\n" if last[3] or last[0] != item[0] else "" if item[1] == last[1] + 1 else " "
            raw, owner = raw + gap, owner + [None] * len(gap)
        raw, owner = raw + item[2], owner + [(item, k) for k in range(len(item[2]))]
        last = item
    norm, places = "", []
    for k, c in enumerate(raw):
        if c.isspace() and norm.endswith(" ") and raw[k - 1].isspace():
            places[-1].append(k)
        else:
            norm, places = norm + (" " if c.isspace() else c), [*places, [k]]
    at = norm.find(query)
    twice = at >= 0 and norm.find(query, at + 1) >= 0
    distance, start, end = (0, at, at + len(query)) if at >= 0 else plain_fit(query, norm)
    ratio = distance / len(query)
    if ratio > 0.35:
        return ("unmapped", "over_threshold", 0.0, distance, len(query), at >= 0, None, None, [])
    covered = [owner[k] for p in places[start:end] for k in p if owner[k]]
    spans = [(i[0], i[1], min(k for j, k in covered if j == i), max(k for j, k in covered if j == i) + 1) for i in items if any(j == i for j, _ in covered)]
    return ("uncertain" if twice or ratio > 0.1 else "mapped", "ambiguous" if twice else None, 0.5 if twice else 1 - ratio, distance, len(query), at >= 0, start, end, spans)


def test_items(spark):
    rng = random.Random(8)
    sentences, candidates, want = [], [], {}
    for k in range(120):
        words = [rng.choice(["ab", "cde", "f", "ghij", "ab"]) for _ in range(rng.randrange(3, 14))]
        items, index = [], 0
        for at in range(0, len(words), 2):
            index += rng.choice([1, 1, 1, 3])
            items.append((index // 6, index, " ".join(words[at : at + 2]) + rng.choice(["", " ", "  "]), rng.random() < 0.3))
        low = rng.randrange(len(words))
        part = list(" ".join(words[low : low + rng.randrange(1, 8)]))
        for _ in range(rng.choice([0, 0, 1, 3, 9])):
            part[rng.randrange(len(part))] = rng.choice(["", "x", "yz"])
        sentence = "".join(part)
        if k % 20 == 0:
            items = []
        if k % 20 == 1:
            sentence = rng.choice(["", "  "])
        sentences.append((k, sentence if k != 21 else None))
        candidates += [(k, *i) for i in items]
        want[k] = plain(sentence if k != 21 else "", items)
    rng.shuffle(candidates)
    got = alignment.on_items(spark.createDataFrame(sentences, "k int, sentence string"), spark.createDataFrame(candidates, "k int, page long, index long, text string, eol boolean"), ["k"]).collect()
    assert len(got) == len(want)
    for r in got:
        spans = [tuple(s)[:4] for s in r.spans]
        assert (r.status, r.reason, round(r.confidence, 9), r.distance, r.length, r.exact, r.matched_start, r.matched_end, spans) == (*want[r.k][:2], round(want[r.k][2], 9), *want[r.k][3:]), (r, want[r.k])
    assert {w[1] for w in want.values()} == {None, "empty_sentence", "no_candidates", "over_threshold", "ambiguous"}


def test_folded_items(spark):
    """Hyphens at line ends, ligatures and zero-width characters: spans stand in the items as they are, and in their normalised texts."""
    items = [(1, 0, 0, "the po​wer-", True), (1, 0, 1, "ful eﬀect  of", True), (1, 1, 2, "words", False)]
    got = alignment.on_items(spark.createDataFrame([(1, "powerful effect of words")], "k int, sentence string"), spark.createDataFrame(items, "k int, page long, index long, text string, eol boolean"), ["k"]).first()
    assert (got.status, got.exact) == ("mapped", True)
    assert [tuple(s) for s in got.spans] == [(0, 0, 4, 11, 4, 10), (0, 1, 0, 13, 0, 13), (1, 2, 0, 5, 0, 5)]


def test_seeds(spark):
    """Of each word the characters from its beginning on, whatever white space is between."""
    rng = random.Random(6)
    parts = ["Ab", "cde", "fghijklmnopqr", "é", ".", " ", "  ", "\t", "\n ", " \r\n", "\x0b", "\u00a0", "\x1c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(16))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", relations._seeds("text", "keys")).collect()
    plain = {t: re.sub("[\t\n\x0b\f\r ]+", " ", t).strip(" ").lower() for t in texts}
    grams = {t: {p[m.start() : m.start() + 12] for m in re.finditer("[^ ]+", p)} for t, p in plain.items()}
    known = {r.g: r.h for r in spark.createDataFrame([(g,) for g in set().union(*grams.values())], "g string").select("g", F.xxhash64("g").alias("h")).collect()}
    for r in rows:
        assert sorted(r["keys"]) == sorted(known[g] for g in grams[r.text]), r.text


def test_texts_are_shuffled_once(spark):
    """Items by their key, sentences, and what was found: no text is dealt out again behind the fit."""
    sentences = spark.createDataFrame([(1, "a b")], "k int, sentence string")
    items = spark.createDataFrame([(1, 0, 0, "a b c", True)], "k int, page long, index long, text string, eol boolean")
    plan = alignment.on_items(sentences, items, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3


def test_recall(spark, tmp_path):
    """Of all pairs of passage and document that fit with at most 0.35 edits a character, 9 of 10 are found, at the same distance or less."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(6, 40))) for _ in range(15)]

    def changed(text, share):
        return "".join(rng.choice(["", "z", c + "q"]) if rng.random() < share else c for c in text)

    docs = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randrange(3, 60))) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.randrange(3)):
            text = changed(rng.choice(passages), rng.choice([0, 0.02, 0.05, 0.1]))
            if rng.random() < 0.4:
                cut = text.rfind(" ", 0, len(text) // 2)
                text = text[:cut] + "\n" + text[cut + 1 :]
            parts.insert(rng.randrange(len(parts) + 1), text)
        docs.append("\n".join(parts))
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, t, "s") for k, t in enumerate(docs)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.item_id): r for r in relations.passage_alignment(spark, str(tmp_path)).collect()}
    fits = {(d, i): alignment.fit(p, " ".join(t.split())) for d, t in enumerate(docs) for i, p in enumerate(passages)}
    true = {k for k, f in fits.items() if f[0] / len(passages[k[1]]) <= 0.35}
    found = {k for k, r in got.items() if r.status != "unmapped"}
    assert len(true) > 40 and found <= true
    assert len(found & true) / len(true) >= 0.9
    assert all(got[k].distance == fits[k][0] for k in found)
    for k in found:
        r = got[k]
        assert r.distance > 0 or " ".join(docs[k[0]][r.start : r.end].split()) == passages[k[1]]
    stats = {r.status: r for r in reports.alignment_stats(spark, str(tmp_path)).collect()}
    for status in {r.status for r in got.values()}:
        own = [r for r in got.values() if r.status == status]
        ratios, sizes = sorted(r.distance / r.length for r in own), sorted(len(r.spans) for r in own)
        reasons = [sum(r.reason == x for r in own) for x in ("empty_sentence", "no_candidates", "over_threshold", "ambiguous")]
        want = Row(status, len(own), sum(r.exact for r in own), *reasons, ratios[len(own) // 2], ratios[-1], sizes[len(own) // 2], sizes[-1])
        assert tuple(stats[status]) == tuple(want)
