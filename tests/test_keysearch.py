"""Sentences sought by their keys, against a plain search that tries every place and every length."""

import random
import unicodedata

from paperloom.operators import keysearch
from paperloom.plans import structures


def keys(text):
    out = []
    for at, c in enumerate(text or ""):
        for d in unicodedata.normalize("NFKD", c):
            if d.isalnum() or unicodedata.category(d)[0] in "LN":
                out += [(k, at) for k in d.lower() if unicodedata.category(k)[0] in "LN"]
    return out


def plain(items, sentences):
    items = sorted(items, key=lambda i: i[:2])
    stream = [(k, i, at) for i, (_, _, text) in enumerate(items) for k, at in keys(text)]
    hay = "".join(k for k, _, _ in stream)
    sought = ["".join(k for k, _ in keys(t)) for _, t in sentences]
    at = [[p for p in range(len(hay)) if k and hay.startswith(k, p)] for k in sought]
    fixed = {i: (p[0], p[0] + len(k)) for i, (p, k) in enumerate(zip(at, sought)) if len(p) == 1 and len(k) >= 20}
    out = []
    for i, (position, _) in enumerate(sentences):
        key, how, segments = sought[i], "manual", []
        before = max((j for j in fixed if j < i), default=None)
        behind = min((j for j in fixed if j > i), default=None)
        if i in fixed:
            how, segments = "unique", [fixed[i]]
        elif at[i]:
            if before is not None and behind is not None:
                inside = [p for p in at[i] if fixed[before][1] <= p and p + len(key) <= fixed[behind][0]]
                if len(inside) == 1:
                    how, segments = "unique_short" if len(at[i]) == 1 else "repeated_by_order", [(inside[0], inside[0] + len(key))]
        elif key:
            rest, good, low = key, True, 0
            while rest and good:
                high = len(hay) if not segments else min(len(hay), low + 8000)
                n = next((n for n in range(len(rest), 0, -1) if any(hay.startswith(rest[:n], p) and p + n <= high for p in range(low, high))), 0)
                starts = [p for p in range(low, high) if n and hay.startswith(rest[:n], p) and p + n <= high]
                if not segments and len(starts) > 1 and before is not None:
                    starts = [p for p in starts if 0 <= p - fixed[before][1] < 8000] or starts
                good = n >= min(12, len(rest)) and n > 0 and (bool(segments) or len(starts) == 1) and len(segments) < 5
                if good:
                    segments.append((starts[0], starts[0] + n))
                    low, rest = starts[0] + n, rest[n:]
            how, segments = ("segmented", segments) if good else ("manual", [])
        spans = []
        for low, high in segments:
            for item in sorted({stream[x][1] for x in range(low, high)}):
                own = [stream[x][2] for x in range(low, high) if stream[x][1] == item]
                spans.append((items[item][0], items[item][1], own[0], own[-1] + 1))
        gaps = [b[0] - a[1] for a, b in zip(segments, segments[1:])]
        tags = [t for t, yes in (("page_boundary", len({s[0] for s in spans}) > 1), ("repeated", len(at[i]) > 1), ("gapped", bool(gaps)), ("short", len(key) < 20)) if yes]
        out.append((position, how, len(at[i]), len(key), spans, gaps, tags))
    return out


def shaped(r):
    return (r.position, r.how, r.occurrences, r.key_length, [tuple(s) for s in r.spans], list(r.gaps), list(r.tags))


def test_located(spark):
    rng = random.Random(23)
    words = ["Alpha", "béta", "γάμμα", "ﬁne", "x²", "ﬄ", "word-", "of", "THE", "…", "№5", "ſharp", "longerword", "日本"]
    sentences, items, want = [], [], {}
    for doc in range(60):
        own, mine, index = [], [], 0
        for position in range(rng.randrange(1, 14)):
            text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 9])))
            if own and rng.random() < 0.2:
                text = rng.choice(own)[1] or ""
            own.append((position, text))
            parts = [text[k : k + 25] for k in range(0, len(text), 25)]
            if rng.random() < 0.2 and len(parts) > 1:
                parts.insert(1, "Note put in")
            if rng.random() < 0.1:
                parts = []
            for part in parts:
                index += rng.choice([1, 2])
                mine.append((index // 8, index, part))
        sentences += [(doc, p, t or None) for p, t in own]
        items += [(doc, *i) for i in mine]
        want |= {(doc, w[0]): w for w in plain(mine, own)}
    rng.shuffle(items)
    rng.shuffle(sentences)
    got = keysearch.located(spark.createDataFrame(sentences, "doc long, position long, text string"), spark.createDataFrame(items, "doc long, page long, index long, text string"), "doc").collect()
    assert len(got) == len(want)
    for r in got:
        assert shaped(r) == want[r.doc, r.position]
    assert {w[1] for w in want.values()} == {"unique", "unique_short", "repeated_by_order", "segmented", "manual"}


def test_given(spark, sf):
    rows = structures.key_places(spark, sf).groupBy("how").count().collect()
    assert {r.how for r in rows} == {"unique", "unique_short", "repeated_by_order", "segmented", "manual"}


def test_each_character_is_decomposed_once(monkeypatch):
    text = "Ǆ ½ ﬁ aé-① İ" * 50
    expected, seen, plainly = keys(text), [], unicodedata.normalize
    monkeypatch.setattr(unicodedata, "normalize", lambda form, c: seen.append(c) or plainly(form, c))
    stream = keysearch.Stream([(1, 1, text), (1, 2, text)])
    assert stream.text == "".join(k for k, _ in expected) * 2
    assert stream.places_of(0) == [at for _, at in expected]
    assert len(seen) <= len(set(text))
