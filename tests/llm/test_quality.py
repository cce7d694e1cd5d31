import math
import random
import re
from collections import Counter, defaultdict

from paperloom.llm import quality


def measures(text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    triples = Counter(zip(words, words[1:], words[2:]))
    hit = [0] * len(words)
    for k in range(len(words) - 2):
        if triples[tuple(words[k : k + 3])] > 1:
            hit[k : k + 3] = [1] * 3
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), lines, dup, sum(hit)


def ratios(m):
    """Logarithms."""
    n, chars, symbols, lines, dup, repeats = m
    return {"symbols": math.log((symbols + 1) / (n + 50)), "repeats": math.log((repeats + 1) / (n + 50)), "word_length": math.log(max(chars, 1) / max(n, 1)), "dup_lines": math.log((dup + 1) / (lines + 8))}


def failed(m):
    return m[0] < 50 or 100 * m[5] > 50 * m[0]


def limits(rows, prior):
    """low and high of each (lang, source, ratio) of (lang, source, measures) rows, with the same buckets, from plain lists."""
    values = defaultdict(list)
    for lang, source, m in rows:
        if not failed(m):
            for r, v in ratios(m).items():
                b = math.ceil(v / math.log(quality.GAMMA))
                for key in ((lang, source, r), (lang, r), (r,)):
                    values[key].append(b * math.log(quality.GAMMA) + math.log(2 / (quality.GAMMA + 1)))

    def quartiles(*key):
        xs = sorted(values[key])
        q = [xs[math.ceil(p * len(xs)) - 1] for p in (0.25, 0.5, 0.75)]
        return len(xs), q[1], q[2] - q[1], q[1] - q[0]

    out = {}
    for lang, source, r in [k for k in values if len(k) == 3]:
        (n, mid, up, down), (n_lang, mid_lang, up_lang, down_lang), (_, _, up_all, down_all) = quartiles(lang, source, r), quartiles(lang, r), quartiles(r)
        up_lang, down_lang = ((n_lang * x + prior * y) / (n_lang + prior) for x, y in ((up_lang, up_all), (down_lang, down_all)))
        mid, up, down = ((n * x + prior * y) / (n + prior) for x, y in ((mid, mid_lang), (up, up_lang), (down, down_lang)))
        reach = quality.REACH * (1 + prior / n_lang if r == "word_length" else 1)
        out[lang, source, r] = (mid - reach * down - math.log(quality.GAMMA) if r == "word_length" else -math.inf, mid + reach * up + math.log(quality.GAMMA))
    return out


def verdicts(rows, prior=quality.PRIOR):
    """Measures and kept of (lang, source, text) rows."""
    ms = [measures(t) for _, _, t in rows]
    known = limits([(lang, source, m) for (lang, source, _), m in zip(rows, ms)], prior)
    return ms, [not failed(m) and all(known[lang, source, r][0] <= v <= known[lang, source, r][1] for r, v in ratios(m).items()) for (lang, source, _), m in zip(rows, ms)]


TEXTS = [None, "", " \n\t", "one", "a b c a b c", "x\nx\n\nx \ny", "é# ü$ 北京 |\x00 <>\n", "w " * 60, " ".join(map(str, range(70))), "\n".join(f"line {k % 7} of the text {k}" for k in range(40))]


def test_measures(spark):
    rows = [(i, t, None, "s", "q") for i, t in enumerate(TEXTS)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string")
    got = sorted((r.doc_id, *(r[m] for m in quality.MEASURES)) for r in quality.measured(docs, ["doc_id"]).collect())
    assert got == sorted((i, *measures(t)) for i, t, *_ in rows)
    assert quality.report(docs).count() == len(rows)
    kept = quality.clean(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == [8]


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.report(docs).count() == 0
    assert quality.clean(docs).count() == 0


def test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    ms, kept = verdicts([(r.lang, r.source, r.text) for r in rows])
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for r, m, k in zip(rows, ms, kept):
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == (*m[:3], *m[4:])
        assert (g.base_failed, g.kept) == (failed(m), k)


def words(n, k, length):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.choice((length - 1, length, length + 1)))) for _ in range(n))


def test_adaptive(spark):
    """Each language and source has bounds of its own; what is usual in one goes in another; a rare language isn't judged by the others."""
    rows = [("aa", "plain", words(60 + k % 90, k + 1, 4)) for k in range(600)]
    rows += [("aa", "marked", words(60 + k % 90, k + 1, 4) + " # $" * (12 + k % 9)) for k in range(600)]
    rows += [("bb", "plain", words(60 + k % 90, k + 1, 14 + k % 3)) for k in range(5)]
    odd = [("aa", "plain", words(100, 7, 4) + " # $" * 14), ("aa", "marked", words(100, 7, 4) + " # $" * 14), ("aa", "plain", words(100, 7, 15)), ("bb", "plain", words(100, 7, 15))]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(odd + rows)], "doc_id long, lang string, source string, text string")
    kept = [r.kept for r in sorted(quality.report(docs).collect(), key=lambda r: r.doc_id)]
    assert kept == verdicts(odd + rows)[1] and kept[:4] == [False, True, False, True] and sum(kept[4:]) > 0.99 * len(rows)


def test_own_sketches(spark):
    """On the given tables the bounds differ between languages and sources, and the spread is each sketch's own."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = quality.stored(quality.measured(docs, ["doc_id", "lang", "source"]))
    found = quality.bounds(quality.sketches(rows)).collect()
    for c in ("symbols_high", "repeats_high", "word_length_high", "word_length_low"):
        values = {(r.lang, r.source): round(r[c], 6) for r in found if r.lang == "en"}
        assert len(set(values.values())) > 0.8 * len(values)
        assert max(values.values()) - min(values.values()) > 0.03
    own = rows.where(~quality.base_failed()).groupBy("lang", "source").count().where(f"count >= {quality.PRIOR}").count()
    assert own >= 15  # sources whose own sketch weighs more than the language's


def test_long(spark):
    docs = spark.createDataFrame([(1, "aa", "s", words(400_000, 3, 4)), (2, "aa", "s", "# " * 500_000), (3, "aa", None, "x" * 3_000_000)], "doc_id long, lang string, source string, text string")
    got = {r.doc_id: (r.n_words, r.n_symbols, r.word_chars) for r in quality.report(docs).collect()}
    assert got[1][0] == 400_000 and got[2] == (500_000, 500_000, 500_000) and got[3] == (1, 0, 3_000_000)


def test_labels(spark):
    """Documents of good quality stay; the others mostly go."""
    sf = "/root/testdata/sf0.01"
    rows = quality.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = ([r.kept for r in rows if r.quality == q] for q in (1, 0))
    assert all(good)
    assert sum(bad) < 0.1 * len(bad)
