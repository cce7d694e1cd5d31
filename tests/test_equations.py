"""Formulas of sentences against a plain version that goes unit by unit."""

import random
import time
import zlib

import pyarrow as pa
import regex
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import equations as eq
from paperloom.plans import structures

PUNCT, CLOSING, DIGITS = regex.compile(r"[.,;:]+"), ")]}", regex.compile(r"[\d.,]+")
MATH = {"CMMI10", "ABCDEF+CMMI10", "ABCDEF+CMSY7"}
ITALIC = {"Times-Italic"}


def fold(text):
    """Characters without white space, and their places; dashes and dots as one each. The texts here are normalised already."""
    kept = [(c, i) for i, c in enumerate(text) if not c.isspace()]
    return "".join("-" if c in "‐‑‒–—−" else "·" if c in "•∙⋅" else c for c, _ in kept), [i for _, i in kept]


def plain(text, units):
    us = []
    for t, page, index, eol, height, base, font in units:
        own = t.strip()
        words = len(regex.findall(r"\p{L}{3,}", own))
        us.append({
            "t": own, "raw": t, "page": page, "index": index, "eol": eol, "h": height, "b": base, "math": font in MATH, "italic": font in ITALIC, "symbol": not words and bool(regex.search(r"[\p{Sm}\p{Greek}]", own)),
            "glyph": len(own) == 1 and own.isalpha(), "prose": words >= 2, "glue": bool(regex.fullmatch(eq.GLUE[1:-1], own)) or own.lower() in ("log", "max", "arg"), "script": False, "letters": len(regex.findall(r"\p{L}", own)),
        })
    weights = {}
    for u in us:
        if u["h"] > 0 and u["t"]:
            weights[u["h"]] = weights.get(u["h"], 0) + len(u["t"])
    body = max(weights, key=lambda h: (weights[h], h)) if weights else 0
    for i, u in enumerate(us):
        if not u["t"] or body <= 0 or not 0 < u["h"] <= body * 0.85:
            continue
        ref = None
        for side in (us[:i][::-1], us[i + 1 :]):
            for x in side if ref is None else ():
                if x["page"] != u["page"] or abs(x["b"] - u["b"]) >= body * 1.5:
                    break
                if x["h"] >= body * 0.95 and x["t"]:
                    ref = x
                    break
        u["script"] = ref is not None and abs(u["b"] - ref["b"]) >= body * 0.08
    for u in us:
        u["glue"] = u["glue"] and not u["script"] and not u["math"]
    prose = [u for u in us if not u["glue"]]
    glyphs = [u for u in prose if u["glyph"]]
    broken = len(glyphs) >= 4 and sum(u["letters"] for u in glyphs) * 2 > sum(u["letters"] for u in prose)
    for u in us:
        u["strong"] = not u["prose"] and (u["math"] or u["symbol"] or u["script"])
        u["weak"] = not u["prose"] and not u["glue"] and not broken and (u["glyph"] or u["italic"] and len(u["t"]) <= 2 and u["letters"] > 0)
    runs, run = [], []
    for u in [*us, None]:
        if u and (u["strong"] or u["weak"] or run and u["glue"]):
            run.append(u)
        elif run:
            runs.append(run)
            run = []
    found, skipped, out, cursor, upto = [], [], "", 0, 0
    flat, places = fold(text)
    for run in runs:
        while run:
            last, rest = run[-1], run[:-1]
            if not PUNCT.fullmatch(last["t"]) and last["t"]:
                if not last["glue"]:
                    break
                if last["t"][-1] in CLOSING:
                    if sum((c in "([{") - (c in ")]}") for u in rest for c in u["t"]) > 0:
                        break
                elif DIGITS.fullmatch(last["t"]):
                    before = [u for u in rest if u["t"]]
                    if before and (before[-1]["symbol"] or before[-1]["math"] or before[-1]["script"]):
                        break
            run = rest
        strong, weak = [u for u in run if u["strong"]], [u for u in run if not u["strong"] and u["weak"]]
        if not strong and len(weak) < 2:
            continue
        raw, prev = "", None
        for u in run:
            raw += (" " if prev and (prev["eol"] or prev["page"] != u["page"] or u["index"] != prev["index"] + 1) else "") + u["raw"]
            prev = u
        raw = raw.strip()
        compact = "".join(raw.split())
        n = [sum(u[k] for u in strong) for k in ("math", "symbol", "script")]
        content = [u for u in run if not u["glue"]]
        letter = bool(regex.search(r"\p{L}", compact))
        if n[2] and not n[0] and not n[1] and all(not u["math"] and (len(u["t"]) >= 2 if regex.fullmatch(r"\p{L}+", u["t"]) else DIGITS.fullmatch(u["t"])) for u in content):
            skipped.append(("text_script", raw))
        elif len(compact) == 1:
            skipped.append(("single_variable" if letter else "single_symbol", raw))
        elif not letter:
            skipped.append(("no_letter", raw))
        else:
            token, key = f"[EQ_{len(found) + 1}]", fold(raw)[0]
            at = flat.find(key, cursor)
            if at >= 0:
                out, upto, cursor = out + text[upto : places[at]] + token, places[at + len(key) - 1] + 1, at + len(key)
            sure = at >= 0 and (sum(x > 0 for x in n) >= 2 or n[0] >= 2)
            found.append((token, raw, "detected" if sure else "math_uncertain", None if at >= 0 else "not_in_sentence_text", *n, len(weak), [(u["page"], u["index"]) for u in run]))
    return out + text[upto:], found, skipped, ["glyph_fragmented_sentence"] if broken else []


def sentence(rng):
    units, index = [], 0
    for _ in range(rng.randrange(1, 16)):
        index += rng.choice([1, 1, 1, 2])
        t = rng.choice(["word", "two words here", "x", "y", "α", "θ", "=", "+", "∼", "−", "(", ")", "[", "]", ",", ".", "100", "2.5", "log", "of", "BERT", "", " ", "|", "≤", "K·V", "a–b", "max"])
        small = rng.random() < 0.2
        units.append((t + rng.choice(["", " "]), rng.choice([0, 0, 0, 0, 1]), index, rng.random() < 0.1, 6.5 if small else rng.choice([10.0, 10.0, 9.8]), rng.choice([97.0, 100.0, 40.0]) if small else 100.0, rng.choice(["CMMI10", "ABCDEF+CMSY7", "Times-Italic", None, "Times", "Times"])))
    text = " ".join(t.strip() for t, *_ in units if t.strip())
    if rng.random() < 0.3:
        text = text.replace("−", "-").replace("α", "a", 1)
    return text, units


def shaped(r):
    return r.en, [(*tuple(e)[:8], [tuple(i) for i in e["items"]]) for e in r.equations], [tuple(s) for s in r.skipped], list(r.warnings)


def test_sentences(spark):
    rng = random.Random(17)
    rows = [(k, *sentence(rng)) for k in range(500)] + [(500, "", [])]
    got = eq.detected(spark.createDataFrame(rows, f"k int, text string, units {eq.UNITS}")).cache()
    want = {k: plain(t, u) for k, t, u in rows}
    for r in got.collect():
        assert shaped(r) == want[r.k], (rows[r.k], shaped(r), want[r.k])
    assert {e[2] for w in want.values() for e in w[1]} == {"detected", "math_uncertain"} and {e[3] for w in want.values() for e in w[1]} == {None, "not_in_sentence_text"}
    assert {s[0] for w in want.values() for s in w[2]} == set(eq.SKIPS) and any(w[3] for w in want.values())
    s = eq.statistics(got.withColumn("g", F.lit(1)), ["g"]).first()
    flat, skips = [e for w in want.values() for e in w[1]], [x for w in want.values() for x in w[2]]
    assert tuple(s) == (1, 501, sum(bool(w[1]) for w in want.values()), len(flat), *(sum(e[2] == x for e in flat) for x in ("detected", "math_uncertain")), sum(e[3] is not None for e in flat), *(sum(x[0] == k for x in skips) for k in eq.SKIPS))


def test_given(spark, sf):
    rows = structures._unit_lines(spark, sf).where("length(text) < 300")
    units = {(r.doc_id, r.pos): (r.text, [tuple(u) for u in r.units]) for r in rows.collect()}
    got = eq.detected(rows).collect()
    assert len(got) == len(units) > 300
    for r in got:
        assert shaped(r) == plain(*units[r.doc_id, r.pos])


def test_statistics_of_a_long_sentence(spark):
    """A sentence of many units is looked through once, not once for each unit."""
    unit = "struct(if(i % 9 = 0, 'α', 'word') AS text, 1L AS page, i AS index, false AS eol, if(i % 7 = 0, 6.5d, 10d) AS height, if(i % 7 = 0, 97d, 100d) AS baseline, 'Times' AS font)"
    rows = spark.range(1).selectExpr("'all' AS k", "array_join(transform(sequence(0L, 14999L), i -> if(i % 9 = 0, 'α', 'word')), ' ') AS text", f"transform(sequence(0L, 14999L), i -> {unit}) AS units")
    rows = rows.withColumn("units", F.col("units").cast(eq.UNITS))
    before = time.monotonic()
    (found,) = eq.statistics(eq.detected(rows), ["k"]).collect()
    assert time.monotonic() - before < 20
    assert found["sentences"] == 1 and found["equations"] + sum(found[k] for k in eq.SKIPS) > 1000


def test_units_of_lines():
    """Words as units, by a checksum of each; blanks are none, and every tenth place is left out."""
    lines = ["", "  a  bé ", " ".join(f"w{k}" for k in range(40)), "中 a"]
    got = structures._word_units(pa.array(lines), pa.array([0, 9, 10, 123], pa.int32())).to_pylist()
    for line, pos, units in zip(lines, (0, 9, 10, 123), got, strict=True):
        words = [w for w in line.split(" ") if w]
        sums = [zlib.crc32(w.encode()) for w in words]
        assert [u["text"] for u in units] == [w + " " * (h % 3 == 0) for w, h in zip(words, sums, strict=True)]
        assert [(u["page"], u["index"], u["eol"]) for u in units] == [(pos // 10, i + i // 9, False) for i in range(len(words))]
        assert [u["height"] for u in units] == [6.5 if h % 7 == 0 else 10.0 for h in sums] and [u["baseline"] for u in units] == [97.0 if h % 14 == 0 else 100.0 for h in sums]
        assert [u["font"] for u in units] == ["ABCDEF+CMMI10" if h % 13 == 0 else "Times-Italic" if h % 17 == 0 else "Times" for h in sums]


def test_many_sentences_are_gone_over_at_once(spark):
    """One task goes over 400,000 units in seconds, and finds in each sentence what it finds in one."""
    word = "element_at(array('α', 'f(x)', 'word', 'of', 'a–b', '=', 'other words', '2.5', 'x'), cast(1 + (id + i) % 9 AS int))"
    unit = f"struct({word} AS text, 1L AS page, i AS index, false AS eol, if((id + i) % 7 = 0, 6.5d, 10d) AS height, if(i % 7 = 0, 97d, 100d) AS baseline, if(i % 13 = 0, 'CMMI10', 'Times') AS font)"
    rows = spark.range(0, 10_000, 1, 1).selectExpr("id", "sequence(0L, 39L) AS n").selectExpr("id", f"array_join(transform(n, i -> {word}), ' ') AS text", f"transform(n, i -> {unit}) AS units")
    rows = rows.cache()
    assert rows.count() == 10_000
    few = {r.id % 63: shaped(r) for r in eq.detected(rows.where("id < 63")).collect()}
    before = time.monotonic()
    many = eq.statistics(eq.detected(rows).withColumn("g", F.col("id") % 63), ["g"]).collect()
    assert time.monotonic() - before < 10
    for r in many:
        _, found, skipped, _ = few[r.g]
        assert (r.equations, sum(r[k] for k in eq.SKIPS)) == (r.sentences * len(found), r.sentences * len(skipped))


def test_normalized(spark):
    """Texts are normalised as by the built-in expressions, by a row and by a batch."""
    rng = random.Random(5)
    parts = ["word", "co-", "\u2010", "-\n", "\n", "\r", "\u2028", "  ", "\t", "\x85", "\x1c", "\u00a0", "\u00ad", "\u200b", "\ufeff", "\u3000", "ﬁ", "ﬃ", "é", "B", "b", "–", "−", "·", "•", "中"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.normalized("text").alias("norm")).collect()
    assert [eq.normalized(r.text) for r in rows] == [r.norm for r in rows]
    assert eq.plain("co-\nop  ﬁ–ne •") == "coop fi-ne ·"


def test_span_units(spark):
    """One shuffle; spans of unknown items are left out, fonts that aren't known or have no name are null."""
    items = spark.createDataFrame([("a", 0, 0, "word", False, 1.0, 2.0, "f0"), ("a", 0, 1, "x", True, 1.0, 2.0, "f1"), ("b", 0, 0, "other", None, 3.0, 2.0, None), ("b", 1, 0, "é😀z", False, 3.0, 2.0, "f0")], "doc string, page long, index long, text string, eol boolean, height double, baseline double, font_name string")
    fonts = spark.createDataFrame([("a", "f0", "CMMI10"), ("b", None, "Times"), ("c", "f1", "Times")], "doc string, font_name string, font string")
    spans = spark.createDataFrame([(1, "a", 0, 0, 1, 3), (1, "a", 0, 0, 3, 1), (2, "a", 0, 1, 0, 9), (2, "a", 0, 2, 0, 9), (3, "b", 0, 0, 0, 2), (3, "b", 1, 0, 1, 2), (4, "c", 0, 0, 0, 1)], "k int, doc string, page long, index long, start int, end int")
    found = eq.span_units(spans, items, fonts, "doc")
    assert found.columns == [*spans.columns, "text", "eol", "height", "baseline", "font"]
    got = sorted((r.k, r.start, r.text, r.eol, r.height, r.font) for r in found.collect())
    assert got == [(1, 1, "or", False, 1.0, "CMMI10"), (1, 3, "", False, 1.0, "CMMI10"), (2, 0, "x", True, 1.0, None), (3, 0, "ot", None, 3.0, None), (3, 1, "😀", False, 3.0, None)]
    gathered = eq.gathered(found, ["doc", "k"], ["page", "index"])
    assert gathered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert [(r.k, len(r.units)) for r in gathered.orderBy("k").collect()] == [(1, 2), (2, 1), (3, 2)]
