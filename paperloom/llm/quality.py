"""Quality rules whose thresholds follow the corpus.

Each text is measured in numpy over whole Arrow batches. The ratios of the texts that the base
rules pass go into quantile sketches, one for each language and source: counts of logarithmic
buckets, so that any quantile is known to a quarter of a per cent and two sketches merge by adding counts.
From a sketch, of the ratio's logarithm, come the median and the widths of the quarters beside it.
A ratio is out of bounds further than REACH widths from the median, on the upper side, or for
TWO_SIDED ones on either; a bucket's width is added, as a sketch knows no better. All of this is estimated; ratios of counts are (count + 1) / (all + EXTRA),
which vary even where nothing is counted, so that no least width has to be fixed.

Estimates from few documents are drawn to the next wider sketch's, as if PRIOR documents more had
had those: the source's median and widths to the language's, the language's widths to the corpus's.
What is usual in TWO_SIDED ratios differs between languages altogether, so there, the fewer documents
a language has, the further bounds reach, by the factor 1 + PRIOR / documents: nothing is known of a
language that hardly occurs, so next to nothing is out of its bounds. The bounds, one row for each
language and source, are joined to the documents.

Defined results: null and empty texts have no words and fail the base rule; null languages and
sources are groups of their own; repeated rows are each measured and judged; a ratio on its bound is
within it; where no document passes the base rules there are no bounds; other columns may have any
names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import stored
from .text import INK, Hasher, Texts, Words, chained, mixed, sliced

#: Relative width of a sketch's buckets.
GAMMA = 1.005
#: Base rule: words of a document.
LEAST_WORDS = 50
#: Documents that a wider sketch counts for.
PRIOR = 200
REACH = 7.0
#: Words, or lines, that are added to what counts are divided by.
EXTRA = {"n_words": 50, "n_lines": 8}
RATIOS = {"symbols": ("n_symbols", "n_words"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words")}
#: Ratios that can also be too small.
TWO_SIDED = ["word_length"]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def measures(texts: Texts) -> list[np.ndarray]:
    """MEASURES of each text. n_lines: lines with a word."""
    data, offsets = texts.data, texts.offsets

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    words = Words(texts, INK)
    hashed = Hasher(data)
    ink = INK[data]
    chars = per_text(ink & ((data & 0xC0) != 0x80))
    symbols = per_text(_SYMBOLS[data])

    newline = data == 10
    after = np.flatnonzero(newline) + 1
    start = np.sort(np.concatenate((offsets[:-1], after)))  # a text's last line may be empty
    text = np.repeat(np.arange(texts.rows), per_text(newline) + 1)
    end = np.append(start[1:], len(data))
    end = np.where(np.append(text[1:] == text[:-1], False), end - 1, offsets[text + 1])
    inked = np.concatenate(([0], np.cumsum(ink)))
    full = inked[end] > inked[start]
    text, start, end = text[full], start[full], end[full]
    lines = np.bincount(text, minlength=texts.rows)
    key = mixed(hashed(start, end) + text.astype(np.uint64) * _ODD)
    order = np.argsort(key)
    again = key[order][1:] == key[order][:-1]
    dup_lines = np.bincount(text[order[1:][again]], minlength=texts.rows)

    in_text = words.text
    triple = chained(hashed(words.start, words.end), 3)
    inside = in_text[: len(triple)] == in_text[2:] if len(triple) else np.zeros(0, bool)
    place = np.flatnonzero(inside)
    key = mixed(triple[place] + in_text[place].astype(np.uint64) * _ODD)
    order = np.argsort(key)
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(place), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[place[twice] + k] = True
    repeats = np.diff(np.concatenate(([0], np.cumsum(covered)))[words.first])
    return [words.counts, chars, symbols, lines, dup_lines, repeats]


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every document and its MEASURES, long."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, keep, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *(pa.array(x.astype(np.int64)) for x in measures(texts))], names=[*names, *MEASURES])

    source = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"))
    return source.mapInArrow(run, f"{fields}{', ' * bool(keep)}{', '.join(f'{m} long' for m in MEASURES)}").toDF(*keep, *MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """Logarithms of the ratios."""
    found = {k: F.log((F.col(n) + 1) / (F.col(of) + EXTRA[of])) for k, (n, of) in RATIOS.items()}
    return found | {"word_length": F.log(F.greatest("word_chars", F.lit(1)) / F.greatest("n_words", F.lit(1)))}


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, ratio, bucket, n: the quantile sketch of each ratio."""
    values = F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k in ratios())), F.array(*ratios().values()))).alias("ratio", "value")
    return (
        rows.where(~base_failed())
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), values)
        .groupBy("lang", "source", "ratio", F.ceil(F.col("value") / math.log(GAMMA)).cast("int").alias("bucket"))
        .agg(F.count("*").alias("n"))
    )


def _quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, ratio, n_docs, mid, up and down - logarithms of the median, and of how far the quartiles are from it - of sketches merged by `by`."""
    merged = sketch.groupBy(*by, "ratio", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "ratio")
    upto = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("bucket") * math.log(GAMMA) + math.log(2 / (GAMMA + 1))
    ranked = merged.select(*by, "ratio", value.alias("value"), F.sum("n").over(upto).alias("upto"), F.sum("n").over(whole).alias("n_docs"))
    q25, q50, q75 = (F.min(F.when(F.col("upto") >= q * F.col("n_docs"), F.col("value"))) for q in (0.25, 0.5, 0.75))
    return ranked.groupBy(*by, "ratio").agg(F.max("n_docs").alias("n_docs"), q50.alias("mid"), (q75 - q50).alias("up"), (q50 - q25).alias("down"))


def bounds(sketch: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """lang, source, and <ratio>_low and <ratio>_high, logarithms, written and read again."""
    sketch = stored(sketch)
    levels = [_quartiles(sketch, by) for by in (["lang", "source"], ["lang"], [])]
    joined = (
        levels[0].alias("a")
        .join(levels[1].alias("b"), F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.ratio") == F.col("b.ratio")))
        .join(levels[2].alias("c"), F.col("a.ratio") == F.col("c.ratio"))
    )

    def drawn(level: str, own: Column, wider: Column) -> Column:
        n = F.col(f"{level}.n_docs")
        return (n * own + prior * wider) / (n + prior)

    mid = drawn("a", F.col("a.mid"), F.col("b.mid"))
    up, down = (drawn("a", F.col(f"a.{x}"), drawn("b", F.col(f"b.{x}"), F.col(f"c.{x}"))) for x in ("up", "down"))
    reach_ = reach * F.when(F.col("a.ratio").isin(TWO_SIDED), 1 + prior / F.col("b.n_docs")).otherwise(1.0)
    limits = joined.select(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("a.ratio").alias("ratio"), (mid - reach_ * down - math.log(GAMMA)).alias("low"), (mid + reach_ * up + math.log(GAMMA)).alias("high"))
    sides = [(r, s) for r in RATIOS for s in (["low", "high"] if r in TWO_SIDED else ["high"])]
    return stored(limits.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == r, F.col(s))).alias(f"{r}_{s}") for r, s in sides)))


def judged(rows: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """The measured rows with base_failed and kept."""
    limits = limits.toDF("limit_lang", "limit_source", *(f"limit_{c}" for c in limits.columns[2:]))
    values = ratios()
    out = F.lit(False)
    for r in RATIOS:
        out = out | F.coalesce(values[r] > F.col(f"limit_{r}_high"), F.lit(False))
        if r in TWO_SIDED:
            out = out | F.coalesce(values[r] < F.col(f"limit_{r}_low"), F.lit(False))
    joined = rows.join(limits, F.col(lang).eqNullSafe(F.col("limit_lang")) & F.col(source).eqNullSafe(F.col("limit_source")), "left")
    return joined.select(*rows.columns, base_failed().alias("base_failed"), (~base_failed() & ~out).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    rows = stored(measured(docs, ["doc_id", "lang", "source"]))
    return judged(rows, bounds(sketches(rows))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lang", "source")


def clean(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that are kept, with the columns they came with."""
    inner = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    docs = docs.toDF(*inner.values())
    text, lang, source = inner[text], inner[lang], inner[source]
    limits = bounds(sketches(measured(docs, [lang, source], text), lang, source))
    return judged(measured(docs, list(inner.values()), text), limits, lang, source).where("kept").select(*(F.col(n).alias(c) for c, n in inner.items()))
