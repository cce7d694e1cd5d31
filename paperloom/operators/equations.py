"""Formulas among the text items of a sentence: signals of each unit, runs, trimming, kinds, and their places in the sentence's text.

A sentence is a row with an array of units, the stretches of items that it covers. The units of many sentences lie side by side in Arrow batches, where
numpy goes over all of them at once, in slices; signals are told once for each different text of a slice.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fonts of mathematics and italics, and what kinds of text count as what.
MATH_FONT = (
    r"(?i)^(CM(MI|SY|EX|BSY|MIB)|MSAM|MSBM|rsfs|eu(fm|fb|rm|sm|ex)|LMMath|CambriaMath|STIX\w*Math|XITSMath|LatinModernMath|(tx|px)(sy|mi|ex)|wasy|stmary|dsrom|bbm|AsanaMath|TeXGyre\w*Math|Symbol$)"
)
ITALIC_FONT = r"(?i)Ital|Oblique|Slanted|-It$|(^|\+|-)TI\d{4}|(^|-)It(\b|\d)"
SUBSET_PREFIX = r"^[A-Z]{6}\+"
MATH_SYMBOL = r"[\p{Sm}\p{IsGreek}]"
GLUE = r"^[\s\d(),.;:|=+\-−*/^_'′″<>\[\]{}·]{0,3}$"
MATH_WORD = r"(?i)^(log|ln|exp|max|min|arg|argmax|argmin|sin|cos|tan|softmax|lim|sup|inf|det|tr|dim)$"
SENTENCE_PUNCTUATION, DIGITS, CLOSED = r"^[.,;:]+$", r"^[\d.,]+$", (")", "]", "}")
SCRIPT_HEIGHT, SCRIPT_BASELINE, BODY_HEIGHT, LINE_HEIGHT = 0.85, 0.08, 0.95, 1.5
#: Units that are gone over at once, but for a longer sentence, which is taken whole.
SLICE = 1 << 18
DETECTED, UNCERTAIN, NOT_IN_TEXT, FRAGMENTED = "detected", "math_uncertain", "not_in_sentence_text", "glyph_fragmented_sentence"
SKIPS = ["single_variable", "single_symbol", "no_letter", "text_script"]

FOUND = "struct<en: string, equations: array<struct<token: string, raw: string, status: string, warning: string, font: int, symbol: int, script: int, weak: int, items: array<struct<page: bigint, index: bigint>>>>, skipped: array<struct<kind: string, raw: string>>, warnings: array<string>>"
UNITS = "array<struct<text: string, page: bigint, index: bigint, eol: boolean, height: double, baseline: double, font: string>>"


def span_units(spans: DataFrame, items: DataFrame, fonts: DataFrame, document: str) -> DataFrame:
    """spans with text, eol, height, baseline and font: the stretch of the item that each names, and the item's font by its real name, null where it isn't known. Spans of unknown items are left out. Of items with the same place, or fonts of the same name, the greatest counts.

    spans: document, page, index, start, end; items: document, page, index, text, eol, height, baseline, font_name; fonts: document, font_name, font.
    """
    keys = [document, "page", "index"]
    asked = [c for c in spans.columns if c not in keys]
    own = items.select(*keys, F.struct("text", "eol", "height", "baseline").alias("own"), "font_name")
    rows = own.unionByName(spans.select(*keys, F.struct(*asked).alias("span")), True).unionByName(fonts.select(document, "font_name", "font"), True)
    # one shuffle, by document, serves both windows, and whoever groups by document and more
    font = F.when(F.col("font_name").isNotNull(), F.max("font").over(Window.partitionBy(document, "font_name")))
    rows = rows.repartition(document).withColumn("font", font).where("own is not null or span is not null")
    item = F.max(F.when(F.col("own").isNotNull(), F.struct("own", "font"))).over(Window.partitionBy(*keys))
    rows = rows.select(*keys, "span", item.alias("item")).where("span is not null and item is not null").select(*keys, "span.*", "item.own.*", "item.font")
    text = F.substring("text", F.col("start") + 1, F.greatest(F.col("end") - F.col("start"), F.lit(0)))
    return rows.select(*spans.columns, text.alias("text"), "eol", "height", "baseline", "font")


def gathered(units: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys and the units of each sentence in order, as detected() takes them; a sentence bounds each array."""
    fields = ("text", "page", "index", "eol", "height", "baseline", "font")
    listed = F.array_sort(F.collect_list(F.struct(*order, F.struct(*fields).alias("unit"))))
    return units.groupBy(*keys).agg(F.transform(listed, lambda u: u["unit"]).cast(UNITS).alias("units"))


def _pattern(java: str) -> re.Pattern:
    """The pattern as Spark reads it: classes and case of ASCII, boundaries of words of all letters."""
    return re.compile(java.replace(r"\b", r"(?u:\b)"), re.ASCII)


# ends are told by fullmatch(), or, in names of fonts, by a $ that also stands before other line ends than Python's
_MATH_FONT, _ITALIC_FONT = (_pattern(p.replace("$", r"(?=(?:\r\n|(?<!\r)\n|[\r\x85\u2028\u2029])?\Z)")) for p in (MATH_FONT, ITALIC_FONT))
_PREFIX, _GLUE, _MATH_WORD, _PUNCTUATION, _DIGITS = (_pattern(p.removesuffix("$")) for p in (SUBSET_PREFIX, GLUE, MATH_WORD, SENTENCE_PUNCTUATION, DIGITS))
_SYMBOL, _WORD = (regex.compile(p) for p in (MATH_SYMBOL.replace("IsGreek", "Greek"), r"\p{L}{3,}"))
_DROPPED, _SPACE = "\u00ad\u200b\u200c\u200d\ufeff", T.SPACES
_GAP = f"[{_SPACE}{_DROPPED}]"
# a hyphen at the end of a line, behind a letter and before a small one
_BREAK, _HYPHEN = re.compile("[\n\r\u2028\u2029]"), regex.compile(rf"(?<=\p{{L}})([{_DROPPED}]*)[-\u2010\u00ad](?={_GAP}*[\n\r\u2028\u2029]){_GAP}+(?=\p{{Ll}})")
_SPACES = re.compile(f"(?![{_DROPPED}])[{_SPACE}]{_GAP}*")
#: Characters that normalising and plain() leave alone, in texts without two spaces in a row.
_EVEN = re.compile("[\x20-\x7e\u00c0-\u024f\u0370-\u052f\u3041-\ud7a3]*")
_INK, _LIGATURES, _DROP = str.maketrans("", "", _SPACE), str.maketrans(T.LIGATURES), str.maketrans("", "", _DROPPED)
_SIGNS = str.maketrans({**dict.fromkeys("‐‑‒–—−\u00ad", "-"), **dict.fromkeys("\u00b7\u2022\u2219\u22c5", "·")})


def _even(text: str) -> bool:
    return _EVEN.fullmatch(text) is not None and "  " not in text


def normalized(text: str) -> str:
    """As T.normalized(): many normalised texts are needed here at once with their units."""
    if _even(text):
        return text
    out = text.translate(_LIGATURES)
    return _SPACES.sub(" ", _HYPHEN.sub(r"\1", out) if _BREAK.search(text) else out).translate(_DROP)


def plain(text: str) -> str:
    """Normalised, with dashes and dots as one each. It has no other white space than single spaces."""
    return text if _even(text) else normalized(text).translate(_SIGNS)


#: What is told of a unit's text: characters, letters, words of three letters, other characters than white space, brackets opened less those closed, and flags.
_TOLD = ("size", "letters", "words", "ink", "open", "symbol", "glue", "free", "closing", "digits", "lettered")


def _told(text: str | None) -> tuple[int, ...]:
    if text is None:
        return 0, 0, 2, 0, 0, 0, 0, 0, 0, 0, 0  # neither begins a run nor continues one
    t = text.strip(T.SPACES)
    size = len(t)
    if t.isalpha():
        return size, size, size > 2, size, 0, size < 3 and _SYMBOL.search(t) is not None, _MATH_WORD.fullmatch(t) is not None, 0, 0, 0, 1
    body = t.removesuffix("\x85")  # the only line end left, before which Spark's $ also stands
    letters = sum(map(str.isalpha, t))
    ink = size if " " not in t and t.isprintable() else len(t.translate(_INK))
    opened = t.count("(") + t.count("[") + t.count("{") - t.count(")") - t.count("]") - t.count("}")
    if letters:
        words = int(letters > 2) if t[:letters].isalpha() else len(_WORD.findall(t))
        return size, letters, words, ink, opened, not words and _SYMBOL.search(t) is not None, body.isalpha() and _MATH_WORD.fullmatch(body) is not None, 0, body[-1:] in CLOSED, 0, body.isalpha()
    return size, 0, 0, ink, opened, _SYMBOL.search(t) is not None, _GLUE.fullmatch(body) is not None, not t or _PUNCTUATION.fullmatch(body) is not None, body[-1:] in CLOSED, _DIGITS.fullmatch(body) is not None, 0


def _sums(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place."""
    return np.concatenate([[0], np.cumsum(values, dtype=np.int64)])


def body_heights(sentence: np.ndarray, height: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """For each of n sentences the height, in tenths, that most characters have, the larger of two; 0 without any."""
    own = np.flatnonzero((height > 0) & (size > 0))
    tenths, code = np.unique(np.floor(height[own] * 10 + 0.5), return_inverse=True)
    groups, of = np.unique(sentence[own] * max(len(tenths), 1) + code, return_inverse=True)
    weight = np.bincount(of, size[own], len(groups))
    at, code = np.divmod(groups, max(len(tenths), 1))
    order = np.lexsort((code, weight, at))
    body = np.zeros(n)
    body[at[order]] = tenths[code[order]] / 10  # the last of a sentence stays
    return body


def _nearest(small: np.ndarray, way: int, u: dict[str, np.ndarray]) -> np.ndarray:
    """The baseline of the unit of the text's height that is nearest to each of the small units, if nothing of another line is before it; NaN without. way: -1 or 1."""
    base, left, at = np.full(len(small), np.nan), np.arange(len(small)), small
    while len(left):
        at = at + way
        inside = (at >= u["first"][small[left]]) & (at < u["behind"][small[left]])
        left, at = left[inside], at[inside]
        own = small[left]
        off, known = np.abs(u["baseline"][at] - u["baseline"][own]), u["paged"][at] & u["paged"][own]
        same, most = u["page"][at] == u["page"][own], u["body"][own] * LINE_HEIGHT
        found = known & same & (off < most) & u["tall"][at]
        base[left[found]] = u["baseline"][at[found]]
        on = ~(found | known & ~same | (off >= most))
        left, at = left[on], at[on]
    return base


def runs(begins: np.ndarray, glue: np.ndarray, first: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First units, and those behind the last, of the stretches that begin with a unit that may and go on with such and with glue."""
    on, place = begins | glue, np.arange(len(begins))
    start = np.flatnonzero(on & ((place == first) | ~np.concatenate([[False], on[:-1]])))
    end = np.flatnonzero(on & ((place + 1 == behind) | ~np.concatenate([on[1:], [False]]))) + 1
    able = np.concatenate([np.flatnonzero(begins), [len(begins)]])
    low = able[np.searchsorted(able, start)]
    return low[low < end], end[low < end]


def without_trailing_glue(low: np.ndarray, high: np.ndarray, u: dict[str, np.ndarray]) -> np.ndarray:
    """Where runs end without punctuation, blanks and glue, but for brackets that close what the run opened, and numbers behind a symbol."""
    high, opened = high.copy(), _sums(u["open"])
    before = np.concatenate([[-1], np.maximum.accumulate(np.where(u["size"] > 0, np.arange(len(u["size"])), -1))])
    sign = u["symbol"] | u["math"] | u["script"]
    left = np.arange(len(low))
    while len(left):
        last, begin = high[left] - 1, low[left]
        behind = before[last]
        bound = np.where(u["closing"][last], opened[last] > opened[begin], u["digits"][last] & (behind >= begin) & sign[behind])
        stays = ~u["free"][last] & (~u["glue"][last] | bound)
        left = left[~stays]
        high[left] -= 1
        left = left[high[left] > low[left]]
    return high


def placed(text: str | None, raws: list[str]) -> tuple[str | None, list[bool | None]]:
    """The normalised text with tokens in the places of the formulas, each sought behind the one before, without white space and with dashes and dots as one each; and which were found."""
    if text is None:
        return None, [None] * len(raws)
    norm = normalized(text)
    own = plain(norm)
    flat, places = own.replace(" ", ""), np.flatnonzero(np.frombuffer(own.encode("utf-32-le"), np.uint32) != 32)
    out, hits, cursor, upto = [], [], 0, 0
    for k, raw in enumerate(raws, 1):
        sought = plain(raw).replace(" ", "")
        at = flat.find(sought, cursor) if sought else -1
        hits.append(at >= 0)
        if at >= 0:
            cursor = at + len(sought)
            out += [norm[upto : int(places[at])], f"[EQ_{k}]"]
            upto = int(places[cursor - 1]) + 1
    return "".join([*out, norm[upto:]]), hits


def _strings(kinds: list[str | None], which: np.ndarray) -> pa.Array:
    return pa.array(kinds, pa.string()).take(pa.array(which))


def _listed(values: pa.Array, counts: np.ndarray, missing: pa.Array | None = None) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(_sums(counts).astype(np.int32)), values, mask=missing)


def _slice(text: pa.Array, units: pa.ListArray) -> pa.StructArray:
    n, counts = len(units), pc.list_value_length(units).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    value, page, index, eol, height, baseline, font = units.flatten().flatten()
    ends, sentence = _sums(counts), np.repeat(np.arange(n), counts)
    values, fonts = value.dictionary_encode("encode"), font.dictionary_encode("encode")
    words, code = values.dictionary.to_pylist(), values.indices.to_numpy(zero_copy_only=False)
    told = np.array([_told(w) for w in words], np.int32).reshape(-1, len(_TOLD))
    u = {name: told[:, k][code] for k, name in enumerate(_TOLD)}
    u |= {name: u[name] > 0 for name in _TOLD[5:]}
    names = [_PREFIX.sub("", f or "", count=1) for f in fonts.dictionary.to_pylist()]
    of = fonts.indices.to_numpy(zero_copy_only=False)
    u["math"], italic = (np.array([p.search(f) is not None for f in names], bool)[of] for p in (_MATH_FONT, _ITALIC_FONT))
    number = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False)
    u["page"], u["paged"], number_of, numbered = number(page), page.is_valid().to_numpy(zero_copy_only=False), number(index), index.is_valid().to_numpy(zero_copy_only=False)
    height, u["baseline"] = (a.to_numpy(zero_copy_only=False).astype(float) for a in (height, baseline))
    u["first"], u["behind"] = ends[:-1][sentence], ends[1:][sentence]

    # set off from the text's baseline in smaller letters; glue is neither that nor set in a font of mathematics
    u["body"] = body_heights(sentence, height, u["size"], n)[sentence]
    full = u["size"] > 0
    u["tall"] = full & (height >= u["body"] * BODY_HEIGHT)
    small = np.flatnonzero((u["body"] > 0) & full & (height > 0) & (height <= u["body"] * SCRIPT_HEIGHT))
    base = _nearest(small, -1, u)
    lost = np.isnan(base)
    base[lost] = _nearest(small[lost], 1, u)
    u["script"] = np.zeros(len(full), bool)
    u["script"][small] = np.abs(u["baseline"][small] - base) >= u["body"][small] * SCRIPT_BASELINE
    u["glue"] &= ~u["script"] & ~u["math"]

    # whether single letters are most of the sentence, as where every letter is an item
    glyph, total = (u["size"] == 1) & (u["letters"] > 0), lambda x: np.diff(_sums(x)[ends])
    single = glyph & ~u["glue"]
    broken = (total(single) >= 4) & (2 * total(u["letters"] * single) > total(u["letters"] * ~u["glue"]))
    prose = u["words"] >= 2
    strong = ~prose & (u["math"] | u["symbol"] | u["script"])
    weak = ~prose & ~u["glue"] & ~broken[sentence] & (glyph | italic & (u["size"] <= 2) & (u["letters"] > 0))
    low, high = runs(strong | weak, u["glue"], u["first"], u["behind"])
    high = without_trailing_glue(low, high, u)

    def within(x: np.ndarray) -> np.ndarray:
        sums = _sums(x)
        return sums[high] - sums[low]

    enough = (within(strong) > 0) | (within(weak) >= 2)
    low, high = low[enough], high[enough]
    of_font, symbol, script, rest = (within(x).astype(np.int32) for x in (strong & u["math"], strong & u["symbol"], strong & u["script"], ~strong & weak))
    word = ~u["math"] & np.where(u["lettered"], u["size"] >= 2, u["digits"])
    ink, letter = within(u["ink"]), within(u["letters"]) > 0
    worded = (script > 0) & (of_font == 0) & (symbol == 0) & (within(~u["glue"] & ~word) == 0)
    skip = np.select([worded, (ink == 1) & letter, ink == 1, ~letter], [SKIPS.index(k) for k in ("text_script", "single_variable", "single_symbol", "no_letter")], -1)

    # a space where a line or page ends, or items are left out
    ended = eol.fill_null(False).to_numpy(zero_copy_only=False)[:-1] | u["paged"][:-1] & u["paged"][1:] & (u["page"][:-1] != u["page"][1:]) | numbered[:-1] & numbered[1:] & (number_of[:-1] + 1 != number_of[1:])
    parted = np.concatenate([[False], ended])[: len(full)]
    raws = []
    for a, b in zip(low.tolist(), high.tolist(), strict=True):
        raw = words[code[a]]
        for k in range(a + 1, b):
            raw += " " + words[code[k]] if parted[k] else words[code[k]]
        raws.append(raw.strip(T.SPACES))

    taken, owner = skip < 0, sentence[low]
    equations, skips = np.bincount(owner[taken], minlength=n), np.bincount(owner[~taken], minlength=n)
    own = [r for r, t in zip(raws, taken.tolist(), strict=True) if t]
    texts, hits, upto = [], [], _sums(equations).tolist()
    for k, t in enumerate(text.to_pylist()):
        en, found = placed(t, own[upto[k] : upto[k + 1]]) if t is None or upto[k] < upto[k + 1] else (normalized(t), [])
        texts.append(en)
        hits += found
    missing = units.is_null()
    hit = np.array([h is True for h in hits], bool)
    sure = hit & ((np.sum([x[taken] > 0 for x in (of_font, symbol, script)], axis=0) >= 2) | (of_font[taken] >= 2))
    nth = np.arange(len(own)) - np.repeat(_sums(equations)[:-1], equations) + 1
    sizes = (high - low)[taken]
    items = pa.array(np.arange(sizes.sum()) - np.repeat(_sums(sizes)[:-1], sizes) + np.repeat(low[taken], sizes))
    fields = {
        "token": pa.array([f"[EQ_{k}]" for k in nth.tolist()], pa.string()), "raw": pa.array(own, pa.string()), "status": _strings([UNCERTAIN, DETECTED], sure.astype(int)), "warning": _strings([None, NOT_IN_TEXT], np.array([h is False for h in hits], int)),
        **{name: pa.array(x[taken]) for name, x in (("font", of_font), ("symbol", symbol), ("script", script), ("weak", rest))}, "items": _listed(pa.StructArray.from_arrays([page.take(items), index.take(items)], ["page", "index"]), sizes),
    }
    left_out = {"kind": _strings(SKIPS, skip[~taken]), "raw": pa.array([r for r, t in zip(raws, taken.tolist(), strict=True) if not t], pa.string())}
    out = {
        "en": pc.if_else(missing, pa.scalar(None, pa.string()), pa.array(texts, pa.string())), "equations": _listed(pa.StructArray.from_arrays(list(fields.values()), list(fields)), equations, missing),
        "skipped": _listed(pa.StructArray.from_arrays(list(left_out.values()), list(left_out)), skips, missing), "warnings": _listed(pa.array([FRAGMENTED] * int(broken.sum()), pa.string()), broken.astype(int)),
    }
    return pa.StructArray.from_arrays(list(out.values()), list(out))


def formulas(text: Column, units: Column) -> Column:
    """FOUND of the text of each sentence and its units."""

    @F.arrow_udf(FOUND)
    def run(text: pa.Array, units: pa.Array) -> pa.Array:
        ends = np.cumsum(pc.list_value_length(units).fill_null(0).to_numpy(zero_copy_only=False))
        parts, at = [], 0
        while at < len(units):
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            parts.append(_slice(text.slice(at, upto - at), units.slice(at, upto - at)))
            at = upto
        return pa.concat_arrays(parts) if parts else _slice(text, units)

    return run(text, units)


def detected(sentences: DataFrame, text: str = "text", units: str = "units") -> DataFrame:
    """The sentences with en, the normalised text with [EQ_n] for each formula found in it, equations (token, raw, status, warning, signals, items), skipped and warnings. units: of type UNITS, in order."""
    return sentences.withColumn("_found", formulas(F.col(text), F.col(units))).select(*sentences.columns, "_found.*")


def statistics(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys and how many sentences, equations, uncertain ones and skipped candidates of each kind there are. found: detected()."""
    of = lambda column, test: F.sum(F.size(F.filter(column, test)))
    skipped = lambda kind: of("skipped", lambda x: x["kind"] == kind).alias(kind)
    return found.groupBy(*keys).agg(
        F.count("*").alias("sentences"), F.count_if(F.size("equations") > 0).alias("with_equations"), F.sum(F.size("equations")).alias("equations"), of("equations", lambda x: x["status"] == DETECTED).alias("detected"),
        of("equations", lambda x: x["status"] == UNCERTAIN).alias("uncertain"), of("equations", lambda x: x["warning"] == NOT_IN_TEXT).alias("not_in_text"), *map(skipped, SKIPS),
    )
