"""Personal data, and words that give it away.

Emails, IP addresses, card and phone numbers are found by pattern; strings of high entropy, such as
keys and tokens, are secrets. Protected are the kinds themselves, each single value, and the names in
an email's local part. For every word of a document that holds a protected entity, the corpus tells
how much it reveals: of the information that naming the entity carries, -log p(entity), it discloses
the share pmi(word, entity) / -log p(entity). For p(entity | word) the lower end of its confidence
interval is taken, so that chance doesn't tell, nor do words that few documents have. Words of the share
GENERALISE or more are replaced by their kind, from REMOVE on they are taken out, wherever they stand,
also in documents without the entity.

Co-occurrence is counted over whole documents, for entities that SUPPORT documents hold or more: pairs
of entity and word add up within tasks, a bounded number at a time, and before the shuffle, then the documents of only those words that are in SUPPORT such pairs or more are
counted. The telling words are broadcast in blocks of bounded size, each with a pass of its own over
the texts; texts are only mapped.

Defined results: null and empty texts have no spans; repeated rows are each reported and count as
documents of their own; words within a base span or secret aren't marked; other columns may have any
names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import small_side, stored
from .text import LETTERS, Hasher, Texts, Words, sliced

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 3
GENERALISE = 0.8
REMOVE = 0.95
#: Standard errors that the lower end of the interval is away from the estimate.
SURE = 3.0
#: Letters of a term, in bytes, at least.
TERM = 3
#: Words of which documents are counted by a broadcast list, and telling words in one broadcast.
LISTED = 4_000_000
#: Distinct pairs that a task holds before it hands them on.
HELD = 1_000_000
#: Bits for each character of a secret, and the share of its letters and of its digits, at least.
ENTROPY, MIX = 3.0, 0.15

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9+_])[A-Za-z0-9+_]{20,}+={0,2}")
_NAME = re.compile(r"[a-z]{3,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @, the run of allowed characters before it, back to the last match at most, and the domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[Span]:
    """In the order of KINDS, then of start; code points."""
    found = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 13 <= len(digits := re.sub(r"[^0-9]", "", m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return found


def entity(text: str, span: Span) -> str:
    """The same for the same thing written otherwise."""
    value = text[span[1] : span[2]]
    return f"{span[0]}:{value.lower() if span[0] in ('email', 'ip') else re.sub(r'[^0-9]', '', value)}"


def secrets(text: str, taken: list[Span]) -> list[Span]:
    """Strings of high entropy, outside the spans taken."""
    found = []
    for m in _SECRET.finditer(text):
        n = Counter(m[0])
        digits, letters = (sum(v for c, v in n.items() if f(c)) for f in (str.isdigit, str.isalpha))
        if min(digits, letters) >= MIX * len(m[0]) and -sum(v * math.log2(v / len(m[0])) for v in n.values()) >= ENTROPY * len(m[0]):
            if not any(s < m.end() and m.start() < e for _, s, e in taken):
                found.append(("secret", *m.span()))
    return found


def entities(text: str, spans: list[Span]) -> set[str]:
    """What the spans protect: kinds, values, and the names of emails."""
    out = {s[0] for s in spans} | {entity(text, s) for s in spans}
    for kind, start, end in spans:
        if kind == "email":
            out |= {f"name:{x}" for x in _NAME.findall(text[start:end].split("@")[0].lower())}
    return out


def code(name: str) -> int:
    h = xxhash.xxh64_intdigest(name)
    return h - (1 << 64) if h >> 63 else h


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _with_digit_or_at(texts: Texts) -> np.ndarray:
    flags = ((texts.data >= 48) & (texts.data <= 57)) | (texts.data == 64)
    return np.flatnonzero(np.diff(np.concatenate(([0], np.cumsum(flags)))[texts.offsets]))


class Marked:
    """The spans of some texts - by row, those that have some - and their terms: hash, text, start and end in code points. Terms are words of letters, outside the spans."""

    def __init__(self, texts: Texts, column: pa.Array):
        self.spans: dict[int, list[Span]] = {}
        self.values: dict[int, str] = {}
        for k in _with_digit_or_at(texts).tolist():
            t = column[k].as_py()
            if spans := base_spans(t):
                self.spans[k] = spans
            if more := secrets(t, spans):
                self.spans[k] = spans + more
            if k in self.spans:
                self.values[k] = t
        words = Words(texts, LETTERS, lower=True)
        digits = np.concatenate(([0], np.cumsum((words.data >= 48) & (words.data <= 57))))
        use = (words.end - words.start >= TERM) & (digits[words.end] == digits[words.start])
        start, end, of = words.start[use], words.end[use], words.text[use]
        points = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
        first = points[texts.offsets[of]]
        self.start, self.end, self.text = points[start] - first, points[end] - first, of
        self.hash = Hasher(words.data)(start, end).view(np.int64)
        free = np.ones(len(of), bool)
        edge = np.searchsorted(of, np.arange(texts.rows + 1))
        for k, spans in self.spans.items():
            own = slice(edge[k], edge[k + 1])
            for _, s, e in spans:
                free[own] &= (self.end[own] <= s) | (self.start[own] >= e)
        self.hash, self.start, self.end, self.text = (x[free] for x in (self.hash, self.start, self.end, self.text))
        self.edge = np.searchsorted(self.text, np.arange(texts.rows + 1))


def _summed(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Equal (entity, term) added up."""
    a, b, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((b, a))
    a, b, n = a[order], b[order], n[order]
    start = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, np.int64)
    return [a[start], b[start], np.add.reduceat(n, start) if len(n) else n]


def _rows(held: list[list[np.ndarray]], names: list[str]) -> Iterator[pa.RecordBatch]:
    columns = _summed(held)
    for k in range(0, len(columns[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 100_000]) for c in columns], names=names)


def entity_codes(docs: DataFrame, text: str, support: int) -> DataFrame:
    """entity of those that `support` documents or more hold; no pair of another one counts. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["entity", "n"])

        for batch in batches:
            for part, texts in sliced(batch, "text"):
                for k in _with_digit_or_at(texts).tolist():
                    t = part["text"][k].as_py()
                    spans = base_spans(t)
                    held.update(code(e) for e in entities(t, spans + secrets(t, spans)))
                if len(held) > HELD // 4:
                    yield out()
                    held.clear()
        yield out()

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "entity long, n long")
    return stored(found.groupBy("entity").agg(F.sum("n").alias("n")).where(F.col("n") >= support).select("entity"))


def pair_counts(docs: DataFrame, text: str = "text", support: int = SUPPORT, listed: int = LISTED) -> DataFrame:
    """entity, term, n: the documents that hold both, `support` or more; with the term 0, those that hold the entity. Stored.

    Only entities of as many documents are paired, as far as they are few enough to broadcast, and never more than HELD pairs are made at a time, however many
    entities a document holds.
    """
    common = entity_codes(docs, text, support)
    shared = docs.sparkSession.sparkContext.broadcast(np.sort(common.toArrow()["entity"].to_numpy())) if common.count() <= listed else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                m = Marked(texts, part["text"])
                for k, t in m.values.items():
                    known = np.array([code(e) for e in entities(t, m.spans[k])], np.int64)
                    if shared:
                        known = known[_among(known, shared.value)]
                    terms = np.append(np.unique(m.hash[m.edge[k] : m.edge[k + 1]]), 0)
                    step = max(1, HELD // len(terms))
                    for at in range(0, len(known), step):
                        some = known[at : at + step]
                        held.append([np.repeat(some, len(terms)), np.tile(terms, len(some)), np.ones(len(some) * len(terms), np.int64)])
                        size += len(some) * len(terms)
                        if size > HELD:
                            held = [_summed(held)]
                            size = len(held[0][0])
                            if size > HELD // 2:
                                yield from _rows(held, ["entity", "term", "n"])
                                held, size = [], 0
        if held:
            yield from _rows(held, ["entity", "term", "n"])

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "entity long, term long, n long")
    return stored(found.groupBy("entity", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= support))


def document_frequency(docs: DataFrame, terms: DataFrame, text: str = "text", listed: int = LISTED) -> DataFrame:
    """term, df: the documents that hold each of the terms - of all, if these are too many to broadcast; added up in tasks and before the shuffle."""
    wanted = None
    if terms.count() <= listed:
        wanted = docs.sparkSession.sparkContext.broadcast(np.sort(terms.toArrow()["term"].to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                m = Marked(texts, part["text"])
                use = _among(m.hash, wanted.value) if wanted else np.ones(len(m.hash), bool)
                order = np.lexsort((m.hash[use], m.text[use]))
                h, t = m.hash[use][order], m.text[use][order]
                once = np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))[: len(h)]
                key, n = np.unique(h[once], return_counts=True)
                held.append([key, np.zeros(len(key), np.int64), n])
                if sum(len(x[0]) for x in held) > HELD:
                    held = [_summed(held)]
                    if len(held[0][0]) > HELD // 2:
                        yield from _rows(held, ["term", "none", "df"])
                        held = []
        if held:
            yield from _rows(held, ["term", "none", "df"])

    found = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).mapInArrow(run, "term long, none long, df long")
    return found.groupBy("term").agg(F.sum("df").alias("df"))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def disclosures(docs: DataFrame, text: str = "text", support: int = SUPPORT, least: float = GENERALISE, listed: int = LISTED) -> DataFrame:
    """entity, term, share of the pairs with the share `least` or more. Stored."""
    counted = pair_counts(docs, text, support, listed)
    pairs = counted.where("term <> 0")
    holders = counted.where("term = 0").select("entity", F.col("n").alias("n_entity"))
    frequency = document_frequency(docs, stored(pairs.select("term").distinct()), text, listed)
    total = F.lit(float(docs.count()))
    known, z = F.col("n") / F.col("df"), SURE * SURE / F.col("df")
    low = (known + z / 2 - SURE * F.sqrt(known * (1 - known) / F.col("df") + z / F.col("df") / 4)) / (1 + z)
    share = 1 + F.log(low) / F.log(total / F.col("n_entity"))
    joined = pairs.join(small_side(stored(holders), 24), "entity").join(frequency, "term")
    return stored(joined.where((F.col("n_entity") < total) & (low > 0)).select("entity", "term", share.alias("share")).where(F.col("share") >= least))


def _blocks(told: DataFrame, listed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms in order, and whether each is removed; in as many blocks as it takes."""
    terms = told.groupBy("term").agg(F.max("share").alias("share"))
    count = max(1, -(-told.count() // listed))
    for k in range(count):
        found = terms.where(F.pmod(F.xxhash64("term"), F.lit(count)) == k).select("term", (F.col("share") >= REMOVE).alias("remove")).toArrow()
        order = np.argsort(found["term"].to_numpy())
        yield found["term"].to_numpy()[order], found["remove"].to_numpy()[order].astype(bool)


_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("remove", pa.bool_())]))
_SQL_HITS = "array<struct<start: long, end: long, remove: boolean>>"


def found(docs: DataFrame, told: DataFrame, keep: list[str], text: str = "text", listed: int = LISTED) -> DataFrame:
    """Columns `keep` of every document, n_<kind> and n_secrets long, base and secrets string, terms array<struct<start, end, remove>>, sorted, and sanitised string. told: disclosures()."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    sc = docs.sparkSession.sparkContext
    out = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.col(text).alias("text"), F.array().cast(_SQL_HITS).alias("terms"))
    ends = [*KINDS, "secrets"]
    blocks = list(_blocks(told, listed))
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        schema = f"{fields}{', '.join(f'n_{x} long' for x in ends)}, base string, secrets string, terms {_SQL_HITS}, sanitised string" if last else out.schema
        out = out.mapInArrow(_pass(sc.broadcast(block), last, names), schema)
    return out.toDF(*keep, *(f"n_{x}" for x in ends), "base", "secrets", "terms", "sanitised")


def _pass(block, last: bool, names: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, remove = block.value
        for batch in batches:
            for part, texts in sliced(batch, "text"):
                m = Marked(texts, part["text"])
                hits: list[list[dict]] = part["terms"].to_pylist()
                own = np.flatnonzero(_among(m.hash, terms))
                for t, s, e, r in zip(m.text[own].tolist(), m.start[own].tolist(), m.end[own].tolist(), remove[np.searchsorted(terms, m.hash[own])].tolist(), strict=True):
                    hits[t].append({"start": s, "end": e, "remove": r})
                if not last:
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(hits, _HITS)], names=part.schema.names)
                    continue
                counts = np.zeros((len(KINDS) + 1, texts.rows), np.int64)
                base, secret = [""] * texts.rows, [""] * texts.rows
                for k, spans in m.spans.items():
                    for kind, n in Counter(s[0] for s in spans).items():
                        counts[KINDS.index(kind) if kind in KINDS else -1, k] = n
                    base[k], secret[k] = (written([s for s in spans if (s[0] == "secret") == x]) for x in (False, True))
                clean = part["text"].to_pylist()
                for k, h in enumerate(hits):
                    h.sort(key=lambda x: x["start"])
                    if h or k in m.spans:
                        clean[k] = rewritten(clean[k], m.spans.get(k, []), h)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[: len(names)], *(pa.array(c) for c in counts), pa.array(base, pa.string()), pa.array(secret, pa.string()), pa.array(hits, _HITS), pa.array(clean, pa.string())],
                    names=[*names, *(f"n_{x}" for x in KINDS), "n_secrets", "base", "secrets", "terms", "sanitised"],
                )

    return run


def rewritten(text: str, spans: list[Span], terms: list[dict]) -> str:
    """Identifiers and secrets replaced by their kind, telling words too, or taken out."""
    new = [(s, e, f"[{k.upper()}]") for k, s, e in spans]
    new += [(t["start"], t["end"], "" if t["remove"] else "[NAME]" if text[t["start"]].isupper() else "[TERM]") for t in terms]
    out, last = [], 0
    for s, e, x in sorted(new):
        if e > last:  # kinds may overlap
            out += [text[last : max(s, last)], x]
            last = e
    return "".join([*out, text[last:]])


def sanitised(docs: DataFrame, text: str = "text", support: int = SUPPORT) -> DataFrame:
    """The documents, the columns they came with, with personal data replaced by its kind, and telling words replaced or removed."""
    inner = {c: f"d{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*inner.values())
    out = found(plain, disclosures(plain, inner[text], support), [n for c, n in inner.items() if c != text], inner[text])
    return out.select(*(F.col("sanitised" if c == text else n).alias(c) for c, n in inner.items()))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_<kind>, n_secrets, n_terms, n_spans - all of these together -, base_sha256, spans and the sanitised text of every document."""
    rows = found(docs, disclosures(docs), ["doc_id"])
    terms = F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"].cast("string"), t["end"].cast("string")))
    spans = F.array_join(F.filter(F.concat(F.array("base", "secrets"), terms), lambda s: s != ""), ",")
    n_terms = F.size("terms").cast("long")
    return rows.select(
        "doc_id", *(f"n_{k}" for k in KINDS), "n_secrets", n_terms.alias("n_terms"), (sum((F.col(f"n_{k}") for k in KINDS), F.col("n_secrets")) + n_terms).alias("n_spans"),
        F.sha2("base", 256).alias("base_sha256"), spans.alias("spans"), F.col("sanitised").alias("text"),
    )
