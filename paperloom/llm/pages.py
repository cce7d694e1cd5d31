"""Main text of web pages by deduced templates.

Every page becomes a sequence of tokens: the paths of its elements and the texts of its blocks. For
each host, tokens that occur equally often on every page - with the same occurrence vector - form an
equivalence class. Vectors are compared by their support and by sums of hashes of (page, count),
which Spark adds up without gathering a host's pages anywhere. A class of two tokens or more that
occurs on nearly all pages of a host, in one order on all of them, is valid. On a page, valid
classes are nested into each other's gaps, from the most frequent down; one that doesn't fit into a
gap is dropped. Blocks whose text belongs to the nested template are the site's; the others fill
its slots.

The article's slot is the template's: of the containers that stand once on a page, in a valid class,
the innermost within which more than half of the host's text stands, links aside. Two such can't lie
beside each other, so it is the one with the least text. On pages that have it, what lies outside
is left out, whatever its elements are called. Within it, and on pages whose host has no such
container, elements and names decide: navigation, headers, footers, asides, forms, notices, adverts
and comments are left out, and where a page marks its article, so is what is outside it. The column
`decided` says which way it was.

Pages are read in time linear in their length, however deeply their elements nest: paths are hashes.

Defined results: null html, and pages without a block, have the empty text; pages without a host or
with too few siblings have no template; repeated rows are each extracted and count as pages; a quote
that a tag opens and the page never closes ends nothing: from there on tags end at the next `>`;
other columns may have any names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import stored

#: A template needs so many pages of a host, and a class this share of them.
PAGES = 4
SHARE = 0.8
#: Bytes of templates that are broadcast; more are joined by host.
BROADCAST_BYTES = 32 << 20

# Elements by what they mean for the main text.
HIDDEN = {"script", "style", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "head", "title", "textarea", "select", "option", "button"}
NO_ARTICLE = {"nav", "footer", "aside", "form", "menu", "dialog", "fieldset"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody",
    "td", "tfoot", "th", "thead", "tr", "ul",
}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words in an element's class, id or role that tell that it is no article.
NAMES = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager", "pagination",
    "popup", "promo", "promotion", "related", "recommended", "replies", "respond", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
#: An element that opens ends these, if nothing of the second set stands between.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

#: Blocks of text: no containers of an article.
TEXT_BLOCKS = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "blockquote", "figcaption", "summary", "hr", "address", "caption"}

_COMMENT = r"<!--.*?(?:-->|\Z)"
_QUOTED = r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def _pattern(inside: str) -> re.Pattern:
    """Comments, scripts with their contents, tags - `inside` is what stands between name and `>` - and texts."""
    return re.compile(
        rf"{_COMMENT}|<(?P<raw>script|style)\b{inside}>.*?(?:</(?P=raw)\b[^>]*+(?:>|\Z)|\Z)"
        rf"|<(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>{inside})>|<[!?/][^>]*+(?:>|\Z)|(?P<text>[^<]++|<)",
        re.S | re.I,
    )


_TOKEN, _PLAIN = _pattern(_QUOTED), _pattern("[^>]*+")
_NAMING = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[^A-Za-z]+|(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


class Block(NamedTuple):
    text: str
    path: int
    outside: bool  # in a region that is no article
    article: bool
    within: bool  # in the template's container, and in no region of it that is no article


class Token(NamedTuple):
    """A path, as a hash, or a path with the text of a block. container: whether it is an element that can hold an article; text: characters of the blocks within it, links aside."""

    hash: int
    container: bool
    text: int


class _Open(NamedTuple):
    name: str
    path: int
    token: int
    hidden: bool
    outside: bool
    article: bool
    link: bool
    within: bool
    apart: bool  # outside, as seen from the template's container


class _Tag(NamedTuple):
    """What an opening tag says: the element's label in a path, and whether it is void, an article, no article, and no article outside of one."""

    label: str
    void: bool
    article: bool
    none: bool
    header: bool
    container: bool


def _tag(name: str, rest: str) -> _Tag:
    named = " ".join(x[1] or x[2] or x[3] for x in _NAMING.findall(rest)) if "=" in rest else ""
    article = name in ("article", "main") or "role" in rest and re.search(r"\brole\s*=\s*[\"']?main\b", rest) is not None
    words = {x.lower() for x in _SPLIT.split(named)} if named and name not in ("html", "body", "main", "article") else set()
    return _Tag(f"{name}.{named}", name in EMPTY or rest.endswith("/"), article, name in NO_ARTICLE or bool(words & NAMES), name == "header" or "header" in words, name in BLOCKS and name not in TEXT_BLOCKS)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def hashed(label: str, path: int = 0) -> int:
    return _signed(xxhash.xxh64_intdigest(label, path & ((1 << 64) - 1)))


def _tags(page: str) -> Iterator[re.Match]:
    """The matches of _TOKEN; from a tag on whose quotes don't close, those of _PLAIN."""
    for m in _TOKEN.finditer(page):
        if m["text"] == "<" and page[m.end() : m.end() + 1].isalpha():
            if page.find(">", m.end()) >= 0:
                yield from _PLAIN.finditer(page, m.start())
                return
            yield from _PLAIN.finditer(page, m.start(), m.end())
            rest = page[m.end() :].split("<")  # no tag ends any more
            yield from (x for k, part in enumerate(rest) for x in _PLAIN.finditer("<" * (k > 0) + part))
            return
        yield m


class _Stack:
    """The open elements, and where each name's stand."""

    def __init__(self, root: _Open):
        self.open, self.where, self.blocks = [root], {}, []

    def push(self, x: _Open) -> None:
        self.where.setdefault(x.name, []).append(len(self.open))
        if x.name in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append(x)

    def close(self, at: int) -> None:
        while len(self.open) > at:
            x = self.open.pop()
            self.where[x.name].pop()
            if x.name in BLOCKS:
                self.blocks.pop()

    def last(self, names: set[str]) -> int:
        """Where the innermost element with one of the names stands; 0 if none does."""
        return max((self.where[n][-1] for n in names if self.where.get(n)), default=0)

    def ended(self, name: str) -> None:
        """Closes what an opening element ends."""
        if name in ENDS:
            ends, within = ENDS[name]
            if (at := self.last(ends)) > self.last(within):
                self.close(at)
        elif name in BLOCKS and self.blocks and self.open[self.blocks[-1]].name == "p":
            self.close(self.blocks[-1])


def parsed(page: str, container: int | None = None) -> tuple[list[Block], list[Token]]:
    """The blocks of a page, and all its tokens in order. container: the path of the template's."""
    stack = _Stack(_Open("", 0, -1, False, False, False, False, False, False))
    blocks: list[Block] = []
    tokens: list[tuple[int, bool]] = []
    gained: list[int] = []
    up_of: list[int] = []
    known: dict[str, _Tag] = {}
    words: list[str] = []
    at = stack.open[0]

    def flush() -> None:
        nonlocal words
        if words:
            text = _SPACE.sub(" ", "".join(words)).strip()
            words = []
            if text:
                blocks.append(Block(text, at.path, at.outside, at.article, at.within and not at.apart))
                tokens.append((hashed(f"\0{text}", at.path), False))
                gained.append(0)
                up_of.append(-1)
                if at.token >= 0 and not at.link:
                    gained[at.token] += len(text)

    for m in _tags(page):
        if m["text"] is not None:
            if not stack.open[-1].hidden:
                if not words:
                    at = stack.open[-1]
                words.append(entities.unescape(m["text"]) if "&" in m["text"] else m["text"])
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            words.append(" ")
            continue
        if m["end"]:
            if stack.where.get(name):
                stack.close(stack.where[name][-1])
            continue
        stack.ended(name)
        up = stack.open[-1]
        tag = known.get(m[0])
        if tag is None:
            tag = known[m[0]] = _tag(name, m["rest"])
        path = hashed(tag.label, up.path)
        gained.append(0)
        if tag.void:
            tokens.append((path, False))
            up_of.append(-1)
            continue
        none = tag.none or tag.header and not up.article
        within = up.within or path == container
        tokens.append((path, tag.container))
        up_of.append(up.token)
        stack.push(_Open(name, path, len(tokens) - 1, up.hidden or name in HIDDEN, up.outside or none, up.article or tag.article, up.link or name == "a", within, up.apart or up.within and none))
    flush()
    for k in range(len(tokens) - 1, -1, -1):  # an element stands behind those around it
        if up_of[k] >= 0:
            gained[up_of[k]] += gained[k]
    return blocks, [Token(h, c, n) for (h, c), n in zip(tokens, gained, strict=True)]


def nested(sequence: list[tuple[int, int]], support: dict[int, int]) -> set[int]:
    """Of the classes of template tokens, given as (place, class) in order, those that nest: each lies in one gap of every class placed before it."""
    places: dict[int, list[int]] = {}
    for place, c in sequence:
        places.setdefault(c, []).append(place)
    kept: dict[int, np.ndarray] = {}
    for c in sorted(places, key=lambda c: (-support[c], -len(places[c]), places[c][0])):
        own = places[c]
        gaps = (np.searchsorted(other, (own[0], own[-1])) for other in kept.values())
        if all(a == b or a == 0 and b == len(other) for (a, b), other in zip(gaps, kept.values(), strict=True)):
            kept[c] = np.array(own)
    return set(kept)


class Template:
    """A host's: class and support of its tokens, by hash, and the article's container, or None."""

    def __init__(self, tokens: dict[int, tuple[int, int]], container: int | None = None):
        self.tokens, self.container = tokens, container


NO_TEMPLATE = Template({})


def main_text(page: str | None, template: Template = NO_TEMPLATE) -> tuple[str, str]:
    """The text, and what decided on it: template, names, or none where there are no blocks."""
    if not page:
        return "", "none"
    blocks, tokens = parsed(page, template.container)
    fixed: set[int] = set()
    if template.tokens:
        known = [(k, t.hash, template.tokens[t.hash]) for k, t in enumerate(tokens) if t.hash in template.tokens]
        valid = nested([(k, c) for k, _, (c, _) in known], {c: n for _, _, (c, n) in known})
        fixed = {t for _, t, (c, _) in known if c in valid}
    slots = [b for b in blocks if hashed(f"\0{b.text}", b.path) not in fixed] if fixed else blocks
    if template.container in fixed:
        return "\n".join(b.text for b in slots if b.within), "template"
    slots = [b for b in slots if not b.outside]
    if any(b.article for b in blocks if not b.outside):
        slots = [b for b in slots if b.article]
    return "\n".join(b.text for b in slots), "names" if blocks else "none"


def tokens_of(pages: DataFrame) -> DataFrame:
    """host, page, token, n, at - the first place -, container and chars of every token of a page with a host. pages: host, html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                size, token, n, at, container, chars = [], [], [], [], [], []
                for h in part["html"]:
                    found = parsed(h.as_py() or "")[1]
                    count = Counter(t.hash for t in found)
                    first = {t.hash: (k, t) for k, t in reversed(list(enumerate(found)))}
                    size.append(len(count))
                    token += count.keys()
                    n += count.values()
                    at += (first[t][0] for t in count)
                    container += (first[t][1].container for t in count)
                    chars += (first[t][1].text for t in count)
                row = pa.array(np.repeat(np.arange(part.num_rows), size))
                yield pa.RecordBatch.from_arrays(
                    [part["host"].take(row), part["page"].take(row), pa.array(token, pa.int64()), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(container, pa.bool_()), pa.array(chars, pa.int32())],
                    names=["host", "page", "token", "n", "at", "container", "chars"],
                )

    source = pages.where("host is not null and html is not null").select("host", F.monotonically_increasing_id().alias("page"), "html")
    return source.mapInArrow(run, "host string, page long, token long, n int, at int, container boolean, chars int")


def templates(pages: DataFrame) -> DataFrame:
    """host, template array<struct<token, class, support>>, container long or null. pages: host, html."""
    # page numbers hold for one run of a job only, so what they are compared in is written down
    rows = stored(tokens_of(pages))
    top = rows.where("at = 0").groupBy("host").agg(F.count("*").alias("n_pages"), F.sum("chars").alias("all_chars"))
    sites = top.where(F.col("n_pages") >= PAGES)
    vector = F.xxhash64("page", "n")
    low, high = F.sum(vector.bitwiseAND(0x7FFFFFFF)), F.sum(F.shiftrightunsigned(vector, 33))
    by_token = rows.groupBy("host", "token").agg(F.count("*").alias("support"), F.sum("n").alias("times"), F.bool_or("container").alias("container"), F.sum("chars").alias("chars"), low.alias("low"), high.alias("high"))
    by_token = by_token.where(F.col("support") >= PAGES)
    frequent = by_token.join(sites.drop("all_chars"), "host").where(F.col("support") >= SHARE * F.col("n_pages")).select("host", "token", "support", F.when(F.col("container") & (F.col("times") == F.col("support")), F.col("chars")).alias("chars"), F.xxhash64("support", "low", "high").alias("class"))
    frequent = stored(frequent)
    large = frequent.groupBy("host", "class").agg(F.count("*").alias("size")).where("size > 1").drop("size")
    frequent = frequent.join(large, ["host", "class"])
    order = F.xxhash64(F.transform(F.sort_array(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]))
    ordered = rows.join(frequent, ["host", "token"]).groupBy("host", "class", "page").agg(order.alias("order")).groupBy("host", "class").agg((F.min("order") == F.max("order")).alias("one")).where("one").drop("one")
    valid = frequent.join(ordered, ["host", "class"])
    # the text of all a host's pages stands in what stands once on them: the most that one of its elements has
    whole = valid.groupBy("host").agg(F.max("chars").alias("whole"))
    most = F.min(F.when(2 * F.col("chars") > F.col("whole"), F.struct("chars", "token")))
    return valid.join(whole, "host").groupBy("host").agg(F.collect_list(F.struct("token", "class", "support")).alias("template"), most["token"].alias("container"))


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def extracted(pages: DataFrame, keep: list[str], url: str = "url", html: str = "html") -> DataFrame:
    """Columns `keep` of every page, its main text, and what decided on it."""
    names = [f"c{i}" for i in range(len(keep))]
    fields = "".join(f"{n} {pages.schema[c].dataType.simpleString()}, " for n, c in zip(names, keep, strict=True))
    source = pages.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    known = stored(templates(source.select("host", "html")))
    size = known.agg(F.sum(24 * F.size("template") + F.octet_length("host") + 64)).first()[0] or 0
    joined = source.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left").select(*names, "host", "html", "template", "container")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Template] = {}
        for batch in batches:
            texts, decided = [], []
            for k, (host, h) in enumerate(zip(batch["host"].to_pylist(), batch["html"], strict=True)):
                template = NO_TEMPLATE if host is None else held.get(host)
                if template is None:
                    t = batch["template"][k].as_py() or ()
                    template = Template({x["token"]: (x["class"], x["support"]) for x in t}, batch["container"][k].as_py())
                    if len(held) >= 64:
                        held.clear()
                    held[host] = template
                text, by = main_text(h.as_py(), template)
                texts.append(text)
                decided.append(by)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array(decided, pa.string())], names=[*names, "text", "decided"])

    return joined.mapInArrow(run, f"{fields}text string, decided string").toDF(*keep, "text", "decided")


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, decided of every page."""
    return extracted(pages, ["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "decided")
