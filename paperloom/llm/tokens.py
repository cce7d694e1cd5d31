"""Alignment of two tokenizers by groups: stretches of bytes at whose both ends tokens of both end.

A chunk is a byte range of a text, led by a space. Its tokens, those that end in the range, make a
fragment: an open prefix up to the first common end, closed groups, and an open suffix after the last
common end. Fragments compose: a suffix and the prefix after it are one closed group, and a fragment
without a common end is all open. That is associative, so chunks of a long text are tokenized in tasks
of their own and composed in a tree, `FAN` neighbours at a time; a text of one chunk is closed at once.
Chunks may end within words: both sides tokenize the word on the edge and keep the tokens that end
in their range. Words are cut before a space that follows another character than white space; there no
token of either vocabulary goes on, so a text's tokens are those of its words. A word of more than a
quarter of a chunk isn't divided; it stays with the chunk in which it starts.

Tokens are written down once, as two bytes each; closed parts of long texts have rows of their own.
An elementary stretch between ends of any kind is one link, the pair of tokens over it. Links are
counted over the whole corpus; up to `PAIRS` of the most frequent pairs are broadcast (13 bytes each),
the links of all others are joined by pair, in which no pair is hot any more.

Defined results: texts that are null or empty, and texts that one tokenizer doesn't give back byte by
byte (U+2581 becomes a space), have no tokens: zeros and an empty digest. Repeated rows, and rows
without an id, are documents of their own. Further columns are ignored. An empty table gives no rows.
Ties for the best link of a token all count. A digest of a long text is made in one task, from its parts
in order, of which only one is held at a time.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import stored
from .text import sliced

#: Where the tokenizers' files are, on every machine.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of a chunk.
CHUNK = 1 << 16
#: Fragments that one step of the tree composes.
FAN = 16
#: Pairs of tokens that are broadcast, at most.
PAIRS = 1 << 21
#: File names of the vocabularies, and the pre-tokenizer's pattern that its file names but doesn't spell out.
FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: A pair of ids as one number.
_BASE = 1 << 16

_TOKENS = "row long, part long, doc_id long, a binary, b binary"
_OPEN = "k long, first long, closed boolean, ok boolean, suf_a binary, suf_b binary"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
_RESULT = "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", groups_sha256 string"


class Tokenizers:
    """Both vocabularies: ids of texts, and the bytes of each id."""

    def __init__(self, folder: str):
        import sentencepiece
        import tiktoken

        self._folder = Path(folder)
        model = json.loads((self._folder / FIRST).read_text(encoding="utf-8"))
        special = {t["content"] for t in model["added_tokens"]}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(visible)))}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in special}
        self._a = tiktoken.Encoding("first", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=str(self._folder / SECOND))
        of = self._b
        self.space = tuple(np.array([x], dtype=np.uint16) for x in (ranks[b" "], of.piece_to_id("▁")))
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b_bytes = [bytes([int(of.id_to_piece(i)[3:5], 16)]) if of.is_byte(i) else of.id_to_piece(i).replace("▁", " ").encode() for i in range(of.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in table]) for table in (self.a_bytes, self.b_bytes))
        # ids as digits with the sign after them, zero bytes around: a's end in , or |, b's in , or ;
        self.a_text, self.b_text = (np.array([[f"{i}{sign}".encode() for i in range(len(table))] for sign in "," + last]) for table, last in ((self.a_bytes, "|"), (self.b_bytes, ";")))

    def _first(self, text: str) -> np.ndarray:
        try:
            return self._a.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # its regular expressions give up on very long white space; the other library, three times slower, doesn't
            from tokenizers import Tokenizer

            slow = Tokenizer.from_file(str(self._folder / FIRST))
            slow.encode_special_tokens = True
            return np.array(slow.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of a space and each text by both; None where either doesn't give the bytes back. Texts aren't empty."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, b in zip(texts, self._b.encode(texts, num_threads=1), strict=True):
            raw = b" " + text.encode()
            if b"".join([self.b_bytes[i] for i in b]) != raw:
                out.append(None)
                continue
            a = self._first(raw.decode())
            same = int(self.a_size[a].sum()) == len(raw)
            out.append((a.astype(np.uint16), np.array(b, dtype=np.uint16)) if same else None)
        return out


@lru_cache(maxsize=1)
def tokenizers(folder: str) -> Tokenizers:
    return Tokenizers(folder)


class Aligned:
    """Groups and links of consecutive texts, each of which starts and ends at common ends. a, b: all ids; many: ids of each text."""

    def __init__(self, t: Tokenizers, a: np.ndarray, b: np.ndarray, a_many: np.ndarray, b_many: np.ndarray):
        self.t, self.a, self.b = t, a.astype(np.int64), b.astype(np.int64)
        self.a_edge, self.b_edge = (np.concatenate(([0], np.cumsum(m))).astype(np.int64) for m in (a_many, b_many))
        self.a_end, self.b_end = np.cumsum(t.a_size[self.a]), np.cumsum(t.b_size[self.b])
        size = int(self.a_end[-1]) if len(self.a_end) else 0
        mark = np.zeros(size + 1, np.uint8)
        mark[self.a_end] = 1
        mark[self.b_end] += 2
        self.common = np.flatnonzero(mark == 3)
        ends = np.flatnonzero(mark)
        self.pair = self.a[np.searchsorted(self.a_end, ends)] * _BASE + self.b[np.searchsorted(self.b_end, ends)]
        bytes_edge = np.concatenate(([0], self.a_end))[self.a_edge]
        self.link_edge = np.searchsorted(ends, bytes_edge, side="right")
        self.group_edge = np.searchsorted(self.common, bytes_edge, side="right")

    def counts(self) -> list[np.ndarray]:
        return [np.diff(x) for x in (self.a_edge, self.b_edge, self.group_edge, self.link_edge)]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of each link over each text."""
        return np.diff(np.concatenate(([0], np.cumsum(values)))[self.link_edge])

    def groups(self) -> list[bytes]:
        """`a1,a2|b1;a3|b2,b3;` of each text."""
        before = [np.concatenate(([0], np.searchsorted(x, self.common, side="right"))) for x in (self.a_end, self.b_end)]
        text = np.empty(len(self.a) + len(self.b), dtype="S6")
        a_group, b_group = (np.searchsorted(self.common, x) for x in (self.a_end, self.b_end))
        for ids, end, group, table, at in ((self.a, self.a_end, a_group, self.t.a_text, before[1][a_group]), (self.b, self.b_end, b_group, self.t.b_text, before[0][b_group + 1])):
            text[np.arange(len(ids)) + at] = table[(self.common[group] == end).astype(np.int64), ids]
        edge = self.a_edge + self.b_edge
        return [text[i:j].tobytes().replace(b"\0", b"") for i, j in zip(edge[:-1], edge[1:], strict=True)]


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a binary column as one array, and their number in each row."""
    values = [x.as_buffer() for x in column]
    parts = [np.frombuffer(x, dtype=np.uint16) for x in values if x is not None and len(x)]
    return np.concatenate(parts) if parts else np.zeros(0, np.uint16), np.array([0 if x is None else len(x) // 2 for x in values], dtype=np.int64)


def _batches(batch: pa.RecordBatch, limit: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many ids."""
    size = np.cumsum([len(x.as_buffer()) if x.is_valid else 0 for x in batch["a"]])
    begin = 0
    while begin < batch.num_rows:
        before = size[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _whole(docs: DataFrame, folder: str) -> DataFrame:
    """Tokens of texts of one chunk, a row for each; a and b are null without tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(folder)
        for batch in batches:
            for part, _ in sliced(batch, "text"):
                texts = part["text"].to_pylist()
                at = [i for i, x in enumerate(texts) if x]
                found: list = [None] * len(texts)
                for i, ids in zip(at, t.encode([texts[i] for i in at]), strict=True):
                    found[i] = ids
                yield pa.RecordBatch.from_arrays([part["row"], pa.nulls(len(texts), pa.int64()), part["doc_id"], *(pa.array([x and x[s].tobytes() for x in found], pa.binary()) for s in (0, 1))], names=["row", "part", "doc_id", "a", "b"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, _TOKENS)


def _chunks(docs: DataFrame, chunk: int) -> DataFrame:
    """Pieces of long texts, whole words whose first space is left out: the tokens of chunk k end in (low, high] of its piece. Rows are numbered from -1 down."""
    space = ord(" ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, value in zip(batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"], strict=True):
                raw = b" " + value.as_buffer().to_pybytes()
                data = np.frombuffer(raw, dtype=np.uint8)
                # a space after a visible ASCII character, or the text's end
                cuts = np.concatenate(([0], 1 + np.flatnonzero((data[1:] == space) & (data[:-1] > space) & (data[:-1] < 127)), [len(raw)]))
                edges = [0]
                for wanted in range(chunk, len(raw), chunk):
                    after = int(np.searchsorted(cuts, wanted))
                    if wanted > edges[-1]:
                        edges.append(int(cuts[after]) if cuts[after] - cuts[after - 1] > chunk // 4 else wanted)
                if edges[-1] < len(raw):
                    edges.append(len(raw))
                for k, (low, high) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                    at, to = int(cuts[np.searchsorted(cuts, low, side="right") - 1]), int(cuts[np.searchsorted(cuts, high)])
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc, "k": k, "low": low - at, "high": high - at, "piece": raw[at + 1 : to].decode()}], schema=schema)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("piece", pa.string())])
    return docs.select((-1 - F.monotonically_increasing_id()).alias("row"), "doc_id", "text").mapInArrow(run, "row long, doc_id long, k long, low long, high long, piece string")


_SCHEMA = pa.schema(
    [("row", pa.int64()), ("part", pa.int64()), ("doc_id", pa.int64()), ("a", pa.binary()), ("b", pa.binary()), ("k", pa.int64()), ("first", pa.int64()), ("closed", pa.bool_()), ("ok", pa.bool_()), ("suf_a", pa.binary()), ("suf_b", pa.binary())]
)


def _fragments(chunks: DataFrame, folder: str) -> DataFrame:
    """Rows with a part are closed groups; the others are what is open of chunk k: a, b the prefix, or all if nothing closes. first: the chunk of the first common end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(folder)
        for batch in batches:
            for c in batch.to_pylist():
                # only a text that ends in a space has a piece of nothing else
                found = t.encode([c["piece"]])[0] if c["piece"] else t.space
                own = {"row": c["row"], "doc_id": c["doc_id"]}
                if found is None:
                    yield pa.RecordBatch.from_pylist([own | {"k": c["k"], "first": c["k"], "closed": False, "ok": False, "a": b"", "b": b""}], schema=_SCHEMA)
                    continue
                ends = [np.cumsum(size[ids]) for size, ids in zip((t.a_size, t.b_size), found, strict=True)]
                ids, ends = zip(*((x[k], e[k]) for x, e in zip(found, ends, strict=True) for k in [(e > c["low"]) & (e <= c["high"])]), strict=True)
                common = np.intersect1d(*ends, assume_unique=True)
                if c["k"] == 0:
                    common = np.concatenate(([0], common))
                if not len(common):
                    yield pa.RecordBatch.from_pylist([own | {"k": c["k"], "first": c["k"], "closed": False, "ok": True, "a": ids[0].tobytes(), "b": ids[1].tobytes()}], schema=_SCHEMA)
                    continue
                pre, mid, suf = (
                    [x[f(e)].tobytes() for x, e in zip(ids, ends, strict=True)] for f in (lambda e: e <= common[0], lambda e: (e > common[0]) & (e <= common[-1]), lambda e: e > common[-1])
                )
                rows = [own | {"k": c["k"], "first": c["k"], "closed": True, "ok": True, "a": pre[0], "b": pre[1], "suf_a": suf[0], "suf_b": suf[1]}]
                if mid[0]:
                    rows.append(own | {"part": 2 * c["k"] + 1, "a": mid[0], "b": mid[1], "ok": True})
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    return chunks.repartition("row", "k").mapInArrow(run, f"{_TOKENS}, {_OPEN}")


def composed(left: dict, right: dict) -> tuple[dict, dict | None]:
    """What is open of two neighbouring fragments together, and the group that closes between them, if one does."""
    ok, own = left["ok"] and right["ok"], {"row": left["row"], "doc_id": left["doc_id"]}
    base = own | {"k": left["k"], "ok": ok}
    if not left["closed"]:
        both = base | {"first": right["first"], "closed": right["closed"], "a": left["a"] + right["a"], "b": left["b"] + right["b"]}
        return both | {x: right[x] for x in ("suf_a", "suf_b")}, None
    a, b = left["suf_a"] + right["a"], left["suf_b"] + right["b"]
    kept = base | {x: left[x] for x in ("first", "closed", "a", "b")}
    if not right["closed"]:
        return kept | {"suf_a": a, "suf_b": b}, None
    closed = own | {"part": 2 * right["first"], "a": a, "b": b, "ok": True} if a or b else None
    return kept | {"suf_a": right["suf_a"], "suf_b": right["suf_b"]}, closed


def _tree(fragments: DataFrame, fan: int) -> DataFrame:
    """Closed parts of every long text, null where its bytes don't come back."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["k"])
        out, total = [], rows[0]
        for right in rows[1:]:
            total, closed = composed(total, right)
            if closed:
                out.append(closed)
        return pa.Table.from_pylist([*out, total | {"k": total["k"] // fan}], schema=_SCHEMA)

    parts, open_ = fragments.where("part is not null"), fragments.where("part is null")
    most = open_.agg(F.max("k")).first()[0] or 0
    while most:
        step = stored(open_.groupBy("row", F.floor(F.col("k") / fan).alias("of")).applyInArrow(run, f"{_TOKENS}, {_OPEN}"))
        parts, open_ = parts.unionByName(step.where("part is not null")), step.where("part is null")
        most //= fan
    names = [f.split()[0] for f in _TOKENS.split(", ")]
    lost = open_.where(~F.col("ok"))
    kept = parts.select(*names).join(lost.select("row"), "row", "left_anti")
    return kept.unionByName(lost.select("row", F.lit(0).cast("long").alias("part"), "doc_id", F.lit(None).cast("binary").alias("a"), F.lit(None).cast("binary").alias("b")))


def parts(docs: DataFrame, folder: str = TOKENIZERS, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Tokens as two-byte ids, between common ends: of texts of one chunk, and the parts of longer ones, in order within a row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    long = stored(_chunks(docs.where(size >= chunk), chunk))
    return stored(_whole(docs.where(size < chunk), folder)), stored(_tree(stored(_fragments(long, folder)), fan))


def pair_counts(tokens: DataFrame, folder: str = TOKENIZERS) -> DataFrame:
    """pair, n: how many links of all texts join these tokens; pair is a's id times 65536 plus b's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(folder)
        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], names=["pair", "n"])

        for batch in batches:
            for some in _batches(batch):
                (a, a_many), (b, b_many) = _ids(some["a"]), _ids(some["b"])
                pair, n = np.unique(Aligned(t, a, b, a_many, b_many).pair, return_counts=True)
                held, at = np.unique(np.concatenate((held, pair)), return_inverse=True)
                counts = np.bincount(at, np.concatenate((counts, n)), len(held)).astype(np.int64)
                if len(held) > 1 << 20:
                    yield out()
                    held, counts = held[:0], counts[:0]
        if len(held):
            yield out()

    return tokens.select("a", "b").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def _judged(counts: DataFrame) -> DataFrame:
    """pair, n, best: whether no other pair of the same b has a higher count. A vocabulary bounds the best ones, so they are broadcast."""
    b = F.col("pair") % _BASE
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _least_count(judged: DataFrame, pairs: int) -> int:
    """The count from which on pairs are broadcast, so that they are at most so many."""
    if judged.count() <= pairs:
        return 0
    upto, least = 0, 1 << 62
    for r in judged.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).agg(F.count("*").alias("many"), F.min("n").alias("least")).orderBy(F.desc("step")).toLocalIterator():
        upto += r.many
        if upto > pairs:
            break
        least = r.least
    return least


def aligned(docs: DataFrame, folder: str = TOKENIZERS, chunk: int = CHUNK, fan: int = FAN, pairs: int = PAIRS) -> DataFrame:
    """doc_id, numbers of tokens, groups and links, of links that are their second token's best, the sum of all links' counts, and the digest of the groups."""
    whole, long = parts(docs, folder, chunk, fan)
    judged = stored(_judged(stored(pair_counts(whole.unionByName(long), folder))))
    least = _least_count(judged, pairs)
    known = judged.where(F.col("n") >= least).toArrow().combine_chunks().sort_by("pair")
    shared = docs.sparkSession.sparkContext.broadcast([known[c].to_numpy() for c in ("pair", "n", "best")])
    names = ["row", "doc_id", *_COUNTS, "groups_sha256", "rest"]
    schema = pa.schema([*((c, pa.int64()) for c in names[:-2]), ("groups_sha256", pa.string()), ("rest", pa.binary())])

    def measured(t: Tokenizers, some: pa.RecordBatch) -> tuple[Aligned, np.ndarray, list[bytes]]:
        """Groups and links of some rows, their six counts, and the pairs that aren't among the frequent ones; those add nothing."""
        pair, n, best = shared.value
        (a, a_many), (b, b_many) = _ids(some["a"]), _ids(some["b"])
        found = Aligned(t, a, b, a_many, b_many)
        if len(pair):
            at = np.minimum(np.searchsorted(pair, found.pair), len(pair) - 1)
            hit = pair[at] == found.pair
            sums = [found.sums(hit & best[at]), found.sums(n[at] * hit)]
        else:
            hit, sums = np.zeros(len(found.pair), bool), [np.zeros(some.num_rows, np.int64)] * 2
        edge = found.link_edge
        rest = [found.pair[i:j][~hit[i:j]].tobytes() for i, j in zip(edge[:-1], edge[1:], strict=True)]
        return found, np.stack([*found.counts(), *sums]).astype(np.int64), rest

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(folder)
        for batch in batches:
            for some in _batches(batch):
                found, sums, rest = measured(t, some)
                digests = [hashlib.sha256(g[:-1]).hexdigest() if g else "" for g in found.groups()]
                yield pa.RecordBatch.from_arrays([some["row"], some["doc_id"], *map(pa.array, sums), pa.array(digests), pa.array(rest, pa.binary())], schema=schema)

    def long_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Parts come sorted by row and part. A part's rare pairs have a row of their own, without a digest."""
        t = tokenizers(folder)
        row, doc, sums, digest, last = None, None, np.zeros(6, np.int64), hashlib.sha256(), b""

        def out() -> pa.RecordBatch:
            digest.update(last[:-1])
            return pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc} | dict(zip(_COUNTS, sums.tolist(), strict=True)) | {"groups_sha256": digest.hexdigest() if sums[0] else "", "rest": b""}], schema=schema)

        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                if one["row"][0].as_py() != row:
                    if row is not None:
                        yield out()
                    row, doc = one["row"][0].as_py(), one["doc_id"][0].as_py()
                    sums, digest, last = np.zeros(6, np.int64), hashlib.sha256(), b""
                found, more, rest = measured(t, one)
                sums += more[:, 0]
                digest.update(last)
                last = found.groups()[0]
                if rest[0]:
                    yield pa.RecordBatch.from_pylist([{"row": row, "rest": rest[0]}], schema=schema)
        if row is not None:
            yield out()

    fields = f"row long, {_RESULT}, rest binary"
    cut = long.repartition("row").sortWithinPartitions("row", "part")
    found = whole.mapInArrow(texts, fields).unionByName(cut.mapInArrow(long_texts, fields))
    return found.drop("row", "rest") if not least else _with_rare(stored(found), judged.where(F.col("n") < least))


def _with_rare(found: DataFrame, rare: DataFrame) -> DataFrame:
    """Rows with the counts of their rare pairs added; each text's pairs are counted before they are joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, value in zip(batch["row"].to_pylist(), batch["rest"], strict=True):
                pair, times = np.unique(np.frombuffer(value.as_buffer(), dtype=np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row)), pa.array(pair), pa.array(times)], names=["row", "pair", "times"])

    links = found.where("length(rest) > 0").select("row", "rest").mapInArrow(run, "row long, pair long, times long")
    sums = links.join(rare, "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more"))
    both = found.where("groups_sha256 is not null").join(sums, "row", "left")
    added = {"n_best": "more_best", "count_sum": "more"}
    return both.select("doc_id", *((F.col(c) + F.coalesce(added[c], F.lit(0))).alias(c) if c in added else c for c in _COUNTS), "groups_sha256")


def report(docs: DataFrame, **parameters) -> DataFrame:
    return aligned(docs, **parameters)
