"""Fingerprints of documents that tell what two versions differ in: invertible Bloom lookup sketches of paragraphs.

A paragraph is a line, or each `PIECE` characters of a longer one; its key is 40 bits of a digest and a
checksum of them. A fingerprint has three tables of eight cells, and each distinct key is in one cell
of each: a cell holds the exclusive or of its keys. Two fingerprints are subtracted cell by cell, which
leaves the keys that only one has; cells that hold one key, as its checksum tells, are peeled until
nothing is left. Where more differ than a fingerprint can tell, the keys are dealt by their own bits to
blocks of about `LOAD` keys, each with cells of its own; a block that doesn't peel is tried again with
twice the cells and other hashes, `RETRIES` times. All of this is done row by row with expressions, and
costs in proportion to the keys (times the root of the blocks, to deal them). The likeness of two
fingerprints with a and b keys that differ in d is (a + b - d) / (a + b).

The document that comes next is found in one shuffle of the texts, by ranges of ids that quantiles
divide; each range also gets the first document of the range after it. An id that several quantiles
fall on, or no id, is divided by ranges of the text's hash.

Defined results: null texts are empty; an empty text's fingerprint has no keys, and two of them are alike
by 1. A paragraph counts once however often it occurs. Rows without an id come last, rows of one id are
ordered by the hashes of their texts; copies follow each other. A table of one row is followed by
itself; an empty one gives no rows. Further columns are ignored. If a block failed at every size, which
independent hashes make rarer than once in 10^15 blocks, all its keys count as differing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import small_side, stored

#: A paragraph's most characters.
PIECE = 160
PARAGRAPH = rf"[^\n]{{1,{PIECE}}}"
#: Tables of a sketch, and cells of each table of a fingerprint, and of a block at first.
TABLES, CELLS = 3, 8
#: Keys of both versions in a block, about.
LOAD = 12
RETRIES = 6
#: Steps of peeling, at most.
STEPS = 16
#: Documents in a range, about, and ranges at most.
RANGE_ROWS, RANGES = 2000, 10_000

#: The largest prime of 20 bits; a checksum is the digest's remainder, moved.
_BITS, _PRIME, _FACTOR = 20, 1048573, 48271
_SUBRANGES = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keys(text: Column) -> Column:
    """Keys of a text's distinct paragraphs."""
    found = F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.trim(p))
    digests = F.transform(F.filter(found, lambda p: p != ""), lambda p: F.conv(F.substring(F.md5(p), 1, 10), 16, 10).cast("long"))
    return F.transform(F.array_distinct(digests), lambda d: F.shiftleft(d, _BITS).bitwiseOR(_check(d)))


def _check(digest: Column) -> Column:
    return digest % _PRIME * _FACTOR % _PRIME


def _single(cell: Column) -> Column:
    """Whether a cell holds one key."""
    return (cell != 0) & (cell.bitwiseAND((1 << _BITS) - 1) == _check(F.shiftright(cell, _BITS)))


def _places(key: Column, cells: int, salt: int) -> Column:
    """A key's cell in each table: of a fingerprint by its own bits, in larger sketches by those of a hash."""
    bits = F.xxhash64(key, F.lit(salt)) if salt else F.shiftright(key, _BITS)
    return F.struct(key.alias("k"), *(F.shiftright(bits, (16 if salt else 3) * t).bitwiseAND(cells - 1).cast("int").alias(f"t{t}") for t in range(TABLES)))


def _xor(cells: Column, table: str, entries: Column) -> Column:
    """The cells of a table with some keys more, or less, which is the same."""
    return F.transform(cells, lambda cell, i: F.aggregate(entries, cell, lambda x, e: F.when(e[table] == i, x.bitwiseXOR(e["k"])).otherwise(x))).alias(table)


_TABLES = [f"t{t}" for t in range(TABLES)]


def sketch(of: Column, cells: int = CELLS, salt: int = 0) -> Column:
    """The tables of some keys' cells."""
    empty = F.array(*[F.lit(0).cast("long")] * cells)
    return let(F.transform(of, lambda k: _places(k, cells, salt)), lambda e: F.struct(*(_xor(empty, t, e) for t in _TABLES)))


def subtracted(one: Column, other: Column) -> Column:
    return let(F.struct(one.alias("a"), other.alias("b")), lambda s: F.struct(*(F.zip_with(s["a"][t], s["b"][t], lambda x, y: x.bitwiseXOR(y)).alias(t) for t in _TABLES)))


def peeled(difference: Column, cells: int = CELLS, salt: int = 0) -> Column:
    """The keys that a difference of sketches holds, of either side; null if they can't be told."""

    def single(state: Column) -> Column:
        return F.array_distinct(F.concat(*(F.filter(state[t], _single) for t in _TABLES)))

    def without(state: Column, gone: Column) -> Column:
        def rest(e: Column) -> Column:
            return F.struct(*(_xor(state[t], t, e) for t in _TABLES), F.concat(state["found"], gone).alias("found"), F.lit(True).alias("on"))

        done = F.struct(*(state[t].alias(t) for t in _TABLES), state["found"].alias("found"), F.lit(False).alias("on"))
        return F.when(F.size(gone) > 0, let(F.transform(gone, lambda k: _places(k, cells, salt)), rest)).otherwise(done)

    start = let(difference, lambda d: F.struct(*(d[t].alias(t) for t in _TABLES), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("on")))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        start,
        lambda s, _: F.when(s["on"], let(single(s), lambda gone: without(s, gone))).otherwise(s),
        lambda s: F.when(F.forall(F.concat(*(s[t] for t in _TABLES)), lambda x: x == 0), s["found"]),
    )


def _in_blocks(one: Column, other: Column, part: Callable[[Column, Column], Column]) -> Column:
    """part(keys of one, keys of other) for each block of keys; they are dealt in two steps, by half of the bits each."""
    bits = F.greatest(F.ceil(F.log2((F.size(one) + F.size(other)) / LOAD)), F.lit(0)).cast("int")

    def dealt(pairs: Column, width: Column, of: Callable[[Column], Column]) -> Column:
        own = lambda side, i: F.filter(side, lambda k: of(k) == i)
        return F.flatten(F.transform(pairs, lambda p: F.transform(F.sequence(F.lit(0).cast("long"), width - 1), lambda i: F.struct(own(p["a"], i).alias("a"), own(p["b"], i).alias("b")))))

    def both(b: Column) -> Column:
        high = let(F.pow(F.lit(2), F.ceil(b / 2)).cast("long"), lambda w: dealt(F.array(F.struct(one.alias("a"), other.alias("b"))), w, lambda k: F.shiftright(k, 40) % w))
        low = let(F.pow(F.lit(2), F.floor(b / 2)).cast("long"), lambda w: dealt(high, w, lambda k: F.shiftright(k, 20).bitwiseAND(0xFFFFF) % w))
        return F.transform(low, lambda p: part(p["a"], p["b"]))

    return let(bits, both)


def differing(one: Column, other: Column, sketch_one: Column, sketch_other: Column) -> Column:
    """How many keys only one of two texts has, from their fingerprints, or from larger sketches of their keys where those don't tell."""

    def tried(a: Column, b: Column, at: int) -> Column:
        cells = CELLS << at
        both = subtracted(sketch(a, cells, at + 1), sketch(b, cells, at + 1))
        return F.array_size(peeled(both, cells, at + 1))

    def block(a: Column, b: Column) -> Column:
        return F.coalesce(*(tried(a, b, at) for at in range(RETRIES)), F.size(a) + F.size(b))

    larger = F.aggregate(_in_blocks(one, other, block), F.lit(0).cast("long"), lambda x, n: x + n)
    return F.coalesce(F.array_size(peeled(subtracted(sketch_one, sketch_other))).cast("long"), larger)


def likeness(one: Column, other: Column, sketch_one: Column, sketch_other: Column) -> Column:
    total = F.size(one) + F.size(other)
    return F.when(total == 0, F.lit(1.0)).otherwise(let(differing(one, other, sketch_one, sketch_other), lambda d: (total - d) / total))


def written(cells: Column) -> Column:
    """A sketch as text: its cells in hexadecimal digits."""
    return F.array_join(F.transform(F.concat(*(cells[t] for t in _TABLES)), lambda x: F.lower(F.hex(x))), " ")


def _range(splits: list[int], hot: list[int]) -> Column:
    """The range of a row, in descending order of ids: how many splits are above its id, by way of every so many of them; hot ids, and rows without, also by hash."""
    step = max(1, int(len(splits) ** 0.5))
    falling = sorted(splits, reverse=True)
    parts = [falling[i : i + step] for i in range(0, len(falling), step)]
    longs = lambda values: F.array(*(F.lit(v).cast("long") for v in values)) if values else F.array().cast("array<bigint>")
    above = lambda values: F.size(F.filter(values, lambda s: s > F.col("doc_id")))
    first = above(longs([p[0] for p in parts]))
    inner = let(first, lambda n: F.when(n > 0, (n - 1) * step + above(F.element_at(F.array(*map(longs, parts)), F.greatest(n, F.lit(1))))).otherwise(0)) if parts else F.lit(0)
    by_hash = F.shiftright("h", 54) + _SUBRANGES // 2
    sub = F.when(F.col("doc_id").isNull() | F.col("doc_id").isin(hot), by_hash + 1).otherwise(0)
    return (F.when(F.col("doc_id").isNull(), len(splits) + 1).otherwise(inner).cast("long") * (2 * _SUBRANGES) + sub).alias("range")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, text, and next_text, the text of the document that comes next in descending order of ids; after the last comes the first."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    ranges = min(RANGES, max(1, n // range_rows))
    at = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", at, 20 * ranges).alias("q")).first()["q"] if at else []
    found = found or []
    hot = sorted({x for x, y in zip(found, found[1:]) if x == y})
    keyed = docs.withColumn("h", F.xxhash64("text"))
    keyed = keyed.select("*", _range(sorted(set(found)), hot))

    # the first row of each range goes to the range before it, too
    heads = keyed.groupBy("range").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("head"))
    falling = Window.orderBy("range")
    before = F.coalesce(F.lag("range").over(falling), F.last("range").over(falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    sent = stored(heads.select(before.alias("to"), F.col("head.doc_id").alias("head_id"), F.bitwise_not("head.h").alias("head_h")))
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h"))
    guests = keyed.join(small_side(sent, 64), same).groupBy("to").agg(F.first("text").alias("text"))
    both = keyed.select("range", "doc_id", "text", "h", F.lit(False).alias("guest")).unionByName(
        guests.select(F.col("to").alias("range"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(None).cast("long").alias("h"), F.lit(True).alias("guest"))
    )
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h")
    return both.withColumn("next_text", F.lead("text").over(order)).where("not guest").select("doc_id", "text", "next_text")


def edited(text: Column, other: Column) -> Column:
    """The text with its later half, rounded down, replaced by as much of the other's beginning."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(other, F.lit(1), half))


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with a column `fingerprint`."""
    return docs.withColumn("fingerprint", written(sketch(keys(F.coalesce(F.col(text), F.lit(""))))))


def report(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, the digest of the edited text, both fingerprints, and the likeness of the first to the second and to the next document's."""
    found = with_next(docs, range_rows).withColumn("edited", edited(F.col("text"), F.col("next_text")))
    versions = F.array(*(F.struct(keys(F.col(c)).alias("keys")) for c in ("text", "edited", "next_text")))
    sketched = F.transform(versions, lambda v: F.struct(v["keys"].alias("keys"), sketch(v["keys"]).alias("cells")))

    def compared(v: Column) -> Column:
        own = F.element_at(v, 1)
        near = F.transform(F.slice(v, 2, 2), lambda x: likeness(own["keys"], x["keys"], own["cells"], x["cells"]))
        return F.struct(F.transform(v, lambda x: written(x["cells"])).alias("written"), near.alias("near"))

    r = found.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), let(sketched, compared).alias("r"))
    return r.select("doc_id", "n_chars", "edited_sha256", F.col("r.written")[0].alias("fingerprint"), F.col("r.written")[1].alias("edited_fingerprint"), F.col("r.near")[0].alias("near_edited"), F.col("r.near")[1].alias("near_next"))
