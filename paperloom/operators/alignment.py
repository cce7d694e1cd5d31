"""Where a passage best fits into a text, by edit distance, and which text items it covers there."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalized
from .assembly import placed
from .normalize import norm_range, normalized_with_map, raw_range, segments

#: The edits a character of the passage that are at most certain, and at most uncertain; why a passage has no place, or several.
MAPPED, UNCERTAIN = 0.1, 0.35
EMPTY, NO_CANDIDATES, OVER, AMBIGUOUS = "empty_sentence", "no_candidates", "over_threshold", "ambiguous"


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _distances(query: np.ndarray, text: np.ndarray, free: bool) -> np.ndarray:
    """Edit distance of all of `query` to the text up to each place, from its beginning or, if free, from wherever is best before.

    Myers' bit vectors, along the text: a bit for each of its characters, whose neighbours differ by one at most, and a step for each of the query's.
    """
    n, m = len(text), len(query)
    chars = np.unique(query)
    at = {c: int.from_bytes(bits.tobytes(), "little") for c, bits in zip(chars.tolist(), np.packbits(text == chars[:, None], axis=1, bitorder="little"), strict=True)}
    full = (1 << n) - 1
    up, down = 0 if free else full, 0
    for c in query.tolist():
        equal = at[c]
        vertical = equal | down
        horizontal = (((equal & up) + up) ^ up) | equal
        more = (down | ((horizontal | up) ^ full)) << 1 | 1
        less = (up & horizontal) << 1
        up, down = (less | ((vertical | more) ^ full)) & full, more & vertical
    bits = (np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little").astype(np.int32) for x in (up, down))
    return m + np.concatenate([[0], np.cumsum(np.subtract(*bits))])


def fit(query: str, text: str) -> tuple[int, int, int]:
    """(distance, start, end) of the stretch of `text` with the least edit distance to all of `query`; of equal ones the earliest end, then the latest start."""
    return fit_long(query, text, max(len(text), 1))


def fit_long(query: str, text: str, piece: int = 1 << 15, most: float = 1.0) -> tuple[int, int | None, int]:
    """fit() in pieces of the text, in memory of a piece's size. The distance is that of an empty stretch at most, so no best stretch is longer than twice the query; pieces overlap by as much.

    Of stretches with more than `most` edits a character of the query, the start is not sought and None.
    """
    if not query:
        return 0, 0, 0
    q, t = _codes(query), _codes(text)
    reach = 2 * len(q)
    step = max(piece, reach)
    found = []
    for at in range(0, max(len(t), 1), step):
        low = max(0, at - reach)
        distances = _distances(q, t[low : at + step], True)
        end = int(distances.argmin())
        found.append((int(distances[end]), low + end))
    distance, end = min(found)
    if distance / len(q) > most:
        return distance, None, end
    # the latest start is the least way back from the end at that distance
    back = _distances(q[::-1], t[max(0, end - reach) : end][::-1], False)
    return distance, end - int((back == distance).argmax()), end


def status(distance: Column, length: Column, exact: Column) -> Column:
    """mapped, uncertain or unmapped; a passage that is found word for word at several places is uncertain."""
    ratio = distance / F.greatest(length, F.lit(1))
    return F.when(exact == 1, "mapped").when(exact > 1, "uncertain").when(ratio <= 0.1, "mapped").when(ratio <= 0.35, "uncertain").otherwise("unmapped")


def aligned(pairs: DataFrame, query: str, text: str, most_cells: int | None = 20_000_000) -> DataFrame:
    """The pairs with exact (how often the text holds the query), distance, start, end and status. Only pairs without an exact hit are fitted; too large ones, if there is a limit, have status too_large."""
    exact = ((F.length(text) - F.length(F.replace(F.col(text), F.col(query), F.lit("")))) / F.greatest(F.length(query), F.lit(1))).cast("int")

    @F.pandas_udf("distance int, start int, end int")
    def fitted(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([fit_long(a, b) if a is not None and b is not None else (None, None, None) for a, b in zip(q, t, strict=True)], columns=["distance", "start", "end"])

    at = F.instr(text, F.col(query)) - 1
    cells = F.length(query).cast("long") * F.length(text)
    rows = pairs.withColumn("exact", exact)
    hit, large = F.col("exact") > 0, F.lit(False) if most_cells is None else cells > most_cells
    fields = ("distance int", "start int", "end int")
    none = F.struct(*(F.lit(None).cast("int").alias(f.split()[0]) for f in fields))
    direct = rows.where(hit).withColumn("fit", F.struct(F.lit(0).alias("distance"), at.alias("start"), (at + F.length(query)).alias("end")))
    rest = rows.where(~hit & ~large).withColumn("fit", fitted(query, text))
    over = rows.where(~hit & large).withColumn("fit", none)
    both = direct.unionByName(rest).unionByName(over)
    done = F.when(F.col("fit.distance").isNull(), "too_large").otherwise(status(F.col("fit.distance"), F.length(query), F.col("exact")))
    return both.select(*rows.columns, "fit.distance", "fit.start", "fit.end", done.alias("status"))


def _found(query: str, text: str) -> tuple[bool, bool, int, int | None, int]:
    """Whether the text holds the query as it is, and more than once; distance, start and end of where it fits."""
    at = text.find(query)
    return (True, text.find(query, at + 1) >= 0, 0, at, at + len(query)) if at >= 0 else (False, False, *fit_long(query, text, most=UNCERTAIN))


def on_items(sentences: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Sentences fitted into their candidate items put together: status, reason, confidence, distance, length, exact, matched_start and matched_end, and the spans of items.

    sentences: keys, sentence; candidates: keys, page, index, text, eol, none of them twice. Both are normalised; what is matched are places in the
    normalised text, spans have places in each item's own text and in its normalised text. An exact hit is taken as it is, and is uncertain if there is
    another; else the least edit distance decides. There is no limit of size: long texts are fitted piece by piece. Places count code points.
    """
    places = F.struct("page", "index", "raw_start", "raw_end", F.concat("separator", "text").alias("part"))
    texts = placed(candidates, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(places)).alias("items"))
    # what the items say is in the text; their places alone go on with it
    texts = texts.select(*keys, F.array_join(F.transform("items", lambda i: i["part"]), "").alias("raw"), F.transform("items", lambda i: F.struct(*(i[c].alias(c) for c in ("page", "index", "raw_start", "raw_end")))).alias("items"))
    rows = sentences.select(*keys, F.trim(normalized(F.coalesce("sentence", F.lit("")))).alias("query")).join(texts, keys, "left").withColumn("length", F.length("query"))

    @F.pandas_udf("exact boolean, twice boolean, distance int, start int, end int")
    def fitted(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        found = [_found(a, segments(b)[0]) if a is not None else (None,) * 5 for a, b in zip(q, t, strict=True)]
        return pd.DataFrame(found, columns=["exact", "twice", "distance", "start", "end"]).astype({"exact": "boolean", "twice": "boolean", "distance": "Int32", "start": "Int32", "end": "Int32"})

    # a row is normalised, searched and fitted once, all in one pass; what is lost has no start, and is not mapped back
    asked = (F.col("length") > 0) & F.col("raw").isNotNull()
    rows = rows.withColumn("fit", fitted(F.when(asked, F.col("query")), F.when(asked, F.col("raw"))))
    exact, twice = (F.coalesce(f"fit.{c}", F.lit(False)) for c in ("exact", "twice"))
    ratio = F.col("fit.distance") / F.col("length")
    reason = F.when(F.col("length") == 0, EMPTY).when(F.col("raw").isNull(), NO_CANDIDATES).when(ratio > UNCERTAIN, OVER).when(twice, AMBIGUOUS)
    found = rows.withColumn("reason", reason)
    lost = F.coalesce(F.col("reason").isin(EMPTY, NO_CANDIDATES, OVER), F.lit(False))
    found = found.select(
        *keys, "length", "reason", exact.alias("exact"), F.coalesce("fit.distance", "length").alias("distance"),
        F.when(lost, "unmapped").when(twice | (ratio > MAPPED), "uncertain").otherwise("mapped").alias("status"),
        F.when(lost, 0.0).when(twice, 0.5).otherwise(1 - ratio).alias("confidence"),
        F.when(~lost, F.col("fit.start")).alias("matched_start"), F.when(~lost, F.col("fit.end")).alias("matched_end"), F.when(~lost, F.col("items")).alias("items"), F.when(~lost, F.col("raw")).alias("text"),
    )
    fields = [c for c in found.columns if c not in ("items", "text", *keys)]
    found = found.withColumn("map", normalized_with_map(F.col("text")))
    found = found.withColumn("raw", F.when(F.col("text").isNotNull(), raw_range(F.col("map.segments"), F.col("matched_start"), F.col("matched_end"))))
    own = F.struct(*(F.col(f"item.{c}").alias(c) for c in ("page", "index", "raw_start", "raw_end")), F.substring("text", (F.col("item.raw_start") + 1).cast("int"), (F.col("item.raw_end") - F.col("item.raw_start")).cast("int")).alias("text"))
    met = found.withColumn("item", F.explode_outer(F.filter("items", lambda i: F.col("raw").isNotNull() & (F.least("raw.end", i["raw_end"]) > F.greatest("raw.start", i["raw_start"])))))
    met = met.withColumn("item", F.when(F.col("item").isNotNull(), own))
    low, high = F.greatest("raw.start", "item.raw_start") - F.col("item.raw_start"), F.least("raw.end", "item.raw_end") - F.col("item.raw_start")
    cut = met.select(*keys, *fields, "item", low.alias("start"), high.alias("end")).withColumn("own", norm_range(normalized_with_map(F.col("item.text"))["segments"], F.col("start"), F.col("end")))
    span = F.when(F.col("item").isNotNull(), F.struct(F.col("item.page").alias("page"), F.col("item.index").alias("index"), "start", "end", F.col("own.start").alias("norm_start"), F.col("own.end").alias("norm_end")))
    spans = cut.groupBy(*keys).agg(F.first(F.struct(*fields)).alias("f"), F.array_sort(F.collect_list(span)).alias("spans"))
    return spans.select(*keys, "f.*", "spans")
