"""Terms of a glossary, as a table, in sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze, trimmed

_WORD = r"[\p{L}\p{N}]+"


def _pattern(term: Column, characters: str) -> Column:
    """Of the term, in lower case, where no such character continues its first or last one."""
    edge = f"[{characters}]"
    left = F.when(term.rlike(f"^{edge}"), F.lit(f"(?<!{edge})")).otherwise(F.lit(""))
    right = F.when(term.rlike(f"{edge}$"), F.lit(f"(?!{edge})")).otherwise(F.lit(""))
    return F.concat(left, F.regexp_replace(term, r"([\\\^$.|?*+()\[\]{}-])", r"\\$1"), right)


def _needle(name: Column, characters: str) -> Column:
    """What to look for, and as which pattern."""
    low = F.lower(trimmed(name))
    return F.struct(low.alias("low"), _pattern(low, characters).alias("pattern"))


def _holds(text: Column, needle: Column) -> Column:
    return F.contains(text, needle["low"]) & F.regexp_like(text, needle["pattern"])


def _met(sentences: DataFrame, key: list[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """key, low (the text in lower case) and the columns of terms, as occurrences() gives them. A term of one word is in the texts that have this word; patterns are made once a term."""
    needle = F.lower(trimmed(term))
    longest = F.reduce(F.regexp_extract_all(needle, F.lit(_WORD), 0), F.lit(""), lambda a, b: F.when(F.length(b) > F.length(a), b).otherwise(a))
    wanted = terms.withColumns({"needle": _needle(F.col(term), r"\p{L}\p{N}"), "word": longest}).where("needle.low <> ''")
    low = sentences.select(*key, F.lower(text).alias("low"))
    words = low.select("*", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(_WORD), F.lit(0)))).alias("word")).join(wanted.where("word <> ''"), "word")
    signs = low.select("*", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(r"[^\p{L}\p{N}\s]"), F.lit(0)))).alias("sign")).join(
        wanted.where("word = ''").withColumn("sign", F.substring("needle.low", 1, 1)), "sign"
    )
    met = words.unionByName(signs.drop("sign").select(words.columns)).where((F.col("word") == F.col("needle.low")) | _holds(F.col("low"), F.col("needle")))
    return met.select(*key, "low", *terms.columns)


def occurrences(sentences: DataFrame, key: list[str], text: str, terms: DataFrame, term: str) -> DataFrame:
    """key and the columns of terms, for each sentence and each term that it mentions as whole words, in any case.

    Sentences and terms meet by the term's longest word, which a mention holds as a whole word; only then is
    the term looked for. A term without a word meets the sentences that hold its first character, in a join
    of its own; empty ones are in none.
    """
    return _met(sentences, key, text, terms, term).drop("low")


def mentions(sentences: DataFrame, key: list[str], text: str, glossary: DataFrame) -> DataFrame:
    """key, the columns of glossary - id, term, aliases (array) and others - and main, once for each sentence and entry whose term (main) or alias it mentions.

    Of the names of an entry in a sentence only the first counts, which the sentence itself tells; nothing is shuffled for it.
    """
    listed = F.concat(F.array("term"), F.col("aliases"))
    before = F.transform(F.slice(listed, F.lit(1), F.col("at")), lambda n: _needle(n, r"\p{L}\p{N}"))
    named = glossary.select("*", F.posexplode(listed).alias("at", "name")).withColumn("earlier", F.filter(before, lambda n: n["low"] != ""))
    met = _met(sentences, key, text, named, "name")
    first = (F.col("at") == 0) | ~F.exists("earlier", lambda n: _holds(F.col("low"), n))
    return met.where(first).select(*key, *glossary.columns, (F.col("at") == 0).alias("main"))


def statistics(sentences: DataFrame, key: list[str], text: str, translation: str, glossary: DataFrame) -> DataFrame:
    """id, occurrences, alias_only, with_preferred, with_original, violations of every glossary entry: id, term, aliases and preferred (arrays).

    A sentence counts for an entry whose term it mentions: with_preferred if its translation has one of the preferred forms, white space aside,
    with_original if it keeps the term or an alias, else as a violation. Sentences with an alias only are counted apart.
    """
    said = F.coalesce(translation, F.lit(""))
    texts = sentences.select(text, F.lower(said).alias("said"), squeeze(said).alias("bare"))
    names = F.filter(F.transform(F.concat(F.array("term"), F.col("aliases")), lambda t: _needle(t, "a-z0-9")), lambda t: t["low"] != "")
    entries = glossary.select("id", "term", "aliases", F.transform("preferred", squeeze).alias("forms"), names.alias("names"))
    met = mentions(texts, ["said", "bare"], text, entries)
    preferred = F.exists("forms", lambda p: F.contains(F.col("bare"), p))
    kept = F.exists("names", lambda n: _holds(F.col("said"), n))
    # null: whether a form is there isn't known
    kind = F.when(~F.col("main"), "alias_only").otherwise(F.when(preferred, "with_preferred").when(~preferred, F.when(kept, "with_original").otherwise("violations")))
    kinds = ("alias_only", "with_preferred", "with_original", "violations")
    sums = met.select("id", "main", kind.alias("kind")).groupBy("id").agg(F.count_if("main").alias("occurrences"), *(F.count_if(F.col("kind") == k).alias(k) for k in kinds))
    return glossary.select("id", "term").join(sums, "id", "left").select("id", "term", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("occurrences", *kinds)))


def links(concepts: DataFrame, named: str, glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, linked) for every name in the array column `named` that a concept or glossary entry has, by lower case, the first of equal ones; and (id, name) of those that none has. Links to itself are dropped.

    concepts: id, name and `named`; glossary: linked, name, pos.
    """
    first = glossary.withColumn("known", F.lower(trimmed("name"))).groupBy("known").agg(F.min_by("linked", "pos").alias("linked"))
    asked = concepts.select("id", F.explode(F.array_distinct(F.filter(F.transform(named, trimmed), lambda x: x != ""))).alias("name")).withColumn("known", F.lower("name"))
    return asked.join(first, "known").where("linked <> id").select("id", "linked").distinct(), asked.join(first, "known", "left_anti").select("id", "name").distinct()


def source_links(references: DataFrame, sources: DataFrame, statuses: list[str]) -> DataFrame:
    """References (with source_id) whose source has one of the statuses and an http(s) address, with its url and title. sources: source_id, url, title, status."""
    good = sources.where(F.col("status").isin(statuses) & F.col("url").rlike("(?i)^https?://")).select("source_id", "url", "title")
    return references.join(good, "source_id")
