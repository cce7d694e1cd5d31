"""Relations inside documents: sections, citations, concepts, runs, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parents(sections: DataFrame, doc: str, number: str, order: str) -> DataFrame:
    """The sections with parent_order: the last earlier one whose number is theirs without its last part. Dotted numbers only."""
    child = sections.withColumn("parent_number", F.when(F.col(number).contains("."), F.regexp_replace(number, r"\.[^.]*$", "")))
    above = sections.select(F.col(doc).alias("p_doc"), F.col(number).alias("p_number"), F.col(order).alias("p_order"))
    pairs = child.join(above, (F.col(doc) == F.col("p_doc")) & (F.col("parent_number") == F.col("p_number")) & (F.col("p_order") < F.col(order)), "left")
    return pairs.groupBy(*sections.columns).agg(F.max("p_order").alias("parent_order"))


def resolved_references(references: DataFrame, key: str, targets: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """References that have a target, and those that have none."""
    known = targets.select(F.col(target).alias("target_key")).distinct()
    return references.join(known, F.col(key) == F.col("target_key")).drop("target_key"), references.join(known, F.col(key) == F.col("target_key"), "left_anti")


def runs(units: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """keys, run, first, last, size of stretches of units that the flag marks. units: one row each, `order` without gaps."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = units.where(flag).withColumn("run", F.col(order) - F.row_number().over(w))
    islands = marked.groupBy(*keys, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("size"))
    return islands.withColumn("run", F.row_number().over(Window.partitionBy(*keys).orderBy("first")).cast("long"))


def term_stats(sentences: DataFrame, key: list[str], occurs: Column, alias: Column, preferred: Column, original: Column) -> DataFrame:
    """key, occurrences, alias_only, with_preferred, with_original, violations."""
    counts = {"occurrences": occurs, "alias_only": ~occurs & alias, "with_preferred": occurs & preferred, "with_original": occurs & ~preferred & original, "violations": occurs & ~preferred & ~original}
    return sentences.groupBy(*key).agg(*(F.count_if(c).alias(n) for n, c in counts.items()))


def compared(truth: DataFrame, optional: DataFrame, predicted: DataFrame, group: str, item: str) -> DataFrame:
    """group, truth, missing, extra, verdict of predicted against true sets; optional items count for neither."""
    sides = [df.select(group, item).distinct().withColumn(f"in_{n}", F.lit(1)) for n, df in (("truth", truth), ("predicted", predicted))]
    both = sides[0].join(sides[1], [group, item], "full").join(optional.select(group, item).distinct().withColumn("in_optional", F.lit(1)), [group, item], "left")
    t, p, free = (F.col(f"in_{n}").isNotNull() for n in ("truth", "predicted", "optional"))
    n = both.groupBy(group).agg(F.count_if(t & ~free).alias("truth"), F.count_if(t & ~p & ~free).alias("missing"), F.count_if(p & ~t & ~free).alias("extra"), F.count_if(p).alias("found"))
    m, e = F.col("missing") > 0, F.col("extra") > 0
    verdict = F.when(F.col("found") == 0, "no_spans").when(m & e, "both").when(m, "missing").when(e, "extra").otherwise("equal")
    return n.withColumn("verdict", verdict).drop("found")


def outcome(status: Column, verdict: Column) -> Column:
    """correct, silent (wrong without a warning) or flagged."""
    return F.when((verdict == "equal") & (status != "unmapped"), "correct").when(status == "mapped", "silent").otherwise("flagged")


def merged(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of the parts; of rows with the same keys the one of the last part."""
    ranked = None
    for n, df in enumerate(parts):
        df = df.withColumn("part_rank", F.lit(n))
        ranked = df if ranked is None else ranked.unionByName(df)
    rest = [c for c in parts[0].columns if c not in keys]
    best = ranked.groupBy(*keys).agg(F.max_by(F.struct(*rest), "part_rank").alias("best"))
    return best.select(*keys, *(F.col(f"best.{c}").alias(c) for c in rest))


def drift(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """key, expected, actual where the two differ; null where one has no such key."""
    a = expected.select(key, F.col(value).alias("expected"))
    b = actual.select(key, F.col(value).alias("actual"))
    return a.join(b, key, "full").where(~F.col("expected").eqNullSafe(F.col("actual")))


def answered(requests: DataFrame, responses: DataFrame, key: str, at: str) -> DataFrame:
    """The requests with answered_at, the first response to each; null where none came."""
    first = responses.groupBy(key).agg(F.min(at).alias("answered_at"))
    return requests.join(first, key, "left")


def toggled(kept: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Selected rows that aren't kept are added; those that are, are taken out."""
    columns = kept.columns
    return kept.join(selected.select(*keys).distinct(), keys, "left_anti").select(*columns).unionByName(selected.join(kept.select(*keys).distinct(), keys, "left_anti").select(*columns))
