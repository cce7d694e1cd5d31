"""Whether what was generated fits what was asked for: results of chunks against the sentences of their document, digests against the sections of their part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed

# Codes of what is wrong with a document's results, and with the digests of a part.
INCOMPLETE, DIFFERENT, UNKNOWN, TWICE, LOST, CHANGED, BLANK = (
    "chunk_not_complete", "result_ids_differ_from_targets", "unknown_sentence", "sentence_in_two_chunks", "sentence_without_result", "result_hash_mismatch", "empty_translation",
)
UNCOVERED = "section_not_covered"
OTHER_SECTION, SECOND, OTHER_EVIDENCE = "unknown_section", "second_digest", "unknown_evidence"


def results_hash(ranked: Column) -> Column:
    """The digest of a chunk's results: an array of structs with rank, id and text."""
    return F.sha2(F.array_join(F.transform(F.array_sort(ranked), lambda r: F.concat_ws("\x1f", r["id"], r["text"])), "\x1e"), 256)


def result_problems(chunks: DataFrame, results: DataFrame, sentences: DataFrame, unit: list[str]) -> DataFrame:
    """unit, code, chunk, id: every problem with the results of a unit, such as a document.

    chunks: unit, chunk, position, status, targets (array of ids), hash; results: unit, chunk, rank, id, text; sentences: unit, id, text, body. Only complete
    chunks count; of a sentence in several the first counts, by the chunks' position and the rank.
    """
    whole = F.col("status") == "complete"
    row = lambda code, chunk=None, id_=None: (F.lit(code).alias("code"), (F.col(chunk) if chunk else F.lit(None).cast("long")).alias("chunk"), (F.col(id_) if id_ else F.lit(None).cast("string")).alias("id"))
    complete = chunks.where(whole)
    listed = results.groupBy(*unit, "chunk").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "text"))).alias("ranked"))
    judged = complete.join(listed, [*unit, "chunk"], "left").withColumn("ranked", F.coalesce("ranked", F.array().cast(listed.schema["ranked"].dataType)))
    differ = judged.where(~(F.col("ranked.id") == F.col("targets")))
    changed = judged.where(~F.coalesce(F.col("hash") == results_hash(F.col("ranked")), F.lit(False)))
    own = results.join(complete.select(*unit, "chunk", "position"), [*unit, "chunk"])
    matched = own.join(sentences.select(*unit, "id", F.col("text").alias("original")), [*unit, "id"], "left").withColumn("nth", F.row_number().over(Window.partitionBy(*unit, "id").orderBy("position", "rank")))
    known = F.col("original").isNotNull()
    empty = (trimmed("original") != "") & (trimmed(F.coalesce("text", F.lit(""))) == "")
    lost = sentences.where("body").join(matched.where(known).select(*unit, "id"), [*unit, "id"], "left_anti")
    found = [
        chunks.where(~whole).select(*unit, *row(INCOMPLETE, "chunk")), differ.select(*unit, *row(DIFFERENT, "chunk")), changed.select(*unit, *row(CHANGED, "chunk")), matched.where(~known).select(*unit, *row(UNKNOWN, "chunk", "id")),
        matched.where(known & (F.col("nth") > 1)).select(*unit, *row(TWICE, "chunk", "id")), matched.where(known & (F.col("nth") == 1) & empty).select(*unit, *row(BLANK, "chunk", "id")), lost.select(*unit, *row(LOST, None, "id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def part_digests(digests: DataFrame, sections: DataFrame, sentences: DataFrame, part: list[str]) -> tuple[DataFrame, DataFrame]:
    """Accepted digests (part, section, summary, evidence) and what is wrong (part, code, section, detail).

    digests: part, rank, section, summary, evidence (array of ids); sections: part, section; sentences: part, section, id. The first digest of a section
    counts, with the evidence that is in the section, each once, in order; a section without a digest, or with a blank one, isn't covered.
    """
    listed = digests.join(sections.withColumn("_own", F.lit(True)), [*part, "section"], "left").withColumn("nth", F.row_number().over(Window.partitionBy(*part, "section").orderBy("rank")))
    own = F.coalesce("_own", F.lit(False))
    first = listed.where(own & (F.col("nth") == 1))
    claims = first.select(*part, "section", F.posexplode("evidence").alias("at", "id"))
    checked = claims.join(sentences.select(*part, "section", "id", F.lit(True).alias("there")), [*part, "section", "id"], "left")
    good = checked.where("there").groupBy(*part, "section", "id").agg(F.min("at").alias("at")).groupBy(*part, "section").agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("e"))
    summary = trimmed(F.coalesce("summary", F.lit("")))
    accepted = first.where(summary != "").join(good, [*part, "section"], "left").select(*part, "section", summary.alias("summary"), F.coalesce(F.col("e.id"), F.array().cast("array<string>")).alias("evidence"))
    note = lambda df, code, detail=None: df.select(*part, F.lit(code).alias("code"), "section", (F.col(detail) if detail else F.lit(None).cast("string")).alias("detail"))
    wrong = note(listed.where(~own), OTHER_SECTION).unionByName(note(listed.where(own & (F.col("nth") > 1)), SECOND)).unionByName(note(checked.where("there is null"), OTHER_EVIDENCE, "id"))
    return accepted, wrong.unionByName(note(sections.join(accepted, [*part, "section"], "left_anti"), UNCOVERED))
