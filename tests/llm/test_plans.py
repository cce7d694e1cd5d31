from paperloom.llm import decontaminate, languages, toxicity

from ..test_plans import plan, read_columns


def test_maps_don_t_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (decontaminate.report(docs, spark.read.parquet(f"{sf}/benchmark.parquet")), languages.report(docs), toxicity.scored(docs, 0.5, ["doc_id"])):
        assert "Exchange" not in plan(df)
        assert read_columns(plan(df), "documents") == [["doc_id", "text"]]
