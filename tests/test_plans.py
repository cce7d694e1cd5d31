"""What the optimizer makes of some queries."""

import re

from paperloom.operators import alignment
from paperloom.plans import registry


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def read_columns(text, table):
    return [re.findall(r"(\w+):", m) for m in re.findall(rf"{table}\.parquet.*?ReadSchema: struct<(.*?)>", text)]


def test_maps_don_t_shuffle(spark, sf):
    for name in ("page_quality", "sentence_classes", "text_forms", "numbers", "page_titles", "event_documents", "normalized_texts", "prompts", "tei_sentences"):
        assert "Exchange" not in plan(registry.QUERIES[name](spark, sf)), name


def test_scans_read_what_they_need(spark, sf):
    assert read_columns(plan(registry.QUERIES["page_quality"](spark, sf)), "documents") == [["doc_id", "text"]]
    assert read_columns(plan(registry.QUERIES["hosts"](spark, sf)), "pages") == [["url"]]
    assert all("text" not in c for c in read_columns(plan(registry.QUERIES["section_members"](spark, sf)), "documents"))


def test_filters_are_pushed_down(spark, sf):
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(event_type,click\)", plan(registry.QUERIES["granted_requests"](spark, sf)))


def test_budgets_are_cut_before_the_shuffle(spark, sf):
    text = plan(registry.QUERIES["granted_requests"](spark, sf))
    assert "WindowGroupLimit" in text.split("Exchange")[-1]


def test_no_product_of_tables(spark, sf):
    for name, query in registry.QUERIES.items():
        if not name.startswith("stream_") and name not in ("review_sample", "carded_review_sample"):
            text = plan(query(spark, sf))
            assert "CartesianProduct" not in text, name
            assert "BroadcastNestedLoopJoin" not in text or name in ("quota_resume", "resolved_versions"), name  # one row


def test_passages_are_fitted_once(spark):
    sentences = spark.createDataFrame([(1, "a b")], "k int, sentence string")
    items = spark.createDataFrame([(1, 0, 0, "a b c", True)], "k int, page long, index long, text string, eol boolean")
    assert len(re.findall(r"fitted\(.*\)#\d+", plan(alignment.on_items(sentences, items, ["k"])).split("== Initial Plan ==")[-1])) == 1
