"""Records are joined with their payload's group in a way that a hot payload can be split."""

from lamina.llm import warc


def test_no_aggregation_right_below_the_join(spark):
    pages = spark.createDataFrame([(k, f"http://a.b/{k}", "same" if k % 3 == 0 else f"page {k}") for k in range(30)], "page_id long, url string, html string")
    made = warc.records(pages)
    assert "Aggregate" not in made._jdf.queryExecution().optimizedPlan().toString()
    values = {r["id"]: r["value"] for r in made.collect()}
    assert len(values) == 30
    assert {k for k, v in values.items() if "WARC-Type: revisit" in v} == set(range(0, 27, 3))
