"""Spans that start at one place come in the order of their kinds."""

from agrispark.llm import pii


def test_kind_before_end(spark):
    rows = [(1, "10.0.0.1@host.com"), (2, "4111111111111111@x.com")]
    got = {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans] for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["email:0:17", "ip:0:8"]
    assert got[2][:2] == ["email:0:22", "card:0:16"]
