"""The work of finding and redacting grows with a text's length, however many spans it has."""

import time

import pytest
from test_llm import base_spans

from agrispark.llm import pii


@pytest.mark.parametrize("one", ["10.20.30.40 ", "4111 1111 1111 1111, ", "a.b@example.com; ", "DE89370400440532013000 bank é ", "1.2.3.4@x.yz +1 555 123 4567 "])
def test_a_megabyte_of_spans(spark, one):
    text = one * (1_000_000 // len(one))
    df = spark.createDataFrame([(1, text, "kept", "kept")], "doc_id long, text string, __text string, __m_ip string")
    began = time.perf_counter()
    found = pii.find_spans(df)
    row = found.select("*", pii.redacted(found.text, found.spans).alias("red")).first()
    assert time.perf_counter() - began < 40
    base = [f"{s.kind}:{s.start}:{s.end}" for s in row.spans if s.base]
    assert base == base_spans(text) and row["__text"] == row["__m_ip"] == "kept"
    want, at = "", 0
    parts = []
    for s in row.spans:
        if s.start >= at:
            parts.append(text[at : s.start] + f"[{s.kind.upper()}]")
        at = max(at, s.end)
    want = "".join(parts) + text[at:]
    assert row.red == want and len(row.spans) >= text.count(one)
