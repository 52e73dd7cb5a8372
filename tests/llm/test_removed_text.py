"""The query of op1 returns the remaining text beside its digest; n_bytes is the length of the input."""

import hashlib

from agrispark.llm.suffix_dedup import op1_suffix_array_dedup


def test_remaining_text(spark, tmp_path):
    shared = "é" + "".join(f"{i} " for i in range(150))[:399] + "é"  # 403 bytes, 402 of them shared with the third text
    texts = {1: f"one {shared} first", 2: f"{shared}zwei", 3: "ũ" + shared[1:-1] + "é-third", 4: "über allem", 5: None}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op1_suffix_array_dedup(spark, str(tmp_path)).collect()}
    kept = {1: b"one  first", 2: b"zwei", 3: b"\xc5-third", 4: "über allem".encode(), 5: b""}
    assert {i: r.n_bytes for i, r in got.items()} == {i: len((t or "").encode()) for i, t in texts.items()}
    assert {i: r.n_bytes - r.n_removed for i, r in got.items()} == {i: len(b) for i, b in kept.items()}
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(b).hexdigest() for i, b in kept.items()}
    assert {i: r.text for i, r in got.items()} == {i: b.decode(errors="replace") for i, b in kept.items()}
