"""Streams: restarts, replays after a failure, and detectors in them."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from agrispark.operators.detectors import Distance, Plain
from agrispark.streaming import labels, segments, tables

KEYS = ["tile_row", "tile_col"]


def add(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines) + "\n")


def rows(counts):
    return sorted((r.tile_row, r.tile_col, r.n, r.n_conf, None if r.mean_conf is None else round(r.mean_conf, 9)) for r in counts.collect())


def wanted(spark, folder):
    lines = spark.read.text(str(folder)).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    return rows(labels.tile_counts(labels.parse_labels(lines)))


def files(folder, start, stop):
    for i in range(start, stop):
        r, c = i % 3, i % 2
        add(folder, f"mid_tile_{r}_{c}__{i}.txt", [f"0 0.{i % 9}5 0.5 0.5 0.2 0.2", "1 0.5 0.5 0.1 0.1", "", "bad line"][: 1 + i % 4])


def test_tile_counts_over_restarts_and_replays(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    files(source, 0, 12)
    add(source, "no_name.txt", ["0 0.5 0.5 0.2 0.2"])

    def run(**kw):
        counts = labels.tile_counts(labels.label_stream(spark, str(source), 3))
        return tables.merged(counts, KEYS, table, state, fold_every=2, **kw)

    first = run()
    assert rows(first) == wanted(spark, source)
    files(source, 12, 26)

    def fail(number):
        if number >= 6:
            raise RuntimeError("lost")

    with pytest.raises(StreamingQueryException):
        run(before_commit=fail)  # its rows are written, the batch isn't done
    assert rows(run()) == wanted(spark, source)
    assert rows(run()) == wanted(spark, source)  # nothing new
    assert tables._complete(spark, f"{table}/base")[-1] >= 6


def test_half_written_batches_are_not_read(spark, tmp_path):
    schema = "k int, v int"
    put = lambda rows, where: spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{tmp_path}/{where}")
    kind = spark.createDataFrame([], schema).schema
    assert tables.latest(spark, str(tmp_path), kind, ["k"]).count() == 0
    put([(1, 1), (2, 1), (None, 1)], "changes/batch=0")
    put([(2, 2), (3, 2)], "changes/batch=1")
    put([(1, 3)], "changes/batch=2")
    (tmp_path / "changes/batch=2/_SUCCESS").unlink()
    got = lambda **kw: sorted(map(tuple, tables.latest(spark, str(tmp_path), kind, ["k"], **kw).collect()), key=str)
    assert got() == [(1, 1), (2, 2), (3, 2), (None, 1)]
    assert got(upto=0) == [(1, 1), (2, 1), (None, 1)]
    put([(1, 1), (2, 2), (3, 2), (None, 1)], "base/batch=1")
    put([(3, 4)], "changes/batch=10")
    assert got() == [(1, 1), (2, 2), (3, 4), (None, 1)]


@pytest.mark.parametrize("kind", [Plain, Distance])
def test_segments_score_in_a_stream_as_in_a_batch(spark, tmp_path, kind):
    rows = [(i, i % 3, 0, float(i % 7), float(i * i % 11) + 0.1 * i) for i in range(40)] + [(99, 8, 8, None, 1.0)]
    df = spark.createDataFrame(rows, "seg_id int, tile_row int, tile_col int, a double, b double")
    df.repartition(5).write.parquet(f"{tmp_path}/in")
    detector = kind(["a", "b"]).fit(df.na.drop())
    tiles = spark.createDataFrame([(r, 0, f"field {r}") for r in range(2)], "tile_row int, tile_col int, field string")
    stream = segments.scored_segments(segments.segment_stream(spark, f"{tmp_path}/in", df.schema, 2), detector, -2.0, tiles)
    got = labels.drained(stream, f"{tmp_path}/out", f"{tmp_path}/state", "append")
    again = labels.drained(segments.scored_segments(segments.segment_stream(spark, f"{tmp_path}/in", df.schema, 2), detector, -2.0, tiles), f"{tmp_path}/out", f"{tmp_path}/state", "append")
    assert got.count() == again.count() == 41
    want = {r.seg_id: r.score for r in detector.score(df).collect()}
    for r in got.collect():
        assert r.score == (None if want[r.seg_id] is None else pytest.approx(want[r.seg_id]))
        assert r.is_inlier == (want[r.seg_id] is not None and want[r.seg_id] >= -2.0)
        assert r.field == (f"field {r.tile_row}" if r.tile_row < 2 else None)
