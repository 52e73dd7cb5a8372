"""Exact long-repeat removal with a run-length compressed index.

Windows of ``length`` bytes are dealt out by their minimiser, so equal windows
meet, wherever they are. A *stretch* is a maximal run of windows with the same
minimiser occurrence. Stretches that are equal byte for byte collapse to one
with a count. Where a minimiser has different stretches, a run-length index
over them (Burrows-Wheeler runs with the text positions and common prefixes
sampled at run ends) streams each position's matching statistic, the longest
match that starts anywhere else; windows that reach ``length`` are marked. A
minimiser with more text than one index may hold is known by its size before
anything is shuffled: its stretches are cut into blocks of 16 windows and dealt
out anew by what all windows of a block share, and the blocks go to indexes of
their own. Only a share that again has too many different blocks around it is
counted window by window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from agrispark.llm import textops as T
from agrispark.llm.common import keyed, original_id
from agrispark.session import stored

OWNER = ["_doc", "_tk", "at", "lo", "hi"]
#: Rows made one by one that a task gathers before it hands them on.
PYTHON_ROWS = 20_000
STRETCH = "h long, d1 long, d2 long, _doc long, _tk long, at int, lo int, hi int"


class RunLengthIndex:
    """Burrows-Wheeler runs over several byte strings, sampled at run ends.

    Of the runs (the start of a string counts as a character of its own) only
    samples are kept. ``head``, ``tail``: text position of the first and last
    suffix of each run; ``common``: bytes that each run's first suffix shares
    with the one before it, the last of the run before.
    """

    def __init__(self, strings: list[bytes]):
        text = np.frombuffer(b"\0".join([*strings, b""]) + b"\0" * 8, np.uint8)
        size = np.array([len(s) for s in strings], np.int64)
        self.n = n = int(size.sum() + len(size))
        self.kind = kind = np.int32 if n < 1 << 31 else np.int64  # of places in the text: most of an index's memory
        self.start = np.cumsum(size + 1) - size - 1
        owner = np.repeat(np.arange(len(size), dtype=kind), size + 1)
        left = np.repeat((self.start + size).astype(kind), size + 1)
        left -= np.arange(n, dtype=kind)
        order = self._sort(text, owner, left)
        before = text[order - 1].astype(kind)
        opening = np.zeros(n, bool)
        opening[self.start] = True
        opening = opening[order]
        before[opening] = -1 - owner[order[opening]]
        del opening, owner
        first = np.flatnonzero(np.append(True, before[1:] != before[:-1]))
        del before
        self.head, self.tail = order[first], order[np.append(first[1:], n) - 1]
        self.common = np.zeros(len(first), kind)
        self.common[1:] = self._common(text, self.head[1:], self.tail[:-1], left)

    @staticmethod
    def _sort(text, owner, left) -> np.ndarray:
        """Suffix order by prefix doubling; string ends differ and come first, by string."""
        n, kind = len(owner), left.dtype
        key = np.zeros(n, np.int64)
        for j in range(7):
            key <<= 9
            key |= np.where(left > j, text[j : j + n].astype(np.int16) + np.int16(1), np.int16(0))
        order = np.argsort(key, kind="stable").astype(kind)  # owners rise along the text, so they break ties
        key, o, e = key[order], owner[order], left[order] < 7
        new = np.append(True, (key[1:] != key[:-1]) | (e[1:] & (o[1:] != o[:-1])) | (e[1:] != e[:-1]))
        del key, o, e
        rank = np.empty(n, kind)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), kind.type(0)))
        step = 7
        at = np.flatnonzero(~(new & np.append(new[1:], True))).astype(kind)
        while len(at):
            act = order[at]
            both = rank[act].astype(np.int64)
            both *= n + 1
            both += rank[np.minimum(act, n - 1 - step) + step if step < n else np.full(len(act), n - 1)]
            by = np.argsort(both, kind="stable").astype(kind)
            act, both = act[by], both[by]
            order[at] = act
            new = np.append(True, both[1:] != both[:-1])
            del by, both
            rank[act] = np.maximum.accumulate(np.where(new, at, kind.type(0)))
            at = at[~(new & np.append(new[1:], True))]
            step *= 2
        return order

    @staticmethod
    def _common(text, a, b, left) -> np.ndarray:
        """Length of the common prefix of each pair of suffixes, within their strings."""
        most = np.minimum(left[a], left[b])
        eight = np.ndarray((len(text) - 7,), "<u8", text, 0, (1,))
        out = np.zeros(len(a), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            x = eight[a[live] + out[live]] ^ eight[b[live] + out[live]]
            same = x == 0
            out[live] += np.where(same, 8, np.bitwise_count((x & (~x + T.U64(1))) - T.U64(1)).astype(np.int64) >> 3)
            live = live[same & (out[live] < most[live])]
        return np.minimum(out, most)

    def matching_statistics(self) -> np.ndarray:
        """For each position the length of the longest match that starts elsewhere.

        Between run ends the match found to either side moves along with the
        text and so loses one byte with each step; only sampled ends are read.
        """
        best = np.zeros(self.n, self.kind)
        np.maximum.at(best, self.head[1:], self.head[1:] + self.common[1:])
        np.maximum.at(best, self.tail[:-1], self.tail[:-1] + self.common[1:])
        best = np.maximum.accumulate(best)
        best -= np.arange(self.n, dtype=self.kind)
        return np.maximum(best, 0, out=best)


def _stretches(length: int, gram: int):
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tk = (batch.column(i).to_numpy() for i in (0, 1))
            for i, _, raw, at in T.chunks(batch.column(2)):
                row = np.repeat(np.arange(len(at) - 1), np.diff(at))
                n = len(raw) - length + 1
                if n <= 0:
                    continue
                grams = T.window_hash(raw, gram, T.BASES[0])
                lo, hi, low = T.winnow(grams, length - gram + 1, row[:n] == row[length - 1 :])
                text = raw.tobytes()
                digest = np.frombuffer(b"".join([xxhash.xxh3_128_digest(text[a:b]) for a, b in zip(lo.tolist(), (hi + length).tolist(), strict=True)]), "<i8").reshape(-1, 2)
                r = row[lo] if len(lo) else lo
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[low].view(np.int64)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(doc[i + r]), pa.array(tk[i + r])]
                    + [pa.array((x - at[r]).astype(np.int32)) for x in (lo, lo, hi)],
                    names=["h", "d1", "d2", *OWNER],
                )

    return make


def _classes(stretches: DataFrame, length: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Marks of stretches that occur twice or more, and one of each class (with its count m) where a key has several.

    big: whether the key's classes have more text than ``limit`` bytes.
    """
    met = stored(stretches.groupBy("h").count().where("count > 1").select("h"))  # a plain side, so that a hot key's partition can be split
    some = stored(stretches.join(met, "h", "left_semi"))
    classes = stored(some.groupBy("h", "d1", "d2").agg(F.count(F.lit(1)).alias("m"), F.min(F.struct(*OWNER)).alias("p")))
    full = some.join(classes.where("m > 1").select("h", "d1", "d2"), ["h", "d1", "d2"], "left_semi").select("_doc", "_tk", "lo", "hi")
    size = F.sum(F.col("p.hi") - F.col("p.lo") + length)
    several = classes.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("m").alias("least"), (size > limit).alias("big"))
    several = stored(several.where("n > 1 and least = 1").select("h", "big"))
    return full, classes.join(several, "h").select("h", "m", "big", "p.*")


CONTENT = "h long, m long, big boolean, _doc long, _tk long, lo int, hi int, content binary"
_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]


def _content_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["h", "m", "big", "_doc", "_tk", "lo", "hi", "content"]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)], names=names)


def _contents(mixed: DataFrame, texts: DataFrame, by: list[str], length: int) -> DataFrame:
    """The bytes of each stretch, cut from ``_text``, which starts at byte ``at`` of its document; ``by`` names a text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offset = T.text_bytes(batch.column(3))
            for doc, tk, at, a, parts in zip(*(batch.column(k).to_pylist() for k in range(3)), offset[:-1].tolist(), batch.column(4).to_pylist(), strict=True):
                a -= at
                yield _content_batch([(p["h"], p["m"], p["big"], doc, tk, p["lo"], p["hi"], raw[a + p["lo"] : a + p["hi"] + length].tobytes()) for p in parts])

    wanted = mixed.groupBy(*by).agg(F.collect_list(F.struct("h", "m", "big", "lo", "hi")).alias("parts"))
    return texts.join(wanted, by).select("_doc", "_tk", "at", "_text", "parts").mapInArrow(cut, CONTENT)


def _indexed(contents: DataFrame, length: int, limit: int) -> DataFrame:
    """Marks (without content) from an index over each batch of keys; rows of big keys come back as they are."""

    def mark(rows: list[tuple]) -> Iterator[tuple]:
        index = RunLengthIndex([r[7] for r in rows])
        ms = index.matching_statistics()
        for r, a in zip(rows, index.start.tolist(), strict=True):
            if r[1] > 1:
                continue
            hit = np.flatnonzero(ms[a : a + r[6] - r[5] + 1] >= length)
            if len(hit):
                first = np.append(True, np.diff(hit) > 1)
                ends = np.append(np.flatnonzero(first)[1:], len(hit)) - 1
                for x, y in zip(hit[first].tolist(), hit[ends].tolist(), strict=True):
                    yield (None, 0, False, r[3], r[4], r[5] + x, r[5] + y, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []  # of whole keys
        held: list[tuple] = []  # of the last key
        done_size = held_size = 0

        def flush():
            if any(r[1] == 1 for r in done) and (rows := list(mark(done))):
                yield _content_batch(rows)

        for batch in batches:
            passed = []
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r[2]:
                    passed.append(r)
                    continue
                if held and r[0] != held[0][0]:
                    if done_size + held_size > limit:
                        yield from flush()
                        done, done_size = [], 0
                    done += held
                    done_size += held_size
                    held, held_size = [], 0
                held.append(r)
                held_size += len(r[7])
            if passed:
                yield _content_batch(passed)
        if done_size + held_size > limit:
            yield from flush()
            done = []
        done += held
        yield from flush()

    # a big key's rows are dealt out by their place, any other key's go together
    dealt = F.when(F.col("big"), F.xxhash64("_doc", "_tk", "lo")).otherwise(F.lit(0).cast("long"))
    return contents.repartition(F.col("h"), dealt).sortWithinPartitions("h").mapInArrow(run, CONTENT)


def _by_blocks(over: DataFrame, length: int, gram: int, limit: int, block: int = 16) -> DataFrame:
    """Marks for keys with very much text, by blocks of windows.

    Blocks lie alike relative to the minimiser, so what all windows of a block
    share is a new key: equal windows meet under it. Blocks equal as a whole
    collapse; different ones go to an index by their key. Windows of keys that
    are big again, of which there is one place or two around a long text that
    very many documents hold, are counted one by one.
    """

    def dealt(out: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if k < 5 else pa.int32()) for k, c in enumerate(out)], names=["h", "d1", "d2", *OWNER])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for _, m, _, doc, tk, lo, hi, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams = T.window_hash(np.frombuffer(text, np.uint8), gram, T.BASES[0])
                low = int(T.winnow(grams, length - gram + 1, np.ones(1, bool))[2][0])
                for b in range((0 - low) // block, (hi - lo - low) // block + 1):
                    first, a, z = b * block + low, max(0, b * block + low), min(hi - lo, b * block + block - 1 + low)
                    core = text[max(0, first + block - 1) : first + length]
                    d = xxhash.xxh3_128_digest(text[a : z + length])
                    for _ in range(min(m, 2)):
                        for k, v in enumerate((xxhash.xxh3_64_intdigest(core) - (1 << 63), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, tk, lo, lo + a, lo + z)):
                            out[k].append(v)
                if len(out[0]) >= PYTHON_ROWS:
                    yield dealt(out)
                    out = [[] for _ in range(8)]
            yield dealt(out)

    full, mixed = _classes(stored(over.mapInArrow(deal, STRETCH)), length, limit)
    texts = over.select("_doc", "_tk", F.col("lo").alias("at"), F.col("content").alias("_text"))
    found = stored(_indexed(_contents(mixed, texts, ["_doc", "_tk", "at"], length), length, limit))
    marks = full.union(found.where("content is null").select("_doc", "_tk", "lo", "hi"))

    def counted(out: list[list]) -> pa.RecordBatch:
        w = np.frombuffer(b"".join(out[4]), "<i8").reshape(-1, 2)
        return pa.RecordBatch.from_arrays(
            [pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), *(pa.array(c, pa.int64()) for c in out[:4])], names=["w1", "w2", "m", "_doc", "_tk", "s"]
        )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for _, m, _, doc, tk, lo, hi, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for s in range(hi - lo + 1):
                    for k, v in enumerate((m, doc, tk, lo + s, xxhash.xxh3_128_digest(text[s : s + length]))):
                        out[k].append(v)
                if len(out[0]) >= PYTHON_ROWS:
                    yield counted(out)
                    out = [[] for _ in range(5)]
            yield counted(out)

    again = found.where("content is not null")
    if again.isEmpty():
        return marks
    each = stored(again.mapInArrow(windows, "w1 long, w2 long, m long, _doc long, _tk long, s long"))
    twice = each.groupBy("w1", "w2").agg(F.sum("m").alias("n")).where("n > 1").select("w1", "w2")
    s = F.col("s").cast("int")
    return marks.union(each.where("m = 1").join(twice, ["w1", "w2"], "left_semi").select("_doc", "_tk", s.alias("lo"), s.alias("hi")))


def repeat_removal(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 64, index_bytes: int = 3 << 20
) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts anywhere else in the corpus.

    Returns ``doc_id, n_bytes, starts, ends`` (byte ranges removed, maximal)
    and ``kept`` (the other bytes) for every row. Matches never cross rows;
    overlapping occurrences count; a row that is given twice is two documents.
    A null or empty text, or one under ``length`` bytes, loses nothing; ids may
    be null or repeated; other columns are ignored. ``index_bytes``: the most
    text that one index is built over; larger keys are dealt out by blocks.
    """
    base = keyed(docs, id_col, text_col)
    full, mixed = _classes(stored(base.mapInArrow(_stretches(length, gram), STRETCH)), length, index_bytes)
    found = stored(_indexed(_contents(mixed, base.withColumn("at", F.lit(0)), ["_doc", "_tk"], length), length, index_bytes))
    marks = full.union(found.where("content is null").select("_doc", "_tk", "lo", "hi"))
    over = found.where("content is not null")
    if not over.isEmpty():
        marks = marks.union(_by_blocks(over, length, gram, index_bytes))
    marks = marks.groupBy("_doc", "_tk").agg(F.collect_list(F.struct("lo", "hi")).alias("p")).select(
        "_doc", "_tk", F.col("p.lo").alias("los"), F.col("p.hi").alias("his")
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, at = T.text_bytes(batch.column(1))
            los, of = T.list_column(batch.column(2))
            his, _ = T.list_column(batch.column(3))
            starts, ends, kept = [], [], []
            for i in range(batch.num_rows):
                text = raw[at[i] : at[i + 1]]
                a, b = T.union_length(los[of[i] : of[i + 1]].astype(np.int64), his[of[i] : of[i + 1]].astype(np.int64) + length)
                starts.append(a)
                ends.append(b)
                if len(a):
                    gone = np.zeros(len(text) + 1, np.int8)
                    gone[a], gone[b] = 1, -1
                    text = text[np.cumsum(gone[:-1], dtype=np.int8) == 0]
                kept.append(text.tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(starts, longs), pa.array(ends, longs), pa.array(kept, pa.binary())],
                names=["_doc", "n_bytes", "starts", "ends", "kept"],
            )

    return (
        base.join(marks, ["_doc", "_tk"], "left")
        .select("_doc", "_text", "los", "his")
        .mapInArrow(keep, "_doc long, n_bytes long, starts array<long>, ends array<long>, kept binary")
        .select(original_id().alias(id_col), "n_bytes", "starts", "ends", "kept")
    )


def op1_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    out = repeat_removal(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),  # a removed run may begin or end inside a character
    )
