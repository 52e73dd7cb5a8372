"""Substring de-duplication on word windows behind a count-min prefilter.

1. Each partition makes a sparse count-min sketch of its windows' seeds (a
   window's seed is its least 8-word gram, so a seed occurs at least as often
   as any window that has it: the sketch overestimates window counts).
2. The sketches are merged block by block; what is left is one bit for each
   counter, "two or more", of a size fixed by ``width_bits``.
3. A second pass groups only the windows estimated repeated, by XXH3-128 of
   their words' bytes, and finds each one's first place; none is lost, as the
   estimate is never low.
4. Places join back to the texts; other places of a repeated window go.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from agrispark.llm import textops as T
from agrispark.llm.common import keyed, original_id, unzipped, zipped

ROWS = 2
BLOCK_BITS = 22


def _seeds(raw, at, window: int, gram: int):
    """Words, and runs of windows by seed: (first, last, seed) of each, over one chunk. Equal windows have equal seeds; others may."""
    start, stop, row = T.word_spans(raw, at)
    words = T.range_hash(raw, start, stop, T.BASES[0])
    grams = T.window_hash(words, gram, T.BASES[1])
    n = len(words) - window + 1
    valid = row[window - 1 :] == row[: max(n, 0)] if n > 0 else np.zeros(0, bool)
    lo, hi, low = T.winnow(grams, window - gram + 1, valid)
    return start, stop, row, lo, hi, grams[low]


def _counters(seed: np.ndarray, j: int, width_bits: int) -> np.ndarray:
    return (T.mix(seed + T.U64(0x632BE59BD9B4E019 * (j + 1) & (2**64 - 1))) >> T.U64(64 - width_bits)).astype(np.int64)


def sketch(docs: DataFrame, window: int = 20, gram: int = 8, width_bits: int = 27) -> np.ndarray:
    """The merged sketch of ``_text``: bits "two or more", ``ROWS`` rows of 2**width_bits.

    At most ROWS * 2**width_bits / 8 bytes (32 MB) reach the driver, whatever
    the input. A fuller sketch only lets more windows through to the exact pass.
    """
    block_bits = min(BLOCK_BITS, width_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.zeros(0, T.U64)]
            for _, _, raw, at in T.chunks(batch.column(0)):
                got.append(_seeds(raw, at, window, gram)[-1])
            seeds = np.concatenate(got)
            out = {"row": [], "block": [], "once": [], "more": []}
            for j in range(ROWS):
                at, n = np.unique(_counters(seeds, j, width_bits), return_counts=True)
                block = at >> block_bits
                first = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(at) else []
                for a, b in zip(first, np.append(first[1:], len(at)), strict=True) if len(at) else ():
                    low, more = (at[a:b] & ((1 << block_bits) - 1)).astype("<u4"), n[a:b] > 1
                    for k, v in zip(out, (j, int(block[a]), low[~more].tobytes(), low[more].tobytes()), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["row"], pa.int32()), pa.array(out["block"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["more"], pa.binary())],
                names=list(out),
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen = None, None

        def packed():
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([np.packbits(seen > 1).tobytes()], pa.binary())],
                names=["row", "block", "bits"],
            )

        for batch in batches:
            for row, block, once, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (row, block) != key:
                    if key is not None:
                        yield packed()
                    key, seen = (row, block), np.zeros(1 << block_bits, np.uint8)
                one = np.frombuffer(once, "<u4")
                seen[one] = np.minimum(seen[one] + 1, 2)
                seen[np.frombuffer(more, "<u4")] = 2
        if key is not None:
            yield packed()

    parts = docs.select("_text").mapInArrow(count, "row int, block int, once binary, more binary")
    merged = parts.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    bits = np.zeros((ROWS, 1 << (width_bits - 3)), np.uint8)
    per = 1 << (block_bits - 3)
    for r in merged.toLocalIterator():
        bits[r["row"], r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["bits"], np.uint8)
    return bits


def _repeated(bits: np.ndarray, seed: np.ndarray, width_bits: int) -> np.ndarray:
    """Whether the sketch has each seed at least twice."""
    out = np.ones(len(seed), bool)
    for j in range(ROWS):
        at = _counters(seed, j, width_bits)
        out &= (bits[j][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return out


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, width_bits: int = 27
) -> DataFrame:
    """Remove each word in a window of ``window`` words whose sequence starts earlier in the corpus.

    Returns ``doc_id, n_words, n_removed, kept_text`` for every row: kept words
    joined by one blank. Earlier: smaller id, or same id and earlier start.
    Null ids come last and count as one document; of rows that share an id
    but not the text, equal windows at the same start keep one. Rows alike in
    id and text are one document given twice: both get the same result; rows
    of one id are told apart by 64 bits of their text's hash. A
    null or empty text has no words. Other columns are ignored.
    """
    base = keyed(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(sketch(base, window, gram, width_bits))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tk = (batch.column(i).to_numpy() for i in (0, 1))
            for i, _, raw, at in T.chunks(batch.column(2)):
                start, stop, row, lo, hi, seed = _seeds(raw, at, window, gram)
                take = _repeated(shared.value, seed, width_bits)
                if not take.any():
                    continue
                w, _ = T.concat_ranges(lo[take], hi[take])
                text, a, b = T.joined_words(raw, start, stop, row)
                digest = xxhash.xxh3_128_digest
                two = np.frombuffer(b"".join([digest(text[x:y]) for x, y in zip(a[w].tolist(), b[w + window - 1].tolist(), strict=True)]), "<i8").reshape(-1, 2)
                first = np.searchsorted(row, np.arange(len(at) - 1), side="left")
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(two[:, k].copy()) for k in (0, 1)), pa.array(doc[i + row[w]]), pa.array((w - first[row[w]]).astype(np.int32)), pa.array(tk[i + row[w]])],
                    names=["k1", "k2", "_doc", "at", "_tk"],
                )

    firsts = (
        base.mapInArrow(places, "k1 long, k2 long, _doc long, at int, _tk long")
        .groupBy("k1", "k2")
        .agg(F.min(F.struct("_doc", "at", "_tk")).alias("p"))
        .groupBy(F.col("p._doc").alias("_doc"), F.col("p._tk").alias("_tk"))
        .agg(F.collect_list("p.at").alias("firsts"))
    )

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, of = T.list_column(batch.column(2))
            n_words, n_removed, kept = [], [], []
            for i, j, raw, at in T.chunks(unzipped(batch.column(1))):
                start, stop, row, lo, hi, seed = _seeds(raw, at, window, gram)
                gone = np.zeros(len(start) + 1, np.int64)
                take = _repeated(shared.value, seed, width_bits)
                w, _ = T.concat_ranges(lo[take], hi[take])
                first = np.searchsorted(row, np.arange(len(at)), side="left")
                mine, owner = flat[of[i] : of[j]], np.repeat(np.arange(j - i), np.diff(of[i : j + 1]))
                w = np.setdiff1d(w, mine + first[owner], assume_unique=True)
                np.add.at(gone, w, 1)
                np.subtract.at(gone, np.minimum(w + window, len(start)), 1)
                gone = np.cumsum(gone)[:-1] > 0
                text = raw.tobytes()
                for r in range(j - i):
                    a, b = first[r], first[r + 1]
                    n_words.append(b - a)
                    n_removed.append(int(gone[a:b].sum()))
                    kept.append(b" ".join([text[start[k] : stop[k]] for k in range(a, b) if not gone[k]]) if b > a else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["_doc", "n_words", "n_removed", "kept_text"],
            )

    return (
        zipped(base).join(firsts, ["_doc", "_tk"], "left")
        .select("_doc", "_text", "firsts")
        .mapInArrow(keep, "_doc long, n_words long, n_removed long, kept_text string")
        .select(original_id().alias(id_col), "n_words", "n_removed", "kept_text")
    )


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
