"""Near-duplicate groups: SimHash fingerprints linked through Golay-code keys.

A segment of a fingerprint, padded to 23 bits, has as keys the indices of all
codewords of the perfect Golay code within distance 4: one or six. Segments
that differ in at most two bits share a key, since the codeword nearest to a
point between them is within 3 + 1 of both.

Pigeonhole over segments of 22, 21 and 21 bits at up to 4 differing bits:
either a segment is equal, and of the other two one differs in at most two
bits (its codeword indices, with the equal segment, are keys); or every
segment differs, two of them in one bit and the third in at most two (half of
each of the two is equal; those halves with the third's codeword indices are
keys). Fingerprints that share a key are verified, and components are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from agrispark.llm import textops as T
from agrispark.llm.common import keyed, original_id
from agrispark.operators.components import connected_components
from agrispark.session import stored

#: Generator polynomial of the Golay code (fixed value).
GENERATOR = 0xAE3
SEGMENTS = ((0, 22), (22, 21), (43, 21))


def _code_tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of single bytes at their places, and each syndrome's error patterns of weight up to 4."""

    def rest(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    by_byte = np.array([[rest(b << s & 0x7FFFFF) for b in range(256)] for s in (0, 8, 16)], np.int64)
    of = [[] for _ in range(2048)]
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            of[rest(e)].append(e)
    return by_byte, np.array([x + [-1] * (6 - len(x)) for x in of], np.int64)


BY_BYTE, PATTERNS = _code_tables()


def code_indices(x: np.ndarray) -> np.ndarray:
    """For each 23-bit word the indices (12 bits) of the codewords within distance 4; -1 fills up to six."""
    s = BY_BYTE[0][x & 255] ^ BY_BYTE[1][x >> 8 & 255] ^ BY_BYTE[2][x >> 16 & 255]
    e = PATTERNS[s]
    return np.where(e < 0, -1, (x[:, None] ^ e) >> 11)


def _codewords() -> np.ndarray:
    """The 4096 codewords by index, as rows of 23 signs."""
    words = np.zeros(4096, np.int64)
    for i in range(12):
        words ^= np.where(np.arange(4096) >> i & 1, GENERATOR << i, 0)
    of = np.zeros(4096, np.int64)
    of[words >> 11] = words
    return ((of[:, None] >> np.arange(23) & 1) * 2 - 1).astype(np.float32)


CODEWORDS = _codewords()


def likely_indices(vote: np.ndarray, most: int) -> np.ndarray:
    """For each row of votes of a segment the indices of the ``most`` codewords that agree best with them.

    The votes say how sure each bit is, so the codewords named are those that
    another text's segment is likely near to, though many weak bits may differ.
    """
    out = []
    for i in range(0, len(vote), 512):
        part = vote[i : i + 512].astype(np.float32)
        part /= np.abs(part).max(axis=1, keepdims=True) + 1e-9
        out.append(np.argpartition(-(part @ CODEWORDS[:, : part.shape[1]].T), most, axis=1)[:, :most])
    return np.concatenate(out) if out else np.zeros((0, most), np.int64)


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys of 64-bit fingerprints, and the row that each key is of."""
    seg = [(fp >> T.U64(a) & T.U64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    code = [code_indices(s) for s in seg]
    rows, keys = [], []

    def add(family: int, rest: np.ndarray, k: int) -> None:
        row, slot = np.nonzero(code[k] >= 0)
        keys.append(family << 56 | rest[row] << 12 | code[k][row, slot])
        rows.append(row)

    for i in range(3):
        j, k = [x for x in range(3) if x != i]
        for other in (j, k):
            add(i * 3 + other, seg[i], other)
        for a, left in enumerate((seg[j] >> 11, seg[j] & 0x7FF)):
            for b, right in enumerate((seg[k] >> 11, seg[k] & 0x7FF)):
                add(16 + i * 4 + a * 2 + b, left << 11 | right, i)
    return np.concatenate(keys), np.concatenate(rows)


def spanning_links(fp: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links between distinct fingerprints at up to ``most`` bits that connect all that such links connect."""
    left = np.arange(len(fp))
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = np.bitwise_count(fp[left] ^ fp[i]) <= most
            for j in left[near].tolist():
                yield i, j
                queue.append(j)
            left = left[~near]


def shingle_hashes(raw: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of the shingles of each row, A-Z lower-cased, and the number of each row's; fewer words are one shingle."""
    digest = xxhash.xxh64_intdigest
    raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    start, stop, row = T.word_spans(raw, at)
    n = np.bincount(row, minlength=len(at) - 1)
    text, begin, end = T.joined_words(raw, start, stop, row)
    first = np.cumsum(n) - n
    count = np.where(n >= shingle, n - shingle + 1, (n > 0).astype(n.dtype))
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    a, b = begin[k], end[k + np.minimum(shingle, np.maximum(n, 1))[owner] - 1]
    return np.array([digest(text[x:y], 42) for x, y in zip(a.tolist(), b.tolist(), strict=True)], T.U64), count


def votes(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each row with hashes and each of the 64 bits: how many more of its hashes have the bit than lack it."""
    some = np.flatnonzero(count)
    if not len(some):
        return np.zeros((0, 64), np.int64)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return 2 * np.add.reduceat(bits, (np.cumsum(count) - count)[some], axis=0, dtype=np.int64) - count[some][:, None]


def packed(vote: np.ndarray) -> np.ndarray:
    return np.packbits(vote > 0, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``_doc, fp`` for every row of ``keyed`` texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = []
            for _, _, raw, at in T.chunks(batch.column(1)):
                h, count = shingle_hashes(raw, at, shingle)
                fp = np.zeros(len(count), T.U64)
                fp[count > 0] = packed(votes(h, count))
                fps.append(fp)
            fp = np.concatenate(fps) if fps else np.zeros(0, T.U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["_doc", "fp"])

    return docs.select("_doc", "_text").mapInArrow(make, "_doc long, fp long")


def _pairs(first: list[int], second: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64())], names=["u", "v"])


def link_fingerprints(distinct: DataFrame, most: int = 4, block: int = 2048) -> DataFrame:
    """Links ``u, v`` between distinct fingerprints ``fp``, enough to connect all at up to ``most`` (4) bits.

    Of a key's fingerprints only links that span its connected parts come out.
    A key with more than ``block`` of them is checked in pairs of blocks, each
    pair a group of its own, so memory stays bounded and no link is lost.
    """
    if most > 4:
        raise ValueError("the keys are complete for up to 4 differing bits")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch.column(0).to_numpy()
            for i in range(0, len(all_fp), 4096):
                fp = all_fp[i : i + 4096]
                keys, rows = keys_of(fp.view(T.U64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], names=["key", "fp"])

    def near(fp: np.ndarray, out: tuple[list, list]) -> None:
        for i, j in spanning_links(fp.view(T.U64), most):
            out[0].append(int(fp[i]))
            out[1].append(int(fp[j]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "block", "u", "v"]
        key, held, n_blocks = None, np.zeros(0, np.int64), 0

        def overflow(k, number, fp):
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(fp), k)), pa.array(np.full(len(fp), number, np.int32)), pa.array(fp), pa.array(fp)], names=names
            )

        def found(out):
            n = len(out[0])
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *_pairs(*out).columns], names=names)

        for batch in batches:
            keys, fps = (c.to_numpy() for c in batch.columns)
            if not len(keys):
                continue
            out: tuple[list, list] = ([], [])
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(first[1:], len(keys))
            whole = (first > 0) & (ends < len(keys)) & (ends - first > 1)
            pair = whole & (ends - first == 2)
            a, b = fps[first[pair]], fps[first[pair] + 1]
            ok = (np.bitwise_count(a.view(T.U64) ^ b.view(T.U64)) <= most) & (a != b)
            out[0].extend(a[ok].tolist())
            out[1].extend(b[ok].tolist())
            for s, e in zip(first.tolist(), ends.tolist(), strict=True) if len(first) <= 2 else [
                (0, int(ends[0])), *zip(first[whole & ~pair].tolist(), ends[whole & ~pair].tolist(), strict=True), (int(first[-1]), len(keys))
            ]:
                if s > 0 and e < len(keys) and e - s <= block:
                    near(fps[s:e], out)
                    continue
                if keys[s] != key:
                    if n_blocks:
                        yield overflow(key, n_blocks, held)
                    elif len(held) > 1:
                        near(held, out)
                    key, held, n_blocks = keys[s], np.zeros(0, np.int64), 0
                held = np.concatenate([held, fps[s:e]])
                while len(held) > block:
                    yield overflow(key, n_blocks, held[:block])
                    held, n_blocks = held[block:], n_blocks + 1
            if out[0]:
                yield found(out)
        out = ([], [])
        if n_blocks:
            yield overflow(key, n_blocks, held)
        elif len(held) > 1:
            near(held, out)
            yield found(out)

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for k, i, j, fp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (k, i, j) != group:
                    near(np.array(held, np.int64), out)
                    group, held = (k, i, j), []
                held.append(fp)
            if out[0]:
                yield _pairs(*out)
        out = ([], [])
        near(np.array(held, np.int64), out)
        yield _pairs(*out)

    found = stored(
        distinct.select("fp")
        .mapInArrow(deal, "key long, fp long")
        .repartition("key")
        .sortWithinPartitions("key")
        .mapInArrow(search, "key long, block int, u long, v long")
    )
    links = found.where("key is null").select("u", "v")
    over = found.where("key is not null").select("key", "block", F.col("u").alias("fp"))
    if not over.isEmpty():
        blocks = over.groupBy("key").agg(F.max("block").alias("last"))
        other = F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other")
        each = over.join(blocks, "key").select("key", "block", "fp", other)
        each = each.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp")
        links = links.union(each.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(cross, "u long, v long"))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, most: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    fp: the SimHash of the text's ``shingle``-word shingles (A-Z lower-cased,
    repeats counted) as a signed long. component_id: the smallest id reachable
    over fingerprints at up to ``most`` differing bits. Equal fingerprints are
    linked, so texts without a word (null and empty ones too), whose
    fingerprint is zero, form one class; ids may repeat; a null id counts
    as the largest and is null where a class has no other. Columns beside the
    two are ignored.
    """
    prints = stored(fingerprints(keyed(docs, id_col, text_col), shingle))
    classes = stored(prints.groupBy("fp").agg(F.min("_doc").alias("low")))
    parts = connected_components(link_fingerprints(classes, most)).select(F.col("id").alias("fp"), "component")
    group = F.coalesce(F.col("component"), F.col("fp"))
    classes = classes.join(parts, "fp", "left").select("fp", "low", group.alias("group"))
    lowest = classes.groupBy("group").agg(F.min("low").alias("lowest"))
    whole = classes.join(lowest, "group").select("fp", "lowest")
    return prints.join(whole, "fp").select(original_id().alias(id_col), "fp", original_id("lowest").alias("component_id"))


def op2_simhash_golay(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
