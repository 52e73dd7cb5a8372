"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. An item's seeds are n-grams
so short that a copy with up to a fifth of its words replaced, dropped or put
in between still has one of them whole (pigeonhole: 4 words, fewer for items
under 16 words, the whole item under 5). The corpus frequency of each n-gram is
counted over all documents; an item's rare n-grams are its seeds. Where a seed
stands in a document, the words around it are aligned with the item, and the
share of the item's words that the best local alignment matches is the
similarity. The benchmark is the stated query set: it is taken in blocks of
items of bounded size, each against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agrispark.llm import textops as T
from agrispark.llm.common import keyed, original_id

#: Bytes between words: all of ASCII but letters and digits.
GAP = np.ones(256, bool)
GAP[128:] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    GAP[_a:_b] = False
#: Score of a match and cost of a mismatch or a gap; a match also counts one in the low bits.
MATCH, MISS, COUNT = 2, 1, 1 << 20


class Words:
    """The words of a chunk of lower-cased texts from row ``first`` on: a hash to look seeds up by, and the bytes for what is found."""

    def __init__(self, first: int, raw: np.ndarray, at: np.ndarray):
        self.first, self.raw = first, raw
        self.start, self.stop, self.row = T.word_spans(raw, at, GAP)
        self.hash = T.range_hash(raw, self.start, self.stop, T.BASES[0])
        self.offset = np.searchsorted(self.row, np.arange(len(at)))

    def said(self, lo: int, hi: int) -> list[bytes]:
        base = int(self.start[lo]) if lo < hi else 0
        text = self.raw[base : self.stop[hi - 1]].tobytes() if lo < hi else b""
        return [text[a - base : b - base] for a, b in zip(self.start[lo:hi].tolist(), self.stop[lo:hi].tolist(), strict=True)]


def words_of(column: pa.Array) -> Iterator[Words]:
    low = pa.array([(x or "").lower() for x in column.to_pylist()], pa.large_string())
    for i, _, raw, at in T.chunks(low):
        yield Words(i, raw, at)


def best_alignment(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """(matched words, end) of the best local alignment of two word sequences (Smith-Waterman, linear gaps)."""
    n = len(text)
    ramp = np.arange(n + 1, dtype=np.int64) * (MISS * COUNT)
    above = np.zeros(n + 1, np.int64)
    best, end = 0, 0
    for w in item:
        here = np.zeros(n + 1, np.int64)
        step = np.where(text == w, MATCH * COUNT + 1, -MISS * COUNT)
        np.maximum(above[:-1] + step, above[1:] - MISS * COUNT, out=here[1:])
        np.maximum(here, 0, out=here)
        here = np.maximum.accumulate(here + ramp) - ramp
        here[here < COUNT] = 0
        k = int(here.argmax())
        if here[k] > best:
            best, end = int(here[k]), k
        above = here
    return best & (COUNT - 1), end


def seed_width(n_words: int, similarity: float, most: int) -> int:
    """Words in the longest run that is left whole by as many edits as the similarity allows, ``most`` at most."""
    edits = int(n_words * (1 - similarity) + 1e-9)
    return max(1, min(most, -(-(n_words - edits) // (edits + 1))))


class Seeds:
    """The n-grams of a block of items that are ``width`` words wide, as arrays: their hashes, and the places of each.

    Hashes only find places; what is found there is aligned by the words themselves.
    """

    def __init__(self, width: int, sequences: list[np.ndarray], items: list[int]):
        self.width = width
        grams = [T.window_hash(sequences[k], width, T.BASES[1]) for k in items]
        size = np.array([len(g) for g in grams], np.int64)
        self.table, place = np.unique(np.concatenate(grams) if grams else np.zeros(0, T.U64), return_inverse=True)
        order = np.argsort(place, kind="stable")
        self.gram = place[order]
        self.item = np.repeat(np.array(items, np.int64), size)[order]
        self.place = (np.arange(len(place)) - np.repeat(np.cumsum(size) - size, size))[order]
        self.start = np.searchsorted(self.gram, np.arange(len(self.table) + 1))
        self.small = np.zeros(1 << 20, bool)
        self.small[(self.table >> T.U64(44)).astype(np.int64)] = True

    def hits(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions whose gram is in the table, and its number there."""
        h = T.window_hash(words, self.width, T.BASES[1])
        if not len(h) or not len(self.table):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.small[(h >> T.U64(44)).astype(np.int64)] & (row[self.width - 1 :] == row[: len(h)]))
        number = np.searchsorted(self.table, h[at])
        same = self.table[np.minimum(number, len(self.table) - 1)] == h[at]
        return at[same], number[same]

    def keep_rare(self, frequency: np.ndarray) -> None:
        """Drops places whose gram is over 8 times as frequent as the item's median gram; half of an item's places always stay."""
        own = frequency[self.gram]
        order = np.lexsort((own, self.item))
        first = np.searchsorted(self.item[order], self.item[order], side="left")
        last = np.searchsorted(self.item[order], self.item[order], side="right")
        median = own[order][(first + last) // 2]
        keep = np.zeros(len(own), bool)
        keep[order] = own[order] <= np.maximum(64, 8 * median)
        self.gram, self.item, self.place = self.gram[keep], self.item[keep], self.place[keep]
        self.start = np.searchsorted(self.gram, np.arange(len(self.table) + 1))


def _block(base: DataFrame, items: list[tuple[int, str]], gram: int, similarity: float) -> DataFrame:
    sc = base.sparkSession.sparkContext
    spoken = [(w, int(w.offset[r]), int(w.offset[r + 1])) for w in words_of(pa.array([t for _, t in items], pa.string())) for r in range(len(w.offset) - 1)]
    sequences = [w.hash[a:b] for w, a, b in spoken]
    said = [w.said(a, b) for w, a, b in spoken]
    by_width: dict[int, list[int]] = {}
    for k, w in enumerate(sequences):
        if len(w):
            by_width.setdefault(seed_width(len(w), similarity, gram), []).append(k)
    tables = [Seeds(width, sequences, own) for width, own in sorted(by_width.items())]
    shared = sc.broadcast(tables)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(len(t.table), np.int64) for t in shared.value]
        for batch in batches:
            for w in words_of(batch.column(0)):
                for t, total in zip(shared.value, totals, strict=True):
                    at, number = t.hits(w.hash, w.row)
                    one = np.unique(w.row[at] * max(len(total), 1) + number) % max(len(total), 1)
                    total += np.bincount(one, minlength=len(total))
        for k, total in enumerate(totals):
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(total[some])], names=["of", "gram", "n"])

    # a row for each gram of the block at most
    counted = base.select("_text").mapInArrow(frequency, "of int, gram long, n long").groupBy("of", "gram").agg(F.sum("n").alias("n")).toPandas()
    for k, t in enumerate(tables):
        df = np.zeros(len(t.table), np.int64)
        own = counted[counted["of"] == k]
        df[own["gram"].to_numpy(np.int64)] = own["n"].to_numpy(np.int64)
        t.keep_rare(df)
    found = sc.broadcast((tables, said, [i for i, _ in items]))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, said, ids = found.value
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            doc = batch.column(0).to_pylist()
            for w in words_of(batch.column(1)):
                i, row, offset = w.first, w.row, w.offset
                near: dict[tuple[int, int], list[int]] = {}
                for t in tables:
                    at, number = t.hits(w.hash, row)
                    place, owner = T.concat_ranges(t.start[number], t.start[number + 1] - 1)
                    for r, k, line in zip(row[at[owner]].tolist(), t.item[place].tolist(), (at[owner] - t.place[place]).tolist(), strict=True):
                        near.setdefault((r, k), []).append(line)
                for (r, k), lines in near.items():
                    best, numbers = (0, 0), {x: n for n, x in enumerate(dict.fromkeys(said[k]))}
                    item = np.array([numbers[x] for x in said[k]])
                    lines.sort()
                    pad = len(item) // 4 + gram
                    first = last = lines[0]
                    for x in [*lines[1:], None]:
                        if x is not None and x - last <= len(item):
                            last = x
                            continue
                        lo, hi = max(offset[r], first - pad), min(offset[r + 1], last + len(item) + pad)
                        m, end = best_alignment(item, np.array([numbers.get(x, -1) for x in w.said(lo, hi)], np.int64))
                        best = max(best, (m, int(lo + end - offset[r])))
                        if x is not None:
                            first = last = x
                    share = best[0] / len(item)
                    if share >= similarity - 1e-9:
                        for c, v in zip(out, (doc[i + r], ids[k], share, best[1], len(lines)), strict=True):
                            c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["_doc", "item_id", "similarity", "end_word", "n_seeds"])

    return base.select("_doc", "_text").mapInArrow(align, "_doc long, item_id long, similarity double, end_word long, n_seeds long")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    gram: int = 4,
    similarity: float = 0.8,
    block_items: int = 20_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """Documents that hold a copy, verbatim, edited or paraphrased in part, of a benchmark item.

    One row for each pair: ``doc_id, item_id, similarity`` (share of the item's
    words in the best alignment, at least ``similarity``), ``end_word`` and
    ``n_seeds``. Copies with up to a fifth of the words edited are found unless
    all n-grams left whole are over 8 times as frequent as the item's median
    one. An item of under 5 words matches where it stands word for word; null
    and empty texts and items match nothing; a document or item row that is
    repeated gives repeated rows. A block of items that is broadcast has at
    most ``block_items`` items and about ``block_chars`` characters, so some
    50 MB of arrays.
    """
    base = keyed(docs, id_col, text_col)
    out, block, chars = None, [], 0

    def close():
        nonlocal out, block, chars
        part = _block(base, block, gram, similarity)
        out = part if out is None else out.unionByName(part)
        block, chars = [], 0

    for r in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).toLocalIterator():
        if block and (len(block) >= block_items or chars + len(r[1]) > block_chars):
            close()
        block.append((r[0], r[1]))
        chars += len(r[1])
    if block or out is None:
        close()
    return out.select(original_id().alias(id_col), "item_id", "similarity", "end_word", "n_seeds")


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
