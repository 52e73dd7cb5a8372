"""Vectorised helpers for whole texts inside Arrow batches.

A batch's texts are worked on as one byte array, in chunks of about a quarter
of a megabyte (a longer text is a chunk of its own), so memory follows the
longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes that separate words: blank and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Odd multipliers of the polynomial hashes (fixed values).
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
POSITION = U64((1 << 31) - 1)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 20)

        def run(b: int) -> np.ndarray:
            x = np.full(size, b, dtype=U64)
            x[0] = 1
            return np.cumprod(x, dtype=U64)

        have = _powers[base] = run(base), run(pow(base, -1, 1 << 64))
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def range_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[start:end] for each pair, by prefix sums. For choosing only: unlike values may share it."""
    n = len(values)
    up, down = powers(base, n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def window_hash(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """range_hash of every run of ``width`` values, for choosing only."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    up, down = powers(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=U64)
    np.cumsum((values.astype(U64) + U64(1)) * up[: len(values)], out=total[1:])
    return mix((total[width:] - total[:-width]) * down[:n])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty), and each row's first byte; one more offset at the end."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with at most ``limit`` bytes, or one long row."""
    raw, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def word_spans(raw: np.ndarray, at: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end byte and row of each word (by default ``[^\\x20\\x09-\\x0D]+``); words never cross rows."""
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~gap[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    first, last = solid.copy(), solid
    first[1:] &= ~solid[:-1] | edge[1:-1]
    end = solid.copy()
    end[:-1] &= ~last[1:] | edge[1:-1]
    start, stop = np.flatnonzero(first), np.flatnonzero(end) + 1
    return start, stop, np.searchsorted(at, start, side="right") - 1


def span_codes(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each of the ascending, disjoint spans, the same for equal bytes only, and the bytes of each number."""
    edge = np.zeros(len(raw) + 1, np.int8)
    np.add.at(edge, start, 1)
    np.subtract.at(edge, stop, 1)
    inside = raw[np.cumsum(edge[:-1], dtype=np.int8) > 0]
    ends = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    spans = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(inside)])
    coded = spans.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def window_codes(code: np.ndarray, width: int) -> np.ndarray:
    """A number for each run of ``width`` codes, the same for equal runs only."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    own = int(code.max()) + 1
    out, size = code[:n], own
    for k in range(1, width):
        if size > (1 << 62) // own:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            size = int(out.max()) + 1
        out, size = out * own + code[k : n + k], size * own
    return out


def repeats_in_row(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For places in order of their rows: whether the code stood before in the row, and whether it stands there twice or more."""
    order = np.argsort(code, kind="stable")
    same = (code[order[1:]] == code[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    before = np.zeros(len(code), bool)
    before[order[1:]] = same
    twice = before.copy()
    twice[order[:-1]] |= same
    return before, twice


def joined_words(raw: np.ndarray, start: np.ndarray, stop: np.ndarray, row: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words with one blank between those of a row, and each word's first and end byte there."""
    keep = ~SPACE[raw]
    gap = stop[:-1][row[1:] == row[:-1]] if len(row) else stop
    keep[gap] = True
    place = np.cumsum(keep) - 1
    raw = raw.copy()
    raw[gap] = 32
    return raw[keep].tobytes(), place[start] if len(start) else start, place[stop - 1] + 1 if len(stop) else stop


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def winnow(grams: np.ndarray, per_window: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows that share their minimiser.

    A window is ``per_window`` consecutive grams; its minimiser is the
    leftmost gram with the least hash. Equal windows have equal minimisers at
    the same place, so they meet under the minimiser's hash. valid: whether
    each window counts. Returns first window, last window and minimiser's
    position of each run.
    """
    n = len(grams) - per_window + 1
    z = np.zeros(0, np.int64)
    if n <= 0:
        return z, z, z
    key = (grams & ~POSITION) | np.arange(len(grams), dtype=U64)
    low = (sliding_min(key, per_window) & POSITION).astype(np.int64)
    at = np.flatnonzero(valid[:n])
    if not len(at):
        return z, z, z
    low = low[at]
    new = np.ones(len(at), bool)
    new[1:] = (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last], low[first]


def concat_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of lo..hi (inclusive) and the number of the range each comes from."""
    n = hi - lo + 1
    owner = np.repeat(np.arange(len(lo)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return lo[owner] + inside, owner


def union_length(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open ranges."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def list_column(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column of integers (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
