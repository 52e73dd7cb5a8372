"""Sequence packing: shortest-pack-first over the length histogram.

Texts are tokenised once. A document's ids are cut at every ``width`` ids; only
the rests need packing. Their length histogram has at most ``width`` bins, so
the packing patterns are found on the driver whatever the number of documents:
lengths are placed longest first, each into the pack with the least in it that
has room, by counts of equal packs. Patterns join back to documents by rank:
the documents of a length are numbered with two-level counts (hash buckets,
then rows within a bucket), so that no length is sorted in one task.
"""

from __future__ import annotations

import base64
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from agrispark.llm.common import keyed, original_id
from agrispark.session import stored

PER_BUCKET = 20_000


def pack_histogram(counts: dict[int, int], width: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in their order) and how often each is used.

    Longest lengths first; each goes into the pack with the least in it, if it
    has room, else opens packs of its own. Equal packs are one entry with a
    count, which splits where only some of them take another length.
    """
    open_packs: list[tuple[int, int, tuple[int, ...], int]] = []  # (filled, age, lengths, count)
    age = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if open_packs and open_packs[0][0] + length <= width:
                filled, _, lengths, n = heapq.heappop(open_packs)
                take = min(n, left)
                if n > take:
                    heapq.heappush(open_packs, (filled, age, lengths, n - take))
                    age += 1
                heapq.heappush(open_packs, (filled + length, age, (*lengths, length), take))
                left -= take
            else:
                fits = width // length
                whole, rest = divmod(left, fits)
                for k, n in ((fits, whole), (rest, 1)):
                    if k and n:
                        heapq.heappush(open_packs, (k * length, age, (length,) * k, n))
                        age += 1
                left = 0
            age += 1
    return [(lengths, n) for _, _, lengths, n in sorted(open_packs)]


#: Runs of white space from this length on are too deep for the faster library's pattern matcher (it gives up at some 1,000,000).
LONG_BLANK = 100_000
BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")


class Encoder:
    """Ids as the ``tokenizers`` file gives them, by the faster ``tiktoken`` where the same vocabulary is there as ranks."""

    def __init__(self, path: str, end_id: int = 1):
        import tiktoken
        from pathlib import Path
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.end = end_id
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = Path(path).with_suffix(".tiktoken")
        if ranks.exists():
            import public_tokenizers

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        got = None
        if self.fast is not None and not any(s in text for s in self.special) and not (len(text) >= LONG_BLANK and BLANKS.search(text)):
            try:
                got = self.fast.encode_ordinary(text)
            except BaseException as error:  # what its pattern matcher gives up on is a panic, which is no Exception
                if not isinstance(error, ValueError) and type(error).__name__ != "PanicException":
                    raise
                got = None
        if got is None:
            got = self.slow.encode(text, add_special_tokens=False).ids
        got.append(self.end)
        return np.array(got, "<u4")


def squeezed(ids: np.ndarray) -> bytes:
    """Ids as zstd bytes after a byte that says how wide one is: two bytes where all are below 65,536, else four."""
    wide = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(ids.astype(f"<u{wide}").tobytes())


def unsqueezed(held: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(held[1:]), f"<u{held[0]}").astype("<u4")


def tokenized(docs: DataFrame, tokenizer: str, width: int, end_id: int, with_ids: bool) -> DataFrame:
    """``_doc, _tk, n`` (ids with the end id), ``crcs`` of the pieces and, if wanted, ``ids`` as ``squeezed`` makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(tokenizer, end_id)
        for batch in batches:
            n, crcs, ids = [], [], []
            for text in batch.column(2):
                x = enc.ids(text.as_py())
                n.append(len(x))
                crcs.append([zlib.crc32(x[a : a + width].tobytes()) for a in range(0, len(x), width)])
                ids.append(squeezed(x) if with_ids else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(ids, pa.binary())],
                names=["_doc", "_tk", "n", "crcs", "ids"],
            )

    return docs.mapInArrow(run, "_doc long, _tk long, n long, crcs array<long>, ids binary")


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 2048,
    end_id: int = 1,
    with_ids: bool = True,
) -> DataFrame:
    """Pack all documents into sequences of at most ``width`` tokens; one row for each piece.

    ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and
    ``ids`` (the piece's ids as little-endian bytes; null without
    ``with_ids``). Each id lies in one piece, pieces fill a sequence from
    offset 0 without gaps. A null or empty text is its end id alone. Rows alike
    in id and text are packed each for itself; null ids stay null; other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    tok = stored(tokenized(keyed(docs, id_col, text_col), tokenizer, width, end_id, with_ids))
    buckets = tok.count() // PER_BUCKET + 1
    rest, full = F.col("n") % width, F.floor(F.col("n") / width).cast("long")
    tok = tok.withColumns({"rest": rest, "full": full, "bucket": F.pmod(F.xxhash64("_doc", "_tk", F.lit(7)), F.lit(buckets))})
    sizes = tok.groupBy("rest", "bucket").agg(F.count(F.lit(1)).alias("rows"), F.sum("full").alias("fulls"))
    before = Window.partitionBy("rest").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "rest", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.coalesce(F.sum("fulls").over(before), F.lit(0)).alias("fulls_before")
    )
    totals = sizes.groupBy("rest").agg(F.sum("rows").alias("rows"), F.sum("fulls").alias("fulls")).collect()  # width rows at most

    places, sequence = [], 0
    taken: dict[int, int] = {}
    for lengths, n in pack_histogram({r["rest"]: r["rows"] for r in totals if r["rest"]}, width):
        at = 0
        slots: dict[int, list[int]] = {}
        for x in lengths:
            slots.setdefault(x, []).append(at)
            at += x
        for x, offs in slots.items():
            first = taken.get(x, 0)
            taken[x] = first + n * len(offs)
            places.append((x, first, taken[x], sequence, offs))
        sequence += n
    bases = []
    for r in totals:
        bases.append((r["rest"], sequence))
        sequence += r["fulls"]
    # Bounds: a row a length; each step of the packing ends a length or a pattern, so patterns stay a few thousand.
    bases = F.broadcast(spark.createDataFrame(bases, "rest long, full_base long"))
    places = F.broadcast(spark.createDataFrame(places, "rest long, lo long, hi long, seq_base long, offs array<long>"))

    order = Window.partitionBy("rest", "bucket").orderBy("_doc", "_tk")
    ranked = (
        tok.withColumns({"rank": F.row_number().over(order) - 1, "fulls_here": F.sum("full").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("full")})
        .join(offsets, ["rest", "bucket"])
        .join(bases, "rest")
        .withColumns({"rank": F.col("rank") + F.col("rows_before"), "full_base": F.col("full_base") + F.col("fulls_before") + F.col("fulls_here")})
    )
    r, p = ranked.alias("r"), places.alias("p")
    placed = r.join(p, (F.col("r.rest") == F.col("p.rest")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    k, q = F.size("offs"), F.col("rank") - F.col("lo")
    kinds = "_doc long, n long, crcs array<long>, full long, full_base long, rest long, seq long, off long, ids array<binary>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of documents to ids of their pieces, a part of a batch at a time."""
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                held = [unsqueezed(x) for x in part.column("ids").to_pylist()]
                pieces = [[x[b : b + width].tobytes() for b in range(0, len(x), width)] for x in held]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(pieces, pa.list_(pa.binary()))], names=part.schema.names)

    last = F.col("piece") >= F.col("full")
    start = F.col("piece").cast("long") * width
    length = F.when(last, F.col("rest")).otherwise(F.lit(width).cast("long"))
    placed = placed.select(
        "_doc", "n", "crcs", "full", "full_base", F.col("r.rest").alias("rest"),
        (F.col("seq_base") + F.floor(q / k)).alias("seq"), F.expr("element_at(offs, cast((rank - lo) % size(offs) as int) + 1)").alias("off"), "ids",
    )
    if with_ids:
        placed = placed.mapInArrow(cut, kinds)
    own = F.get("ids", F.col("piece")) if with_ids else F.col("ids")
    return placed.select("*", F.explode(F.sequence(F.lit(0), F.size("crcs") - 1)).alias("piece")).select(
        original_id().alias(id_col),
        start.alias("start"),
        length.alias("length"),
        F.element_at("crcs", F.col("piece") + 1).alias("ids_crc32"),
        F.col("n").alias("doc_tokens"),
        F.when(last, F.col("seq")).otherwise(F.col("full_base") + F.col("piece")).cast("long").alias("sequence_id"),
        F.when(last, F.col("off")).otherwise(F.lit(0).cast("long")).alias("offset"),
        own.alias("ids"),
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), with_ids=False).drop("ids")
