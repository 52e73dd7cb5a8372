"""Near copies by shared word shingles: the SimHash operator for a similarity of texts in place of a distance of fingerprints.

Texts with equal sets of shingles form a class. The class's SimHash votes over
its set are cut into the fingerprint's three segments. Sets at a similarity of
0.8 differ in 10 of 64 bits in the mean, too many for keys by distance; but a
segment decoded to the six codewords of the Golay code that agree best with
its votes shares one with that of such a set in 19 of 20 cases. Pigeonhole: of
the three segments two share one in 99 of 100 cases, so the pairs of codeword
indices of two segments, 3 x 36, are the keys.

Every set also has 128 further SimHash bits. Sets that share a key and differ
in up to ``DISTANCE`` of these, which unlike sets do in two of a million cases,
are compared whole: first each with two in the middle of its groups, then, group by
group, those that are not connected yet. A large group is compared in parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from agrispark.llm import textops as T
from agrispark.llm.common import keyed
from agrispark.llm.simhash_golay import SEGMENTS, likely_indices, packed, shingle_hashes, votes
from agrispark.operators.components import connected_components
from agrispark.session import stored

#: Codewords of a segment, and the most of the 128 further bits in which sets may differ (at a similarity of 0.8: 19.3 in the mean, deviation 4.1).
CODES, DISTANCE = 6, 36
#: What makes further hashes of a shingle's (fixed values).
FURTHER = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Members of a key that are sorted out by their further bits in one piece; groups of more are compared whole.
MOST_AT_ONCE = 1 << 15


def shingle_sets(raw: np.ndarray, at: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, and their offsets; a text of fewer words is one shingle."""
    grams, count = shingle_hashes(raw, at, shingle)
    owner = np.repeat(np.arange(len(count)), count)
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(count)))]).astype(np.int64)


def set_links(grams: np.ndarray, at: np.ndarray, similarity: float) -> Iterator[tuple[int, int]]:
    """Links between sets at ``similarity`` and more (Jaccard) that connect all that such links connect."""
    _, code = np.unique(grams, return_inverse=True)
    size = np.diff(at)
    mark = np.zeros(len(code) and int(code.max()) + 1, bool)
    left = np.ones(len(size), bool)
    while left.any():
        i = int(left.argmax())
        left[i] = False
        queue = [i]
        while queue and left.any():
            i = queue.pop()
            mine = code[at[i] : at[i + 1]]
            mark[mine] = True
            both = np.add.reduceat(mark[code], at[:-1], dtype=np.int64)
            mark[mine] = False
            near = left & (both >= similarity * (size + size[i] - both) - 1e-9)
            for j in np.flatnonzero(near).tolist():
                yield i, j
                queue.append(j)
            left &= ~near


def further_bits(grams: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Two words of SimHash bits for each row with hashes."""
    return np.stack([packed(votes(T.mix(grams ^ T.U64(x)), count)) for x in FURTHER], axis=1)


def linked(bits: np.ndarray) -> np.ndarray:
    """For each row of bits the number of the first row that it is connected to by rows within ``DISTANCE`` bits."""
    up, left = np.arange(len(bits)), np.arange(len(bits))
    while len(left):
        root, queue, left = int(left[0]), [int(left[0])], left[1:]
        while queue and len(left):
            near = np.bitwise_count(bits[left] ^ bits[queue.pop()]).sum(axis=1) <= DISTANCE
            up[left[near]] = root
            queue += left[near].tolist()
            left = left[~near]
    return up


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in T.chunks(batch.column(2)):
                grams, offsets = shingle_sets(raw, at, shingle)
                h = [xxhash.xxh3_64_intdigest(grams[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                size = np.diff(offsets)
                vote = votes(grams, size)
                bits = np.zeros((j - i, len(FURTHER)), T.U64)
                bits[size > 0] = further_bits(grams, size)
                codes = np.concatenate([likely_indices(vote[:, a : a + n], CODES) for a, n in SEGMENTS], axis=1)
                ends = np.concatenate([[0], np.cumsum((size > 0) * codes.shape[1])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(np.array(h, T.U64).view(np.int64)),
                        *(pa.array(bits[:, k].copy().view(np.int64)) for k in range(len(FURTHER))),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(codes.ravel().astype(np.int16))),
                    ],
                    names=["_doc", "_tk", "h", "b0", "b1", "codes"],
                )

    return docs.select("_doc", "_tk", "_text").mapInArrow(make, "_doc long, _tk long, h long, b0 long, b1 long, codes array<short>")


def _dealt(classes: DataFrame) -> DataFrame:
    """``lead, codes, h, b0, b1``: a row for each codeword of a key's first segment, with all those of its second, so that
    a set's bits travel once for six keys; sets without a shingle have none."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = T.list_column(batch.column(3))
            some = np.flatnonzero(np.diff(at))
            code = flat.reshape(-1, len(SEGMENTS), CODES)
            pairs = list(combinations(range(len(SEGMENTS)), 2))
            lead = np.stack([k << 12 | code[:, a].astype(np.int32) for k, (a, _) in enumerate(pairs)], axis=1)
            rest = np.repeat(np.stack([code[:, b] for _, b in pairs], axis=1)[:, :, None], CODES, axis=2)
            own = [batch.column(c).to_numpy()[some] for c in range(3)]
            each = len(pairs) * CODES
            ends = pa.array(np.arange(len(some) * each + 1, dtype=np.int32) * CODES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lead.ravel()), pa.ListArray.from_arrays(ends, pa.array(rest.ravel())), *(pa.array(np.repeat(x, each)) for x in own)],
                names=["lead", "codes", "h", "b0", "b1"],
            )

    return classes.select("h", "b0", "b1", "codes").mapInArrow(deal, "lead int, codes array<short>, h long, b0 long, b1 long")


def middle(bits: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the row of its group that is nearest to the group's majority bits, and their distance."""
    flat = np.unpackbits(bits.view(np.uint8).reshape(len(bits), -1), axis=1, bitorder="little")
    order = np.argsort(group, kind="stable")
    first = np.flatnonzero(np.append(True, group[order][1:] != group[order][:-1]))
    n = np.diff(np.append(first, len(group)))
    most = 2 * np.add.reduceat(flat[order], first, axis=0, dtype=np.int64) > n[:, None]
    number = np.empty(len(group), np.int64)
    number[order] = np.repeat(np.arange(len(first)), n)
    far = (flat != most[number]).sum(axis=1)
    near = np.lexsort((far, number))
    chosen = near[np.searchsorted(number[near], np.arange(len(first)))][number]
    return chosen, np.bitwise_count(bits ^ bits[chosen]).sum(axis=1).astype(np.int32)


def _groups(dealt: DataFrame) -> DataFrame:
    """``key, least, part, n, far, h``: members of a key that hang together by ``DISTANCE`` bits and less.

    least: the least of the n of them; part: the one in the middle, and far,
    how many bits off. Of a key with more than ``MOST_AT_ONCE`` members all are
    one group, with part 0.
    """
    names, kinds = ["key", "least", "part", "n", "far", "h"], (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, passing = None, [], False

        def batch_of(*columns):
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], names=names)

        def parted(key, h, bits, out):
            order = np.argsort(h)
            h, bits = h[order], bits[order]
            up = linked(bits)
            n = np.bincount(up, minlength=len(h))[up]
            many = np.flatnonzero(n > 1)
            if len(many):
                chosen, far = middle(bits[many], up[many])
                for c, v in zip(out, (np.full(len(many), key), h[up[many]], h[many][chosen], n[many], far, h[many]), strict=True):
                    c.append(v)

        def closed(out):
            if held and not passing:
                parted(key, *(np.concatenate([x[k] for x in held]) for k in (0, 1)), out)

        for batch in batches:
            keys, h, *words = (c.to_numpy() for c in batch.columns)
            bits = np.stack(words, axis=1).view(T.U64)
            out: list[list] = [[] for _ in names]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            ends = np.append(first[1:], len(keys))
            inner = (first > 0) & (ends < len(keys))
            two = first[inner & (ends - first == 2)]
            apart = np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1).astype(np.int32)
            two, apart = two[apart <= DISTANCE], apart[apart <= DISTANCE]
            least, other = np.minimum(h[two], h[two + 1]), np.maximum(h[two], h[two + 1])
            for c, v in zip(out, (np.tile(keys[two], 2), np.tile(least, 2), np.tile(least, 2), np.full(2 * len(two), 2), np.concatenate([0 * apart, apart]), np.concatenate([least, other])), strict=True):
                c.append(v)
            edge = (first == 0) | (ends == len(keys))
            for s, e in zip(first[edge | (ends - first > 2)].tolist(), ends[edge | (ends - first > 2)].tolist(), strict=True):
                if s > 0 and e < len(keys):
                    parted(keys[s], h[s:e], bits[s:e], out)
                    continue
                if keys[s] != key:
                    closed(out)
                    key, held, passing = keys[s], [], False
                held.append((h[s:e], bits[s:e]))
                if passing or sum(len(x[0]) for x in held) > MOST_AT_ONCE:
                    for x, _ in held:
                        none = np.zeros(len(x), np.int64)
                        yield batch_of(np.full(len(x), key), none, none, none, none, x)
                    held, passing = [], True
            if any(len(x) for x in out[0]):
                yield batch_of(*(np.concatenate(c) for c in out))
        out = [[] for _ in names]
        closed(out)
        if out[0]:
            yield batch_of(*(np.concatenate(c) for c in out))

    # a number of parts keeps them apart where they look small, as six keys are made of a row
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = dealt.repartition(parts, "lead").withColumn("code", F.explode("codes"))
    keys = keys.select((F.col("lead") * 4096 + F.col("code")).alias("key"), "h", "b0", "b1")
    return keys.sortWithinPartitions("key").mapInArrow(split, "key int, least long, part long, n int, far int, h long")


def _with_first(pairs: DataFrame, whole: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links ``u, v`` among ``pairs`` of sets: all partners of one ``u`` meet it, in groups of about ``block``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine = None, np.zeros(0, np.int64)
        for batch in batches:
            flat, at = T.list_column(batch.column(4))
            out: tuple[list, list] = ([], [])
            for r, (u, part, first, v) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                own = flat[at[r] : at[r + 1]].view(T.U64)
                if first == 0:
                    group, mine = (u, part), own.copy()
                    continue
                assert group == (u, part)
                both = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                if both >= similarity * (len(mine) + len(own) - both) - 1e-9:
                    out[0].append(u)
                    out[1].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["u", "v"])

    parts = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    theirs = pairs.join(parts, "u").select("u", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("first"), F.col("v").alias("h"))
    mine = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("first"), F.col("u").alias("h"))
    rows = theirs.unionByName(mine).join(whole, "h").select("u", "part", "first", "h", "grams")
    return rows.repartition("u", "part").sortWithinPartitions("u", "part", "first").mapInArrow(run, "u long, v long")


def _grams(texts: DataFrame, shingle: int) -> DataFrame:
    """``h, grams``: the sets, made anew from ``h, _text``."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, raw, at in T.chunks(batch.column(1)):
                grams, offsets = shingle_sets(raw, at, shingle)
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), sets], names=["h", "grams"])

    return texts.select("h", "_text").mapInArrow(make, "h long, grams array<long>")


def _compared(groups: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` of sets ``h, grams`` in the groups ``key, i, j``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}

        def found():
            h, sets = list(held), list(held.values())
            at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
            links = [(h[i], h[j]) for i, j in set_links(np.concatenate(sets), at, similarity)]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            flat, at = T.list_column(batch.column(4))
            for r, (k, i, j, h) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True)):
                if (k, i, j) != group:
                    if len(held) > 1:
                        yield found()
                    group, held = (k, i, j), {}
                held[h] = flat[at[r] : at[r + 1]].copy()
        if len(held) > 1:
            yield found()

    return groups.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").select("key", "i", "j", "h", "grams").mapInArrow(run, "u long, v long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = 512) -> DataFrame:
    """``_doc, _tk`` (as ``keyed``) for every row, and ``first``: the least (_doc, _tk) of its component.

    Rows are linked where the sets of their ``shingle``-word shingles (A-Z
    lower-cased) have a Jaccard similarity of ``similarity`` or more; rows
    without a word are linked among themselves.
    """
    if similarity < 0.8:
        raise ValueError("the keys are made for a similarity of 0.8 and more")
    base = keyed(docs, id_col, text_col)
    sets = stored(_sets(base, shingle))
    classes = stored(sets.groupBy("h").agg(F.min(F.struct("_doc", "_tk")).alias("low"), F.first("b0").alias("b0"), F.first("b1").alias("b1"), F.first("codes").alias("codes")))
    found = _groups(_dealt(classes))
    # groups with the same least member go together; a key's whole group goes by its key
    gid = F.when(F.col("part") != 0, F.xxhash64("least")).otherwise(F.xxhash64("key", F.lit(0)))
    groups = stored(found.select(gid.alias("key"), F.when(F.col("part") != 0, F.col("part")).alias("part"), "n", "far", "h"))

    # the sets of proposed texts alone are kept; the table of these is stored, so that Spark knows its size and broadcasts it where it is small
    proposed = stored(groups.select("h").distinct().join(classes.select("h", "low._doc", "low._tk"), "h"))
    whole = stored(_grams(base.join(proposed, ["_doc", "_tk"]), shingle))

    # each set meets the nearest of all middles of its groups, and that of the largest group
    beside = groups.where("part is not null and part <> h").groupBy("h")
    middles = beside.agg(F.min_by("part", F.struct("far", "part")).alias("a"), F.max_by("part", F.struct("n", "part")).alias("b"))
    pairs = stored(middles.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("u"), F.col("h").alias("v")))
    links = stored(_with_first(pairs, whole, similarity, block))
    parts = connected_components(links).select(F.col("id").alias("h"), "component")

    # Groups that are not one component yet, each only once for the same members. Members of a group's largest component
    # are dealt into parts and meet the others, which go to every part; if those are many, all meet in pairs of parts.
    named = groups.select("key", "h").distinct().join(parts, "h", "left").select("key", "h", F.coalesce("component", "h").alias("component"))
    members = [F.bit_xor(F.xxhash64("h", F.lit(x))) for x in (1, 2)]
    sizes = named.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), *(m.alias(f"m{i}") for i, m in enumerate(members)))
    met = sizes.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("several"), F.bit_xor("m0").alias("m0"), F.bit_xor("m1").alias("m1")
    )
    once = met.where("several > 1").groupBy("n", "m0", "m1").agg(F.min(F.struct("key", "most")).alias("k"))
    once = stored(once.select("k.key", F.ceil(F.col("n") / block).cast("int").alias("parts"), F.col("k.most.component").alias("largest"), (F.col("n") - F.col("k.most.n") > block).alias("many")))
    part = F.pmod(F.xxhash64("h", "key"), F.col("parts")).cast("int")
    each = named.join(once, "key").select("key", "h", "parts", "many", part.alias("part"), (F.col("component") == F.col("largest")).alias("inside"))
    alone = F.when(F.col("many"), F.sequence(F.lit(0), F.col("parts") - 1)).when(F.col("inside"), F.array("part")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    each = each.select("key", "h", "many", "part", F.explode(alone).alias("other"))
    each = each.select("key", F.when(F.col("many"), F.least("part", "other")).otherwise(F.col("other")).alias("i"), F.when(F.col("many"), F.greatest("part", "other")).otherwise(F.col("other")).alias("j"), "h")
    more = stored(_compared(each.join(whole, "h"), similarity))
    if not more.isEmpty():
        parts = connected_components(links.unionByName(more)).select(F.col("id").alias("h"), "component")
    classes = classes.join(parts, "h", "left").select("h", "low", F.coalesce("component", "h").alias("group"))
    lowest = classes.groupBy("group").agg(F.min("low").alias("first"))
    return sets.select("_doc", "_tk", "h").join(classes.join(lowest, "group").select("h", "first"), "h").select("_doc", "_tk", "first")
