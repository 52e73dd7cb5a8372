"""Spelling variants: words one edit apart, found by a frontier of states that walks a trie level by level.

The trie is an edge table (node, letter, what follows): a node is a direction
and a beginning of a word, and a level's edges meet the level's states
(word, position, node, edits) in an equi-join. Two words one edit apart agree
up to the edit or from the edit on, so there are two tries, of the words and of
the words reversed, and a state starts at the node of a word's own first half,
without edits. At each level it goes on to the node of its next letter, and
takes its one edit at other letters of the node: the letter replaces the
word's next one (from the word with the lesser letter), or stands before it.
Deletions are the insertions of the other word. A state with its edit spent
follows its own letters alone; where it ends at the end of a word, that word
is near. Each pair of words is found once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agrispark.session import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of up to so many code points go through the trie; pairs with a longer one meet by their strings less one letter.
LEVELS = 48
#: Modulus and bases of the hashes of long words' parts.
PRIME, BASES = (1 << 61) - 1, (1_000_003, 998_244_353)


def lowered(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quick way where all is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, damage: bool = False) -> DataFrame:
    """``word, n``: the runs of letters of at least ``least`` code points, A-Z lower-cased, and how often each occurs.

    Null texts have none. With ``damage``, a run whose crc32 with the row's id
    (``<doc_id>:<run>``, a null id empty) is divisible by 31 loses one letter
    first. Counts are combined before the shuffle, so a frequent word is few
    rows.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([A-Za-zÀ-ÿ]{{{least},}})"), F.lit(1)))
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), run.alias("run")).withColumn("word", lowered(F.col("run")))
    if damage:
        h = F.crc32(F.concat("doc", F.lit(":"), "word"))
        at = (h % F.length("word")).cast("int")
        runs = runs.select(F.when(h % 31 == 0, F.concat(F.substr("word", F.lit(1), at), F.substr("word", at + 2))).otherwise(F.col("word")).alias("word"))
    return runs.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def edges(directed: DataFrame) -> DataFrame:
    """``level, node, letter, n, follow`` of the words ``s`` in direction ``way``, from the level where a state can start.

    n: of the word that ends after the letter, else null. follow: the letters
    that can come next.
    """
    size = F.length("s")
    level = F.explode(F.sequence(F.floor((size - 1) / 2).cast("int"), size - 1))
    each = directed.select("way", "s", "n", level.alias("level"))
    each = each.select(
        F.concat("way", F.substr("s", F.lit(1), F.col("level"))).alias("node"),
        F.substr("s", F.col("level") + 1, F.lit(1)).alias("letter"),
        F.when(F.col("level") == F.length("s") - 1, F.col("n")).alias("n"),
    )
    each = stored(each.groupBy("node", "letter").agg(F.max("n").alias("n")))
    after = each.groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("letter")), "").alias("follow"))
    after = after.select(F.col("node").alias("child"), "follow")
    out = each.join(after, F.concat("node", "letter") == after["child"], "left").drop("child")
    return out.select((F.length("node") - 1).alias("level"), "node", "letter", "n", F.coalesce("follow", F.lit("")).alias("follow"))


def _step(states: DataFrame, level_edges: DataFrame) -> DataFrame:
    """States with their edit spent one level down; those that end at a word have its ``near_n``.

    States that can't go on, by the letters that follow, are left out at once.
    """
    size, here = F.length("s"), F.col("position")
    own = F.substr("s", here + 1, F.lit(1))
    met = states.join(level_edges.select(F.col("node").alias("at"), "letter", F.col("n").alias("end_n"), "follow"), F.col("node") == F.col("at"))
    met = met.where((F.col("letter") == own) == (F.col("edits") == 1))

    def alive(position: Column) -> Column:
        return F.when(position == size, F.col("end_n").isNotNull()).otherwise(F.contains("follow", F.substr("s", position + 1, F.lit(1))))

    # a letter before a run of the same letter that reaches into the first half is found from the other end
    first = size - F.floor(size / 2).cast("int")
    ours = (F.col("way") == "f") | (F.substr("s", first + 1, here - first) != F.repeat("letter", here - first))
    # of two words with different letters at a place, the one with the lesser letter finds the other
    onward = ((F.col("edits") == 1) | ((here < size) & (F.col("letter") > own))) & alive(here + 1)
    before = (F.col("edits") == 0) & ours & alive(here)
    moves = F.when(onward & before, F.array(F.lit(0), F.lit(1))).when(onward, F.array(F.lit(1))).when(before, F.array(F.lit(0)))
    out = met.withColumn("by", F.explode(moves)).withColumn("to", here + F.col("by"))
    near = F.when(F.col("to") == size, F.col("end_n")).alias("near_n")
    return out.select("way", "s", "n", F.col("to").alias("position"), F.concat("node", "letter").alias("node"), F.lit(1).alias("edits"), near)


def trie_pairs(words: DataFrame, longest: int) -> DataFrame:
    """``word, near, near_n`` for both of every two of ``words`` (``word, n``) that are one edit apart and at most ``longest`` long.

    Each level is one join of the level's states and edges, written to the
    shared folder; a node with many states is split by Spark as a skewed key,
    as it has at most one edge a letter. States without edits are at the nodes
    of their own words, so they are named and not carried.
    """
    ways = F.explode(F.array(F.struct(F.lit("f").alias("way"), F.col("word").alias("s")), F.struct(F.lit("r").alias("way"), F.reverse("word").alias("s"))))
    directed = words.select(ways.alias("w"), "n").select("w.way", "w.s", "n")
    size, half = F.length("s"), F.floor(F.length("s") / 2).cast("int")
    start = F.when(F.col("way") == "f", half).otherwise(size - half)
    starts = stored(directed.select("way", "s", "n", start.alias("start"), size.alias("size")).sortWithinPartitions("start"))
    table = stored(edges(directed).sortWithinPartitions("level"))
    carried, found = None, []
    for level in range(longest + 1):
        states = starts.where((F.col("start") <= level) & (F.col("size") >= level))
        node = F.concat("way", F.substr("s", F.lit(1), F.lit(level)))
        states = states.select("way", "s", "n", F.lit(level).alias("position"), node.alias("node"), F.lit(0).alias("edits"))
        if carried is not None:
            states = states.unionByName(carried.where("near_n is null").drop("near_n"))
        carried = stored(_step(states, table.where(F.col("level") == level)))
        found.append(carried.where("near_n is not null"))
    met = reduce(DataFrame.union, found)
    turned = lambda c: F.when(F.col("way") == "f", c).otherwise(F.reverse(c))
    met = met.select(turned(F.col("s")).alias("a"), "n", turned(F.substr("node", F.lit(2))).alias("b"), "near_n")
    there = F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("near_n").alias("near_n"))
    back = F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n").alias("near_n"))
    return met.select(F.explode(F.array(there, back)).alias("p")).select("p.*")


def long_pairs(words: DataFrame, shortest: int) -> DataFrame:
    """As ``trie_pairs``, for pairs with a word of over ``shortest`` code points, by their strings less one letter.

    A word has a row for each of its letters, with hashes of what is left of it
    and right of it, so a row stays small however long the word is; pairs that
    meet are compared as strings.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points = [ord(c) for c in word]
                size = len(points)
                sums = []
                for base in BASES:
                    left, right, power = [0], [0], 1
                    for x in points:
                        left.append((left[-1] * base + x) % PRIME)
                    for x in reversed(points):
                        right.append((right[-1] + x * power) % PRIME)
                        power = power * base % PRIME
                    powers = [1]
                    for _ in range(size):
                        powers.append(powers[-1] * base % PRIME)
                    less = [(left[i] * powers[size - i - 1] + right[size - i - 1]) % PRIME for i in range(size)]
                    sums.append((left[-1], less))
                for i in range(0, size, 65536):
                    part = [np.array(s[1][i : i + 65536], np.int64) for s in sums]
                    n = len(part[0])
                    at = np.arange(i, i + n)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.full(n, size - 1)), pa.array(at), *map(pa.array, part)], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([size], pa.int64()), pa.array([-1], pa.int64()), *(pa.array([s[0]], pa.int64()) for s in sums)], names=names)

    names = ["name", "size", "at", "h1", "h2"]
    long = words.where(F.length("word") >= shortest).select("word", "n", F.sha2("word", 256).alias("name"))
    keys = stored(long.select("word", "name").mapInArrow(rows, "name string, size long, at long, h1 long, h2 long"))
    a, b = keys.alias("a"), keys.alias("b")
    equal = (F.col("a.size") == F.col("b.size")) & (F.col("a.h1") == F.col("b.h1")) & (F.col("a.h2") == F.col("b.h2"))
    replaced = a.where("at >= 0").join(b.where("at >= 0"), equal & (F.col("a.at") == F.col("b.at")) & (F.col("a.name") != F.col("b.name")))
    inserted = a.where("at = -1").join(b.where("at >= 0"), equal)
    two = lambda x, y: F.struct(F.col(f"{x}.name").alias("x"), F.col(f"{y}.name").alias("y"))
    pairs = replaced.select(two("a", "b").alias("p")).union(inserted.select(F.explode(F.array(two("a", "b"), two("b", "a"))))).select("p.x", "p.y").distinct()
    left = long.select(F.col("name").alias("x"), "word")
    right = long.select(F.col("name").alias("y"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = pairs.join(left, "x").join(right, "y").where(F.greatest(F.length("word"), F.length("near")) > shortest)
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")


def near_words(words: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``word, near, near_n`` for both of every two of ``words`` (``word, n``, each word once) that are one edit apart."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    pairs = trie_pairs(words.where(F.length("word") <= levels), min(longest, levels))
    return pairs.unionByName(long_pairs(words, levels)) if longest > levels else pairs


def variants(words: DataFrame, times: int = 10, levels: int = LEVELS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words`` (``word, n``, each word once).

    near: one inserted, deleted or replaced code point apart. form: the near
    word of largest n (ties: the smallest in code-point order) if its n is at
    least ``times`` that of the word, else null. root: where the forms lead
    to, the word itself if it has none; each step multiplies n, so the number
    of doubling rounds follows from the largest n. Nulls count as no word.
    """
    if times < 2:
        raise ValueError("forms lead to an end only if n grows at each step")
    words = stored(words.where("word is not null").select("word", "n"))
    near = near_words(words, levels)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    takes = -F.col("best.less") >= times * F.col("n")
    out = words.join(near, "word", "left").select(
        "word",
        F.when(takes, F.col("best.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(takes, -F.col("best.less")).alias("form_n"),
    )
    out = stored(out)
    most = out.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most, 2), times)) + 1)
    roots = out.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return variants(occurrences(docs, damage=True).where("n >= 2"))
