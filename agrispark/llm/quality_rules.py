"""Quality rules as a short-circuit cascade ordered by rejection per cost.

Base counts are made for every text. Further rules run one after the other,
each only over the texts that all rules before it kept. Their order comes from
a sample: each rule's time and rejections are measured, and the rule with the
most rejections per second goes first. The order changes the time, never the
verdict: a text is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from agrispark.llm import textops as T
from agrispark.llm.common import keyed, original_id

SYMBOL = np.zeros(256, bool)
SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


class Texts:
    """A chunk of texts with its words; what several rules need is made once, when first asked for, and goes along into subsets."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, counts: dict[str, np.ndarray] | None = None):
        self.raw, self.at, self.n, self.counts = raw, at, len(at) - 1, counts or {}

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return T.word_spans(self.raw, self.at)

    def once(self, name: str, make: Callable[[], np.ndarray]) -> np.ndarray:
        if name not in self.counts:
            self.counts[name] = make()
        return self.counts[name]

    @property
    def n_words(self) -> np.ndarray:
        return self.once("n_words", lambda: np.bincount(self.words[2], minlength=self.n))

    def per_text(self, flag: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def word_chars(self) -> np.ndarray:
        return self.once("word_chars", lambda: self.per_text(~T.SPACE[self.raw] & ((self.raw & 0xC0) != 0x80)))

    def n_symbols(self) -> np.ndarray:
        return self.once("n_symbols", lambda: self.per_text(SYMBOL[self.raw]))

    def _lines(self):
        cut = np.flatnonzero(self.raw == 10)
        start = np.unique(np.concatenate([self.at[:-1], cut + 1]))
        start = start[start < len(self.raw)]
        row = np.searchsorted(self.at, start, side="right") - 1
        stop = np.minimum(np.append(start[1:], len(self.raw)), self.at[row + 1])
        stop = stop - ((stop > start) & (self.raw[np.maximum(stop - 1, 0)] == 10))
        solid = np.concatenate([[0], np.cumsum(~T.SPACE[self.raw])])
        some = solid[stop] > solid[start]
        return start[some], stop[some], row[some]

    def _count_lines(self) -> np.ndarray:
        start, stop, row = self._lines()
        again, _ = T.repeats_in_row(T.span_codes(self.raw, start, stop)[0], row)
        return np.stack([np.bincount(row, minlength=self.n), np.bincount(row[again], minlength=self.n)], axis=1)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those equal to an earlier one, by text."""
        both = self.once("lines", self._count_lines)
        return both[:, 0], both[:, 1]

    def n_repeat_words(self) -> np.ndarray:
        start, stop, row = self.words
        if len(start) < 3:
            return np.zeros(self.n, np.int64)
        at = np.flatnonzero(row[2:] == row[:-2])
        _, twice = T.repeats_in_row(T.window_codes(T.span_codes(self.raw, start, stop)[0], 3)[at], row[at])
        hit = np.zeros(len(start), bool)
        for k in range(3):
            hit[at[twice] + k] = True
        return np.bincount(row[hit], minlength=self.n)

    def subset(self, rows: np.ndarray) -> "Texts":
        parts = [self.raw[self.at[r] : self.at[r + 1]] for r in rows.tolist()]
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        return Texts(np.concatenate(parts) if parts else self.raw[:0], at, {k: v[rows] for k, v in self.counts.items()})


def _share(a, b):
    return a / np.maximum(b, 1)


def many_symbols(t: Texts) -> np.ndarray:
    """Over 3 symbols ``#*$%&|<>`` in 10 words."""
    return 10 * t.n_symbols() > 3 * t.n_words


def word_length(t: Texts) -> np.ndarray:
    """A mean word of under 2 or over 15 code points."""
    mean = _share(t.word_chars(), t.n_words)
    return (mean < 2) | (mean > 15)


def repeated_lines(t: Texts) -> np.ndarray:
    """Over half of all lines equal to an earlier one, of 6 lines or more."""
    lines, again = t.lines()
    return (lines >= 6) & (2 * again > lines)


def shouting(t: Texts) -> np.ndarray:
    """Over 3 A-Z in 10 ASCII letters."""
    low = t.raw | 32
    letter = (low >= 97) & (low <= 122)
    return 10 * t.per_text(letter & (t.raw < 97)) > 3 * t.per_text(letter)


def exclamations(t: Texts) -> np.ndarray:
    """Over one ``!`` in 5 words."""
    return 5 * t.per_text(t.raw == 33) > t.n_words


def few_letters(t: Texts) -> np.ndarray:
    """Under half of all words with a letter (a byte a-z, A-Z or beyond ASCII)."""
    low = t.raw | 32
    total = np.concatenate([[0], np.cumsum(((low >= 97) & (low <= 122)) | (t.raw > 127))])
    start, stop, row = t.words
    return 2 * np.bincount(row[total[stop] > total[start]], minlength=t.n) < t.n_words


RULES: dict[str, Callable[[Texts], np.ndarray]] = {
    f.__name__: f for f in (many_symbols, word_length, repeated_lines, shouting, exclamations, few_letters)
}


def base_counts(t: Texts) -> tuple[np.ndarray, ...]:
    """The base counts of the query, and whether a text fails by them."""
    repeat = t.n_repeat_words()
    return t.n_words, t.word_chars(), t.n_symbols(), t.lines()[1], repeat, (t.n_words < 50) | (2 * repeat > t.n_words)


def best_order(seconds: list[float], together: dict[int, int]) -> list[tuple[int, float]]:
    """Rules by number, each with what it rejects of what those before it leave, the most rejections per second first.

    together: texts by the set of rules that reject them, as bits.
    """
    placed, out, left = 0, [], list(range(len(seconds)))
    while left:
        new = {r: sum(n for bits, n in together.items() if bits >> r & 1 and not bits & placed) for r in left}
        r = max(left, key=lambda r: (new[r] / max(seconds[r], 1e-9), -seconds[r]))
        out.append((r, float(new[r])))
        placed |= 1 << r
        left.remove(r)
    return out


def rule_costs(docs: DataFrame, text_col: str = "text", sample_rows: int = 2000, rules: dict[str, Callable[[Texts], np.ndarray]] | None = None) -> list[tuple[str, float, float]]:
    """(rule, seconds, rejections) in the order of the cascade, measured in Spark over about ``sample_rows`` rows.

    Texts are measured as they come to the cascade: the base counts are there
    and those that fail by them are gone. Rejections are those of texts that
    no rule before it rejects. The sample bounds only the measuring; an empty
    table measures nothing and leaves the order as it is.
    """
    rules = rules or RULES
    n = docs.count()
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("t")).sample(min(1.0, sample_rows / max(n, 1)), seed=1)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, raw, at in T.chunks(batch.column(0)):
                t = Texts(raw, at)
                t = t.subset(np.flatnonzero(~base_counts(t)[-1]))
                bits, took, _ = np.zeros(t.n, np.int64), [], t.words  # the words are split before any rule is timed
                for k, f in enumerate(rules.values() if t.n else ()):
                    began = time.perf_counter()
                    bad = f(t)
                    took.append(time.perf_counter() - began)
                    bits |= bad.astype(np.int64) << k
                kind, count = np.unique(bits, return_counts=True)
                at_rule = list(range(len(took))) + [-1] * len(kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at_rule, pa.int32()), pa.array([-1] * len(took) + kind.tolist(), pa.int64()), pa.array([*took, *map(float, count)], pa.float64())],
                    names=["rule", "bits", "amount"],
                )

    rows = sample.mapInArrow(measure, "rule int, bits long, amount double").groupBy("rule", "bits").agg(F.sum("amount").alias("amount")).collect()
    seconds = {r["rule"]: r["amount"] for r in rows if r["rule"] >= 0}
    names, took = list(rules), [seconds.get(k, 0.0) for k in range(len(rules))]
    return [(names[r], took[r], new) for r, new in best_order(took, {r["bits"]: int(r["amount"]) for r in rows if r["rule"] < 0})]


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000, order: list[str] | None = None) -> DataFrame:
    """Base counts and verdict for every row.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept``. A null or empty text has no words and fails; rows that
    repeat are judged alike; other columns are ignored. order: the cascade's
    rules; by default as ``rule_costs`` finds best.
    """
    order = order or [m[0] for m in rule_costs(docs, text_col, sample_rows)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(7)]
            for _, _, raw, at in T.chunks(batch.column(1)):
                t = Texts(raw, at)
                *counted, failed = base_counts(t)
                kept = ~failed
                left = t
                rows = np.arange(t.n)
                if not kept.all():
                    rows = np.flatnonzero(kept)
                    left = t.subset(rows)
                for name in order:
                    if not len(rows):
                        break
                    bad = RULES[name](left)
                    if bad.any():
                        kept[rows[bad]] = False
                        rows, left = rows[~bad], left.subset(np.flatnonzero(~bad))
                for c, v in zip(cols, (*counted, failed, kept), strict=True):
                    c.append(v)
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x.astype(np.int64)) for x in flat[:5]), *(pa.array(x.astype(bool)) for x in flat[5:])],
                names=["_doc", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
            )

    return (
        keyed(docs, id_col, text_col)
        .select("_doc", "_text")
        .mapInArrow(judge, "_doc long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
        .select(original_id().alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    )


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
