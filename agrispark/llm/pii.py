"""Personal data: expressions propose, checksums confirm, context adjusts. DataFrame functions only.

Places come from the gaps between matches (``split``) and the matches
(``regexp_extract_all``), which both walk a text's matches from the left. The
quantifiers are possessive where giving back could not help, so that long runs
neither recurse nor are tried again from each of their characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from agrispark.llm.common import documents

#: Kinds in their order, what proposes them, and their scores.
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,64}|AKIA[0-9A-Z]{16})(?![A-Za-z0-9])",
}
NEEDS = {"email": "@", "phone": "+"}
BASE_KINDS = ("email", "ip", "card", "phone")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.4}
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|credit|debit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|tax id",
    "secret": "token|key|secret|password|credential",
}
CONTEXT_GAIN, THRESHOLD, BEFORE, AFTER = 0.3, 0.6, 40, 20
CHUNK = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value made once, however often the body and lambdas in it name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(items: Column, value: Callable[[Column], Column], op: Callable[[Column, Column], Column], zero: Column) -> Column:
    """Array of (x, before): each item, and ``op`` over the values of all items before it.

    Items go in blocks of 64, so no array grows item by item over a whole text.
    """

    def block(items: Column, b: Column) -> Column:
        part = F.slice(items, b * 64 + 1, F.lit(64))
        return let(part, lambda p: F.struct(F.aggregate(p, zero, lambda s, x: op(s, value(x))).alias("total"), p.alias("part")))

    def grow(state: Column, next_at: Column, item: Column) -> Column:
        return F.struct(next_at.alias("at"), F.concat(state["out"], F.array(item)).alias("out"))

    def inside(b: Column, offset: Column) -> Column:
        none = F.slice(F.transform(b["part"], lambda x: F.struct(x.alias("x"), offset.alias("before"))), F.lit(1), F.lit(0))
        step = lambda s, x: grow(s, op(s["at"], value(x)), F.struct(x.alias("x"), s["at"].alias("before")))
        return F.aggregate(b["part"], F.struct(offset.alias("at"), none.alias("out")), step, lambda s: s["out"])

    def whole(blocks: Column) -> Column:
        none = F.slice(F.array(zero), F.lit(1), F.lit(0))
        step = lambda s, b: grow(s, op(s["at"], b["total"]), s["at"])
        offsets = F.aggregate(blocks, F.struct(zero.alias("at"), none.alias("out")), step, lambda s: s["out"])
        return F.flatten(F.zip_with(blocks, offsets, inside))

    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / 64).cast("int")), lambda b: block(a, b))
    return let(items, lambda a: F.when(F.size(a) > 0, let(cut(a), whole)).otherwise(F.array()))


def chunked(text: Column) -> Column:
    """The text in parts of ``CHUNK`` code points, so that a place late in a long text is found without counting from its start."""

    def cut(t: Column, size: int) -> Column:
        n = F.length(t)
        return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / size).cast("int")), lambda i: F.substr(t, i * size + 1, F.lit(size)))

    return let(text, lambda t: F.flatten(F.transform(cut(t, CHUNK * 128), lambda part: cut(part, CHUNK))))


def piece(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a chunked text."""
    first, last = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    get = lambda i: F.coalesce(F.get(chunks, i), F.lit(""))
    head, tail = F.substr(get(first), a % CHUNK + 1), F.substr(get(last), F.lit(1), b % CHUNK)
    middle = F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(b <= a, "").when(first == last, F.substr(get(first), a % CHUNK + 1, b - a)).otherwise(F.concat(head, middle, tail))


def digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check (empty: no)."""

    def weigh(number: Column, i: Column) -> Column:
        d = F.substr(number, F.length(number) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    def total(n: Column) -> Column:
        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: weigh(n, i)), F.lit(0), lambda a, x: a + x)

    return let(number, lambda n: F.when(F.length(n) > 0, total(n) % 10 == 0).otherwise(False))


def mod97(iban: Column) -> Column:
    """Whether an account number without blanks passes the mod-97 check."""

    def step(turned: Column, a: Column, i: Column) -> Column:
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c >= 65, (a * 100 + c - 55) % 97).otherwise((a * 10 + c - 48) % 97)

    def rest(turned: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda a, i: step(turned, a, i))

    return F.when(F.length(iban) > 4, let(F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4))), rest) == 1).otherwise(False)


def valid(kind: str, found: Column) -> Column:
    """Whether a proposed match is confirmed."""
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return found.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return let(digits(found), lambda n: F.when(F.length(n).between(14, 19), luhn(n)).otherwise(False))
    if kind == "phone":
        return F.length(digits(found)).between(10, 15)
    if kind == "iban":
        return let(F.replace(found, F.lit(" "), F.lit("")), lambda n: F.when(F.length(n).between(15, 34), mod97(n)).otherwise(False))
    return F.lit(True)


def _places(text: Column, kind: str) -> Column:
    """Array of (start, end, rank, kind) of the confirmed matches, in code points."""
    pattern, rank = PATTERNS[kind], list(PATTERNS).index(kind)

    def placed(matches: Column) -> Column:
        # a match with the gap before it; the last gap has no match
        parts = F.zip_with(
            F.split(text, pattern, -1),
            matches,
            lambda gap, found: F.struct(F.length(gap).alias("gap"), F.length(found).alias("size"), F.coalesce(valid(kind, found), F.lit(False)).alias("ok")),
        )
        walked = running(F.filter(parts, lambda p: p["size"].isNotNull()), lambda p: p["gap"] + p["size"], lambda a, b: a + b, F.lit(0))

        def span(r: Column) -> Column:
            start = r["before"] + r["x"]["gap"]
            return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + r["x"]["size"]).alias("end"), F.lit(kind).alias("kind"))

        return F.transform(F.filter(walked, lambda r: r["x"]["ok"]), span)

    empty = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    some = let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.exists(m, lambda x: valid(kind, x)), placed(m)).otherwise(empty))
    return F.when(F.instr(text, NEEDS[kind]) > 0, some).otherwise(empty) if kind in NEEDS else some


def find_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``spans``: array of (start, end, kind, score, base), by start, then kind.

    Base kinds (email, ip, card, phone) keep every confirmed match. Other
    kinds (iban, ssn, secret) need a score of 0.6 with the words around them
    and no base span in their place. A null or empty text has none. ``docs``
    may have a column named spans already: it is replaced; no other column is
    touched. The work grows with the text's length, not with its square,
    however many spans it has.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    latest, soonest = F.lit(-1), F.lit(2**31 - 1)

    def scored(chunks: Column, s: Column) -> Column:
        around = F.lower(F.concat(piece(chunks, F.greatest(s["start"] - BEFORE, F.lit(0)), s["start"]), F.lit(" "), piece(chunks, s["end"], s["end"] + AFTER)))
        score, near = F.lit(0.0), F.lit(False)
        for kind in PATTERNS:
            score = F.when(s["kind"] == kind, F.lit(SCORES[kind])).otherwise(score)
            near = F.when(s["kind"] == kind, around.rlike(rf"(?:^|[^a-z])(?:{CONTEXT[kind]})")).otherwise(near)
        score = F.least(F.lit(1.0), score + F.when(near, CONTEXT_GAIN).otherwise(0.0))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), score.alias("score"), (s["rank"] < len(BASE_KINDS)).alias("base"))

    def kept(spans: Column) -> Column:
        """Without those of the other kinds that are unlikely or in the place of a base span, before or after them in the order."""
        left = running(spans, lambda s: F.when(s["base"], s["end"]).otherwise(latest), F.greatest, latest)
        both = running(F.reverse(left), lambda r: F.when(r["x"]["base"], r["x"]["start"]).otherwise(soonest), F.least, soonest)
        free = F.filter(
            both,
            lambda r: r["x"]["x"]["base"]
            | ((r["x"]["x"]["score"] >= THRESHOLD) & (r["x"]["before"] <= r["x"]["x"]["start"]) & (r["before"] >= r["x"]["x"]["end"])),
        )
        return F.reverse(F.transform(free, lambda r: r["x"]["x"]))

    def judged(spans: Column) -> Column:
        marked = let(chunked(text), lambda chunks: F.transform(spans, lambda s: scored(chunks, s)))
        sure = F.transform(F.filter(spans, lambda s: F.lit(False)), lambda s: scored(F.array(F.lit("")), s))
        return F.when(F.size(spans) > 0, let(marked, lambda m: F.when(F.exists(m, lambda s: ~s["base"]), kept(m)).otherwise(m))).otherwise(sure)

    # structs sort by start, then kind
    return docs.withColumn("spans", let(F.array_sort(F.concat(*(_places(text, k) for k in PATTERNS))), judged))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap an earlier one are merged into it."""

    def joined(chunks: Column, walked: Column) -> Column:
        def part(r: Column) -> Column:
            s, at = r["x"], r["before"]
            return F.when(s["start"] < at, "").otherwise(F.concat(piece(chunks, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]")))

        last = F.array_max(F.transform(walked, lambda r: r["x"]["end"]))
        return F.concat(F.array_join(F.transform(walked, part), ""), piece(chunks, last, F.length(text)))

    walked = running(spans, lambda s: s["end"], F.greatest, F.lit(0))
    done = let(walked, lambda w: let(chunked(text), lambda chunks: joined(chunks, w)))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    out = find_spans(documents(spark, sf_dir))
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: lambda s: s["kind"] == k
    count = [F.size(F.filter("spans", of(k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return out.select(
        "doc_id", *count, F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans")
    )
