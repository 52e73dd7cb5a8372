"""Text operators: SQL where there is some, else brute force, round trips and held-out pages; odd rows for all."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

import oracle
from agrispark.llm import chat_format, decontaminate, html_extract, licenses, packing, pii, quality_rules, queries, simhash_golay, substring_dedup, suffix_dedup
from agrispark.operators.components import connected_components

SF = f"{oracle.DATA}/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}" for i in range(60_000))
#: Null id, null and empty text, ties, repeated rows, a very long text, and columns with names the operators use inside.
ODD = [(None, "alpha beta " * 40), (1, None), (2, ""), (3, "same text here " * 60), (3, "same text here " * 60), (4, "same text here " * 60), (5, LONG), (6, " \n\t "), (7, "Ünïcödé wörds ✓ " * 70)]
KIND = "doc_id long, text string, _doc int, h string, fp string, spans string, n int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 1, "x", "y", "z", 2) for r in ODD], KIND)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def result(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    assert oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.ORACLE_SQL[name]) == ""


# --- op1 ---

def repeats(rows, length):
    count = collections.Counter()
    for _, t in rows:
        b = (t or "").encode()
        count.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r.doc_id, r.n_bytes, sum(b - a for a, b in zip(r.starts, r.ends, strict=True)), len(r.starts), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def test_index_gives_matching_statistics():
    rng = random.Random(3)
    for _ in range(60):
        texts = [bytes(rng.choice(b"ab\0") for _ in range(rng.randrange(0, 25))) for _ in range(rng.randrange(1, 5))]
        index = suffix_dedup.RunLengthIndex(texts)
        got = index.matching_statistics()
        every = [(k, j) for k, t in enumerate(texts) for j in range(len(t))]
        for k, i in every:
            best = 0
            for o, j in every:
                if (o, j) != (k, i):
                    n = 0
                    while i + n < len(texts[k]) and j + n < len(texts[o]) and texts[k][i + n] == texts[o][j + n]:
                        n += 1
                    best = max(best, n)
            assert got[index.start[k] + i] == best


@pytest.mark.parametrize("index_bytes", [1 << 20, 2000, 400, 60])
def test_repeats_match_brute_force(spark, index_bytes):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abc") for _ in range(n))
    shared = text(33)
    rows = [(i, text(rng.randrange(0, 80))) for i in range(80)] + [(200 + i, text(30) + shared + text(30)) for i in range(40)]
    rows += [(None, "a" * 34), (5, None), (7, ""), (300, shared * 3), (300, shared * 3), (300, shared + "x")]
    got = removed(suffix_dedup.repeat_removal(spark.createDataFrame(rows, "doc_id long, text string"), length=20, gram=6, index_bytes=index_bytes))
    assert got == repeats(rows, 20)


def test_repeats_on_odd_rows(odd):
    assert removed(suffix_dedup.repeat_removal(odd)) == repeats(ODD, 400)
    assert suffix_dedup.repeat_removal(odd.limit(0)).count() == 0


# --- op2 ---

def test_keys_meet_at_up_to_four_bits():
    rng = np.random.default_rng(0)
    fp = rng.integers(0, 2**64, 400, dtype=np.uint64)
    for e in (0, 1, 2, 3, 4):
        other = fp.copy()
        for r in range(len(other)):
            for b in rng.choice(64, e, replace=False):
                other[r] ^= np.uint64(1 << int(b))
        keys, rows = simhash_golay.keys_of(fp)
        mine = set(zip(rows.tolist(), keys.tolist(), strict=True))
        keys, rows = simhash_golay.keys_of(other)
        assert {r for r, k in zip(rows.tolist(), keys.tolist(), strict=True) if (r, k) in mine} == set(range(len(fp)))


def classes(ids, near):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def simhash(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[k : k + 4]) for k in range(max(len(w) - 3, 1))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_near_duplicates_match_brute_force(spark, docs):
    fps = {i: simhash(t) for i, t in docs.items()}
    low = classes(list(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    want = sorted(((i, f"{fps[i]:016x}", low[i]) for i in fps), key=repr)
    assert result(queries.QUERIES["op2_simhash_golay"](spark, SF), "doc_id", "fingerprint", "component_id") == want


def test_near_duplicates_on_odd_rows(odd):
    got = {r.doc_id: r.component_id for r in simhash_golay.near_duplicates(odd).collect()}
    assert (got[1], got[2], got[6], got[4], got[5]) == (1, 1, 1, 3, 5) and got[None] is None
    assert simhash_golay.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2048, 16])
def test_large_groups_keep_every_link(spark, block):
    rng = random.Random(1)
    points = [rng.getrandbits(64)]
    while len(points) < 200:
        p = rng.choice(points)
        for b in rng.sample(range(64), rng.randrange(1, 6)):
            p ^= 1 << b
        points.append(p)
    signed = sorted({p - (1 << 64) if p >> 63 else p for p in points})
    links = simhash_golay.link_fingerprints(spark.createDataFrame([(p,) for p in signed], "fp long"), 4, block)
    got = {r.id: r.component for r in connected_components(links).collect()}
    assert {p: got.get(p, p) for p in signed} == classes(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)


# --- op3 ---

def test_quality_on_odd_rows_and_in_any_order(odd):
    one = result(quality_rules.quality_rules(odd), "doc_id", "n_words", "n_repeat_words", "kept")
    assert one == result(quality_rules.quality_rules(odd, order=list(quality_rules.RULES)[::-1]), "doc_id", "n_words", "n_repeat_words", "kept")
    assert (1, 0, 0, False) in one and (5, 60_000, 60_000, False) in one
    assert quality_rules.quality_rules(odd.limit(0)).count() == 0


def test_quality_agrees_with_labels(spark):
    kept = {r.doc_id: r for r in quality_rules.op3_quality_rules(spark, f"{oracle.DATA}/sf0.01").collect()}
    labels = spark.read.parquet(f"{oracle.DATA}/sf0.01/labels.parquet").collect()
    assert all(kept[r.doc_id].kept == (r.quality == 1) for r in labels if not kept[r.doc_id].base_failed)


# --- op4 ---

def test_windows_on_odd_rows(odd):
    rows, seen, want = sorted({r for r in ODD}, key=lambda r: (r[0] is None, r[0] or 0)), set(), {}
    for i, t in rows:
        w = WORDS.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone[k : k + 20] = [True] * 20
            seen.add(tuple(w[k : k + 20]))
        want[i] = (len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y))
    got = substring_dedup.substring_dedup(odd).collect()
    assert len(got) == len(ODD) and all((r.n_words, r.n_removed, r.kept_text) == want[r.doc_id] for r in got)
    full = substring_dedup.substring_dedup(odd, width_bits=4).collect()  # a sketch that is full loses nothing
    assert sorted(full, key=repr) == sorted(got, key=repr)
    assert substring_dedup.substring_dedup(odd.limit(0)).count() == 0


# --- op5 ---

def test_extraction_of_pages(spark):
    sf = f"{oracle.DATA}/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in html_extract.op5_html_extract(spark, sf).collect():
        article = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", article))
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_extraction_leaves_boilerplate_of_unseen_kinds(spark):
    sf = f"{oracle.DATA}/sf0.01"
    read = lambda t: spark.read.parquet(f"{sf}/{t}.parquet")
    model = html_extract.train(html_extract.labelled_pages(read("pages"), read("documents")))
    page = (
        "<body><header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies on this long page.</p></div><article><h1>Title &amp; more</h1><p>First\n  paragraph is"
        " here.<aside class=sidebar><p>Side text that looks quite real.</p></aside><p>Second one, <a href=x>linked</a>.</p><form><p>Your name, please enter it here.</p></form>"
        "<section id='comments'><p>I disagree with this article.</p></section></article><footer>foot</footer><script>var a='<p>no</p>'</script>"
    )
    assert html_extract.extract_text(page, *model) == "Title & more\n\nFirst paragraph is here.\n\nSecond one, linked."
    kind = "page_id long, url string, html string, text string"
    rows = spark.createDataFrame([(1, None, None, "x"), (None, "u", "", "x"), (2, "u", "<p", "x"), (2, "u", "<p", "x")], kind)
    assert [r.text for r in html_extract.extract(rows).collect()] == ["", "", "", ""]


# --- op6 ---

def test_leaks_verbatim_and_edited(spark, docs):
    got = {(r.doc_id, r.item_id) for r in decontaminate.op6_decontaminate(spark, SF).collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    assert {(i, j) for i, t in docs.items() for j, u in items.items() if u in t} <= got
    rng = random.Random(2)
    words = [f"word{rng.randrange(10**6)}" for _ in range(40)]
    edited = words[:12] + ["changed"] + words[13:25] + words[26:33] + ["one", "more"] + words[33:]
    rows = [(1, "Before it. " + " ".join(edited).upper() + " after"), (2, " ".join(words[:20])), (3, "nothing"), (None, " ".join(words)), (4, None), (1, "other")]
    bench = spark.createDataFrame([(9, " ".join(words)), (10, "too few"), (11, ""), (None, None)], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(decontaminate.contaminated(df, bench), "doc_id", "item_id") == [(1, 9), (None, 9)]
    assert result(decontaminate.contaminated(df, bench, block_items=1), "doc_id", "item_id") == [(1, 9), (None, 9)]
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0 and decontaminate.contaminated(df.limit(0), bench).count() == 0


# --- op7 ---

def test_known_licences_whatever_their_form(spark, odd):
    mit, bsd = licenses.KNOWN["MIT"][0], licenses.KNOWN["BSD-3-Clause"][0]
    rows = [(0, "Copyright (c) 2020 Me\n" + mit.upper().replace('"', "“")), (1, bsd.replace(",", " ,")), (2, "x\nLicenced under the  apache license version 2.0\n"), (3, "see Licence"), (4, mit + " more"), (None, mit), (0, mit)]
    got = result(licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "license", "line_licenses")
    assert got == sorted([(0, "MIT", ""), (0, "MIT", ""), (1, "BSD-3-Clause", ""), (2, None, "Apache-2.0"), (None, "MIT", "")], key=repr)
    assert all(re.search(licenses.HINT, t) for texts in licenses.KNOWN.values() for t in texts)
    assert licenses.license_scan(odd).count() == 0 == licenses.license_scan(odd.limit(0)).count()


def test_licence_query_matches_brute_force(spark, docs):
    known = {licenses.canonical_text(t): name for name, texts in licenses.KNOWN.items() for t in texts}
    want = []
    for i, t in docs.items():
        lines = [known[c] for c in map(licenses.canonical_text, (t or "").split("\n")) if c in known]
        whole = known.get(licenses.canonical_text(t or ""))
        if lines or whole:
            want.append((i, whole, ",".join(sorted(set(lines))), len(lines)))
    assert result(licenses.op7_license_scan(spark, SF), "doc_id", "license", "line_licenses", "n_license_lines") == sorted(want, key=repr)


# --- op8 ---

def test_packing_loses_nothing(spark, odd):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    rows = [*ODD, (50, "a <|endoftext|> b"), (51, "x" * 3000), (52, "  \n\n  it's 12345 ...")]
    pieces = packing.pack(spark.createDataFrame([(r[0], r[1], "z") for r in rows], "doc_id long, text string, ids string"), packing.default_tokenizer(), width=256).collect()
    want = collections.Counter()
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 256):
            want[i, a, len(ids), ids[a : a + 256].tobytes()] += 1
    assert collections.Counter((r.doc_id, r.start, r.doc_tokens, bytes(r.ids)) for r in pieces) == want
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in pieces)
    by = collections.defaultdict(list)
    for r in pieces:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(odd.limit(0), packing.default_tokenizer()).count() == 0


def test_ids_are_those_of_the_tokenizer(spark):
    """Every id of every document of the tables, as CRC of its pieces, against the other library."""
    from tokenizers import Tokenizer

    tok, sf = Tokenizer.from_file(packing.default_tokenizer()), f"{oracle.DATA}/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = {i: np.array([*e.ids, 1], "<u4") for i, e in zip(texts, tok.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    seen = collections.Counter()
    for r in packing.op8_packing(spark, sf).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
    assert seen == {i: len(v) for i, v in ids.items()}


def test_little_padding(spark):
    by = collections.Counter()
    for r in packing.op8_packing(spark, f"{oracle.DATA}/sf0.01").collect():
        by[r.sequence_id] += r.length
    padding = sum(2048 - n for n in by.values() if n & (n - 1))
    assert padding < 0.01 * sum(by.values())


# --- op9 ---

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            n = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(n))) % 10 == 0 if len(n) < 20 else False
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or 0) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(n) <= 19 and luhn) or kind == "phone" and not 10 <= len(n) <= 15:
                continue
            out.append((m.start(), rank, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def test_personal_data_matches_brute_force(spark, docs):
    for r in pii.op9_pii(spark, SF).collect():
        want = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in want) for k in BASE]
        assert set(want) <= set(r.spans.split(",")) or not want


def test_personal_data_in_odd_texts(spark, odd):
    texts = ["a@b.c_d@e.f x@y.z..q@r.s 1.2.3.4.5.6.7.8 999.1.1.1.2.3 é" + "9" * 30 + " +1 (2) 3-4 +12345678901", "@@a@b.c@d.e", "1" * 5000 + ".1.1.1", "x" * 20000, "4 1-1 " * 4000]
    texts += ["✓ 4111 1111 1111 1111 ✓", "DE89 3704 0044 0532 0130 00 IS, GB82WEST12345698765432, DE88 3704 0044 0532 0130 00", "my ssn 123-45-6789", "call 123-45-6789", None, ""]
    found = pii.find_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    rows = {r.doc_id: r for r in found.select("*", pii.redacted(found.text, found.spans).alias("red")).collect()}
    for i, t in enumerate(texts):
        assert [f"{s.kind}:{s.start}:{s.end}" for s in rows[i].spans if s.base] == base_spans(t or "")
    assert [[s.kind for s in rows[i].spans] for i in (6, 7, 8)] == [["iban", "iban"], ["ssn"], []]
    assert rows[5].red == "✓ [CARD] ✓" and rows[9].red is None
    assert pii.find_spans(odd).count() == len(ODD) and pii.find_spans(odd.limit(0)).count() == 0


# --- op10 ---

def test_chat_round_trip(spark):
    odd = "\\ <|end|> <|turn|>assistant\n</s>[INST]<s>\\n [/INST] <"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (None, 0, "a\nb\\", "x"), (None, None, None, None), (2, 0, "user", "q"), (2, 0, "user", "q"), (2, 1, "assistant", "|turn|>" * 2000)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "conv_id long, turn long, role string, text string, piece string, position int")
    turns = chat_format.format_turns(df)
    expanded = chat_format.examples(turns)
    back = [(r.conv_id, t.role, t.text) for r in chat_format.read_back(expanded).collect() for t in r.turns]
    assert sorted(back, key=repr) == sorted(((c, r or "", t or "") for c, _, r, t in rows), key=repr)
    assert all(r.piece.count("<|") == 2 and "[INST]" not in r.piece and "</s>" not in r.piece for r in turns.collect())
    whole = chat_format.written_out(expanded).collect()
    assert len(whole) == 3 and expanded.where("loss_start is null").count() == 1
    trained = {(r.conv_id, r.example): (r.trained, r.n_chars) for r in chat_format.read_back(expanded).collect()}
    for r in whole:
        assert r.text.endswith("<|end|>") and r.text[r.loss_end :] == "<|end|>" and r.text[: r.loss_start].endswith("<|turn|>assistant\n")
        masked = spark.range(1).select(chat_format.unescaped(chat_format.F.lit(r.text[r.loss_start : r.loss_end]))).first()[0]
        assert trained[r.conv_id, r.example] == (masked, len(r.text))
    assert chat_format.examples(chat_format.format_turns(df.limit(0))).count() == 0


def test_wrong_prefix_shows(spark):
    df = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"turn {i} " * (i + 1)) for i in range(6)], "conv_id long, turn long, role string, text string")
    expanded = chat_format.examples(chat_format.format_turns(df))
    right = {r.example: r.trained for r in chat_format.read_back(expanded).collect()}
    assert right == {k: f"turn {2 * k - 1} " * (2 * k) for k in (1, 2, 3)}
    for wrong in (expanded.where("example <> 2"), expanded.withColumn("fresh", chat_format.F.expr("if(example = 2, substr(fresh, 2), fresh)"))):
        got = {r.example: r.trained for r in chat_format.read_back(wrong).collect()}
        assert got[3] != right[3]


def test_prefix_targets_stand_alone(spark):
    """Every example holds its whole context, equals the written-out form and gives its turns and target back by itself."""
    odd = "\\ <|end|> <|turn|>assistant\n</s>[INST]<s> [/INST] <"
    rows = [(1, i, ("user", "assistant")[i % 2], f"turn {i} {odd}" * (i % 3)) for i in range(7)] + [(2, 0, "assistant", odd), (None, 1, "user", None), (3, None, "a\nb\\", "x"), (3, 1, "assistant", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat_format.format_turns(df)
    made = chat_format.prefix_targets(turns)
    short = {(r.conv_id, r.example): (r.text, r.loss_start, r.loss_end) for r in chat_format.written_out(chat_format.examples(turns)).collect()}
    assert {(r.conv_id, r.example): (r.text, r.loss_start, r.loss_end) for r in made.where("loss_start is not null").collect()} == short and len(short) == 5
    each = {(r.conv_id, r.example): r for r in chat_format.read_targets(made.withColumn("last", chat_format.F.lit(True))).collect()}
    for conv in (1, 2, None, 3):
        given = [(r[2], r[3] or "") for r in rows if r[0] == conv]
        ends = [i for i, r in enumerate(given) if r[0] == "assistant" or i == len(given) - 1]
        for k, end in enumerate(ends, 1):
            r = each.pop((conv, k))
            assert [(t.role, t.text) for t in r.turns] == given[: end + 1] and r.trained == (given[end][1] if given[end][0] == "assistant" else None)
    assert not each
    plan = queries.QUERIES["op10_chat_format"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "slice(" in plan


# --- pipeline ---

def test_pipeline_matches_brute_force(spark, docs):
    import corpus_pipeline

    kept = {r.doc_id for r in quality_rules.op3_quality_rules(spark, SF).collect() if r.kept}
    sets = {i: shingles(docs[i]) for i in kept}
    low = classes(list(kept), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    leaks = {r.doc_id for r in decontaminate.op6_decontaminate(spark, SF).collect()}
    want = {i for i in kept if low[i] == i} - leaks
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in out} == want
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.start, bytes(r.ids)))
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    for i, parts in by.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(parts)), "<u4").tolist()
        text = tok.decode(ids[:-1], skip_special_tokens=False)
        assert ids[-1] == 1 and (text == docs[i] or base_spans(docs[i]) and not base_spans(text) or "[SECRET]" in text)


def test_rules_go_by_rejections_per_second_of_what_is_left(spark):
    import time

    from agrispark.llm import quality_rules

    def rule(share, seconds, start=0):
        def judged(t):
            time.sleep(seconds)
            ids = np.array([int(t.raw[a:b].tobytes().split()[0]) for a, b in zip(t.at[:-1], t.at[1:], strict=True)])
            return (ids % 100 >= start) & (ids % 100 < start + share)

        return judged

    # by themselves: twin 60, wide 60, other 30, slow 90, none 0; after wide, twin rejects nothing and other 30
    rules = {"none": rule(0, 0.0), "slow": rule(90, 2.0), "twin": rule(60, 0.06), "other": rule(30, 0.06, 60), "wide": rule(60, 0.02)}
    words = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(i, f"{i} {words}") for i in range(400)] + [(i, f"{i}") for i in range(400, 800)], "doc_id int, text string").coalesce(1)
    got = quality_rules.rule_costs(docs, sample_rows=10**6, rules=rules)
    assert [r for r, _, _ in got][:2] == ["wide", "other"] and {r for r, _, n in got if n == 0} == {"none", "twin", "slow"}
    assert [n for _, _, n in got][:2] == [240.0, 120.0]  # rows that the base rejects count for none
    assert quality_rules.rule_costs(docs.limit(0), rules=rules)
    assert quality_rules.best_order([1.0, 1.0], {}) == [(0, 0.0), (1, 0.0)]
