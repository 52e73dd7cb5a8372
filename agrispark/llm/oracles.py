"""DuckDB SQL for the text operators that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"

QUALITY = rf"""WITH {_WORDS},
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d) u),
r AS (SELECT doc_id, k FROM g GROUP BY doc_id, k HAVING count(*) > 1),
p AS (SELECT DISTINCT g.doc_id, g.i + o AS pos FROM g JOIN r ON r.doc_id = g.doc_id AND r.k = g.k, (VALUES (0), (1), (2)) x(o)),
n AS (SELECT doc_id, count(*) AS rep FROM p GROUP BY doc_id),
c AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls,
 coalesce(rep, 0) AS n_repeat_words, len(regexp_extract_all(t, '[A-Z]')) AS up, len(regexp_extract_all(t, '[A-Za-z]')) AS letters, len(regexp_extract_all(t, '!')) AS bangs,
 len(list_filter(w, lambda x: regexp_matches(x, '[^\x00-\x40\x5B-\x60\x7B-\x7F]'))) AS lettered FROM d LEFT JOIN n ON n.doc_id = d.doc_id),
b AS (SELECT *, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT (base_failed OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR (len(ls) >= 6 AND 2 * n_dup_lines > len(ls))
 OR 10 * up > 3 * letters OR 5 * bangs > n_words OR 2 * lettered < n_words) AS kept FROM b"""

SUBSTRING = rf"""WITH {_WORDS},
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS i FROM d) u),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM g) q WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, pos FROM (SELECT doc_id, unnest(generate_series(i, i + 19)) AS pos FROM a) q),
e AS (SELECT doc_id, i AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM d) u),
k AS (SELECT e.doc_id, count(gone.pos) AS n_removed, string_agg(CASE WHEN gone.pos IS NULL THEN word END, ' ' ORDER BY e.pos) AS kept
 FROM e LEFT JOIN gone ON gone.doc_id = e.doc_id AND gone.pos = e.pos GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id"""


def _escaped_length(c: str) -> str:
    return rf"(length({c}) + length({c}) - length(replace({c}, '\', '')) + len(regexp_extract_all({c}, '<\||<s>|</s>|\[INST\]|\[/INST\]')))"


CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
l AS (SELECT *, sum(16 + {_escaped_length('role')} + length(role) - length(replace(role, chr(10), '')) + {_escaped_length('text')}) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS stop FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
 CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN stop END), 0) AS BIGINT) AS formatted_chars FROM l GROUP BY conv_id"""

#: The 256 remainders of crc32, made bit by bit, and the crc32 of a list of bytes by them.
_CRC = """crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
 lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END) AS c FROM range(256) r(i)) x)"""


def _crc(octets: str) -> str:
    """The unsigned crc32 of a list of bytes; the table is a column ``t``."""
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)), CAST(4294967295 AS BIGINT))"


def _octets(text: str) -> str:
    """UTF-8 bytes of text below U+0800."""
    points = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    return f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + (p >> 6), 128 + (p & 63)] END))"


SPELLING = f"""WITH RECURSIVE {_CRC},
runs AS (SELECT d, w, count(*) AS k FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
 translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) q GROUP BY d, w),
hashed AS (SELECT w, k, {_crc(_octets("d || ':' || w"))} AS h FROM runs, crc),
made AS (SELECT CASE WHEN h % 31 = 0 THEN w[:CAST(h % length(w) AS INT)] || w[CAST(h % length(w) AS INT) + 2:] ELSE w END AS word, k FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
less AS MATERIALIZED (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words) q),
longer AS (SELECT DISTINCT a.word AS short, a.n AS short_n, b.word AS long, b.n AS long_n FROM words a JOIN less b ON b.rest = a.word),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
 UNION ALL SELECT short, long, long_n FROM longer UNION ALL SELECT long, short, short_n FROM longer),
best AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -near_n, b := near)) AS top FROM near GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -top.a >= 10 * w.n THEN top.b END AS form, CASE WHEN -top.a >= 10 * w.n THEN -top.a END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS at, form AS next FROM forms UNION ALL SELECT k.word, k.next, f.form FROM walk k JOIN forms f ON f.word = k.next WHERE k.next IS NOT NULL)
SELECT f.word, f.form, k.at AS root, f.n, f.n_near, f.form_n FROM forms f JOIN walk k ON k.word = f.word AND k.next IS NULL"""


def _with(letter: str, cost: str, rest: str) -> str:
    """A letter before a value, which is the cost as nine digits and then the letters."""
    return f"(lpad(CAST(CAST({rest}[:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || '{letter}' || {rest}[10:])"


def _kept(initial: str, rest: str, other: str | None = None) -> str:
    also = f" OR i = '{other}'" if other else ""
    return f"CASE WHEN NOT gone AND (i = '{initial}'{also}) THEN {_with('K', 'cut', rest)} END"


_OF = {state: f"least({_with('D', '3', 'b.' + state)}, CASE WHEN NOT gone THEN {_with('R', '2 + cut', 'b.' + after)} END, {kept})" for state, after, kept in (
    ("s0", "s2", f"CASE WHEN i = 's' THEN {_kept('s', 'b.s1')} ELSE {_kept('u', 'b.s2')} END"), ("s1", "s2", _kept("u", "b.s2")), ("s2", "s3", _kept("a", "b.s3")), ("s3", "s2", _kept("u", "b.s2")))}

REPAIR = rf"""WITH RECURSIVE {_CRC},
given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc(_octets("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"))} % 20 AS kind FROM conversations, crc),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
 CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(generate_series(1, CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM given WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER w AS p, lag(role[1]) OVER w AS was, role[1] AS i0 FROM hurt WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
judged AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN min(p) OVER (PARTITION BY conv_id, role, text) < p THEN 'duplicate'
 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM placed),
steps AS MATERIALIZED (SELECT conv_id, p, role, text, i0 AS i, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM judged),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
 count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (was IS NOT NULL AND was || i0 NOT IN ('su', 'ua', 'au')) AS illegal, max(p) AS last FROM judged GROUP BY conv_id),
ends AS (SELECT conv_id, last, '000000000' AS s0, CAST(NULL AS VARCHAR) AS s1, {_with("I", "2", "'000000000'")} AS s2, '000000000' AS s3 FROM counts),
back AS (SELECT conv_id, last AS p, s0, {_with("I", "2", "s2")} AS s1, s2, s3 FROM ends
 UNION ALL SELECT conv_id, p, least(r0, {_with("I", "2", "i2")}) AS s0, least(r1, {_with("I", "2", "i2")}) AS s1, i2 AS s2, i3 AS s3 FROM (
  SELECT *, least(r2, {_with("I", "2", "r3")}) AS i2, least(r3, {_with("I", "2", "r2")}) AS i3 FROM (
   SELECT b.conv_id, b.p - 1 AS p, {_OF["s0"]} AS r0, {_OF["s1"]} AS r1, {_OF["s2"]} AS r2, {_OF["s3"]} AS r3 FROM back b JOIN steps s ON s.conv_id IS NOT DISTINCT FROM b.conv_id AND s.p = b.p) x) y),
best AS (SELECT conv_id, CAST(s0[:9] AS BIGINT) AS cost, s0[10:] AS audit FROM back WHERE p = 0),
pieces AS (SELECT conv_id, unnest(regexp_extract_all(audit, 'I|[DKR]')) AS e, unnest(generate_series(1, length(audit))) AS o FROM best),
owned AS (SELECT *, count(*) FILTER (e <> 'I') OVER (PARTITION BY conv_id ORDER BY o) AS p FROM pieces),
left_over AS (SELECT w.conv_id, w.o, w.e, CASE WHEN e <> 'I' THEN s.role END AS role, CASE WHEN e = 'I' THEN '' ELSE s.text END AS text FROM owned w LEFT JOIN steps s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.p = w.p WHERE e <> 'D'),
heads AS (SELECT *, row_number() OVER v AS q, first_value(CASE WHEN e = 'K' THEN role[1] END) OVER v AS head FROM left_over WINDOW v AS (PARTITION BY conv_id ORDER BY o)),
said AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (q + CASE WHEN head = 's' THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY o)) AS h FROM heads GROUP BY conv_id)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) g
 LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM g.conv_id LEFT JOIN said s ON s.conv_id IS NOT DISTINCT FROM g.conv_id"""

_EDGE = r"(?:[^a-z0-9]|\A|\z)"
#: The default patterns as expressions, written by hand.
_PATTERNS = ", ".join(
    f"('{name}', '{verdict}', '(?s){expression}')"
    for name, verdict, expression in (
        ("^casino^", "block", rf"{_EDGE}casino{_EDGE}"),
        ("^casino-film^", "allow", rf"{_EDGE}casino-film{_EDGE}"),
        ("^poker^online^", "block", rf"{_EDGE}poker{_EDGE}online{_EDGE}"),
        ("^free-bets^", "block", rf"{_EDGE}free-bets{_EDGE}"),
        ("^sports-betting^", "block", rf"{_EDGE}sports-betting{_EDGE}"),
        ("^cheap-pills^", "block", rf"{_EDGE}cheap-pills{_EDGE}"),
        ("^online-pharmacy^", "block", rf"{_EDGE}online-pharmacy{_EDGE}"),
        ("^payday^loan", "block", rf"{_EDGE}payday{_EDGE}loan"),
        ("||adult-", "block", r"\A[^/?#]*://([^/?#]*\.)?adult-"),
        ("||adult-education.", "allow", r"\A[^/?#]*://([^/?#]*\.)?adult-education\."),
        ("||xxx.", "block", r"\A[^/?#]*://([^/?#]*\.)?xxx\."),
        (".xxx/", "block", r"\.xxx/"),
        ("^spam-farm^", "block", rf"{_EDGE}spam-farm{_EDGE}"),
        ("^link-farm^", "block", rf"{_EDGE}link-farm{_EDGE}"),
        ("^ads-track^", "block", rf"{_EDGE}ads-track{_EDGE}"),
        ("||adserver.", "block", r"\A[^/?#]*://([^/?#]*\.)?adserver\."),
        ("^banner-ads^*.gif|", "block", rf"{_EDGE}banner-ads{_EDGE}.*\.gif\z"),
        ("^free-download^*^crack^", "block", rf"{_EDGE}free-download{_EDGE}.*{_EDGE}crack{_EDGE}"),
        ("^keygen^", "block", rf"{_EDGE}keygen{_EDGE}"),
        ("^click-here^*^win^prize^", "block", rf"{_EDGE}click-here{_EDGE}.*{_EDGE}win{_EDGE}prize{_EDGE}"),
    )
)

URLS = rf"""WITH u AS (SELECT page_id, row_number() OVER () AS k, translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
 translate(regexp_extract(coalesce(url, ''), '(?s)\A.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
 regexp_extract(coalesce(url, ''), '(?s)\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
r(h, p, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
site AS (SELECT k, max(struct_pack(a := length(h || p), b := h || p, c := v)) AS s FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY k),
q(pattern, v, e) AS (VALUES {_PATTERNS}),
fit AS (SELECT k, min(struct_pack(a := CASE WHEN v = 'allow' THEN 0 ELSE 1 END, b := -length(pattern), c := pattern, d := v)) AS f FROM u JOIN q ON regexp_matches(low, e) GROUP BY k)
SELECT page_id, host, path, s.b AS rule, coalesce(s.c, f.d, 'allow') AS verdict, CASE WHEN s IS NULL THEN f.c END AS pattern FROM u LEFT JOIN site ON site.k = u.k LEFT JOIN fit ON fit.k = u.k"""

ORACLES: dict[str, str] = {"op11_spelling_variants": SPELLING, "op12_turn_repair": REPAIR, "op13_url_filter": URLS, "op3_quality_rules": QUALITY, "op4_substring_dedup": SUBSTRING, "op10_chat_format": CHAT}
