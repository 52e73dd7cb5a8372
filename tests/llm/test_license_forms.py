"""Notices and texts of licences in the forms that documents hold."""

import textwrap

from agrispark.llm import licenses


def test_notices_full_texts_and_wrapped_texts(spark):
    isc = licenses.KNOWN["ISC"][0]
    wrapped = [textwrap.fill(isc, w) for w in range(60, 90)]
    assert any(line.startswith("copyright notice") for t in wrapped for line in t.split("\n"))
    full = {p.stem: p.read_text() for p in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    rows = [(0, "x\nThis work is licensed under the GNU General Public License, version 3.\ny"), (1, "a\nLicensed under CC BY-NC 4.0."), (2, "Released under GPLv3")]
    rows += [(10 + k, t) for k, t in enumerate(wrapped)] + [(100 + k, full[n]) for k, n in enumerate(sorted(full))]
    rows += [(200, "Copyright Jane Doe\n" + isc), (201, "(c) 2020 Me\n" + isc), (202, textwrap.fill(full["Apache-2.0"], 10**6)), (203, full["Unlicense"].partition("For more")[0])]
    got = {r.doc_id: (r.license, r.line_licenses) for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0], got[1], got[2][0]) == ((None, "GPL-3.0"), (None, "CC-BY-NC-4.0"), "GPL-3.0")
    assert {got.get(10 + k, [None])[0] for k in range(len(wrapped))} == {"ISC"}
    assert [got.get(100 + k, [None])[0] for k in range(len(full))] == sorted(full)
    assert [got.get(k, [None])[0] for k in (200, 201, 203)] == ["ISC", "ISC", "Unlicense"]


def test_own_texts_need_no_hint(spark):
    known = licenses.known_digests(spark, {"own": ["You may do as you like."]})
    rows = spark.createDataFrame([(1, "YOU may do, as you like!"), (2, "x\nyou may do as you like\n"), (3, "as you like"), (None, None), (4, "")], "doc_id long, text string")
    got = sorted((r.doc_id, r.license, r.line_licenses) for r in licenses.license_scan(rows, known=known).collect())
    assert got == [(1, "own", "own"), (2, None, "own")]
