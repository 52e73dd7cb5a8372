"""Licence scan by canonical digests.

A text's canonical form has no case, punctuation, copyright lines or spelling
variants. Entire texts, and entire lines, whose canonical form has the digest
of a known licence or notice are reported; the digests meet in a hash join.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from agrispark.llm.common import keyed, original_id

_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES "
    "WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR "
    "IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
_BSD_12 = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts and notices (fixed values).
KNOWN: dict[str, list[str]] = {
    "MIT": [
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
        "following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        'Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "SPDX-License-Identifier: MIT",
    ],
    "ISC": [
        f"ISC License\n\n{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_END}",
        "Released under the ISC License.",
        "Licensed under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ],
    "0BSD": [f"Zero-Clause BSD License\n\n{_GRANT}.\n\n{_ISC_END}", "SPDX-License-Identifier: 0BSD"],
    "BSD-2-Clause": [
        f"BSD 2-Clause License\n\n{_BSD_HEAD}{_BSD_12}{_BSD_END}",
        "Released under the BSD 2-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "BSD-3-Clause": [
        f"BSD 3-Clause License\n\n{_BSD_HEAD}{_BSD_12}{_BSD_3}{_BSD_END}",
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a '
        "copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the '
        "License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0": [
        "Licensed under the GNU General Public License, Version 3.",
        "Released under the GNU General Public License, Version 3.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "CC-BY-4.0": [
        "Licensed under the Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}
#: How notices begin, and the names by which they call a licence; every beginning goes with every name.
BEGINNINGS = [
    f"{subject}{verb} under {article}"
    for subject in ("", *(f"This {x} is " for x in ("work", "software", "project", "program", "file")))
    for verb in ("Licensed", "Released", "Distributed")
    for article in ("", "the ", "a ", "the terms of the ")
]


def _gnu(name: str, short: str, number: str) -> list[str]:
    named = [f"{x}{sep}{v}" for x in (f"GNU {name}", f"GNU {short}", short) for v in {number, number.removesuffix(".0")} for sep in (" version ", " v", " ", "v")]
    return [f"{x}{later}" for x in named for later in ("", " or later", " or any later version")]


def _cc(words: str, short: str, number: str) -> list[str]:
    kinds = ("", " License", " International", " International License", " Unported License")
    return [f"{x} {number}{k}" for x in (f"Creative Commons {words}", f"CC {short}", f"Creative Commons {short}") for k in kinds]


NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT License", "Expat License", "MIT/Expat License"],
    "ISC": ["ISC", "ISC License"],
    "0BSD": ["0BSD", "0BSD License", "Zero-Clause BSD License", "BSD Zero Clause License"],
    "BSD-2-Clause": ["BSD 2-Clause", "BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD 2-Clause Simplified License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause", "BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "Apache-2.0": [f"{x}{v}{k}" for x in ("Apache", "Apache License", "Apache Software License") for v in (" 2.0", " v2.0", " Version 2.0", " v2", " 2", " Version 2") for k in ("", " License")],
    "GPL-2.0": _gnu("General Public License", "GPL", "2.0"),
    "GPL-3.0": _gnu("General Public License", "GPL", "3.0"),
    "LGPL-2.1": _gnu("Lesser General Public License", "LGPL", "2.1"),
    "LGPL-3.0": _gnu("Lesser General Public License", "LGPL", "3.0"),
    "AGPL-3.0": _gnu("Affero General Public License", "AGPL", "3.0"),
    "MPL-2.0": [f"{x}{v}" for x in ("Mozilla Public License", "MPL") for v in (" 2.0", " v2.0", " v. 2.0", " Version 2.0")],
    "CC0-1.0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal License"],
    "Unlicense": ["Unlicense", "Unlicense License"],
    **{
        f"CC-{short}-{number}": _cc(words, short, number)
        for words, short in (
            ("Attribution", "BY"),
            ("Attribution-ShareAlike", "BY-SA"),
            ("Attribution-NonCommercial", "BY-NC"),
            ("Attribution-NoDerivatives", "BY-ND"),
            ("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
            ("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
        )
        for number in ("2.0", "2.5", "3.0", "4.0")
    },
}


def _complete() -> None:
    """Adds to KNOWN the notices, SPDX lines, full texts (with and without what follows their terms) and texts without their title."""
    for name, named in NAMES.items():
        texts = KNOWN.setdefault(name, [])
        texts += [t.partition("\n\n")[2] for t in list(texts) if "\n\n" in t and t.partition("\n\n")[0].endswith("License")]
        texts += [f"{x}{y}" for x in BEGINNINGS for y in named]
        spdx = [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]
        texts += [f"SPDX-License-Identifier: {x}" for x in spdx]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        KNOWN[path.stem].append(text)
        for end in ("END OF TERMS AND CONDITIONS", "For more information"):
            if end in text:
                KNOWN[path.stem].append(text.partition(end)[0] + (end if end.isupper() else ""))


_complete()
#: Spellings that count as equal (fixed values).
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "cancelled": "canceled",
    "catalogue": "catalog",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelled": "labeled",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "merchantibility": "merchantability",
    "modelling": "modeling",
    "noncommercial": "non commercial",
    "organisation": "organization",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "utilisation": "utilization",
    "wilful": "willful",
}
#: Words that follow "copyright" or "(c)" inside the known texts; other words there name a holder.
INSIDE = "|".join(sorted({w for texts in KNOWN.values() for t in texts for w in re.findall(r"(?:\bcopyright|\(c\))\s+([a-z]+)", t.lower())} - {"by", "copyright"}))
_HOLDER = rf"(?:©|[0-9]{{4}}|[<\[{{{{]|(?!(?:{INSIDE})\b)[a-z\x{{80}}-\x{{10FFFF}}])"
#: (pattern, replacement), in their order; each means the same in Java's and Python's syntax. A line that starts like
#: a copyright line goes only if a sign, a year or a holder follows, as lines of wrapped texts may start with the word.
STEPS = [
    (rf"(?m)^[ \t/*#;-]*(?:©|copyright\b[ \t:]*(?:\(c\)|{_HOLDER})|\(c\)[ \t]*{_HOLDER})[^\n]*$", " "),
    (r"all rights reserved", " "),
    (r"©|\(c\)", " copyright "),
    (r"https?://", " http "),
    (r"[^a-z0-9\x{80}-\x{10FFFF}]+|[\x{2010}-\x{201F}\x{A0}]+", " "),
    *((rf"\b{a}\b", b) for a, b in SPELLINGS.items()),
    (r"^ +| +$", ""),
    (r" +", " "),
]


COMPILED = [(re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: f"\\U{int(m[1], 16):08x}", pattern)), by) for pattern, by in STEPS]


def canonical(text: Column) -> Column:
    out = F.lower(text)
    for pattern, by in STEPS:
        out = F.regexp_replace(out, pattern, by)
    return out


def canonical_text(text: str) -> str:
    """``canonical`` of one Python string, for the known texts."""
    out = text.lower()
    for pattern, by in COMPILED:
        out = pattern.sub(by, out)
    return out


def _hint() -> str:
    """A pattern that every known text meets: what notices have, and as many long words as the other texts need."""
    words = ["licen[cs]e", "(?:released|distributed)[^a-z0-9]+under"]
    left = [set(re.findall("[a-z]{8,}", t.lower())) for texts in KNOWN.values() for t in texts if not re.search("|".join(words), t.lower())]
    while left:
        n = Counter(w for t in left for w in t)
        word = max(n, key=lambda w: (n[w], len(w), w))
        words += [word, *(a for a, b in SPELLINGS.items() if b == word)]
        left = [t for t in left if word not in t]
    return "(?iu)" + "|".join(words)


#: Every known text has one of these, so other texts need no canonical form.
HINT = _hint()


def known_digests(spark: SparkSession, known: dict[str, list[str]] | None = None) -> DataFrame:
    rows = {hashlib.sha256(canonical_text(t).encode()).hexdigest(): name for name, texts in (known or KNOWN).items() for t in texts}
    return spark.createDataFrame(sorted(rows.items()), "digest string, license string")


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None, hint: str | None = None) -> DataFrame:
    """Documents that are, or hold a line that is, a known licence or notice.

    ``doc_id, license`` (of the entire text, else null), ``line_licenses``
    (names found as entire lines, sorted, comma-joined) and ``n_license_lines``.
    known: digests of canonical forms and their names, in place of the texts
    here. hint: only texts and lines that have it are brought to canonical
    form; by default every known text here has it, and with ``known`` all are
    tried. Null and empty texts match nothing; rows alike in id and text
    give one row each; a null id stays null; other columns are ignored.
    """
    if known is None:
        known, hint = F.broadcast(known_digests(docs.sparkSession)), hint or HINT  # a fixed list of some 60,000 digests
    has = lambda c: F.col(c).rlike(hint) if hint else F.lit(True)
    likely = keyed(docs, id_col, text_col).where(has("_text"))
    units = likely.select("_doc", "_tk", F.lit(-1).alias("line"), F.col("_text").alias("unit"))
    lines = likely.select("_doc", "_tk", F.posexplode(F.split("_text", "\n")).alias("line", "unit")).where(has("unit"))
    hits = (
        units.unionByName(lines)
        .withColumn("digest", F.sha2(canonical(F.col("unit")), 256))
        .drop("unit")
        .join(known, "digest")
    )
    whole = F.col("line") < 0
    found = hits.groupBy("_doc", "_tk").agg(
        F.min(F.when(whole, F.col("license"))).alias("license"),
        F.array_join(F.array_sort(F.collect_set(F.when(~whole, F.col("license")))), ",").alias("line_licenses"),
        F.countDistinct(F.when(~whole, F.col("line"))).alias("n_license_lines"),
    )
    return likely.select("_doc", "_tk").join(found, ["_doc", "_tk"]).select(original_id().alias(id_col), "license", "line_licenses", "n_license_lines")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
