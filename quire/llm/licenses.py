"""License scans: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates are split into words; hashes of ``SHINGLE`` words are winnowed (the smallest in every window of
``WINDOW``) into an inverted index, some 13,000 entries for the fixed templates below: one-line notices, identifier tags,
headers and whole license texts. Templates under ``SHORT`` words have all their shingles of ``SHORT_SHINGLE`` words in it, as
one changed word leaves no longer one whole. A document's
shingles are looked up in it; only runs of words that occur in some template can hit. Hits of a template
on near diagonals form a candidate, which a banded semi-global alignment of words scores: coverage is the
share of template words matched in order, and the span runs from the first to the last matched word. What a match
covers is masked and the remaining hits go on, so each of several copies is reported, however close.

A match has coverage of 0.8 or more, an identifier tag all its words; one inside the span of a match with more matched words is dropped.
Defined results: null, empty and blank texts have no match; a document without matches gives one row with
null license; rows that repeat a doc_id are scanned each; equal matches sort by start, then name; empty
tables give empty results; extra columns are ignored. Texts are scanned whole, whatever their length.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._license_bodies import BODIES
from quire.runtime import ship_code, spread

SHINGLE, WINDOW, COVERAGE, BAND, SHORT, SHORT_SHINGLE = 5, 3, 0.8, 12, 12, 3
EXPRESSION = 12  # words of a notice that another license's may stand in, as in "MIT OR Apache-2.0"
WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution. {third} THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS
BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING
IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
#: Public license notices.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "MIT-line": "Released under the MIT License",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.1-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "AGPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-3.0-or-later": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "LGPL-2.0-or-later": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by
the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by
the Free Software Foundation.""",
    "GPL-3.0-only": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by
the Free Software Foundation.""",
    "BSD-2-Clause-body": _BSD.format(third=""),
    "BSD-3-Clause-body": _BSD.format(third="""Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""),
    "ISC-body": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER
RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE.""",
    "Unlicense-body": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this
software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the
author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and
to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under
copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the
following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as
being the original software. 3. This notice may not be removed or altered from any source distribution.""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and
the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are
solely in the form of machine-executable object code generated by a source language processor.""",
    **BODIES,
}
#: Names of a license as one-line notices write them; each follows "Licensed under" and, where it is short, other verbs.
_NAMES = {
    "Apache-2.0": ("the Apache License 2.0", "the Apache 2.0 license", "Apache License, Version 2.0"),
    "MIT": ("the MIT License", "the terms of the MIT License"),
    "ISC": ("the ISC License", "the terms of the ISC License"),
    "BSD-2-Clause": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License"),
    "BSD-3-Clause": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License"),
    "MPL-2.0": ("the Mozilla Public License, Version 2.0", "the Mozilla Public License 2.0", "the MPL 2.0"),
    "MPL-1.1": ("the Mozilla Public License, Version 1.1", "the Mozilla Public License 1.1"),
    "EPL-2.0": ("the Eclipse Public License, Version 2.0", "the Eclipse Public License 2.0"),
    "EPL-1.0": ("the Eclipse Public License, Version 1.0", "the Eclipse Public License 1.0"),
    "BSL-1.0": ("the Boost Software License, Version 1.0",),
    "CC0-1.0": ("CC0 1.0 Universal", "the CC0 1.0 license", "the Creative Commons CC0 1.0 Universal"),
}
_NAMES = {license_id: (*names, *(n.removeprefix("the ") for n in names if n.startswith("the "))) for license_id, names in _NAMES.items()} | {
    f"{short}-{v if '.' in v else v + '.0'}{suffix}": tuple(
        f"the {name}{later}" for later in laters for name in (f"GNU {long} License, version {v}", f"GNU {long} License v{v}", f"GNU {short} version {v}", f"GNU {short} v{v}", f"{short} version {v}", f"{short} v{v}")
    )
    for short, long, versions in (("GPL", "General Public", "123"), ("LGPL", "Lesser General Public", ("2.1", "3")), ("AGPL", "Affero General Public", "3"), ("GFDL", "Free Documentation", ("1.2", "1.3")))
    for v in versions
    for suffix, laters in (("", ("",)), ("-or-later", (" or later", ", or (at your option) any later version")))
}
_CC = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
_NAMES |= {
    f"CC-{kind}-{v}": (f"CC {kind} {v}", f"the CC {kind} {v} license", f"a Creative Commons {long} {v} {'International' if v == '4.0' else 'Unported'} License", f"a Creative Commons {long} {v} License", f"Creative Commons {long} {v}")
    for kind, long in _CC.items()
    for v in ("1.0", "2.0", "2.5", "3.0", "4.0")
}


#: Identifiers of licenses in tags; names with versions above are added.
_TAGS = "MIT MIT-0 ISC Zlib Unlicense WTFPL PostgreSQL NCSA 0BSD BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 Apache-1.1 Apache-2.0 Artistic-1.0 Artistic-2.0 CDDL-1.0 CDDL-1.1 CC0-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 MPL-1.1 MPL-2.0 OFL-1.1 Python-2.0".split()
_TAGS += [f"{family}-{v}{suffix}" for family, versions in (("GPL", ("1.0", "2.0", "3.0")), ("LGPL", ("2.0", "2.1", "3.0")), ("AGPL", ("3.0",)), ("GFDL", ("1.2", "1.3"))) for v in versions for suffix in ("", "-only", "-or-later")]
_TAGS += [f"CC-{kind}-{v}" for kind in _CC for v in ("1.0", "2.0", "2.5", "3.0", "4.0")]


def _lines() -> dict[str, str]:
    out: dict[str, str] = {f"{tag}-tag": f"SPDX-License-Identifier: {tag}" for tag in _TAGS}
    taken = {tuple(tokens(text)) for text in TEMPLATES.values()}
    for license_id, names in _NAMES.items():
        for name in names:
            verbs = ("Licensed", "This work is licensed") if len(tokens(name)) > 5 else ("Licensed", "Released", "Distributed", "Available")
            # the second of two licenses of a work follows a conjunction
            for begin in (*(f"{verb} under" for verb in verbs), *(("and", "or", "and under", "or under") if name.startswith("the ") else ())):
                own = tuple(tokens(line := f"{begin} {name}"))
                if len(own) > SHORT_SHINGLE and own not in taken:
                    taken.add(own)
                    out[f"{license_id}-line" if f"{license_id}-line" not in TEMPLATES | out else f"{license_id}-line-{sum(x.startswith(f'{license_id}-line') for x in TEMPLATES | out) + 1}"] = line
    return out


#: Short forms of notices, by rule: a family's name with its version, as "Licensed under GPLv3" and "MIT licensed" write them.
_SHORT_FORMS = {
    "MIT": ("MIT licensed under the", "is MIT licensed", "code is MIT licensed"),
    **{f"{family}-{v}.0": (f"Licensed under {family}v{v}", f"Licensed under the {family}v{v}", f"Released under {family}v{v}", f"Distributed under {family}v{v}") for family, versions in (("GPL", "23"), ("LGPL", "3"), ("AGPL", "3")) for v in versions},
}


def license_of(template: str) -> str:
    """The license that a template is one of."""
    return re.sub(r"-(?:line(?:-\d+)?|tag|header|body|text|short-\d+)$", "", template)


def family_of(template: str) -> str:
    """Licenses that quote each other's names: all of one project, or the same letters before a version."""
    name = license_of(template).split("-")[0]
    return "GNU" if name in ("GPL", "LGPL", "AGPL", "GFDL") else name


def tokens(text: str) -> list[str]:
    return WORD.findall(text.lower())


TEMPLATES |= _lines()
TEMPLATES |= {f"{license_id}-short-{i}": line for license_id, lines in _SHORT_FORMS.items() for i, line in enumerate(lines[1:] if license_id == "MIT" else lines, 1)}


def shingle_hash(words: list[str] | tuple[str, ...]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass"))


def winnow(hashes: list[int]) -> set[int]:
    """Places of the smallest hash (the last of equals) in every window."""
    if len(hashes) <= WINDOW:
        return {min(range(len(hashes)), key=lambda i: (hashes[i], -i))} if hashes else set()
    return {min(range(at, at + WINDOW), key=lambda i: (hashes[i], -i)) for at in range(len(hashes) - WINDOW + 1)}


@cache
def _short_heads() -> frozenset[tuple[str, str]]:
    """The first two words of the shingles of short templates: a cheap test before a hash."""
    out = set()
    for text in TEMPLATES.values():
        own = tokens(text)
        if len(own) < SHORT:
            out |= set(zip(own, own[1:], strict=False))
    return frozenset(out)


@cache
def index() -> tuple[dict[str, list[str]], dict[int, list[tuple[str, int]]], frozenset[str], dict[str, Counter]]:
    """Words of the templates, the inverted index hash -> (template, place), their vocabulary, and how often each holds a word."""
    words = {name: tokens(text) for name, text in TEMPLATES.items()}
    postings: dict[int, list[tuple[str, int]]] = defaultdict(list)
    for name, own in words.items():
        width = SHORT_SHINGLE if len(own) < SHORT else SHINGLE
        hashes = [shingle_hash(own[i : i + width]) for i in range(len(own) - width + 1)]
        for place in range(len(hashes)) if len(own) < SHORT else winnow(hashes):
            postings[hashes[place]].append((name, place))
    return words, dict(postings), frozenset(w for own in words.values() for w in own), {name: Counter(own) for name, own in words.items()}


def drift(length: int) -> int:
    """How far a copy may stray from its diagonal: BAND words and a tenth of the template, but less than the next copy is away."""
    return min(BAND + length // 10, max(2, length // 2))


def needed(name: str, length: int) -> float:
    return length if name.endswith("-tag") else COVERAGE * length


@lru_cache(maxsize=256)
def align(template: tuple[str, ...], region: tuple[str, ...], shift: int) -> tuple[int, int, int]:
    """(matched words, first and last matched word of the region): banded alignment, free ends in the region.

    ``shift`` is where in the region the template is expected to begin; the band allows ``drift`` words around that diagonal. A match scores 2, a gap or a mismatch -1. A cell is one
    number, score, matched words, first and last matched word from the highest bit on (14 bits each but the score)."""
    half, gap, none = drift(len(template)), 1 << 42, -(1 << 62)
    codes: dict[str, int] = {}
    own = np.array([codes.setdefault(w, len(codes)) for w in region], dtype=np.int64)
    at = np.arange(len(region) + 1)
    before = np.full(len(region) + 1, none)
    before[max(0, shift - half) : max(1, shift + half + 1)] = 1 << 57
    for i, word in enumerate(template, 1):
        low, high = max(0, i + shift - half), max(0, min(len(region), i + shift + half))
        if low > high:  # the region ends inside the template
            break
        row = before[low : high + 1] - gap
        start = max(low, 1)
        diagonal = before[start - 1 : high] - gap
        same = np.flatnonzero(own[start - 1 : high] == codes.get(word, -1))
        if len(same):
            cell, place = before[same + start - 1], same + start
            ends = cell & ((1 << 28) - 1)
            first = ends >> 14
            diagonal[same] = cell - ends + 2 * gap + (1 << 28) + (np.where(first > 0, first, place) << 14) + place
        np.maximum(row[start - low :], diagonal, out=row[start - low :])
        way = at[: high - low + 1] * gap  # a gap in the template: the running maximum less the way to it
        before = np.full(len(region) + 1, none)
        before[low : high + 1] = np.maximum.accumulate(row + way) - way
    best = int(before.max())
    if best < 0:
        return 0, -1, -1
    return best >> 28 & 16383, (best >> 14 & 16383) - 1, (best & 16383) - 1


def matches(text: str | None) -> list[tuple[str, float, int, int, int]]:
    """(license, coverage, matched words, start, end) in characters of the text."""
    templates, postings, vocabulary, bags = index()
    found = list(WORD.finditer((low := (text or "").lower())))
    if len(low) != len(text or ""):  # a few letters change length in lower case: spans must point into the text itself
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text or "")
        found = list(WORD.finditer(low))
    words = [m.group() for m in found]
    hits: dict[str, list[tuple[int, int]]] = defaultdict(list)
    run, heads = 0, _short_heads()
    for at, word in enumerate(words):
        run = run + 1 if word in vocabulary else 0
        if run >= SHORT_SHINGLE and (words[at - 2], words[at - 1]) in heads:
            for name, place in postings.get(shingle_hash(words[at - SHORT_SHINGLE + 1 : at + 1]), ()):
                hits[name].append((at - SHORT_SHINGLE + 1 - place, at))
        if run >= SHINGLE:
            for name, place in postings.get(shingle_hash(words[at - SHINGLE + 1 : at + 1]), ()):
                hits[name].append((at - SHINGLE + 1 - place, at))
    out = []
    known = list(accumulate((w in vocabulary for w in words), initial=0)) if hits else []
    for name, own in hits.items():
        template = templates[name]
        least, margin = needed(name, len(template)), drift(len(template))
        own.sort()
        at, done = 0, -1  # the next hit, and the last word that a match covers
        while at < len(own):
            if own[at][1] <= done:
                at += 1
                continue
            end = at + 1
            while end < len(own) and own[end][0] - own[at][0] <= margin:
                end += 1
            begin = own[(at + end - 1) // 2][0]
            low_end = max(done + 1, begin - margin, 0)
            high_end = max(low_end, min(len(words), begin + len(template) + margin))
            count = 0
            # too few words of any template, or of this one, leave no alignment that matches enough
            if known[high_end] - known[low_end] >= least:
                region = tuple(words[low_end:high_end])
                if sum((Counter(region) & bags[name]).values()) >= least:
                    count, first, last = align(tuple(template), region, begin - low_end)
            if count and count >= least:
                out.append((name, count / len(template), count, found[low_end + first].start(), found[low_end + last].end()))
                done = low_end + last
            else:
                at = (at + end - 1) // 2 + 1
    out.sort(key=lambda m: (-m[2], -m[1], m[0], m[3]))
    kept: list[tuple[str, float, int, int, int]] = []
    for m in out:
        # inside another match: the same words said of one license, unless all its words are there and the licenses have nothing to do with each other
        if any(k[3] < m[4] and m[3] < k[4] and license_of(k[0]) == license_of(m[0]) for k in kept):
            continue  # another template of the same license has these words
        if not any(k[3] <= m[3] and m[4] <= k[4] and (m[1] < 1 or family_of(k[0]) == family_of(m[0]) or len(index()[0][k[0]]) > EXPRESSION) for k in kept):
            kept.append(m)
    return sorted([*kept, *_expressions(text, kept)], key=lambda m: (m[3], m[0]))


EXPRESSIONS = re.compile(r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:AND|OR|WITH)[ \t]+[A-Za-z0-9.+()-]+)+)")


def _expressions(text: str, kept: list[tuple[str, float, int, int, int]]) -> list[tuple[str, float, int, int, int]]:
    """What the identifier tags found say of further licenses: an exact reading of the expressions they begin."""
    out, known = [], {tag.lower(): tag for tag in _TAGS}
    for start in sorted({m[3] for m in kept if m[0].endswith("-tag")}):
        found = EXPRESSIONS.match(text, start)
        if found:
            have = {m[0] for m in kept if m[3] == start}
            for part in re.finditer(r"[A-Za-z0-9.+-]+", found[1]):
                name = f"{known.get(part[0].lower())}-tag"
                if name in TEMPLATES and name not in have:
                    have.add(name)
                    out.append((name, 1.0, len(index()[0][name]), start, found.start(1) + part.end()))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, license, template, coverage, matched_words, span_start, span_end: a row a match, or one with nulls."""
    types = [("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.string()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("span_start", pa.int64()), ("span_end", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows += [(doc_id, license_of(m[0]), *m) for m in matches(text.as_py())] or [(doc_id, None, None, None, None, None, None)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), types, strict=True)], names=[n for n, _ in types])

    ship_code(docs.sparkSession)
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    return docs.select(*columns).mapInArrow(run, "doc_id long, license string, template string, coverage double, matched_words long, span_start long, span_end long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = None
