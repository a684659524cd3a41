import random

import pytest

from quire.llm import licenses as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide, words


@pytest.mark.parametrize("name", list(m.TEMPLATES))
def test_every_template_is_found_with_its_span(name):
    rng = random.Random(name)
    before = words(rng, 50) + " "
    text = before + m.TEMPLATES[name] + " " + words(rng, 50)
    got = m.matches(text)
    assert [g[0] for g in got] == [name] and got[0][1] == 1.0
    assert m.tokens(text[got[0][3] : got[0][4]]) == m.tokens(m.TEMPLATES[name])


@pytest.mark.parametrize(
    ("line", "name"),
    [
        ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
        ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"),
        ("Released under the MIT License.", "MIT"),
        ("Licensed under the Apache License, Version 2.0.", "Apache-2.0"),
        ("licensed under the GNU Affero General Public License v3 or later", "AGPL-3.0-or-later"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-NC-ND-4.0"),
        ("Distributed under the BSD 3-Clause License", "BSD-3-Clause"),
        ("Released under MIT License", "MIT"),
    ],
)
def test_notices_as_documents_write_them(line, name):
    rng = random.Random(line)
    text = f"{words(rng, 40)}\n{line}\n{words(rng, 40)}"
    got = m.matches(text)
    assert [(g[0].split("-line")[0], g[1]) for g in got] == [(name, 1.0)]
    assert text[got[0][3] : got[0][4]] in line


@pytest.mark.parametrize("name", [*m.BODIES, "BSD-2-Clause-body", "BSD-3-Clause-body"])
def test_edited_license_texts_are_found_under_their_own_name(name):
    rng = random.Random(name)
    text = " ".join(w for w in m.TEMPLATES[name].split() if rng.random() > 0.02)
    got = m.matches(words(rng, 30) + " " + text + " " + words(rng, 30))
    assert name in [g[0] for g in got] and max(got, key=lambda g: g[2])[0] == name


def test_edited_copies_count_above_the_threshold_only():
    own = m.TEMPLATES["MIT"].split()
    rng = random.Random(1)
    light = [w for w in own if rng.random() > 0.05]
    heavy = [w if rng.random() > 0.6 else "other" for w in own]
    assert [g[0] for g in m.matches(" ".join(light))] == ["MIT"] and 0.85 < m.matches(" ".join(light))[0][1] < 1
    assert m.matches(" ".join(heavy)) == []


def test_matches_agree_with_a_plain_alignment():
    rng = random.Random(2)
    template = tuple(m.tokens(m.TEMPLATES["GPL-2.0-or-later"]))
    for _ in range(20):
        region = [w for w in template if rng.random() > 0.1]
        for _ in range(3):
            region.insert(rng.randrange(len(region)), "new")
        best = [[0] * (len(region) + 1) for _ in range(len(template) + 1)]
        for i, a in enumerate(template, 1):
            for j, b in enumerate(region, 1):
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (a == b))
        assert m.align(template, tuple(region), 0)[0] == best[-1][-1]


@pytest.mark.parametrize("n", [1, 2, 6, 25])
@pytest.mark.parametrize("name", ["MIT-line", "Apache-2.0-line", "Unlicense", "ISC"])
def test_every_one_of_several_copies_is_reported(name, n):
    got = m.matches((m.TEMPLATES[name] + ". ") * n)
    assert [g[0] for g in got] == [name] * n and len({g[3] for g in got}) == n


def test_one_changed_word_leaves_a_short_notice_and_tags_are_exact():
    for word in range(5):
        own = m.TEMPLATES["MIT-line"].split()
        own[word] = "other"
        if word != 2:  # all shingles of three words hold the middle one
            assert len(m.matches("some text " + " ".join(own) + " and more")) == 1
    text = "// SPDX-License-Identifier: GPL-2.0-or-later\n# SPDX-License-Identifier: MIT\n; SPDX-License-Identifier: Nothing-9.9"
    assert [g[0] for g in m.matches(text)] == ["GPL-2.0-or-later-tag", "MIT-tag"]


def test_matches_agree_with_brute_force_over_all_places(monkeypatch):
    """Whatever matches some stretch of a text is found, and only that: templates against every start, without index or band."""
    rng = random.Random(6)
    vocabulary = [words(rng, 1) for _ in range(60)]
    templates = {f"t{i}": " ".join(rng.sample(vocabulary, n)) for i, n in enumerate([5, 8, 11, 14, 30, 60])}
    monkeypatch.setattr(m, "TEMPLATES", templates)
    for cached in (m.index, m._short_heads, m.align):
        cached.cache_clear()

    def longest(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b, 1):
                new.append(max(row[j], new[-1], row[j - 1] + (x == y)))
            row = new
        return row[-1]

    for _ in range(60):
        text, planted = [], set()
        for _ in range(rng.randint(1, 4)):
            text += [words(rng, 1) for _ in range(rng.randint(0, 15))]
            name = rng.choice(list(templates))
            own = templates[name].split()
            if rng.random() < 0.7 and len(own) > 8:
                own.pop(rng.randrange(len(own)))
            text += own
            planted.add(name)
        got = m.matches(" ".join(text))
        brute = set()
        for name, template in templates.items():
            own = template.split()
            if any(longest(own, text[i : i + len(own) + 2]) >= m.COVERAGE * len(own) for i in range(len(text))):
                brute.add(name)
        assert {g[0] for g in got} == brute >= planted
    for cached in (m.index, m._short_heads, m.align):
        cached.cache_clear()


def test_several_copies_and_odd_case():
    text = "İ " + m.TEMPLATES["MIT-line"].upper() + ". " + "x " * 60 + m.TEMPLATES["MIT-line"]
    got = m.matches(text)
    assert [g[0] for g in got] == ["MIT-line"] * 2 and text[got[0][3] : got[0][4]] == m.TEMPLATES["MIT-line"].upper()


def test_scan_gives_a_row_a_document_at_least(spark):
    rows = wide(corpus() + [(900, m.TEMPLATES["ISC"] + " and " + m.TEMPLATES["CC-BY-4.0"], "en", "s", 0)])
    got = m.scan(spark.createDataFrame(rows, CLASHING)).collect()
    assert len(got) == len(rows) + 1
    assert sorted(r.license for r in got if r.license) == ["CC-BY-4.0", "ISC"]
    assert m.scan(spark.createDataFrame([], DOCS)).collect() == []


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("SPDX-License-Identifier: MIT OR Apache-2.0", {"MIT", "Apache-2.0"}),
        ("SPDX-License-Identifier: (GPL-2.0-only OR MIT)", {"GPL-2.0-only", "MIT"}),
        ("SPDX-License-Identifier: Apache-2.0 AND BSD-3-Clause", {"Apache-2.0", "BSD-3-Clause"}),
        ("SPDX-License-Identifier: GPL-2.0-or-later", {"GPL-2.0-or-later"}),
        ("SPDX-License-Identifier: MIT", {"MIT"}),
        ("Dual licensed under the MIT License and the Apache License, Version 2.0", {"MIT", "Apache-2.0"}),
        ("Licensed under the Apache License 2.0 or the MIT License", {"MIT", "Apache-2.0"}),
        ("Licensed under GPLv3", {"GPL-3.0"}),
        ("this code is MIT licensed", {"MIT"}),
    ],
)
def test_all_licenses_of_a_notice_are_told(line, want):
    rng = random.Random(line)
    got = m.matches(f"{words(rng, 40)}\n{line}\n{words(rng, 40)}")
    assert {m.license_of(g[0]) for g in got} == want


def test_license_ids_are_no_template_names():
    assert {m.license_of(n) for n in ("MIT-line-8", "Apache-2.0-line", "GPL-2.0-only-tag", "ISC-body", "GPL-3.0-short-2", "0BSD")} == {"MIT", "Apache-2.0", "GPL-2.0-only", "ISC", "GPL-3.0", "0BSD"}
