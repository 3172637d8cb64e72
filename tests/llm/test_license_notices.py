"""Operator 7 on notices that were not trained on: other frames, other spellings, names in other senses."""

import re

import pytest
import regex

from sparkweave.llm import license_notices, licenses

FRAMES = (
    "Code: {}.", "The project uses the {}.", "This package is free software, {}.", "Content is offered under the {} unless noted.", "{} applies to all files here.", "Copyright 2020 J. Doe, {}",
    "This module is distributed under the same terms, namely the {}.", "see LICENSE ({})", "The documentation is under {}.", "© 2015 The Authors. Licensed under the {}, see the file.",
    "Diese Bibliothek ist unter der {} lizenziert.", "Le code est sous {}.", "El código está licenciado bajo la {}.", "Die Daten stehen unter {}-Lizenz bereit.", "We chose the {} for this library.",
    "license = {}", "Contributions are accepted under the {}.", "{} (see https://example.org/license)",
)
NAMES = {
    "mit": ("MIT License", "MIT licence", "MIT-License", "The MIT License"),
    "apache": ("Apache License v2.0", "Apache-2.0 license", "Apache License 2", "Apache 2.0 licence"),
    "gpl": ("GNU General Public Licence", "GPL-3.0", "GPL version 3", "LGPL-3.0-or-later", "GNU GPLv3 license"),
    "bsd": ("BSD 3-Clause License", "BSD license", "three-clause BSD", "BSD-2-Clause license"),
    "mozilla": ("MPL 2", "Mozilla Public Licence 2.0", "MPL-2.0 license"),
    "creative_commons": ("CC BY-NC-SA 4.0", "Creative Commons BY 4.0", "CC-BY 3.0", "Creative Commons Attribution license"),
    "public_domain": ("CC0 license", "CC0 1.0"),
    "": (
        "ISC licence", "Eclipse Public License v1.0", "AGPL v3", "GNU Affero General Public License version 3", "EPL-1.0", "zlib license", "Fishing License, version 2.0", "Boost License", "Artistic License",
        "Academic Free License 3.0", "Hiking Permit 2.0",
    ),
}
SENSES = (
    "The MIT museum opened a hall.", "MIT and Harvard signed a treaty.", "A licence was sold by MIT's press office.", "Apache gunships crossed the river.", "The Apache nation has its own licence plates.",
    "He configured Apache and nginx.", "BSD sockets are used by all programs.", "A talk on BSD history and the licence of the bar.", "Mozilla published a report on privacy.", "Mozilla/4.0 (compatible; MSIE 6.0)",
    "Photos of the public domain exhibition were lost.", "A conference on the public domain was held.", "Creative Commons has a new office.", "cc by noon please", "Send a cc by post to the office.",
    "All rights were reserved by the crown, they said.", "The rights of all are reserved in law.", "Mit Lizenz darf man hier angeln.", "Kommen Sie mit Lizenz und Boot.", "The GPL was debated for years.",
    "Er kam mit dem Boot.", "The general public license office is closed.", "The MPL season starts in May.",
)
CASES = [(f.format(n), {family} - {""}) for family, own in NAMES.items() for n in own for f in FRAMES] + [(t, set()) for t in SENSES]
EXACT = [
    ("Licensed under the Eclipse Public License 2.0.", ""), ("Licensed under the Fishing License, Version 2.0.", ""), ("License: MIT", "mit"), ("Code in this repo is MIT-licensed.", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: GPL-2.0-only", "gpl"), ("distributed under the GNU Affero GPL v3", ""), ("Dual-licensed under MIT and Apache-2.0.", "apache,mit"),
    ("All content is licensed CC-BY-SA.", "creative_commons"), ("Distributed under the ISC license.", ""), ("# Licensed under the\n# Apache License,\n# Version 2.0.", "apache"),
    ("A tale of two towns.\nReleased under the MIT\nLicense. The end.", "mit"), ("© 2021 Verlag.\r\nAlle Rechte vorbehalten.", "all_rights_reserved"), ("x\n\nLicense: MIT\n\ny\n\nAll rights reserved.", "all_rights_reserved,mit"),
]


@pytest.fixture(scope="module")
def model():
    return licenses.fit([])


def test_held_out_notices(spark, model):
    trained = {t for t, _ in licenses.notices()}
    assert len(CASES) > 600 and not trained & {t for t, _ in CASES}
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "doc_id long, text string"), model).collect()}
    got = [set(rows[i]["families"].split(",")) - {""} for i in range(len(CASES))]
    right, found, there = (sum(map(len, x)) for x in ([g & w for g, (_, w) in zip(got, CASES)], got, [w for _, w in CASES]))
    assert right / found >= 0.95 and right / there >= 0.95


def test_exact_notices(spark, model):
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(EXACT)], "doc_id long, text string"), model).collect()}
    assert {t: rows[i]["families"] for i, (t, _) in enumerate(EXACT)} == dict(EXACT)
    assert (rows[len(EXACT) - 1]["n_paragraphs"], rows[len(EXACT) - 1]["n_unknown"]) == (4, 2)


def test_scores_are_those_of_the_model(spark, model):
    lines = spark.createDataFrame([(i, licenses.plain(t), f) for i, (t, _) in enumerate(EXACT) for f in licenses.FAMILIES], "i int, words string, family string")
    for r in licenses.scored(lines.selectExpr("named_struct('x', 1L, 'y', 2L) AS key", "i", "words", "family"), model).collect():
        assert r["score"] == pytest.approx(model.probabilities(EXACT[r["i"]][0])[r["family"]], abs=1e-4)


def test_hints_cover_names():
    """A line that names a family has a hint, so that no text is passed over."""
    patterns = [regex.compile(p) for p in license_notices.HINT_PATTERNS]
    spaced = [t.replace(" ", "_\n- ") for t, _ in EXACT]
    for t in [t for t, _ in CASES + EXACT] + [t for t, _ in licenses.notices()] + spaced:
        if any(re.search(p, licenses.plain(t)) for p in license_notices.NAMED.values()):
            assert any(h in t.lower() for h in license_notices.HINTS) or any(p.search(t.lower()) for p in patterns), t


def test_name_alone_or_score_alone_is_not_enough(model):
    assert model.probabilities("The Apache helicopter landed on the field.")["apache"] < model.sure
    assert not re.search(license_notices.NAMED["mozilla"], licenses.plain("Licensed under the Eclipse Public License 2.0."))
