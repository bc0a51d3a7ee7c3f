from __future__ import annotations

import random
import re
from re import _constants as sre
from re import _parser

from test_native import plain_scan, scans, words

from clickfold.llm import licenses
from clickfold.llm.license_rules import rules

SENTENCES = {
    "Licensed under the MIT License": "mit", "Released under the MIT license.": "mit",
    "licensed under the BSD 3-Clause License": "bsd-3-clause", "Licensed under the ISC License": "isc",
    "This file is licensed under the terms of the Mozilla Public License": "mpl",
    "licensed under either the zlib license or the MIT license": "mit,zlib",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "licensed under the Example Corp license": "licensed", "licensed under the Foo License, see the MIT license": "licensed,mit",
}


def test_a_named_licence_is_not_hidden_by_the_general_sentence(docs):
    rows = list(enumerate(SENTENCES))
    got = scans(licenses.scan(docs(rows)))
    assert {t: got[i][5] for i, t in rows} == SENTENCES
    assert got == {i: plain_scan(t) for i, t in rows}


GLUED = {"AGPLv3": "agpl-3", "LGPLv2.1": "lgpl-2.1", "LGPLv3": "lgpl-3", "GPL2": "gpl-2", "GPL3": "gpl-3", "GPLv1": "gpl-1",
         "GPLv3 or any later version": "gpl-3-or-later", "GPL License": "gpl", "Open Font License 1.1": "ofl-1.1",
         "PNG Reference Library License": "libpng", "EUPLv1.2": "eupl-1.2", "Eclipse Distribution License": "edl"}


def example(parsed, rng):
    """A random string that a pattern matches."""
    out = []
    for op, arg in parsed:
        if op is sre.LITERAL:
            out.append(chr(arg))
        elif op is sre.IN:
            low, high = (arg[0][1], arg[0][1]) if arg[0][0] is sre.LITERAL else arg[0][1]
            out.append(chr(rng.randint(low, high)))
        elif op is sre.SUBPATTERN:
            out.append(example(arg[3], rng))
        elif op is sre.BRANCH:
            out.append(example(rng.choice(arg[1]), rng))
        elif op is sre.MAX_REPEAT:
            out += [example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2)))]
        else:
            assert op is sre.ASSERT_NOT
    return "".join(out)


def test_every_match_holds_a_gate_word():
    rng = random.Random(1)
    for label, gate, pattern in rules():
        for _ in range(60):
            assert set(gate) & set(example(_parser.parse(pattern), rng).split()), (label, pattern)


def test_glued_names_agree_with_an_ungated_scan(docs):
    rows = list(enumerate(GLUED))
    got = scans(licenses.scan(docs(rows)))
    assert {t: got[i][5] for i, t in rows} == GLUED
    for i, text in rows:
        canon = f" {' '.join(words(text))} "
        ungated = {label for label, _, pattern in rules() if re.search(f"(?<= )(?:{pattern})(?= )", canon)}
        assert set(got[i][5].split(",")) <= ungated and ungated


def test_hand_written_patterns():
    # versions and "or later" are not counted
    from clickfold.llm import license_rules as r
    assert len(r._MORE) + len(r._NAMED) + len(r._VERSIONED) + 2 * len(r._CC_TERMS) >= 200
