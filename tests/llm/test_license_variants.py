"""Close variants are told apart, every template is found as itself, and what has no template is not reported."""

import random

import numpy as np
import pytest

from cobblestone.llm import license_scan
from cobblestone.llm.license_scan import TEMPLATES, plain_text

UNLISTED = [
    "Released under the Artistic License.", "Released under the Apache License.", "Licensed under CC BY 2.0.", "CC BY 1.0.",
    "This work is licensed under the GNU General Public License, version 1.", "Released under the BSD 5-Clause License.",
    "Licensed under the Apache License, Version 3.0.", "Licensed under the Apache License, Version 2.0.1.", "Released under the Zlib License.",
    "This work is licensed under the GNU General Public License, version 2.1.", "Licensed under CC BY-XY 4.0.",
    "This work is licensed under the GNU Free Documentation License, version 3.",
    "Licensed under the Mozilla Public License, version 1.0.", "This work is licensed under a Creative Commons Attribution 1.0 International License.",
]


def scanned(spark, rows, **more):
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "name string, text string").repartition(8), **more).collect():
        got.setdefault(r.name, []).append((r.license, r.coverage, r.first_word, r.last_word))
    return got


def test_every_template_is_found_as_itself(spark):
    rows = [(n, "int main() { return 0; } some words before\n" + plain_text(t) + "\nand some words after") for n, t in TEMPLATES.items()]
    got = scanned(spark, rows)
    assert [(n, got.get(n)) for n in TEMPLATES if [x[:2] for x in got.get(n, [])] != [(n, 1.0)]] == []


def test_unlisted_licenses_and_versions_are_not_reported(spark):
    assert scanned(spark, [(t, f"Some words. {t} More words.") for t in UNLISTED]) == {}


def test_wording_around_a_name_may_differ(spark):
    got = scanned(spark, [("a", "Distributed under the MIT License."), ("b", "available under the terms of the MIT license")])
    assert [(k, [x[:2] for x in v]) for k, v in got.items()] == [("a", [("MIT-notice", 0.8)])]


@pytest.mark.parametrize("name", ["GPL-2.0", "AGPL-3.0", "LGPL-2.1", "BSD-3-Clause", "BSD-4-Clause", "ISC", "MPL-2.0", "CC-BY-SA-4.0"])
def test_close_relatives_are_listed(spark, name):
    """A sentence that names the license is reported as that one."""
    assert [x[:2] for x in scanned(spark, [("x", plain_text(TEMPLATES[f"{name}-notice"]))])["x"]] == [(f"{name}-notice", 1.0)]


def common(a, b):
    """Length of a longest common subsequence."""
    row = np.zeros(len(b) + 1, int)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def test_mutated_texts_are_aligned_almost_as_well_as_by_brute_force(spark):
    """Scattered and block edits of texts up to 1,800 words. A chain of hits may miss few equal words, and up to four that an
    insertion longer than the band parts from the first or last hit."""
    rng = random.Random(4)
    rows, best = [], {}
    for name, template in TEMPLATES.items():
        words = plain_text(template).split()
        if not 60 <= len(words) <= 1800:
            continue
        new = [w for w in words if rng.random() > 0.04]
        for _ in range(len(words) // 40):
            new[rng.randrange(len(new))] = "zz%d" % rng.randrange(9)
        at = rng.randrange(len(new))
        text = " ".join(new[:at] + ["inserted"] * 25 + new[at:])
        rows.append((name, text))
        coded = [next(license_scan._words(license_scan.pa.array([t]))).codes() for t in (plain_text(template), text)]
        best[name] = common(*coded) / len(coded[0])
    got = scanned(spark, rows)
    for name, share in best.items():
        found = {x[0]: x[1] for x in got.get(name, [])}
        telling = "{" in TEMPLATES[name]
        assert telling and not found or max(found.values()) >= share - 0.02 - 4 / len(plain_text(TEMPLATES[name]).split()), (name, share, found)


def test_a_long_text_twice(spark):
    text = plain_text(TEMPLATES["Apache-2.0-text"])
    got = scanned(spark, [("x", text + " and once more " + text)])["x"]
    assert [x[:2] for x in got] == [("Apache-2.0-text", 1.0)] * 2
