"""License scan against regular expressions, and the expression parser against truth tables."""

import random
import re

import pytest
from wakeline.llm import license as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_of(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    places, labels = [], set()
    for phrase, label in lic.BASE.items():
        p = phrase.split()
        hits = [k for k in range(len(words)) if words[k : k + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_matches_brute_force(spark):
    r = random.Random(4)
    bits = ["GNU", "General", "public", "license", "Apache", "CC", "BY", "MIT", "nc", "sa", "é", "İ", "x", "...", "\n", "-", "version 2", "SPDX-License-Identifier: MIT\n", "cc by cc by", "ﬁ"]
    texts = ["".join(r.choice(bits) + r.choice([" ", "-", " ", "\n", ""]) for _ in range(r.randint(0, 120))) for _ in range(300)] + [None, "", "mit license " * 20_000]
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)], "doc_id long, text string, score long")
    got = {x.doc_id: x for x in lic.scan_licenses(df).collect()}
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        x = got[k]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == base_of(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and x.labels == ",".join(sorted(set(filter(None, x.labels.split(","))))) and 0 <= x.score <= 1


@pytest.mark.parametrize("text, labels, score", [
    (b"MIT", {"mit"}, 1.0), (b"MIT OR GPL-2.0-only", {"mit", "gpl-2.0-only"}, 1.0), (b"MIT AND GPL-2.0-only", {"mit", "gpl-2.0-only"}, 0.5),
    (b"GPL-2.0-only WITH Classpath-exception-2.0", {"gpl-2.0-only", "classpath-exception-2.0"}, 0.625),
    (b"MIT OR GPL-3.0 AND CC-BY-NC-4.0", {"mit", "gpl-3.0", "cc-by-nc-4.0"}, 1.0), (b"(MIT OR GPL-3.0) AND CC-BY-NC-4.0", {"mit", "gpl-3.0", "cc-by-nc-4.0"}, 0.25),
    (b"MIT */", {"mit"}, 1.0), (b"(MIT", {"mit"}, 1.0), (b"MIT)", {"mit"}, 1.0), (b"AND MIT", set(), None), (b"", set(), None), (b"MIT AND", {"mit"}, 1.0), (b"MIT is my choice", {"mit"}, 1.0), (b"Foo-1.0", {"foo-1.0"}, 0.5),
    (b"GPL-2.0+ with X or MIT and ISC", {"gpl-2.0+", "x", "mit", "isc"}, 1.0),
])
def test_expressions(text, labels, score):
    assert lic.evaluate(text) == (labels, score)


def random_expression(r, depth):
    """(text, value) with full parentheses where needed; value by the definition."""
    kind = r.choice(["leaf", "and", "or"]) if depth else "leaf"
    if kind == "leaf":
        name = r.choice(["MIT", "Apache-2.0", "GPL-3.0-only", "CC-BY-NC-4.0", "MPL-2.0"])
        if r.random() < 0.3:
            f = lic.freedom(name.lower())
            return f"{name} WITH Some-exception", f + (1 - f) / 4
        return name, lic.freedom(name.lower())
    (a, x), (b, y) = random_expression(r, depth - 1), random_expression(r, depth - 1)
    return f"({a}) {kind.upper()} ({b})", max(x, y) if kind == "or" else min(x, y)


def test_random_expressions():
    r = random.Random(6)
    for _ in range(500):
        text, value = random_expression(r, 4)
        assert lic.evaluate(text.encode())[1] == value


def test_tags_and_notices(spark):
    text = "// SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-or-later) AND BSD-3-Clause\nAll rights reserved."
    x = lic.scan_licenses(spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")).collect()
    assert len(x) == 2 and x[0] == x[1]
    assert set(x[0].labels.split(",")) >= {"apache-2.0", "gpl-2.0-or-later", "bsd-3-clause", "all-rights-reserved"} and x[0].score == 0.0
    assert lic.scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tags_anywhere_in_very_long_texts_and_clashing_columns(spark):
    far = "x " * 200_000 + "SPDX-License-Identifier : (MIT OR Foo-1.0) \n" + "é " * 50_000 + "spdx-LICENSE-identifier:GPL-2.0 AND MIT\nspdx license identifier: BSD"
    df = spark.createDataFrame([(1, far, "c", "d"), (None, None, "c", "d"), (2, "", "c", "d"), (1, far, "c", "d")], "doc_id long, text string, labels string, n_words string")
    got = sorted(((x.doc_id or 0, x.labels, x.score) for x in lic.scan_licenses(df).collect()))
    assert got == [(0, "", 0.0), (1, "foo-1.0,gpl-2.0,mit", 0.5), (1, "foo-1.0,gpl-2.0,mit", 0.5), (2, "", 0.0)]
