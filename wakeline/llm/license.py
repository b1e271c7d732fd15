"""License scan (operator 10): an Aho-Corasick automaton finds notice phrases and identifier
tags in whole texts; a shunting-yard parser evaluates the tags' AND / OR / WITH expressions.

Base places: positions, counted in words, where a base phrase's words stand one after another.
The method's labels: notices more exact than the base phrases (gpl-3.0, apache-2.0, cc-by-nc, bsd
and so on) and the identifiers named by `SPDX-License-Identifier:` tags. The score is how free
the evidence leaves the reader, 0 to 1: AND takes the lowest of its sides, OR the highest, WITH
raises its licence by a quarter of what it lacks; notices count as AND; no evidence gives 0.
Defined results: null and empty texts have no words, no label and score 0; a broken expression
keeps the identifiers read before the fault; repeated rows get equal results; an empty table gives an
empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, small_batches

BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices of the method: words to label.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution": "cc-by",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd-2-clause",
    "bsd 3 clause": "bsd-3-clause",
    "bsd license": "bsd",
    "isc license": "isc",
    "all rights reserved": "all-rights-reserved",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "released into the public domain": "public-domain",
}
TAG = "spdx license identifier"
TAG_TEXT = "spdx-license-identifier"
#: How free a licence leaves its reader, by the longest prefix of its label that is listed.
FREEDOM = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "0bsd": 1.0, "unlicense": 1.0, "public-domain": 1.0, "cc0": 1.0, "zlib": 1.0, "apache": 0.95, "cc-by": 0.9,
    "mpl": 0.7, "epl": 0.65, "lgpl": 0.6, "cc-by-sa": 0.6, "gpl": 0.5, "agpl": 0.4, "cc-by-nc": 0.25, "cc-by-nd": 0.25, "all-rights-reserved": 0.0,
}
UNKNOWN = 0.5

#: Bytes that end a word become spaces, A-Z become a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else (c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
_PARTS = re.compile(rb"\(|\)|[A-Za-z0-9.+:-]+|\S")
_AFTER_TAG = re.compile(rb"\s*:[ \t]*([^\n\r]*)")


def freedom(label: str) -> float:
    """The freedom of a label: that of the longest listed prefix ending at a dash or the end."""
    best, score = -1, UNKNOWN
    for k, v in FREEDOM.items():
        if (label == k or label.startswith(k + "-") or label.startswith(k + "+")) and len(k) > best:
            best, score = len(k), v
    return score


def evaluate(expression: bytes) -> tuple[set[str], float | None]:
    """Labels and freedom of a licence expression, by Dijkstra's shunting yard.

    WITH binds tighter than AND, AND tighter than OR. Reading stops at the first part that cannot
    follow what was read, so prose after the tag does no harm; None: no licence was read.
    """
    rank = {"or": 1, "and": 2, "with": 3}
    values: list[float] = []
    operators: list[str] = []
    labels: set[str] = set()

    def apply() -> None:
        op = operators.pop()
        b, a = values.pop(), values.pop()
        values.append(max(a, b) if op == "or" else min(a, b) if op == "and" else a + (1 - a) / 4)

    operand = True  # whether an operand is due
    for part in _PARTS.findall(expression):
        low = part.lower().decode("ascii", "replace")
        if operand:
            if low == "(":
                operators.append(low)
            elif low in rank or not re.fullmatch(r"[a-z0-9.+:-]*[a-z0-9.+]", low):
                break
            elif operators and operators[-1] == "with":
                labels.add(low)
                values.append(0.0)
                operand = False
            else:
                labels.add(low)
                values.append(freedom(low))
                operand = False
        elif low == ")":
            while operators and operators[-1] != "(":
                apply()
            if not operators:
                break
            operators.pop()
        elif low in rank:
            while operators and operators[-1] != "(" and rank[operators[-1]] >= rank[low]:
                apply()
            operators.append(low)
            operand = True
        else:
            break
    while operators:
        if operators[-1] == "(" or len(values) < 2 or operand:
            operators.pop()  # left open
            operand = False
        else:
            apply()
    return labels, (values[-1] if values else None)


def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, over folded text; values: (base label, notice's label, is the tag, number of words)."""
    found = ahocorasick.Automaton()
    for words in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {words} ", (BASE.get(words), NOTICES.get(words), words == TAG, len(words.split())))
    found.make_automaton()
    return found


def tag_automaton() -> ahocorasick.Automaton:
    """The tag's own spelling, over text with A-Z lower-cased, a byte a character."""
    found = ahocorasick.Automaton()
    found.add_word(TAG_TEXT, len(TAG_TEXT))
    found.make_automaton()
    return found


def scan(raw: bytes, phrases: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score of one text."""
    words = raw.translate(_FOLD).split(b" ")
    words = [w for w in words if w] if b"" in words else words
    folded = b" " + b" ".join(words) + b" "
    text = folded.decode("latin-1")  # a byte a character: offsets are byte offsets
    places, base, labels, scores, tagged = [], set(), set(), [], False
    before = at = 0  # words that end before the byte at
    for end, (b, notice, tag, size) in phrases.iter(text):  # by ascending end
        if b:
            before, at = before + text.count(" ", at, end), end
            places.append(before - size)
            base.add(b)
            if not notice:
                scores.append(freedom(b))
        if notice:
            labels.add(notice)
            scores.append(freedom(notice))
        tagged |= tag
    if tagged:
        for end, _ in _TAGS.iter(raw.lower().decode("latin-1")):
            m = _AFTER_TAG.match(raw, end + 1)
            if not m:
                continue
            found, score = evaluate(m[1])
            labels |= found
            if score is not None:
                scores.append(score)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), min(scores, default=0.0)


_TAGS = tag_automaton()

KINDS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the results of scan() for each row of docs; no shuffle."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for b in batches:
            found = [scan(x, phrases) for x in as_bytes(b.column(1))]
            columns = [pa.array([x[k] for x in found], _ARROW[t]) for k, t in enumerate(KINDS.values())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *KINDS])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, " + ", ".join(f"{k} {t}" for k, t in KINDS.items()))
