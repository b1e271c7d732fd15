"""Decontamination: the search against scoring every item, and matches against planted passages."""

import random

from wakeline.llm import decontam

DOCS = "doc_id long, text string, item_id long, score string"
ITEMS = "item_id long, text string, doc_id string"
WORDS = [f"t{k}" for k in range(500)]


def say(r, n, skew=1):
    return " ".join(WORDS[int(len(WORDS) * r.random() ** skew)] for _ in range(n))


def items(r, n=40):
    return [(k, f"{say(r, r.randint(8, 40), 2).capitalize()}? {say(r, r.randint(1, 20)).capitalize()}.") for k in range(n)]


def test_block_max_wand_finds_what_scoring_all_finds():
    r = random.Random(1)
    for n in (1, 7, 60, 300):
        index = decontam.Index(items(r, n))
        weight = [{} for _ in index.ids]
        for t, (k, v) in enumerate(zip(index.items, index.weights, strict=True)):
            for item, x in zip(k, v, strict=True):
                weight[item][t] = x
        assert all(abs(sum(w.values()) - 1) < 1e-9 for w in weight)
        for _ in range(120):
            query = sorted(r.sample(range(len(index.items)), r.randint(0, min(60, len(index.items)))))
            for threshold in (0.1, 0.5):
                got = dict(index.search(query, threshold))
                want = {k: s for k, w in enumerate(weight) if (s := sum(w.get(t, 0) for t in query)) >= threshold}
                assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def brute(texts, its):
    """Every passage against every item."""
    index = decontam.Index(its)
    own = [set(decontam.words_of(t)) for _, t in its]
    of = {w: t for w, t in index.term.items()}
    weight = {}
    for t, (k, v) in enumerate(zip(index.items, index.weights, strict=True)):
        for item, x in zip(k, v, strict=True):
            weight[item, t] = x
    found, step = set(), index.longest
    for k, text in enumerate(texts):
        w = decontam.words_of(text)
        for a in range(0, max(1, len(w)), step):
            passage = w[a : a + 2 * step]
            terms = set(passage)
            joined = b" " + b" ".join(passage) + b" "
            grams = decontam.shingles(passage)
            for i, mine in enumerate(own):
                if sum(weight[i, of[x]] for x in mine & terms) < decontam.THRESHOLD - 1e-9:
                    continue
                shares = []
                for part in decontam.question_answer(its[i][1]):
                    g = decontam.shingles(part)
                    shares.append(1.0 if not part else float(b" " + b" ".join(part) + b" " in joined) if len(part) < 5 else len(g & grams) / len(g))
                if min(shares) >= decontam.OVERLAP:
                    found.add((k, i))
    return found


def corpus(r, its, n=80):
    texts, planted = [], set()
    for k in range(n):
        parts = [say(r, r.randint(0, 400), 2)]
        if k % 3 == 0:
            i, text = r.choice(its)
            parts.append(text.upper() if k % 2 else text.replace(" ", "\n  "))
            planted.add((k, i))
        parts.append(say(r, r.randint(0, 200), 2))
        texts.append(" ".join(parts))
    return texts, planted


def test_matches_equal_brute_force_and_hold_planted():
    for seed in range(4):
        r = random.Random(seed)
        its = items(r)
        texts, planted = corpus(r, its)
        got = {(k, i) for k, i, *_ in decontam.matches(texts, decontam.Index(its))}
        assert got == brute(texts, its) and planted <= got


def test_query_and_filter(spark, monkeypatch):
    r = random.Random(9)
    its = items(r)
    texts, planted = corpus(r, its)
    docs = spark.createDataFrame([(k, t, 0, "clash") for k, t in enumerate(texts)] + [(900, None, 0, ""), (901, "", 0, "")], DOCS)
    bench = spark.createDataFrame([(i, t, "clash") for i, t in its] + [(800, None, ""), (801, "  ", "")], ITEMS)
    want = {(k, its[i][0]) for k, i in brute(texts, its)}
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()} == want
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {*range(len(texts)), 900, 901} - {k for k, _ in want}
    # items in blocks: weights are those of a block, planted passages are found all the same
    monkeypatch.setattr(decontam, "PASS_BYTES", 2000)
    assert planted <= {(x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()}


def test_edges(spark):
    docs = spark.createDataFrame([(1, "the answer is blue whales indeed", 0, ""), (1, "the answer is blue whales indeed", 0, ""), (None, "What is it? Blue whales.", 0, "")], DOCS)
    bench = spark.createDataFrame([(1, "What is it? Blue whales.", ""), (2, "What is it? Blue whales.", "")], ITEMS)
    got = sorted(((x.doc_id, x.item_id) for x in decontam.contaminated(docs, bench).collect()), key=str)
    assert got == [(None, 1), (None, 2)]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.clean(docs, bench.limit(0)).count() == 3
    assert decontam.contaminated(docs.limit(0), bench).count() == 0


def test_very_long_text():
    r = random.Random(3)
    its = items(r)
    text = say(r, 150_000, 2)
    whole = text + " " + its[3][1] + " " + text
    assert 3 in {i for _, i, *_ in decontam.matches([whole], decontam.Index(its))}


def test_edited_and_truncated_copies():
    """Copies with one changed word, or cut short, that hold 0.8 of an item's shingles or words are found."""
    r = random.Random(21)
    its = [(k, " ".join(f"u{r.randrange(9000)}" for _ in range(r.randint(30, 60))) + "? " + " ".join(f"u{r.randrange(9000)}" for _ in range(r.choice([1, 2, 3, 4, 5, 8, 14]))) + ".") for k in range(60)]
    index = decontam.Index(its)
    for k, text in its:
        w = text.split()
        copies = [[*w[:i], "changed", *w[i + 1 :]] for i in range(len(w))]
        copies += [w[: len(w) - round(0.15 * (len(w) - 4))], [*w[:9], *w[10:]], [*w[:9], "more", *w[9:]]]
        for copy in copies:
            grams = decontam.shingles(decontam.words_of(text))
            assert len(grams & decontam.shingles(decontam.words_of(" ".join(copy)))) >= 0.8 * len(grams)
        got = {i for i, item, *_ in decontam.matches([say(r, 30) + " " + " ".join(c) + " " + say(r, 30) for c in copies], index) if item == k}
        assert got == set(range(len(copies))), (k, set(range(len(copies))) - got)


def test_short_parts_tolerate_edits_but_not_other_words():
    its = [(1, "Which animal of the northern seas grows largest of all? The great blue whale indeed."), (2, "Who was it that first saw the far moon? Galileo Galilei.")]
    texts = [
        "Which animal of the northern seas grows biggest of all? The great blue whale indeed.", "Which animal of the northern seas grows largest of all? The great blue shark indeed.",
        "Who was it that first saw the far moon? Tycho Brahe.", "Who was it that first saw the far moon? Galileo Galilej.", "The great blue whale indeed.", "Who was it that first saw a far moon? Galileo Galilei.",
        "Whose cat was it that sang under the moon? Johannes Kepler.",
    ]
    assert {(k, i) for k, i, *_ in decontam.matches(texts, decontam.Index([(i, t) for i, t in its]))} == {(0, 0), (1, 0), (3, 1), (5, 1)}


def plain_edits(part, passage):
    row = [0] * (len(passage) + 1)
    for i, x in enumerate(part, 1):
        new = [i]
        for j, y in enumerate(passage, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def test_least_edits_match_the_plain_table():
    r = random.Random(5)
    for _ in range(1500):
        part, passage = [r.choice("abc") for _ in range(r.randint(1, 70))], [r.choice("abc") for _ in range(r.randint(0, 40))]
        assert decontam.least_edits(part, passage) == plain_edits(part, passage)


def test_a_giant_item_has_a_pass_of_its_own(spark):
    """Passages stay short for the other items; copies of both kinds are found."""
    r = random.Random(12)
    giant = " ".join(f"w{r.randrange(5000)}" for _ in range(20_000))
    small = [" ".join(f"v{r.randrange(3000)}" for _ in range(30)) + ". " + " ".join(f"u{r.randrange(3000)}" for _ in range(8)) for _ in range(6)]
    edge = "x" * 19 + " " + "e " * ((1 << 14) - 11) + "z"  # of 2^15 - 1 bytes, the longest of the small ones
    assert len(edge) == (1 << 15) - 1
    bench = spark.createDataFrame([(0, giant), *enumerate(small, 1), (7, edge), (8, edge + "z"), (9, None), (10, "")], "item_id long, text string")
    blocks = list(decontam.item_blocks(bench))
    assert [[i for i, _ in b] for b in blocks] == [[*range(1, 8)], [0, 8]]
    docs = [(100, f"lead {giant} tail"), (101, "lead " * 50 + small[2] + " tail" * 50), (102, "clean words " * 400), (103, None), (104, giant[: len(giant) // 2])]
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(100, 0), (101, 3)}
    assert {x.doc_id for x in decontam.clean(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()} == {102, 103, 104}
