"""Benchmark decontamination (operator 7): every training passage queries a BM25 index of test items.

Items are few (their bytes are checked, and taken in blocks that fit a task), documents are many:
the index goes to the documents. A passage is a window of twice the longest item's words,
half a window on from the last, so an item's place always lies in one passage. Term weights are
BM25 with an item's own score taken as 1: a passage that holds all of an item's terms scores 1, and one
threshold serves all items. Search is block-max WAND: postings in item order with the highest weight of
the list and of each block of postings. Before it, the block maxima of all
passages of a batch are summed at once; a passage whose sum for every block of items stays under the threshold cannot
pass and is not searched. Both bounds are upper bounds, so all matches are found. A match is
verified by its words: at least 0.8 of the five-word shingles of the whole item stand in the passage, or else 0.8
of the item's question (all but its last sentence) and of its answer (the last), each by its shingles or by
its words in order, of which edits may change the rest. A question or answer of under five words may differ
by edits of a fifth of its letters.

Defined results: words are lower-cased letters and digits; null and empty texts match nothing;
null items have no words and match nothing; equal items all match; an item of under five words
is one shingle; repeated rows get equal results; an empty benchmark leaves everything clean; very long
texts are searched in bounded parts; clean() keeps all columns as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import release, small_batches

K1, B = 1.2, 0.75
#: Of an item's own score.
THRESHOLD = 0.5
SHINGLE = 5
OVERLAP = 0.8
BLOCK = 8  # postings in a block of a list
BLOCKS = 256  # blocks of items in the bounds on passages, at most
#: A block of items that one pass over the documents carries: 16 MB of text at most, or one item.
PASS_BYTES = 16 << 20
#: Items of under 2^15 bytes share blocks, then those of under 2^19, and so on: a passage is twice the longest item of
#: its block, so a giant item makes long passages in its own pass alone.
SMALL_BITS, CLASS_BITS = 15, 4
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split()


def shingles(words: list[bytes]) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}


def question_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of an item's question and answer: the last sentence that has words is the answer; an item
    of one sentence is cut in halves."""
    parts = [x for x in map(words_of, _SENTENCE.split(text)) if x]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    w = parts[0] if parts else []
    return w[: len(w) // 2], w[len(w) // 2 :]


def least_edits(part: Sequence[Hashable], passage: Sequence[Hashable]) -> int:
    """The fewest edits (one put in, left out or changed) from part to some stretch of passage, by
    Myers' bit vectors."""
    m = len(part)
    places: dict[Hashable, int] = {}
    for i, x in enumerate(part):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, now, best = full, 0, m, m
    for x in passage:
        eq = places.get(x, 0)
        xv = eq | down
        xh = ((eq & up) + up) ^ up | eq
        more, less = down | ~(xh | up) & full, up & xh
        if more & top:
            now += 1
        elif less & top:
            now -= 1
            best = min(best, now)
        more, less = more << 1 & full, less << 1 & full
        up, down = less | ~(xv | more) & full, more & xv
    return best


def edit_share(part: list[bytes], passage: list[bytes], joined: bytes, overlap: float) -> float:
    """How much of a part stands in a passage but for edits: of words, or of letters if it has under five; 0 if
    too few of its words do for the overlap."""
    if len(part) < SHINGLE:
        text = b" ".join(part)
        return max(0.0, 1 - least_edits(b" " + text + b" ", joined) / len(text))
    if sum((Counter(part) & Counter(passage)).values()) < overlap * len(part) - 1e-9:
        return 0.0
    return 1 - least_edits(part, passage) / len(part)


class Index:
    """Inverted index of items with BM25 weights, an item's own score being 1."""

    def __init__(self, items: list[tuple[int | None, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.parts = [question_answer(t) for _, t in items]
        self.grams = [tuple(map(shingles, x)) for x in self.parts]
        words = [words_of(t) for _, t in items]
        self.whole = [shingles(x) for x in words]
        self.longest = max([1, *map(len, words)])
        average = max(1.0, sum(map(len, words)) / max(1, len(words)))
        df = Counter(w for x in words for w in set(x))
        idf = {w: math.log(1 + (len(items) - n + 0.5) / (n + 0.5)) for w, n in df.items()}
        lists: dict[bytes, list[tuple[int, float]]] = {w: [] for w in df}
        for k, x in enumerate(words):
            weight = {w: idf[w] * n * (K1 + 1) / (n + K1 * (1 - B + B * len(x) / average)) for w, n in Counter(x).items()}
            own = sum(weight.values())
            for w, v in weight.items():
                lists[w].append((k, v / own))
        self.term = {w: t for t, w in enumerate(sorted(lists, key=lambda w: (-df[w], w)))}
        self.items = [[k for k, _ in lists[w]] for w in self.term]
        self.weights = [[v for _, v in lists[w]] for w in self.term]
        self.block_max = [[max(v[i : i + BLOCK]) for i in range(0, len(v), BLOCK)] for v in self.weights]
        self.list_max = [max(v) for v in self.weights]
        self._bounds(len(items))

    def _bounds(self, n: int) -> None:
        """Block maxima by blocks of items, as arrays; the most common terms, together at most half
        the threshold for any block, are counted as present in every passage."""
        width = max(1, -(-n // BLOCKS))
        self.blocks = -(-n // width)
        rows = []
        for k, v in zip(self.items, self.weights, strict=True):
            by: dict[int, float] = {}
            for i, x in zip(k, v, strict=True):
                by[i // width] = max(by.get(i // width, 0.0), x)
            rows.append(by)
        self.common = np.zeros(self.blocks)
        self.n_common = 0
        for by in rows:
            more = self.common.copy()
            for b, x in by.items():
                more[b] += x
            if more.max() > THRESHOLD / 2:
                break
            self.common = more
            self.n_common += 1
        self.start = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64)
        self.block = np.array([b for r in rows for b in r], np.int64)
        self.bound = np.array([x for r in rows for x in r.values()])

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """Items that score the threshold or more for the distinct terms, by block-max WAND."""
        lists = [(self.items[t], self.weights[t], self.block_max[t], self.list_max[t]) for t in terms]
        at = [0] * len(lists)
        done = len(self.ids)
        item = [x[0][0] for x in lists]
        order = list(range(len(lists)))
        found = []
        limit = threshold - 1e-9
        while True:
            order.sort(key=item.__getitem__)
            total, pivot = 0.0, -1
            for p, k in enumerate(order):
                if item[k] == done:
                    break
                total += lists[k][3]
                if total >= limit:
                    pivot = p
                    break
            if pivot < 0:
                return found
            target = item[order[pivot]]
            while pivot + 1 < len(order) and item[order[pivot + 1]] == target:
                pivot += 1
            # block maxima of the lists up to the pivot, where they would stand at the target
            bound, skip = 0.0, done
            for k in order[: pivot + 1]:
                items, _, maxima, _ = lists[k]
                b = at[k] // BLOCK
                while b < len(maxima) and items[min(len(items), (b + 1) * BLOCK) - 1] < target:
                    b += 1
                if b < len(maxima):
                    bound += maxima[b]
                    skip = min(skip, items[min(len(items), (b + 1) * BLOCK) - 1] + 1)
            if bound >= limit:
                if item[order[0]] == target:
                    score = 0.0
                    for k in order[: pivot + 1]:
                        score += lists[k][1][at[k]]
                        at[k] += 1
                        item[k] = lists[k][0][at[k]] if at[k] < len(lists[k][0]) else done
                    if score >= limit:
                        found.append((target, score))
                    continue
                skip = target
            else:
                # no item before the nearest block end, or before the next list's item, can pass
                if pivot + 1 < len(order):
                    skip = min(skip, item[order[pivot + 1]])
                skip = max(skip, target + 1)
            for k in order[: pivot + 1]:
                items = lists[k][0]
                while at[k] < len(items) and items[at[k]] < skip:
                    at[k] += 1
                item[k] = items[at[k]] if at[k] < len(items) else done

    def candidates(self, segment: np.ndarray, term: np.ndarray, segments: int) -> np.ndarray:
        """Segments k for which segments k and k+1 together may reach the threshold in some block of items."""
        rare = term >= self.n_common
        code = np.unique(segment[rare] * len(self.items) + term[rare])
        s, t = code // len(self.items), code % len(self.items)
        n = self.start[t + 1] - self.start[t]
        place = np.repeat(self.start[t] - np.cumsum(n) + n, n) + np.arange(n.sum())
        sums = np.bincount(np.repeat(s, n) * self.blocks + self.block[place], self.bound[place], segments * self.blocks).reshape(segments, self.blocks)
        sums[:-1] += sums[1:]  # the next document's first segment only raises the bound
        return np.flatnonzero((sums + self.common >= THRESHOLD - 1e-9).any(axis=1))


def share(grams: set[bytes], own: set[bytes], joined: bytes) -> float:
    """The share of shingles that a passage holds; less than a shingle is looked for as words."""
    if len(grams) == 1:
        return float(b" " + next(iter(grams)) + b" " in joined)
    return len(grams & own) / len(grams) if grams else 1.0


def matches(texts: list[str], index: Index, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float, float]]:
    """(text, item, score, question overlap, answer overlap, item overlap) of verified matches, the best passage of each."""
    step, found = index.longest, {}
    most = max(1, (4 << 20) // max(1, index.blocks))  # segments at once
    lookup = index.term.get

    def flush(part: list[tuple[int, list[bytes]]]) -> None:
        terms = np.array([lookup(w, -1) for _, x in part for w in x], np.int64)
        sizes = np.array([len(x) for _, x in part], np.int64)
        pieces = np.maximum(1, -(-sizes // step))
        first = np.cumsum(pieces) - pieces
        within = np.arange(len(terms)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        segment = np.repeat(first, sizes) + within // step
        known = terms >= 0
        owner = np.repeat(np.arange(len(part)), pieces)
        for k in index.candidates(segment[known], terms[known], int(pieces.sum())).tolist():
            text, words = part[owner[k]]
            begin = (k - int(first[owner[k]])) * step
            passage = words[begin : begin + 2 * step]
            query = {t for w in passage if (t := lookup(w)) is not None}
            hits = index.search(sorted(query), threshold)
            if not hits:
                continue
            own = shingles(passage)
            joined = b" " + b" ".join(passage) + b" "
            for item, score in hits:
                whole = share(index.whole[item], own, joined)
                shares = [share(g, own, joined) for g in index.grams[item]]
                if whole < overlap - 1e-9:
                    for i in sorted((0, 1), key=lambda i: -shares[i]):  # the other is not looked at if this fails
                        if shares[i] < overlap:
                            shares[i] = max(shares[i], edit_share(index.parts[item][i], passage, joined, overlap))
                        if shares[i] < overlap - 1e-9:
                            break
                if whole >= overlap - 1e-9 or min(shares) >= overlap - 1e-9:
                    best = found.get((text, item))
                    if best is None or score > best[0]:
                        found[text, item] = (score, *shares, whole)

    part, segments = [], 0
    for k, text in enumerate(texts):
        words = words_of(text)
        if not words:
            continue
        part.append((k, words))
        segments += -(-len(words) // step)
        if segments >= most:
            flush(part)
            part, segments = [], 0
    if part:
        flush(part)
    return [(k, item, *x) for (k, item), x in found.items()]


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks of one class of sizes and at most PASS_BYTES; the driver holds one block at a time."""
    block, size, now = [], 0, 0
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    bits = F.length(F.bin(F.octet_length("t")))
    items = items.select(F.floor(F.greatest(bits - SMALL_BITS + CLASS_BITS - 1, F.lit(0)) / CLASS_BITS).cast("int").alias("class"), "i", "t")
    for kind, i, t in items.orderBy("class", "i", "t").toLocalIterator():
        if not words_of(t):
            continue
        if block and (kind != now or size + len(t.encode()) > PASS_BYTES):
            yield block
            block, size = [], 0
        now = kind
        block.append((i, t))
        size += len(t.encode())
    if block:
        yield block


def _texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, item_overlap) of each row of docs and item that match; no shuffle.

    Each block of items is one pass over the documents.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, item_overlap double"
    out = None
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            release()
            index = Index(sent.value)
            for b in batches:
                ids = b.column(0).to_pylist()
                found = [(ids[k], index.ids[i], *x) for k, i, *x in matches(_texts(b.column(1)), index)]
                kinds_ = (pa.int64(), pa.int64(), *[pa.float64()] * 4)
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], t) for c, t in enumerate(kinds_)], names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "item_overlap"])

        slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        found = slim.mapInArrow(rows, kinds)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], kinds) if out is None else out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that match no item; a filter in the scan, no shuffle."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text_col)
    for block in item_blocks(benchmark):
        sent = spark.sparkContext.broadcast(block)

        def rows(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            release()
            index = Index(sent.value)
            for b in batches:
                bad = {k for k, *_ in matches(_texts(b.column(at)), index)}
                yield b.filter(pa.array([k not in bad for k in range(b.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(rows, docs.schema)
    return docs
