"""Suffix-array dedup (operator 1): bytes covered by a 100-byte string that also starts earlier.

Order is by document id, then offset. At 100 TB no machine holds one suffix array, so equal
100-byte windows are brought together first, by an anchor that a window's own bytes determine
(the 32-gram of least hash in it), and suffix arrays are built over what meets:

1. Each text is cut into runs of windows that share an anchor (about one run in 35 bytes). Packed
   anchor hashes are dealt out by hash; those met once cannot repeat and end here.
2. Runs whose anchor recurs are fetched from the text with the bytes that they cover and dealt
   out by anchor. Equal runs leave all but their first. Where different runs share an anchor, a
   suffix array over their windows is built (ranks of 8, 16, 32, 64 and 100 bytes), and previous
   and next smaller positions in suffix order give each window's longest previous factor: it is
   a later copy if that is 100 bytes or more.
3. The spans go back to their documents; the bytes they cover are removed.

Hot anchors (those of many documents, found in a bounded sample of documents) need not be met in
step 1, and their runs are dealt window by window, by a hash of the window, so no task gets one
anchor's rows; which anchors are in that list changes where work is done, never the result.
Equal runs and windows are merged in each batch before they are dealt.

Defined results: null and short texts keep everything; texts of any length are taken in segments
that overlap; a null id comes after all ids; of rows that share an id, the order is by the bucket, the
hash of the row and its text, and of equal rows (by id and text, not by hash alone) one keeps its bytes; an empty table gives an empty table; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, mix, pack, parts, small_batches, text_bytes, unpack

LENGTH = 100
GRAM = 32
SPREAD = LENGTH - GRAM + 1  # places of a gram in a window
POSITION_BITS = 22
CHUNK = 1 << 18  # bytes hashed at once: its arrays stay in cache
SEGMENT = 1 << 21  # longer texts are hashed in segments that overlap by a window
BUCKET_BYTES = 1 << 23  # bytes of texts in one bucket, about
HOT_SAMPLE = 20_000  # documents in the sample for hot anchors
HOT_DOCS = 20  # an anchor of that many of them is hot
HOT_MOST = 50_000  # anchors in the list at most: 400 KB in a task's closure
_LAST = np.iinfo(np.int64).max

_rng = np.random.default_rng(100)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_FACTORS = _rng.integers(0, 2**63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the 32 bytes from each offset on."""
    x, step = _TABLE[data], 1
    with np.errstate(over="ignore"):
        for f in _FACTORS:
            x, step = x[:-step] * f + x[step:], 2 * step
    return x


def window_runs(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in segments of data: segment, offset, anchor - offset, windows, hash."""
    empty = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64))
    if len(data) < LENGTH:
        return empty
    h = gram_hashes(data)
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= SPREAD:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    least = np.minimum(least[: len(h) - SPREAD + 1], least[SPREAD - width :])
    edge = np.zeros(len(least) + 1, np.int64)
    fit = lengths >= LENGTH
    np.add.at(edge, starts[fit], 1)
    np.add.at(edge, starts[fit] + lengths[fit] - LENGTH + 1, -1)
    p = np.flatnonzero(np.cumsum(edge[:-1]))
    if not len(p):
        return empty
    a = (least[p] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    at, anchor = p[first], a[first]
    segment = np.searchsorted(starts, at, "right") - 1
    return segment, at - starts[segment], anchor - at, np.diff(np.concatenate((first, [len(p)]))), mix(h[anchor])


def text_runs(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """window_runs() over texts, in chunks: text, offset, anchor - offset, windows, hash."""
    pieces: list[tuple[int, int, bytes]] = []
    size = 0

    def flush() -> tuple[np.ndarray, ...]:
        data = np.frombuffer(b"".join(x[2] for x in pieces), np.uint8)
        lengths = np.array([len(x[2]) for x in pieces], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        segment, at, *rest = window_runs(data, starts, lengths)
        return np.array([x[0] for x in pieces], np.int64)[segment], at + np.array([x[1] for x in pieces], np.int64)[segment], *rest

    for k, x in enumerate(texts):
        for at in range(0, max(1, len(x) - LENGTH + 1), SEGMENT):
            piece = x[at : at + SEGMENT + LENGTH - 1]
            if len(piece) < LENGTH:
                continue
            if pieces and size + len(piece) > CHUNK:
                yield flush()
                pieces, size = [], 0
            pieces.append((k, at, piece))
            size += len(piece)
    if pieces:
        yield flush()


def smaller_neighbours(position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the nearest before and after it that holds a smaller position (-1 and n: none).

    Pointers jump over places known to hold larger positions, all at once.
    """
    n = len(position)
    before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
    held = np.concatenate((position, [-1]))  # -1 and n both read the stop
    for near, stop in ((before, -1), (after, n)):
        todo = np.arange(n)
        while len(todo):
            at = near[todo]
            todo = todo[(at != stop) & (held[at] > position[todo])]
            near[todo] = near[near[todo]]
    return before, after


def later_copies(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Of windows of 100 bytes at ascending starts in data: whether an equal one starts earlier.

    The suffix array orders windows by their 100 bytes (prefix doubling); the longest previous
    factor of a window is reached at its previous or next smaller position in that order.
    """
    if not len(starts):
        return np.zeros(0, bool)
    whole = np.concatenate((data, np.zeros(8, np.uint8)))
    rank = np.lib.stride_tricks.as_strided(whole[:8].view(">u8"), (len(data),), (1,)).astype(np.uint64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.uint64)
    for h in (8, 16, 32):
        later = np.concatenate((rank[h:], np.zeros(min(h, len(rank)), np.uint64)))[: len(rank)]
        rank = np.unique(rank << np.uint64(32) | later, return_inverse=True)[1].astype(np.uint64)
    hundred = rank[starts] << np.uint64(32) | rank[starts + LENGTH - 64]
    suffixes = np.argsort(hundred, kind="stable")
    hundred, position = hundred[suffixes], starts[suffixes]
    before, after = smaller_neighbours(position)
    ends = np.concatenate((hundred, [np.uint64(0)]))
    long = (before >= 0) & (ends[before] == hundred) | (after < len(starts)) & (ends[after] == hundred)
    out = np.zeros(len(starts), bool)
    out[suffixes] = long
    return out


def _dealt(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Arrays by bucket, their order kept within one."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    arrays = tuple(x[order] for x in arrays)
    cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            yield int(bucket[i]), [x[i:j] for x in arrays]


def _joined(blobs: list[bytes], *kinds: str) -> list[np.ndarray]:
    if not blobs:
        return [np.zeros(0, k) for k in kinds]
    return [np.concatenate(x) for x in zip(*(unpack(b, *kinds) for b in blobs), strict=True)]


_RUN = ("<i8", "<u4", "u1", "u1")  # row, offset, anchor - offset, windows (+ 128 if hot)
_SPAN = ("<u4", "<u4", "<u4", "<u4")  # bucket and place of the document in it, start, end
_CONTEXT = ("<i8", "<u4", "<u4", "<u4", "u1", "u1")  # id, bucket, place, offset, anchor - offset (255: a hot window), windows


def hot_anchors(rows: DataFrame, count: int) -> np.ndarray:
    """Sorted hashes of anchors that many documents of a bounded sample of the `count` rows share."""
    every = max(1, count // HOT_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("row", F.lit("hot")), F.lit(every)) == 0).select("text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, _, _, _, h in text_runs(as_bytes(b.column(0))):
                pairs = np.unique(np.stack([k.view(np.uint64), h], 1), axis=0)[:, 1]
                yield pa.RecordBatch.from_arrays([pa.array(pairs.copy().view(np.int64))], names=["h"])

    counts = sample.mapInArrow(hashes, "h long").groupBy("h").agg(F.count("*").alias("n"))
    top = counts.where(F.col("n") >= HOT_DOCS).orderBy(F.desc("n"), "h").limit(HOT_MOST).collect()
    return np.sort(np.array([x.h for x in top], np.int64).view(np.uint64))


def _member(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def recurring_runs(rows: DataFrame, hot: np.ndarray, n: int) -> DataFrame:
    """(bucket of the row, packed runs) whose anchor recurs, from rows(row, text)."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy()
            found = [np.concatenate(x) for x in zip(*text_runs(as_bytes(b.column(1))), strict=True)]
            if not found:
                continue
            k, at, lead, windows, h = found
            is_hot = _member(h, hot)
            kind, bucket, blob = [], [], []
            fields = (row[k], at.astype(np.uint32), lead.astype(np.uint8), (windows + 128 * is_hot).astype(np.uint8))
            for i, x in _dealt((h[~is_hot] % np.uint64(n)).astype(np.int64), (h[~is_hot] >> np.uint64(32)).astype(np.uint32), *(f[~is_hot] for f in fields)):
                kind.append(0), bucket.append(i), blob.append(pack(*x))
            for i, x in _dealt(fields[0][is_hot] % n, *(f[is_hot] for f in fields)):
                kind.append(1), bucket.append(i), blob.append(pack(*x))
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(bucket, pa.int64()), pa.array(blob, pa.binary())], names=["kind", "bucket", "blob"])

    def met(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        h, *run = _joined([b for k, b in zip(kinds, blobs, strict=True) if k == 0], "<u4", *_RUN)
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        again = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))]) if len(s) else order
        known = _joined([b for k, b in zip(kinds, blobs, strict=True) if k == 1], *_RUN)
        run = [np.concatenate((x[again], y)) for x, y in zip(run, known, strict=True)]
        out = [(i, pack(*x)) for i, x in _dealt(run[0] % n, *run)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})

    dealt = rows.select("row", "text").mapInArrow(anchors, "kind int, bucket long, blob binary").repartition(n, "bucket")
    return dealt.groupBy("bucket").applyInArrow(met, "bucket long, blob binary")


def _documents(table: pa.Table) -> list[tuple[int, int, bytes, int | None]]:
    """(id, null last; row; text; id) of a group's rows, in document order."""
    ids, rows = table.column("doc_id").to_pylist(), table.column("row").to_pylist()
    docs = [(_LAST if i is None else i, r, x, i) for i, r, x in zip(ids, rows, as_bytes(table.column("text")), strict=True)]
    return sorted(docs, key=lambda d: d[:3])


_DEALT = {"kind": pa.int32(), "bucket": pa.int64(), "blob": pa.binary(), "data": pa.binary()}


def fetched_contexts(docs: DataFrame, runs: DataFrame, n: int) -> DataFrame:
    """Contexts of recurring runs, dealt by anchor (kind 0), and spans known already (kind 1)."""

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        row, at, lead, windows = _joined(right.column("blob").to_pylist(), *_RUN)
        order = np.lexsort((at, row))
        # equal rows found each run as often as they stand
        order = order[np.concatenate(([True], (np.diff(row[order]) != 0) | (np.diff(at[order]) != 0)))] if len(order) else order
        row, at, lead, windows = row[order], at[order].tolist(), lead[order].tolist(), windows[order].tolist()
        seen: set[bytes] = set()
        seen_windows: set[bytes] = set()
        spans: list[tuple] = []
        contexts: dict[int, list] = {}
        own = left.column("bucket")[0].as_py() if len(left) else 0
        before = None
        for place, (order_id, r, text, _) in enumerate(_documents(left)):
            if (order_id, text) == before:
                continue  # a row equal to the last: remove() takes it whole
            before = order_id, text
            i, j = np.searchsorted(row, (r, r + 1)) if r < _LAST else (np.searchsorted(row, r), len(row))
            for k in range(i, j):
                a = at[k]
                w = min(windows[k] & 127, len(text) - LENGTH + 1 - a)
                if w < 1:
                    continue  # the run of another text with this hash
                context = text[a : a + w - 1 + LENGTH]
                if context in seen:
                    spans.append((own, place, a, a + len(context)))
                    continue
                seen.add(context)
                if windows[k] < 128:
                    group = xxhash.xxh64_intdigest(context[lead[k] : lead[k] + GRAM])
                    contexts.setdefault(group % n, []).append((order_id, own, place, a, lead[k], w, context))
                    continue
                for p in range(w):
                    window = context[p : p + LENGTH]
                    if window in seen_windows:
                        spans.append((own, place, a + p, a + p + LENGTH))
                    else:
                        seen_windows.add(window)
                        group = xxhash.xxh64_intdigest(window)
                        contexts.setdefault(group % n, []).append((order_id, own, place, a + p, 255, 1, window))
        out = [(1, own, pack(*(np.array(f, k) for f, k in zip(zip(*spans, strict=True), _SPAN, strict=True))), b"")] if spans else []
        for i, x in contexts.items():
            *fields, data = zip(*x, strict=True)
            blob = pack(*(np.array(f, k) for f, k in zip(fields, _CONTEXT, strict=True)))
            out.append((0, i, blob, pack(np.frombuffer(b"".join(data), np.uint8))))
        return pa.table({k: pa.array([x[c] for x in out], t) for c, (k, t) in enumerate(_DEALT.items())})

    return docs.groupBy("bucket").cogroup(runs.repartition(n, "bucket").groupBy("bucket")).applyInArrow(fetch, "kind int, bucket long, blob binary, data binary")


def copied_spans(contexts: DataFrame, n: int) -> DataFrame:
    """(bucket of the row, packed spans) of windows with an equal one earlier."""

    def meet(table: pa.Table) -> pa.Table:
        kinds, blobs, datas = (table.column(k).to_pylist() for k in ("kind", "blob", "data"))
        known = _joined([b for k, b in zip(kinds, blobs, strict=True) if k == 1], *_SPAN)
        ident, home, place, at, lead, windows = _joined([b for k, b in zip(kinds, blobs, strict=True) if k == 0], *_CONTEXT)
        data = b"".join(unpack(d, "u1")[0].tobytes() for k, d in zip(kinds, datas, strict=True) if k == 0)
        sizes = windows.astype(np.int64) + LENGTH - 1
        begin = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        order = np.lexsort((at, place, home, ident))
        seen: set[bytes] = set()
        whole, first, texts, anchors = [], [], [], []
        leads = lead.tolist()
        for k in order.tolist():
            x = data[begin[k] : begin[k] + sizes[k]]
            if x in seen:
                whole.append(k)
            else:
                seen.add(x)
                first.append(k)
                texts.append(x)
                anchors.append(x if leads[k] == 255 else x[leads[k] : leads[k] + GRAM])
        spans = [tuple(known), (home[whole], place[whole], at[whole], at[whole] + sizes[whole].astype(np.uint32))]
        # different runs of one anchor, in document order
        first = np.array(first, np.int64)
        shared = np.zeros(len(first), bool)
        if len(first):
            met = Counter(anchors)
            shared = np.array([met[x] > 1 for x in anchors], bool)
        if shared.any():
            some = first[shared]
            text = np.frombuffer(b"".join(x for x, s in zip(texts, shared.tolist(), strict=True) if s), np.uint8)
            base = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
            w = windows[some].astype(np.int64)
            owner = np.repeat(np.arange(len(some)), w)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(w) - w, w)
            later = np.flatnonzero(later_copies(text, base[owner] + step))
            if len(later):
                new = np.concatenate(([True], (np.diff(later) > 1) | (owner[later][1:] != owner[later][:-1])))
                a = later[new]
                z = later[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(later) - 1]))]
                k = some[owner[a]]
                spans.append((home[k], place[k], at[k] + step[a].astype(np.uint32), at[k] + (step[z] + LENGTH).astype(np.uint32)))
        home, place, start, end = (np.concatenate(x).astype(np.uint32) for x in zip(*spans, strict=True))
        out = [(i, pack(*x)) for i, x in _dealt(home, home, place, start, end)]
        return pa.table({"bucket": pa.array([x[0] for x in out], pa.int64()), "blob": pa.array([x[1] for x in out], pa.binary())})

    return contexts.repartition(n, "bucket").groupBy("bucket").applyInArrow(meet, "bucket long, blob binary")


def merged(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs that spans cover; spans that touch make one run."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(start.tolist(), end.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_RESULT = pa.schema({"doc_id": pa.int64(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))})


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """RESULT for each row of docs, with kept (the remaining bytes) if asked for.

    Texts are shuffled once (two steps read the same exchange); anchors, contexts and spans travel
    as packed blobs. The number of buckets follows the bytes of all texts, so a task's share does not grow with them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    count, size = text_bytes(docs, text_col)
    n = max(2 * parts(spark), size // BUCKET_BYTES + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("row", F.xxhash64("doc_id", "text"))
    runs = recurring_runs(rows, hot_anchors(rows, count), n)
    placed = rows.withColumn("bucket", F.pmod(F.col("row"), F.lit(n))).repartition(n, "bucket")
    spans = copied_spans(fetched_contexts(placed, runs, n), n)

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        _, places, start, end = _joined(right.column("blob").to_pylist(), *_SPAN)
        order = np.argsort(places, kind="stable")
        places, start, end = places[order], start[order], end[order]
        out, kept, before = [], [], None
        for place, (order_id, _, text, ident) in enumerate(_documents(left)):
            if (order_id, text) == before:
                found = [(0, len(text))] if len(text) >= LENGTH else []
            else:
                i, j = np.searchsorted(places, place, "left"), np.searchsorted(places, place, "right")
                found = merged(start[i:j], end[i:j])
            before = order_id, text
            edges = [0, *(x for s in found for x in s), len(text)]
            left_over = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if found else text
            out.append({"doc_id": ident, "n_bytes": len(text), "n_removed": len(text) - len(left_over), "n_spans": len(found), "kept_sha256": hashlib.sha256(left_over).hexdigest(), "spans": [{"start": a, "end": b} for a, b in found]})
            kept.append(left_over)
        table = pa.Table.from_pylist(out, _RESULT)
        return table.append_column("kept", pa.array(kept, pa.binary())) if with_kept else table

    return placed.groupBy("bucket").cogroup(spans.repartition(n, "bucket").groupBy("bucket")).applyInArrow(remove, RESULT + ", kept binary" * with_kept)
