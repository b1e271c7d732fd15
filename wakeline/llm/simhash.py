"""SimHash near-duplicates (operator 5) with deletion-variant signatures.

A fingerprint has a bit set where over half of a text's shingle hashes have it. Fingerprints
within four bits are found exactly: cut into three segments, either some segment is equal, or
each differs and then one of the first two differs by exactly one bit. So keys are (a) each
segment whole and (b) each of the first two with one bit left out. Either key leaves few bits
to differ in the rest (four, three), so the rest is cut into five or four blocks of which one
must be equal, and that block joins the key: about 30 bits of key, 183 keys a fingerprint,
which keeps chance meetings rare at billions of fingerprints. Keys meet by an equality shuffle of
packed fingerprints; links are verified by counting bits, and each meeting emits a spanning
forest, never all its pairs. Only distinct fingerprints are indexed; copies follow by a join.

Defined results: null and empty texts have fingerprint 0 and are linked like any other;
repeated rows and copies share a fingerprint; a null id never names a component while its group has
another; an empty table gives an empty table; other columns are not read. one_of_each() keeps all
columns (names that start with two underscores are reserved), counts null and empty texts as one
group, and of repeated rows keeps one.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import as_bytes, cut, mix, pack, parts, release, small_batches, unpack, written
from wakeline.llm.graph import components

SEED = 42
BITS = 4


KEYS_PER_BUCKET = 4_000_000  # keys of a bucket, nine bytes each, about


def _masks() -> np.ndarray:
    """The kept bits of each of the 183 kinds of key."""
    span = lambda a, b: sum(1 << i for i in range(a, b))
    bounds = [(0, 21), (21, 42), (42, 64)]
    out = []
    for k, (a, b) in enumerate(bounds):
        rest = [i for i in range(64) if not a <= i < b]
        whole = np.array_split(rest, 5)
        out += [span(a, b) | sum(1 << int(i) for i in block) for block in whole]
        if k < 2:
            for bit in range(a, b):
                out += [(span(a, b) & ~(1 << bit)) | sum(1 << int(i) for i in block) for block in np.array_split(rest, 4)]
    return np.array(out, np.uint64)


MASKS = _masks()


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the text's word shingles, repeats included; A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(text[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)], np.uint64)


def ones(h: np.ndarray) -> np.ndarray:
    """How many of the hashes set each of the 64 bits."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 255 << 8):  # bounded memory for very long texts
        part = h[at : at + (255 << 8)]
        bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        full = len(part) // 255 * 255
        # sums of 255 rows fit a byte, and bytes are summed many at once
        total += np.add.reduce(np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8), axis=0, dtype=np.int64)
        total += np.add.reduce(bits[full:], axis=0, dtype=np.uint8)
    return total


def majority(h: np.ndarray) -> int:
    """The 64-bit fingerprint of shingle hashes: bits set in over half of them."""
    if not len(h):
        return 0
    return int.from_bytes(np.packbits(2 * ones(h) > len(h), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; no shuffle."""
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([majority(shingle_hashes(x, size)) for x in as_bytes(b.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(rows, "doc_id long, fp long")


def forest(values: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints that share a key; the least
    come first, so that the forests of other keys share its edges."""
    edges, left = [], np.sort(values)
    queue: deque[np.uint64] = deque()
    while len(left):
        if not queue:
            queue.append(left[0])
            left = left[1:]
        at = queue.popleft()
        near = np.bitwise_count(left ^ at) <= bits
        if near.any():
            found = left[near]
            edges += [(int(at), int(x)) for x in found]
            queue.extend(found)
            left = left[~near]
    return edges


def _keys(fps: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((fps & MASKS[kinds]) * np.uint64(0x9E3779B97F4A7C15) + kinds.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03) + np.uint64(1))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b) that link the distinct fingerprints of fps(fp) as far as all pairs within
    `bits` (4 or fewer) bits would: a spanning forest of each meeting. Buckets follow the number of
    fingerprints, so what one task holds does not grow with them."""
    if bits > BITS:
        raise ValueError(f"the keys are complete up to {BITS} bits")
    n = max(4 * parts(fps.sparkSession), fps.count() * len(MASKS) // KEYS_PER_BUCKET + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 4096):
                part = values[at : at + 4096]
                kinds = np.repeat(np.arange(len(MASKS), dtype=np.uint8), len(part))
                every = np.tile(part, len(MASKS))
                bucket = (_keys(every, kinds) % np.uint64(n)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                every, kinds, bucket = every[order], kinds[order], bucket[order]
                cuts = np.flatnonzero(np.diff(bucket)) + 1
                starts = np.concatenate(([0], cuts))
                blobs = [pack(every[i:j], kinds[i:j]) for i, j in zip(starts, [*cuts, len(every)], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        every, kinds = (np.concatenate(x) for x in zip(*(unpack(x, "<u8", "u1") for x in table.column("blob").to_pylist()), strict=True))
        keys = _keys(every, kinds)
        order = np.argsort(keys)
        every, keys = every[order], keys[order]
        same = keys[1:] == keys[:-1]
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        sizes = np.diff([*starts, len(keys)])
        two = starts[sizes == 2]
        close = np.bitwise_count(every[two] ^ every[two + 1]) <= bits
        a, b = [every[two][close]], [every[two + 1][close]]
        for i, m in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if found := forest(every[i : i + m], bits):
                x = np.array(found, np.uint64)
                a.append(x[:, 0])
                b.append(x[:, 1])
        x = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], 1), axis=0)
        return pa.table({"a": x[:, 0].copy().view(np.int64), "b": x[:, 1].copy().view(np.int64)})

    dealt = fps.mapInArrow(deal, "bucket long, blob binary").repartition(n, "bucket")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links) of each row of docs."""
    fp = cut(fingerprints(docs, id_col, text_col, size))
    own = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("least")))
    root = components(links(own.select("fp"), bits)).toDF("fp", "root")
    linked = own.join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", "fp", "component_id")


LANES = 6
CHECKS = 3  # further lanes, of which similarity is read
USED = 2  # lanes that are indexed; what they miss the exact join finds
_LANE = np.random.default_rng(5).integers(0, 2**64, LANES + CHECKS, dtype=np.uint64)
SEGMENTS = ((0, 21), (21, 42), (42, 64))


def _routes() -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(lane, segment, bits kept) of each route, and the single bits (0: none) that its variants leave out.

    A segment is cut in three blocks; a route keeps two of them and leaves out one bit of the third in turn.
    """
    routes, bits = [], []
    for lane in range(LANES):
        for k, (a, b) in enumerate(SEGMENTS):
            blocks = np.array_split(np.arange(b - a), 3)
            for third in range(3):
                routes.append((lane, k, sum(1 << int(i) for j in range(3) if j != third for i in blocks[j])))
                bits.append([1 << int(i) for i in blocks[third]] + [0] * (8 - len(blocks[third])))
    return routes, np.array(bits, np.uint32)


ROUTES, LEFT_OUT = _routes()
CHUNK = 1 << 22  # bytes of texts whose shingles are counted and answered together
PER_BUCKET = 1_000_000  # shingles of a bucket in which they are counted, about
MEET = 4096  # members of a group that are compared in one task; larger groups are cut in blocks
FEW = 16  # shingles below which fingerprints say too little to leave a pair out
#: Bits of the 320 of five lanes in which a pair at 0.8 does not differ: 48 are expected, this is six deviations more.
FAR = 87
_SMALL = 9  # entries of a meeting up to which all its pairs are compared at once


def lanes(raw: bytes, size: int) -> bytes:
    """Nine independent SimHash fingerprints of the set of a text's shingles, 72 bytes."""
    return lanes_of(np.unique(shingle_hashes(raw, size)))


def lanes_of(h: np.ndarray, used: int = LANES) -> bytes:
    """lanes() of a set of shingle hashes, of the first `used` ones and the checks."""
    return b"".join(majority(mix(h ^ k)).to_bytes(8, "little") for k in (*_LANE[:used], *_LANE[LANES:]))


def most_bits(similarity: float) -> int:
    """Differing bits of two texts' check lanes up to which they count as similar.

    A bit differs with probability acos(2J / (1 + J)) / pi at Jaccard similarity J; one standard
    deviation is allowed on top, so that similarity itself is more often met than missed.
    """
    n, p = 64 * CHECKS, np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(n * p + np.sqrt(n * p * (1 - p)))


def met_pairs(seg: np.ndarray, route: np.ndarray, node: np.ndarray, check: np.ndarray, most: int) -> np.ndarray:
    """Edges (least node, node) of a spanning forest of the links among entries: segments of one route
    that are equal but for one bit left out, and check lanes that differ in at most `most` bits."""
    names, at = np.unique(node, return_inverse=True)
    parent = np.arange(len(names))
    label = parent.copy()
    close = lambda x, y: np.bitwise_count(check[x] ^ check[y]).sum(axis=-1, dtype=np.int64) <= most

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def unite(x: np.ndarray, y: np.ndarray) -> None:
        for i, j in zip(at[x].tolist(), at[y].tolist(), strict=True):
            i, j = find(i), find(j)
            if i != j:
                parent[max(i, j)] = min(i, j)

    for v in range(LEFT_OUT.shape[1]):
        bit = LEFT_OUT[route, v]
        use = np.flatnonzero(bit)
        key = route[use].astype(np.uint64) << np.uint64(32) | (seg[use] & ~bit[use])
        order = np.argsort(key, kind="stable")
        key, use = key[order], use[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff([*starts, len(key)])
        small = np.repeat(sizes <= _SMALL, sizes)
        for d in range(1, _SMALL):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            if not len(i):
                break
            x, y = use[i], use[i + d]
            apart = label[at[x]] != label[at[y]]
            x, y = x[apart], y[apart]
            near = close(x, y)
            unite(x[near], y[near])
        for i, m in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
            left, queue = use[i : i + m], deque()
            if (label[at[left]] == label[at[left[0]]]).all():
                continue
            while len(left):
                if not queue:
                    queue.append(left[0])
                    left = left[1:]
                here = queue.popleft()
                hit = close(left, here)
                if hit.any():
                    unite(left[hit], np.full(int(hit.sum()), here))
                    queue.extend(left[hit].tolist())
                    left = left[~hit]
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        label = parent.copy()
    linked = np.flatnonzero(parent != np.arange(len(parent)))
    return np.stack([names[parent[linked]], names[linked]], 1)


def similar_links(prints: DataFrame, similarity: float, used: int = USED) -> DataFrame:
    """Edges (a, b) that connect the nodes of prints(node, lanes) whose check lanes differ in most_bits() at most.

    Texts of similarity 0.8 differ in about 15 % of the bits, far beyond what segments of one
    fingerprint find for certain, so each of the `used` lanes is cut in three and each segment indexed with
    one bit left out: of two lanes one of the 6 segments differs by at most one bit in 61 % of the pairs at
    0.8, 92 % at 0.9. The variants of a segment travel together: the bit left out lies in one of three
    blocks, so an entry for each pair of blocks (18 a text) reaches all meetings of the 126 variants,
    which are formed where the entries arrive. What meets is compared by three further lanes, and each bucket
    leaves a spanning forest.
    """
    routes_used = [(r, *x) for r, x in enumerate(ROUTES) if x[0] < used]
    n = 2 * parts(prints.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            every = np.frombuffer(b"".join(b.column(1).to_pylist()), "<u8").reshape(-1, used + CHECKS)
            node = b.column(0).to_numpy()
            segs = np.empty((len(every), len(routes_used)), np.uint32)
            bucket = np.empty((len(every), len(routes_used)), np.int64)
            with np.errstate(over="ignore"):
                for at, (r, lane, k, kept) in enumerate(routes_used):
                    a, z = SEGMENTS[k]
                    seg = every[:, lane] >> np.uint64(a) & np.uint64((1 << (z - a)) - 1)
                    segs[:, at] = seg
                    bucket[:, at] = mix((seg & np.uint64(kept)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1)) % np.uint64(n)
            place = np.repeat(np.arange(len(every), dtype=np.uint16), len(routes_used))
            route = np.tile(np.array([x[0] for x in routes_used], np.uint8), len(every))
            bucket, segs = bucket.reshape(-1), segs.reshape(-1)
            order = np.argsort(bucket, kind="stable")
            bucket, segs, place, route = bucket[order], segs[order], place[order], route[order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            checks = [every[:, used + k].copy() for k in range(CHECKS)]
            out = []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    held, own = np.unique(place[i:j], return_inverse=True)
                    out.append((int(bucket[i]), pack(node[held], *(c[held] for c in checks)), pack(segs[i:j], route[i:j], own.astype(np.uint16))))
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], names=["bucket", "nodes", "blob"])

    def meet(table: pa.Table) -> pa.Table:
        release()
        segs, routes, nodes, checks = [], [], [], []
        for t, blob in zip(table.column("nodes").to_pylist(), table.column("blob").to_pylist(), strict=True):
            node, *check = unpack(t, "<i8", *["<u8"] * CHECKS)
            seg, route, place = unpack(blob, "<u4", "u1", "<u2")
            segs.append(seg), routes.append(route), nodes.append(node[place]), checks.append(np.stack(check, 1)[place])
        edges = met_pairs(*(np.concatenate(x) for x in (segs, routes, nodes, checks)), most)
        return pa.table({"a": edges[:, 0].copy(), "b": edges[:, 1].copy()})

    most = most_bits(similarity)
    small_batches(prints.sparkSession, 16_384)
    dealt = prints.select("node", "lanes").mapInArrow(deal, "bucket long, nodes binary, blob binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a long, b long")


def prefix_length(n: int, similarity: float) -> int:
    """Of n shingles in an order that all texts share, the first so many: of two texts of the given
    Jaccard similarity or more, these have one in common."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def node_of(h: np.ndarray) -> int:
    """A signed long that names a set of shingle hashes."""
    return int(np.uint64(xxhash.xxh64_intdigest(h.tobytes(), SEED)).view(np.int64))


_SURVEY = {"kind": pa.int32(), "h": pa.int64(), "node": pa.int64(), "n": pa.int64(), "lanes": pa.binary(), "bucket": pa.int64(), "chunk": pa.int64(), "blob": pa.binary()}


def _rows(**columns: list) -> pa.RecordBatch:
    """A batch of _SURVEY; columns not given are null."""
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(k, [None] * size), t) for k, t in _SURVEY.items()], names=list(_SURVEY))


def _places(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where a shingle is counted: its bucket, and 32 bits of its hash within that."""
    return (mix(h) % np.uint64(buckets)) << np.uint64(32) | h >> np.uint64(32)


def _chunk(nodes: list[int], raws: list[bytes]) -> bytes:
    """Texts and their nodes, compressed."""
    lengths = np.fromiter(map(len, raws), np.uint32, len(raws))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([len(raws).to_bytes(8, "little"), np.array(nodes, np.int64).tobytes(), lengths.tobytes(), *raws]))


def _texts(blob: bytes) -> dict[int, bytes]:
    """The texts of a chunk by their nodes."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    count = int.from_bytes(raw[:8], "little")
    nodes, lengths = np.frombuffer(raw, np.int64, count, 8), np.frombuffer(raw, np.uint32, count, 8 + 8 * count)
    ends = 8 + 12 * count + np.cumsum(lengths, dtype=np.int64)
    return {n: raw[a:z] for n, a, z in zip(nodes.tolist(), [8 + 12 * count, *ends.tolist()], ends.tolist(), strict=False)}


def fetched(wanted: DataFrame, seen: DataFrame) -> DataFrame:
    """(node, text) of wanted(node, chunk), out of the chunks of survey()."""

    def fetch(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        texts = _texts(right.column("blob")[0].as_py()) if len(left) and len(right) else {}
        found = [n for n in dict.fromkeys(left.column("node").to_pylist()) if n in texts]
        return pa.table({"node": pa.array(found, pa.int64()), "text": pa.array([texts[n] for n in found], pa.binary())})

    blobs = seen.where("kind = 2").select("chunk", "blob")
    return wanted.groupBy("chunk").cogroup(blobs.groupBy("chunk")).applyInArrow(fetch, "node long, text binary")


def survey(texts: DataFrame, size: int, buckets: int) -> DataFrame:
    """One pass over distinct texts(h, text): rows of kind 0 hold a text's node, number of shingles and lanes; of kind 1
    the shingles of a chunk of texts, without repeats, dealt to the buckets that count them; of kind 2 the chunk's texts."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple[int, bytes, np.ndarray]] = []
        bytes_ = 0

        def flush() -> Iterator[pa.RecordBatch]:
            release()
            raws, sets = [x[1] for x in pending], [x[2] for x in pending]
            nodes = [node_of(x) for x in sets]
            chunk = int(np.uint64(xxhash.xxh64_intdigest(b"".join(raws), len(raws))).view(np.int64))
            yield _rows(kind=[0] * len(raws), h=[x[0] for x in pending], node=nodes, n=[len(x) for x in sets], lanes=[lanes_of(x, USED) for x in sets], chunk=[chunk] * len(raws))
            once = dict(zip(nodes, sets, strict=True))
            keys, times = np.unique(_places(np.concatenate(list(once.values())), buckets), return_counts=True)
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            blobs, to = [], []
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    low = keys[i:j].astype(np.uint32)
                    blobs.append(pack(np.diff(low, prepend=np.uint32(0)), np.minimum(times[i:j], 65_535).astype(np.uint16)))
                    to.append(int(bucket[i]))
            blobs.append(_chunk(nodes, raws))
            yield _rows(kind=[1] * len(to) + [2], bucket=[*to, None], chunk=[chunk] * (len(to) + 1), blob=blobs)

        for b in batches:
            for h, x in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                pending.append((h, x, np.unique(shingle_hashes(x, size))))
                bytes_ += len(x)
                if bytes_ >= CHUNK:
                    yield from flush()
                    pending, bytes_ = [], 0
        if pending:
            yield from flush()

    return texts.mapInArrow(look, "kind int, h long, node long, n long, lanes binary, bucket long, chunk long, blob binary")


def counted(entries: DataFrame) -> DataFrame:
    """(chunk, bucket, blob): for the shingles of entries(bucket, chunk, blob), as sent, in how many texts each stands, as
    the logarithm rounded up; 0: in no other."""

    def count(table: pa.Table) -> pa.Table:
        release()
        every, times, sizes = [], [], []
        for x in table.column("blob").to_pylist():
            step, n = unpack(x, "<u4", "<u2")
            every.append(np.cumsum(step, dtype=np.uint32)), times.append(n), sizes.append(len(n))
        _, at = np.unique(np.concatenate(every), return_inverse=True)
        total = np.bincount(at, np.concatenate(times))
        level = np.ceil(np.log2(total)).astype(np.uint8)[at]
        ends = np.cumsum(sizes)
        out = [pack(level[z - n : z]) for z, n in zip(ends.tolist(), sizes, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "blob": pa.array(out, pa.binary())})

    return entries.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, blob binary")


def shared_prefixes(seen: DataFrame, size: int, similarity: float, buckets: int) -> DataFrame:
    """(g, node, met): groups of distinct texts of survey() that share a shingle of their prefixes; met: how many of a
    text's shingles stand in other texts too.

    Any two texts of the similarity share a group: a prefix filter, exact for whatever order all texts agree on. The order
    has shingles that stand in few texts of the whole corpus first (by levels of counts, then by hash), and shingles
    that stand in one text only meet nobody. Keys are cut to 48 bits, which only adds meetings; groups of the same
    texts are one.
    """

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        release()
        out = []
        if len(left) and len(right):
            sets = {k: np.unique(shingle_hashes(x, size)) for k, x in _texts(left.column("blob")[0].as_py()).items()}
            replies = sorted(zip(right.column("bucket").to_pylist(), right.column("blob").to_pylist(), strict=True))
            level = np.concatenate([unpack(x, "u1")[0] for _, x in replies])
            node, n = np.fromiter(sets, np.int64, len(sets)), np.fromiter(map(len, sets.values()), np.int64, len(sets))
            h = np.concatenate(list(sets.values()))
            _, at = np.unique(_places(h, buckets), return_inverse=True)
            level, place = level[at], np.repeat(np.arange(len(sets), dtype=np.uint32), n)
            order = np.lexsort((h, level, place))
            met = np.bincount(place, level > 0, len(sets)).astype(np.uint32)
            nth = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
            most = np.array([prefix_length(int(x), similarity) for x in n], np.int64)
            order = order[(nth < most[place]) & (level[order] > 0)]  # place is sorted already
            key, place = h[order] & np.uint64(2**48 - 1), place[order]
            bucket = (mix(key) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((key, bucket))
            key, place, bucket = key[order], place[order], bucket[order]
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i < j:
                    used, own = np.unique(place[i:j], return_inverse=True)
                    out.append((int(bucket[i]), pack(node[used], met[used]), pack((key[i:j] & np.uint64(2**32 - 1)).astype(np.uint32), (key[i:j] >> np.uint64(32)).astype(np.uint16), own.astype(np.uint32))))
        return pa.table({k: pa.array([x[c] for x in out], t) for c, (k, t) in enumerate({"bucket": pa.int64(), "nodes": pa.binary(), "blob": pa.binary()}.items())})

    def meet(table: pa.Table) -> pa.Table:
        release()
        nodes, mets, keys = [], [], []
        for t, blob in zip(table.column("nodes").to_pylist(), table.column("blob").to_pylist(), strict=True):
            (node, met), (low, high, place) = unpack(t, "<i8", "<u4"), unpack(blob, "<u4", "<u2", "<u4")
            nodes.append(node[place]), mets.append(met[place]), keys.append(high.astype(np.uint64) << np.uint64(32) | low)
        node, met, key = np.concatenate(nodes), np.concatenate(mets), np.concatenate(keys)
        order = np.lexsort((node, key))
        node, met, key = node[order], met[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        node, met, key = node[new], met[new], key[new]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        count = np.diff([*starts, len(key)])
        g = np.add.reduceat(mix(node.view(np.uint64)), starts)
        _, first = np.unique(g, return_index=True)
        stay = np.zeros(len(starts), bool)
        stay[first] = True
        stay = np.repeat(stay & (count > 1), count)
        return pa.table({"g": np.repeat(g, count)[stay].view(np.int64), "node": node[stay], "met": met[stay].astype(np.int64)})

    replies = counted(seen.where("kind = 1").select("bucket", "chunk", "blob"))
    dealt = seen.where("kind = 2").select("chunk", "blob").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(choose, "bucket long, nodes binary, blob binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "g long, node long, met long").distinct()


def _cells(members: DataFrame, key: str, most: int, buckets: int) -> DataFrame:
    """members dealt to buckets by cell: groups of equal key, those beyond `most` members cut in blocks, of which each
    pair is a cell, so no task has to hold a whole group. side: 2 within a block, else which block of the pair.
    Groups of one root are left out."""
    sizes = members.groupBy(key).agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select(key, F.ceil(F.col("k") / most).alias("blocks"))
    x = members.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("node", key), F.col("blocks")))
    x = x.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    x = x.withColumn("cell", F.xxhash64(key, F.least("own", "other"), F.greatest("own", "other"))).withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
    return x.drop(key, "own", "other", "blocks").withColumn("bucket", F.pmod("cell", F.lit(buckets)))


def _compared(table: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, Iterator[tuple[int, np.ndarray]], np.ndarray]]:
    """For each cell of a bucket: its rows in the table, the labels of their roots, and an iterator over (place, later
    places of other labels that may be similar to it), nearest first. Labels may be changed meanwhile."""
    cell, side, node, n, met, root = (table.column(k).to_numpy() for k in ("cell", "side", "node", "n", "met", "root"))
    lanes_ = np.frombuffer(b"".join(table.column("lanes").to_pylist()), np.uint64).reshape(len(node), -1)
    order = np.lexsort((node, cell))
    cuts = [0, *(np.flatnonzero(np.diff(cell[order])) + 1).tolist(), len(cell)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        rows = order[i:j]
        label = np.unique(root[rows], return_inverse=True)[1]
        s, m, size, bits_of = side[rows], met[rows], n[rows], lanes_[rows]

        def near(label=label, s=s, m=m, size=size, bits_of=bits_of) -> Iterator[tuple[int, np.ndarray]]:
            for k in range(len(s) - 1):
                to = np.flatnonzero((label[k + 1 :] != label[k]) & ((s[k + 1 :] != s[k]) | (s[k] == 2))) + k + 1
                to = to[np.minimum(m[to], m[k]) >= (size[to] + size[k]) * similarity / (1 + similarity) - 1e-6]
                if len(to):
                    bits = np.bitwise_count(bits_of[to] ^ bits_of[k]).sum(axis=1, dtype=np.int64)
                    stay = (bits <= FAR) | (np.minimum(size[to], size[k]) < FEW)
                    if stay.any():
                        yield k, to[stay][np.argsort(bits[stay], kind="stable")]

        yield rows, near(), label


def suspects(members: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the nodes of members(g, node, n, met, root, lanes) whose pairs one group holds, that are of
    different roots, and whose shingles that stand elsewhere too are enough for the similarity, as are their fingerprints.

    Groups are compared where they lie, and a cell leaves a spanning forest of such pairs, not the pairs.
    """

    def compare(table: pa.Table) -> pa.Table:
        release()
        node = table.column("node").to_numpy()
        out = [np.zeros((0, 2), np.int64)]
        for rows, near, _ in _compared(table, similarity):
            tree = np.arange(len(rows))
            for k, to in near:
                to = to[np.unique(tree[to], return_index=True)[1]]
                to = to[tree[to] != tree[k]]
                if len(to):
                    tree[np.isin(tree, tree[to])] = tree[k]
                    out.append(np.stack([np.full(len(to), node[rows[k]]), node[rows[to]]], 1))
        found = np.unique(np.concatenate(out), axis=0)
        return pa.table({"a": found[:, 0].copy(), "b": found[:, 1].copy()})

    return _cells(members, "g", MEET, 2 * parts(members.sparkSession)).groupBy("bucket").applyInArrow(compare, "a long, b long")


def proven(members: DataFrame, size: int, similarity: float, buckets: int) -> DataFrame:
    """Edges (a, b) of roots that connect those of members(c, node, n, met, root, lanes, text) of one cluster c that hold a pair
    of the similarity, by counting shingles. What is connected already is not compared again."""

    def compare(table: pa.Table) -> pa.Table:
        release()
        root, texts = table.column("root").to_numpy(), table.column("text")
        out: list[tuple[int, int]] = []
        for rows, near, label in _compared(table, similarity):
            sets = [np.unique(shingle_hashes(texts[int(r)].as_py(), size)) for r in rows]
            for k, to in near:
                for j in to.tolist():
                    if label[j] != label[k]:
                        both = len(np.intersect1d(sets[k], sets[j], assume_unique=True))
                        if both >= similarity * (len(sets[k]) + len(sets[j]) - both) - 1e-9:
                            out.append((int(root[rows[k]]), int(root[rows[j]])))
                            label[label == label[j]] = label[k]
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return _cells(members, "c", MEET // 2, buckets).groupBy("bucket").applyInArrow(compare, "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """The rows of pairs(a, b, ...) whose texts(node, text) have the Jaccard similarity of shingle sets, by counting."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            release()
            last: dict[bytes, np.ndarray] = {}
            stay = []
            for x, y in zip(as_bytes(b.column("x")), as_bytes(b.column("y")), strict=True):
                for raw in (x, y):
                    if raw not in last:
                        if len(last) >= 256:
                            last.pop(next(iter(last)))
                        last[raw] = np.unique(shingle_hashes(raw, size))
                p, q = last.get(x), last[y]
                p = np.unique(shingle_hashes(x, size)) if p is None else p
                both = len(np.intersect1d(p, q, assume_unique=True))
                stay.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield b.select(names).filter(pa.array(stay, pa.bool_()))

    names = pairs.columns
    found = pairs.join(texts.toDF("a", "x"), "a").join(texts.toDF("b", "y"), "b").select(*names, "x", "y")
    return found.mapInArrow(rows, pairs.schema)


def _joined(own: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(node, root) of all nodes of own, after edges(a, b) between roots of names(node, root), or between nodes."""
    root = components(edges).toDF("root", "further")
    before = own.select("node", F.col("node").alias("root")) if names is None else names
    return cut(before.join(root, "root", "left").select("node", F.coalesce("further", "root").alias("root")))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, but one of each group of copies and near copies: that of the
    smallest id (null last); of repeated rows one stays.

    Groups are what links connect, a link being a Jaccard similarity of shingle sets of the given or
    more: every such link counts, and no other. Fingerprints propose links first, which join most
    copies; then all pairs that share a prefix and are not joined yet are compared. Each link is verified by its
    shingles. Texts are shuffled once without their copies, then as compressed chunks; of what is to be verified each
    text is fetched out of its chunk.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    h = F.xxhash64(text)
    # a shingle a word, six bytes a word
    buckets = max(parts(spark), ((docs.agg(F.sum(F.octet_length(text))).first()[0] or 0) // 6) // PER_BUCKET + 1)
    slim = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), h.alias("h")))
    texts = docs.select(text.alias("text")).distinct().select(F.xxhash64("text").alias("h"), "text")
    seen = written(survey(texts, size, buckets), "simhash-survey")
    print_ = seen.where("kind = 0").select("h", "node", "n", "lanes", "chunk")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h"))
    own = written(slim.join(print_, "h").groupBy("node").agg(F.first("lanes").alias("lanes"), F.first("n").alias("n"), F.min("chunk").alias("chunk"), first.alias("first")), "simhash-nodes")

    def texts_of(nodes: DataFrame) -> DataFrame:
        return written(fetched(nodes.join(own.select("node", "chunk"), "node"), seen), "simhash-texts")

    # one proposal a text: it joins most copies, and what it leaves apart the groups hold too
    some = cut(similar_links(own, similarity).groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    held = texts_of(some.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    small_batches(spark)
    names = _joined(own, cut(verified(some, held, size, similarity)))
    groups = written(shared_prefixes(seen, size, similarity, buckets), "simhash-prefixes")
    known = own.select("node", "n", "lanes").join(names, "node")
    # what may be similar still is cut into clusters, of which each text is fetched once and compared in place
    near = cut(components(suspects(groups.join(known, "node"), similarity)).toDF("node", "c"))
    count = near.count()
    if count:
        met = groups.select("node", "met").distinct()
        members = near.join(known, "node").join(met, "node").join(texts_of(near.select("node")), "node")
        names = _joined(own, cut(proven(members, size, similarity, max(parts(spark), count // MEET + 1))), names)
    group = own.join(names, "node").groupBy("root").agg(F.min("first").alias("first"))
    stay = written(group.select(F.col("first.doc_id").alias("__id"), F.col("first.h").alias("__h")), "simhash-stay")
    small_batches(spark)
    kept = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (h == F.col("__h")), "left_semi")
    repeated = slim.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        kept = kept.withColumn("__h", h).dropDuplicates([id_col, "__h"]).drop("__h")
    return kept
