"""Token-ID output (operator 2): documents as packed rows of token ids.

Texts are encoded by a public byte-level BPE, each document ended by one end token. Documents
longer than a row are cut into whole rows and a rest, losing nothing. Pieces are packed by
best-fit decreasing: the longest first, each into the row with the least room that takes it,
found in a segment tree over capacities. A packed row is one row of the id matrix: its ids
(padded), the cumulative segment lengths, the places where positions start again, and for each
segment its document and the token offset in it.

Packing is local to a stretch of a scan task's documents, bounded in tokens and pieces, so
nothing is shuffled and a lost task is redone alone; a few thousand pieces fill rows almost fully. So which documents
share a row follows from how files are cut into tasks: a run over the same files and settings gives the same rows, one
over files cut otherwise packs the same tokens into other rows.

Defined results: null and empty texts are documents of the end token alone; null ids are kept as
null; repeated rows are packed as often as they stand; very long texts become many pieces; ties in
size keep the order of documents; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import small_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LENGTH = 2048
#: Bounds of a stretch: tokens (2 bytes each, 4 if the vocabulary is large) and pieces.
STRETCH_TOKENS = 4 << 20
STRETCH_PIECES = 16_384
#: The vocabulary is sent to the tasks; a larger file is refused.
MAX_VOCABULARY_BYTES = 64 << 20

_encodings: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The encoding of a rank file, built once a process."""
    key = hashlib.sha256(vocabulary).hexdigest()
    if key not in _encodings:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding(key, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


class Capacities:
    """Open rows by room left, with the least sufficient room found in a segment tree over rooms."""

    def __init__(self, length: int) -> None:
        self.size = 1 << length.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        at = room + self.size
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of a row with the least room of at least need, taken out; None: there is none."""
        count, at = self.count, need + self.size
        if not count[at]:
            # up to the first right-hand neighbour that holds rows, then down its left-most path
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.size
        while at:
            count[at] -= 1
            at >>= 1
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of indices of sizes (each from 1 to length); equal sizes keep their order."""
    open_, rows = Capacities(length), []
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        found = open_.take(sizes[k])
        if found is None:
            room, row = length, len(rows)
            rows.append([])
        else:
            room, row = found
        rows[row].append(k)
        if room > sizes[k]:
            open_.put(room - sizes[k], row)
    return rows


SCHEMA = "doc_ids array<long>, doc_starts array<long>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, input_ids binary"
_SCHEMA = pa.schema({"doc_ids": pa.list_(pa.int64()), "doc_starts": pa.list_(pa.int64()), "cu_seqlens": pa.list_(pa.int32()), "position_resets": pa.list_(pa.int32()), "n_tokens": pa.int32(), "input_ids": pa.binary()})


def _pack(docs: list[tuple[int | None, np.ndarray]], length: int, pad: int) -> pa.RecordBatch:
    pieces = [(i, at, x[at : at + length]) for i, x in docs for at in range(0, len(x), length)]
    out: list[dict[str, Any]] = []
    for row in best_fit_decreasing([len(p[2]) for p in pieces], length):
        ids = np.concatenate([pieces[k][2] for k in row])
        ends = np.cumsum([0, *(len(pieces[k][2]) for k in row)])
        resets = ends if ends[-1] < length else ends[:-1]  # the padding is a segment for positions
        padded = np.concatenate((ids, np.full(length - len(ids), pad, ids.dtype)))
        out.append({"doc_ids": [pieces[k][0] for k in row], "doc_starts": [pieces[k][1] for k in row], "cu_seqlens": ends.tolist(), "position_resets": resets.tolist(), "n_tokens": len(ids), "input_ids": padded.tobytes()})
    return pa.RecordBatch.from_pylist(out, _SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", end: int | None = None) -> DataFrame:
    """SCHEMA, a packed row each; input_ids holds `length` little-endian ids of 2 bytes (4 for a vocabulary
    above 65,536). end: the end and padding token, by default the first free id."""
    small_batches(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        vocabulary = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(vocabulary) > MAX_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is larger than what may be sent to every task")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(sent.value)
        stop = enc.n_vocab if end is None else end
        kind = np.dtype("<u2") if max(stop, enc.n_vocab) < 1 << 16 else np.dtype("<u4")
        stretch: list[tuple[int | None, np.ndarray]] = []
        tokens = pieces = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.array([*enc.encode_ordinary(text or ""), stop], kind)
                stretch.append((i, x))
                tokens += len(x)
                pieces += -(-len(x) // length)
                if tokens >= STRETCH_TOKENS or pieces >= STRETCH_PIECES:
                    yield _pack(stretch, length, stop)
                    stretch, tokens, pieces = [], 0, 0
        if stretch:
            yield _pack(stretch, length, stop)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(rows, SCHEMA)


def positions(cu_seqlens: list[int], length: int = LENGTH) -> np.ndarray:
    """Position ids of a row: from 0 in each segment, and in the padding."""
    edges = [*cu_seqlens, length] if cu_seqlens[-1] < length else cu_seqlens
    return np.concatenate([np.arange(b - a) for a, b in zip(edges, edges[1:], strict=False)])


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet: the id matrix is the column input_ids, a row each."""
    packed.write.parquet(path)
