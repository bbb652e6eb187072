"""Byte-level BPE by a rank queue, and decoding.

A text is split by a pattern and each piece is merged alone: always the pair of the lowest
rank, the leftmost first. The pairs wait in buckets by rank. A hierarchical bitmap marks the
ranks that have a bucket, and find-first-set on its two levels gives the next one. Buckets
are heaps of positions in a linked list of parts; a position whose rank has changed since it
was put there is stale and skipped. Work is n log n in the piece, however long it is.

Merged pieces are remembered by each worker, up to ``CACHE_PIECES``. NULL text counts as
empty: no ids, an empty decoding. Rows are independent of each other.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from tracktally.llm.common import add_columns, chunks, texts_of

#: Pieces that a worker remembers and their longest length; bounds its memory.
CACHE_PIECES = 500_000
CACHE_CHARS = 48
#: A node of the bitmap holds so many bits.
NODE_BITS = 8
NODE_MASK = (1 << NODE_BITS) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: base64 of the token, a blank, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece.

    The two levels of the bitmap lead to the lowest rank that has a bucket, and the bucket, a
    heap of positions in the linked list, to the leftmost of them.
    """
    n = len(piece)
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    find = ranks.get
    parts: list = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rank_at = [find(piece[i : i + 2]) for i in range(n)]
    rank_at[-1] = None
    buckets: dict[int, list[int]] = {}
    nodes: dict[int, int] = {}
    top = 0
    for i, r in enumerate(rank_at):  # ascending positions are a heap already
        if r is not None:
            if r in buckets:
                buckets[r].append(i)
            else:
                buckets[r] = [i]
                h = r >> NODE_BITS
                nodes[h] = nodes.get(h, 0) | 1 << (r & NODE_MASK)
                top |= 1 << h
    while top:
        h = (top & -top).bit_length() - 1
        node = nodes[h]
        r = h << NODE_BITS | (node & -node).bit_length() - 1
        bucket = buckets[r]
        i = heappop(bucket)
        if not bucket:
            del buckets[r]
            if node := node & (node - 1):
                nodes[h] = node
            else:
                del nodes[h]
                top &= top - 1
        if rank_at[i] != r:
            continue  # stale
        j = after[i]
        joined = parts[i] + parts[j]
        parts[i], parts[j], rank_at[j] = joined, None, None
        k = after[i] = after[j]
        changed = ()
        if k < n:
            before[k] = i
            new = rank_at[i] = find(joined + parts[k])
            if new is not None:
                changed = ((i, new),)
        else:
            rank_at[i] = None
        p = before[i]
        if p >= 0:
            new = rank_at[p] = find(parts[p] + joined)
            if new is not None:
                changed = (*changed, (p, new))
        for i, r in changed:
            if r in buckets:
                heappush(buckets[r], i)
            else:
                buckets[r] = [i]
                h = r >> NODE_BITS
                nodes[h] = nodes.get(h, 0) | 1 << (r & NODE_MASK)
                top |= 1 << h
    return [ranks[x] for x in parts if x is not None]


def packed_ids(text: str, find, ranks: dict[bytes, int], known: dict[str, bytes]) -> bytes:
    """Ids of a text as 32-bit numbers; ``known`` remembers pieces."""
    pieces = find(text)
    try:
        return b"".join(map(known.__getitem__, pieces))
    except KeyError:
        made = []
        for piece in pieces:
            if (ids := known.get(piece)) is None:
                ids = array("i", merge_piece(piece.encode(), ranks)).tobytes()
                if len(piece) <= CACHE_CHARS and len(known) < CACHE_PIECES:
                    known[piece] = ids
            made.append(ids)
        return b"".join(made)


def encoding(ranks: dict[bytes, int], known: dict[str, bytes], pattern: str) -> Callable[[pa.Array], pa.Array]:
    find = regex.compile(pattern).findall

    def run(column: pa.Array) -> pa.Array:
        packed = [packed_ids(t, find, ranks, known) for t in texts_of(column)]
        offsets = np.zeros(len(packed) + 1, np.int32)
        np.cumsum([len(p) >> 2 for p in packed], out=offsets[1:])
        values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
        return pa.ListArray.from_arrays(pa.array(offsets), values)

    return run


def decoding(tokens: list[bytes | None]) -> Callable[[pa.Array], pa.Array]:
    vocabulary = pa.array(tokens, pa.binary())

    def run(column: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(column), 0).to_pylist()
        made = []
        for start, end in chunks(counts):
            spelled = vocabulary.take(pc.list_flatten(column.slice(start, end - start)))
            offsets = np.zeros(end - start + 1, np.int32)
            np.cumsum(counts[start:end], out=offsets[1:])
            made.append(pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), spelled), b""))
        return pa.concat_arrays(made) if made else pa.array([], pa.binary())

    return run


def token_list(ranks: dict[bytes, int]) -> list[bytes | None]:
    """The token of each id; None where no token has it."""
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return tokens


def encode_bpe(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None
) -> DataFrame:
    """Each row with ``ids``, an int array, and with ``decoded`` what these ids decode to.

    Columns of these names are replaced. The rank file is read once on the driver (its size
    is that of one vocabulary) and broadcast, so executors need no copy of it. Decoding in
    the same pass spares a second Python worker beside each task.
    """
    # a worker keeps a broadcast value from task to task, and so the pieces put in here
    shared = docs.sparkSession.sparkContext.broadcast((load_ranks(path), {}))

    def make():
        ranks, known = shared.value
        encode = encoding(ranks, known, pattern)
        if decoded is None:
            return lambda column: [encode(column)]
        decode = decoding(token_list(ranks))

        def run(column):
            made = encode(column)
            return [made, decode(made)]

        return run

    return add_columns(docs, [text], f"`{ids}` array<int>" + (f", `{decoded}` binary" if decoded else ""), make)


def decode_bpe(rows: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Each row with ``decoded``, the bytes of its ids; NULL ids decode to no bytes.

    An id outside the vocabulary fails the job.
    """
    shared = rows.sparkSession.sparkContext.broadcast(token_list(load_ranks(path)))

    def make():
        decode = decoding(shared.value)
        return lambda column: [decode(column)]

    return add_columns(rows, [ids], f"`{decoded}` binary", make)
