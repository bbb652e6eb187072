"""Cross-tokenizer alignment by ``merge_asof``.

Two tokenizers cut the same bytes (a blank and the text). The documents of a batch lie end to
end, so a byte place is also the document's key; for each token start of one side
``pandas.merge_asof`` finds the other side's token that covers it. The union of both directions
is every pair of tokens that overlap: a link. Bytes where tokens of both sides end cut a
document into groups.

How often an id pair is linked in the corpus takes three steps. A task adds up the pairs of a
chunk of documents, about ``CHUNK_BYTES`` of text; the counts of the chunks are summed by pair;
and each chunk gets back the totals of its own pairs only, to add them up for its documents. So
what is shuffled is pairs of chunks, not of tokens, and no task holds more than a chunk. No
total is broadcast: how many pairs there are grows with the corpus.

NULL and empty texts have no tokens, nor have texts whose bytes a side does not give back
(U+2581 in a text becomes a blank); all their numbers are zero and their groups empty. Every
row is aligned by itself; repeated rows and ids count once each. Other columns are left behind.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tracktally.llm.common import chunks, exact, saved, slices, texts_of

#: Text of a chunk, whose pairs are summed before they are shuffled.
CHUNK_BYTES = 4_000_000
#: Characters aligned at once.
STEP_CHARS = 250_000
#: An id pair is one number: the ids have at most so many bits.
ID_BITS = 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_level_side(data: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of texts and the bytes of each id, from a tokenizer file's content."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    model = tokenizers.Tokenizer.from_str(data)
    model.encode_special_tokens = True
    letters = byte_letters()
    names = {i: t for t, i in model.get_vocab(with_added_tokens=False).items()}
    spelled = [bytes(letters[c] for c in t) if all(c in letters for c in t) else b"" for t in (names.get(i, "") for i in range(max(names) + 1))]
    return lambda texts: [x.ids for x in model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)], spelled


def piece_side(data: bytes) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """The same for a piece model, which puts a blank before a text itself."""
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    spelled = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        spelled.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode())
    return lambda texts: model.encode(texts, num_threads=1), spelled


def lists(flat: pa.Array, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), flat)


def offsets_of(sizes: Sequence[int] | np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(np.asarray(sizes, np.int64))].astype(np.int64)


def covering(starts: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each start the number of the other side's token that covers it."""
    left = pd.DataFrame({"at": starts})
    right = pd.DataFrame({"at": others, "token": np.arange(len(others))})
    return pd.merge_asof(left, right, on="at")["token"].to_numpy()


def links(a_start: np.ndarray, b_start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers of all overlapping pairs; those that start together are met in both directions."""
    if not len(a_start) or not len(b_start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of_a, of_b = covering(a_start, b_start), covering(b_start, a_start)
    later = np.flatnonzero(a_start[of_b] < b_start)
    return np.r_[np.arange(len(a_start)), of_b[later]], np.r_[of_a, later]


class Aligner:
    """Both sides of an alignment and their tables; one for each worker."""

    def __init__(self, a: str, b: bytes):
        (self.a, a_bytes), (self.b, b_bytes) = byte_level_side(a), piece_side(b)
        self.sides = [(pa.array(s, pa.binary()), np.array([len(x) for x in s], np.int64)) for s in (a_bytes, b_bytes)]
        self.base = max(len(a_bytes), len(b_bytes))
        if self.base > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")
        self.spelled = pa.array([f"{i}{end}" for end in (",", "|", ";") for i in range(self.base)])

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids and document offsets of both sides; documents not given back have none."""
        made, fits = [], np.array([bool(t) for t in texts])
        whole = pa.array([b" " + t.encode() for t in texts], pa.binary())
        for encode, (vocabulary, _) in zip((self.a, self.b), self.sides, strict=True):
            coded = encode(texts)
            ends = offsets_of([len(x) for x in coded])
            ids = np.fromiter(chain.from_iterable(coded), np.int64, int(ends[-1]))
            given = pc.binary_join(lists(vocabulary.take(pa.array(ids)), ends), b"")
            fits &= pc.equal(given, whole).to_numpy(zero_copy_only=False)
            made.append((ids, ends))
        kept = []
        for ids, ends in made:
            sizes = np.diff(ends)
            kept.append((ids[np.repeat(fits, sizes)], offsets_of(np.where(fits, sizes, 0))))
        return kept

    def align(self, texts: list[str]) -> dict[str, list]:
        """Columns of the documents, and the distinct id pairs of each with their numbers."""
        n = len(texts)
        (a, a_at), (b, b_at) = self.tokens(texts)
        a_end, b_end = np.cumsum(self.sides[0][1][a]), np.cumsum(self.sides[1][1][b])
        x, y = links(a_end - self.sides[0][1][a], b_end - self.sides[1][1][b])
        near = b_end[np.minimum(np.searchsorted(b_end, a_end), len(b_end) - 1)] if len(b_end) else b_end
        cuts = a_end[near == a_end]
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        n_groups = np.bincount(np.searchsorted(a_at, np.searchsorted(a_end, cuts), "right") - 1, minlength=n)[:n] if len(cuts) else np.zeros(n, int)
        # groups spelled out: each side's ids of a group stand together, a before b
        order = np.full(len(a) + len(b), 0, np.int64)
        a_place = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")
        b_place = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
        order[a_place] = a + self.base * (cuts[a_group] == a_end)
        order[b_place] = b + 2 * self.base * (cuts[b_group] == b_end)
        spelled = pc.binary_join(lists(self.spelled.take(pa.array(order)), a_at + b_at), "").to_pylist()
        # links of each document by id pair
        doc = np.searchsorted(a_at, x, "right") - 1
        pair = (doc << 2 * ID_BITS) | (a[x] << ID_BITS) | b[y]
        pair, times = np.unique(pair, return_counts=True)
        owner = pair >> 2 * ID_BITS
        at = np.searchsorted(owner, np.arange(n + 1))
        return {
            "n_a": np.diff(a_at),
            "n_b": np.diff(b_at),
            "n_groups": n_groups,
            "n_links": np.bincount(doc, minlength=n)[:n],
            "groups_sha256": [hashlib.sha256(s[:-1].encode()).hexdigest() if s else "" for s in spelled],
            "pairs": lists(pa.array(pair & ((1 << 2 * ID_BITS) - 1)), at),
            "times": lists(pa.array(times.astype(np.int32)), at),
        }


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
CODED = "chunk long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def aligned(docs: DataFrame, a_path: str, b_path: str, chunk: int) -> DataFrame:
    """``id`` and the columns of `CODED`; documents of one chunk have its number."""
    schema = T.StructType([docs.schema["id"], *T.StructType.fromDDL(CODED)])
    arrow = to_arrow_schema(schema)
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        # two vocabularies; a worker keeps the value from task to task, and so the aligner put in here
        shared = docs.sparkSession.sparkContext.broadcast((a.read(), b.read(), []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, made_before = shared.value
        if not made_before:
            made_before.append(Aligner(a, b))
        aligner = made_before[0]
        number, size = TaskContext.get().partitionId() << 32, 0
        for batch in slices(batches):
            texts = texts_of(batch.column(1))
            for start, end in chunks([len(t) for t in texts], STEP_CHARS):
                part = texts[start:end]
                made = aligner.align(part)
                if size > chunk:
                    number, size = number + 1, 0
                size += sum(map(len, part))
                columns = {"id": batch.column(0).slice(start, end - start), "chunk": [number] * (end - start), **made}
                arrays = [columns[f.name] for f in arrow]
                arrays = [x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(arrays, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow, strict=True)], schema=arrow)

    return docs.mapInArrow(run, schema)


def pair_totals(by_chunk: DataFrame) -> DataFrame:
    """``pair, total, best``: links of a pair in the corpus; whether no other pair of its b id has more."""
    totals = by_chunk.groupBy("pair").agg(F.sum("times").alias("total"))
    of_b = Window.partitionBy(F.col("pair").bitwiseAND((1 << ID_BITS) - 1))  # as many rows as ids at most
    return totals.withColumn("best", F.col("total") == F.max("total").over(of_b))


def align_tokenizers(
    docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text", chunk: int = CHUNK_BYTES
) -> DataFrame:
    """One row a document: ``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` are its links whose pair is linked as often in the corpus as any pair of the same
    b id, ``count_sum`` adds the corpus counts of its links' pairs.
    """
    coded = saved(aligned(docs.select(exact(id).alias("id"), exact(text).alias("text")), a_path, b_path, chunk), "align-coded")
    each = coded.select("chunk", "times", F.posexplode("pairs").alias("at", "pair"))
    by_chunk = saved(each.groupBy("chunk", "pair").agg(F.sum(F.get("times", "at")).alias("times")), "align-pairs")
    known = by_chunk.select("chunk", "pair").join(pair_totals(by_chunk), "pair")
    schema = T.StructType(
        [coded.schema["id"], *(T.StructField(c, T.LongType()) for c in (*COUNTS, "n_best", "count_sum")), T.StructField("groups_sha256", T.StringType())]
    )
    arrow = to_arrow_schema(schema)

    def add_up(rows: pa.Table, totals: pa.Table) -> pa.Table:
        pair = totals["pair"].to_numpy()
        order = np.argsort(pair)
        pair, total, best = pair[order], totals["total"].to_numpy()[order], totals["best"].to_numpy()[order]
        sizes = pc.list_value_length(rows["pairs"]).to_numpy()
        owner = np.repeat(np.arange(len(rows)), sizes)
        at = np.searchsorted(pair, pc.list_flatten(rows["pairs"]).to_numpy())
        times = pc.list_flatten(rows["times"]).to_numpy().astype(np.int64)
        sums = np.zeros((2, len(rows)), np.int64)
        if len(at):
            np.add.at(sums[0], owner, times * best[at])
            np.add.at(sums[1], owner, times * total[at])
        return pa.table([rows["id"], *(rows[c] for c in COUNTS), pa.array(sums[0]), pa.array(sums[1]), rows["groups_sha256"]], schema=arrow)

    done = coded.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(add_up, schema)
    return done.withColumnRenamed("id", id)
