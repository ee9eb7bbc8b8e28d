"""Harmonic packing of tokenised documents into sequences of at most ``capacity`` tokens.

Lengths fall into reciprocal-capacity classes: class k holds pieces of at most
``capacity / k`` tokens and more than ``capacity / (k + 1)``, and each of its bins is closed
with exactly k pieces. A document gives whole sequences first; its rest is cut
into the longest piece of exactly ``capacity // k`` tokens that fits, again and
again until less than ``least_piece`` is left, so full bins have little padding.
Every task packs its own rows, without a shuffle: its classes have bounded
room, and what its bins hold at the end is run together into whole sequences.

Null or empty texts give the end id alone. Null ids stay null, repeated rows
are packed each. No rows give no pieces.
"""

from __future__ import annotations

import base64
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import text_of

SCHEMA = ("id long, start long, length long, ids binary, doc_tokens long, "
          "sequence_id long, offset long")
SPECIAL = "<|endoftext|>"


def byte_bpe(ranks_path: str | None = None):
    """text -> ids, the same as the tokenizers library gives for this vocabulary.

    ``ranks_path``: the vocabulary as ranks (default: the installed byte_bpe_50k.tiktoken).
    """
    import public_tokenizers
    import tiktoken

    with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                 special_tokens={SPECIAL: len(ranks)})
    return lambda text: (encoding.encode(text, allowed_special="all") if SPECIAL in text
                         else encoding.encode_ordinary(text))


def cuts(rest: int, capacity: int, least_piece: int) -> list[tuple[int, int]]:
    """(class, length) of the pieces of ``rest`` < ``capacity`` tokens."""
    out = []
    while rest:
        if rest < least_piece:
            out.append((capacity // rest, rest))
            break
        k = -(-capacity // rest)  # the longest capacity // k that fits
        out.append((k, capacity // k))
        rest -= capacity // k
    return out


class Packer:
    """Bins of one task; ``add`` and ``close`` yield rows in the order of ``SCHEMA``."""

    def __init__(self, capacity: int, least_piece: int, first: int):
        self.capacity, self.least_piece, self.next = capacity, least_piece, first
        self.open = defaultdict(list)

    def _sequence(self, pieces):
        at, number = 0, self.next
        self.next += 1
        for doc, start, ids, total in pieces:
            yield doc, start, len(ids), ids.tobytes(), total, number, at
            at += len(ids)

    def add(self, doc, ids: np.ndarray):
        total = len(ids)
        whole = total - total % self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._sequence([(doc, start, ids[start:start + self.capacity], total)])
        start = whole
        for k, n in cuts(total - whole, self.capacity, self.least_piece):
            self.open[k].append((doc, start, ids[start:start + n].copy(), total))
            start += n
            if len(self.open[k]) == k:
                yield from self._sequence(self.open.pop(k))

    def close(self):
        held, room = [], self.capacity
        for k in sorted(self.open):
            for doc, start, ids, total in self.open[k]:
                while len(ids):
                    held.append((doc, start, ids[:room], total))
                    start, ids, room = start + len(ids[:room]), ids[room:], room - len(ids[:room])
                    if not room:
                        yield from self._sequence(held)
                        held, room = [], self.capacity
        if held:
            yield from self._sequence(held)
        self.open.clear()


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024,
         least_piece: int = 32, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: ``id_col``, start, length, ids (little-endian uint32), doc_tokens,
    sequence_id (task number and a count), offset."""
    def rows(batches):
        encode = byte_bpe(ranks_path)
        packer = Packer(capacity, least_piece, TaskContext.get().partitionId() << 32)
        schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                            ("sequence_id", pa.int64()), ("offset", pa.int64())])

        def batch(out):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=f.type) for c, f in zip(zip(*out), schema)], schema=schema)

        out, held = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.array(encode(text.as_py()) + [end_id], dtype="<u4")
                out.extend(packer.add(doc, ids))
                held += len(ids)
                if held > 2_000_000:
                    if out:
                        yield batch(out)
                    out, held = [], 0
        out.extend(packer.close())
        if out:
            yield batch(out)

    packed = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    return packed.mapInArrow(rows, SCHEMA).withColumnRenamed("id", id_col)
