"""Exact removal of repeated word windows, dealt out as super-k-mers.

A window is ``width`` consecutive words. Its minimiser is the ``gram``-word gram
with the least hash inside it; neighbouring windows mostly share it, and a run
of windows that do travels as one packed string (a super-k-mer) to the bucket
of the minimiser. Equal windows have equal minimisers, so each bucket sees all
occurrences of its windows; it sorts them and finds, exactly, every window that
also starts in a document with a smaller id.

Before it sends anything, a task drops windows it can already tell are repeated
(they occur in a smaller document of its own rows), so a hot passage travels at
most once from each chunk of rows. Sorting goes by a 64-bit hash, and equality
is always checked word by word. Strings are packed per bucket: the words once,
then their numbers, compressed.

A bucket is held by one task, so neither all of them nor one minimiser may fill it: their
number follows the number of windows, and a minimiser with more windows than ``HOT`` (a passage
that a third of the documents share, each with other words around it) sends its windows one by
one to as many buckets as it takes, by (minimiser, window hash). Equal windows still meet. Both
numbers are estimated on one document in ``SAMPLE``, chosen by a hash; they decide where
windows go and never what is found.

Words: ``[^\\x20\\x09-\\x0D]+``, unchanged. Null and empty texts have no words.
A null id is smaller than any other; rows with equal ids never remove words
from each other. Texts shorter than ``width`` words keep all their words.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import (
    NULL_ID, ids_of, text_of, write_table,
)
from playmetrics.llm.minimisers import Minimisers, _MIX, mixed, sized

#: Words that a task gathers before it packs them.
CHUNK_WORDS = 2_000_000
#: Windows of one minimiser, and of one bucket, that are about as many as a task should hold.
HOT, BUCKET_WINDOWS = 200_000, 1_000_000
#: One document in so many is looked at before, to size the buckets.
SAMPLE = 32
_UNMIX = np.uint64(pow(int(_MIX), -1, 1 << 64))


class Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` values, from running sums; wraps on purpose."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(len(h), r, np.uint64))))
                for r in (_MIX, _UNMIX))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * down[:-1], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * up[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def repeated(ids: np.ndarray, at: np.ndarray, docs: np.ndarray, hashes: np.ndarray,
             width: int) -> np.ndarray:
    """Mask over windows starting at ``at``: also starts in a smaller doc.

    ``docs`` (of each window) ascends. Equal hashes are checked word by word; windows that
    differ from the first of their hash are gone through again on their own.
    """
    out = np.zeros(len(at), bool)
    open_ = np.arange(len(at))
    while len(open_):
        order = open_[np.argsort(hashes[open_], kind="stable")]
        h = hashes[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        order, first = order[~new], first[~new]
        same = np.ones(len(order), bool)
        for j in range(width):
            same &= ids[at[order] + j] == ids[at[first] + j]
        out[order[same]] = docs[order[same]] > docs[first[same]]
        open_ = np.sort(order[~same])
    return out


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Concatenated ranges start..start+len."""
    ends = np.cumsum(lens)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)


def runs_of(flag: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, length) of runs of true ``flag``; ``joined[i]``: i may go on from i - 1."""
    before = np.concatenate(([False], flag[:-1])) & joined
    starts = np.flatnonzero(flag & ~before)
    after = np.concatenate((flag[1:] & joined[1:], [False]))
    return starts, np.flatnonzero(flag & ~after) - starts + 1


def packed(words: list[bytes], ids: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray,
           hashes: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> bytes:
    """Words once, documents once, and for each string its document, start and windows."""
    used, numbers = np.unique(ids, return_inverse=True)
    text = b" ".join([words[i] for i in used.tolist()])
    kind = np.uint16 if len(used) <= 1 << 16 else np.uint32
    some, number = np.unique(docs, return_inverse=True)
    parts = [text, numbers.astype(kind).tobytes(), doc_ids[some].tobytes(), hashes[some].tobytes(),
             number.astype(np.int32).tobytes(), starts.astype(np.int64).tobytes(),
             counts.astype(np.int32).tobytes()]
    raw = struct.pack("<qqqq", len(text), len(ids), len(some), len(docs)) + (
        b"2" if kind == np.uint16 else b"4") + b"".join(parts)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpacked(blob: bytes):
    """Words, word numbers, and for each string: document id, text hash, start, windows."""
    raw = pa.Codec("zstd").decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)
    n_text, n_ids, n_docs, n_rows = struct.unpack("<qqqq", raw[:32])
    kind, at = (np.uint16 if raw[32:33] == b"2" else np.uint32), 33
    words = raw[at:at + n_text].split(b" ")
    at += n_text
    out = []
    for dtype, n in ((kind, n_ids), (np.int64, n_docs), (np.int64, n_docs), (np.int32, n_rows),
                     (np.int64, n_rows), (np.int32, n_rows)):
        out.append(np.frombuffer(raw, dtype, n, at))
        at += out[-1].nbytes
    ids, doc_ids, hashes, number, starts, counts = out
    return words, ids.astype(np.int32), [doc_ids[number], hashes[number], starts,
                                         counts.astype(np.int64)]


def _chunk(docs, width: int, gram: int, to: Minimisers | None):
    """docs: [(id, text hash, word numbers)], and the words; yields (bucket, kind, payload).

    Without ``to``: (minimiser, windows to be sent)."""
    import xxhash

    docs, words = docs
    docs = sorted(docs, key=lambda d: d[0])
    ids = np.concatenate([d[2] for d in docs])
    lens = np.array([len(d[2]) for d in docs])
    doc = np.repeat(np.arange(len(docs)), lens)
    begin = np.cumsum(lens) - lens
    n = len(ids) - width + 1
    if n <= 0:
        return
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))[ids]
    inside = doc[:n] == doc[width - 1:]
    least = sliding_min(window_hashes(h, gram), width - gram + 1)
    at = np.flatnonzero(inside)
    doc_ids = np.array([d[0] for d in docs], dtype=np.int64)
    hashes = np.array([d[1] for d in docs], dtype=np.int64)
    gone = np.zeros(n, bool)
    whole = window_hashes(h, width)
    gone[at] = repeated(ids, at, doc_ids[doc[at]], whole[at], width)
    if to is None:
        yield from zip(*(x.tolist() for x in np.unique(
            least[inside & ~gone].view(np.int64), return_counts=True)))
        return
    buckets = to.buckets

    next_to = np.concatenate(([False], doc[1:n] == doc[:n - 1]))
    starts, count = runs_of(gone, next_to)
    if len(starts):
        d = doc[starts]
        a = starts - begin[d]
        yield int(mixed(np.array([starts[0]]))[0] % np.uint64(buckets)), 1, b"".join(
            c.astype(np.int64).tobytes() for c in (doc_ids[d], hashes[d], a, a + count + width - 1))
    same = next_to & np.concatenate(([False], least[1:] == least[:-1]))
    which = to.hot(least)
    starts, count = runs_of(inside & ~gone & (which < 0), same)
    bucket = to.bucket(least[starts])
    alone = np.flatnonzero(inside & ~gone & (which >= 0))
    if len(alone):
        starts, count = np.concatenate((starts, alone)), np.concatenate((count, np.ones(len(alone), count.dtype)))
        bucket = np.concatenate((bucket, to.dealt(least[alone], which[alone], whole[alone])))
    if not len(starts):
        return
    order = np.argsort(bucket, kind="stable")
    starts, count, bucket = starts[order], count[order], bucket[order]
    d = doc[starts]
    edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
    for a, z in zip(edges[:-1], edges[1:]):
        part = ids[ragged(starts[a:z], count[a:z] + width - 1)]
        yield int(bucket[a]), 0, packed(words, part, d[a:z], doc_ids, hashes,
                                        starts[a:z] - begin[d[a:z]], count[a:z])


def _super_kmers(width: int, gram: int, to: Minimisers | None, chunk_words: int):
    def run(batches):
        docs, number, held, seen = [], Numbers(), 0, set()

        def flush():
            rows = list(_chunk((docs, list(number)), width, gram, to))
            docs.clear(), number.clear(), seen.clear()
            if rows and to is None:
                least, n = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(least, pa.int64()), pa.array(n, pa.int64())], ["least", "n"])
            elif rows:
                b, k, p = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b, pa.int32()), pa.array(k, pa.int8()), pa.array(p, pa.binary())],
                    ["bucket", "kind", "payload"])

        for batch in batches:
            for key, h, text in zip(ids_of(batch.column(0)).tolist(), batch.column(1).to_pylist(),
                                    batch.column(2)):
                words = text.as_py().split()
                if len(words) < width or (key, h) in seen:
                    continue  # a repeated row fares like the first
                seen.add((key, h))
                docs.append((key, h, np.fromiter(map(number.__getitem__, words), np.int32,
                                                 len(words))))
                held += len(words)
                if held > chunk_words:
                    yield from flush()
                    held = 0
        if docs:
            yield from flush()

    return run


_REMOVED = "id long, h long, start long, end long"


def _sort_bucket(width: int):
    def run(table: pa.Table) -> pa.Table:
        found = [[], [], [], []]
        number, ids, columns = {}, [], []
        for kind, payload in zip(table.column("kind"), table.column("payload")):
            blob = payload.as_py()
            if kind.as_py() == 1:
                parts = np.frombuffer(blob, np.int64).reshape(4, -1)
                for f, p in zip(found, parts):
                    f.append(p)
                continue
            words, local, cols = unpacked(blob)
            ids.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32,
                                   len(words))[local])
            columns.append(cols)
        if ids:
            ids = np.concatenate(ids)
            doc, h, start, count = (np.concatenate(c) for c in zip(*columns))
            lens = count + width - 1
            first = np.cumsum(lens) - lens
            order = np.argsort(doc, kind="stable")
            doc, h, start, count, first = (x[order] for x in (doc, h, start, count, first))
            at = ragged(first, count)
            run_of = np.repeat(np.arange(len(count)), count)
            hashes = window_hashes(mixed(np.arange(1, len(number) + 1))[ids], width)
            gone = repeated(ids, at, doc[run_of], hashes[at], width)
            joined = np.concatenate(([False], run_of[1:] == run_of[:-1]))
            s, n = runs_of(gone, joined)
            r = run_of[s]
            a = start[r] + at[s] - first[r]
            for f, p in zip(found, (doc[r], h[r], a, a + n + width - 1)):
                f.append(p)
        return pa.table({k: pa.array(np.concatenate(f) if f else np.zeros(0, np.int64))
                         for k, f in zip(("id", "h", "start", "end"), found)})

    return run


def _sized(rows: DataFrame, width: int, gram: int, buckets: int | None,
           chunk_words: int) -> Minimisers:
    """Buckets for ``rows`` (id, h, text), from a sample of them."""
    def counted(some):
        return some.mapInArrow(_super_kmers(width, gram, None, chunk_words), "least long, n long")

    return sized(rows, counted, SAMPLE, HOT, BUCKET_WINDOWS, buckets)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, width: int = 13, gram: int = 4,
                   buckets: int | None = None, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """(id, h, start, end): words start to end - 1 of the document go; spans may overlap.

    ``h``: XXH64 of the text, so that rows with equal ids stay apart; a null id is ``NULL_ID``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col))
                       .alias("h"), text_of(text_col).cast("binary").alias("text"))
    to = _sized(rows, width, gram, buckets, chunk_words)
    sent = rows.mapInArrow(_super_kmers(width, gram, to, chunk_words),
                           "bucket int, kind byte, payload binary")
    return sent.groupBy("bucket").applyInArrow(_sort_bucket(width), _REMOVED)


def _cut(batches):
    for batch in batches:
        out = [[], [], []]
        for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
            words = text.as_py().split()
            out[0].append(len(words))
            if starts.is_valid:
                covered = np.zeros(len(words) + 1, np.int64)
                np.add.at(covered, starts.values.to_numpy(), 1)
                np.add.at(covered, ends.values.to_numpy(), -1)
                keep = (np.cumsum(covered[:-1]) == 0).tolist()
                kept = [w for w, k in zip(words, keep) if k]
            else:
                kept = words
            out[1].append(out[0][-1] - len(kept))
            out[2].append(b" ".join(kept))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
             pa.array(out[2], pa.binary()).cast(pa.string())],
            ["id", "n_words", "n_removed", "text"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 13, gram: int = 4, buckets: int | None = None,
                   chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: ``id_col``, n_words, n_removed, text (kept words, one space between)."""
    spans = write_table(repeated_spans(docs, id_col, text_col, width, gram, buckets, chunk_words),
                        "repeated-spans")
    spans = write_table(spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end"))
                        .alias("s")).select("id", "h", F.col("s.start").alias("starts"),
                                            F.col("s.end").alias("ends")), "repeated-by-document")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.xxhash64(text_of(text_col)).alias("h"),
                       text_of(text_col).cast("binary").alias("text"))
    out = rows.join(spans, ["id", "h"], "left").select("id", "text", "starts", "ends").mapInArrow(
        _cut, "id long, n_words long, n_removed long, text string")
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed(
        "id", id_col)
