"""Document likelihood over all segmentations into existing subword pieces.

The pieces and their ranks come from a public vocabulary file; nothing is added
to them. Each word (after a word mark) has a lattice of pieces, every character
also having its bytes; a forward recursion in log space sums all segmentations,
and a document's probability is the product over its words and its end. The
vocabulary's ranks give the first weights, and rounds of forward-backward
counts over the training words, made by Spark, re-estimate them.

Chunks of documents are stored once as word numbers. Their distinct words go,
dealt by hash, to buckets where each word is counted over the whole corpus and
scored once; each chunk gets the counts and scores of its own words back. So
what is shuffled follows distinct words per chunk, not running words, and no
vocabulary is ever gathered in one place.

The number of buckets follows the bytes of text, so that what one holds (its words, and the
number of each in every chunk that has it) stays bounded. Words of more than ``LONG`` characters
(encoded files, texts without spaces) go through the same recursion position by position, in
blocks, over the pieces that fit there: time and memory in proportion to their length.

Lower-cased A-Z; words ``[^\\x20\\x09-\\x0D]+``, then one end, a token too.
Training rows are those whose fold is not held out; a null id counts as empty
text there. Null texts are empty: only the end. Repeated rows count each.
"""

from __future__ import annotations

import math
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import (
    fold_number, ids_of, null_back, shuffle_partitions, text_of, write_table,
)

#: Running words that a chunk holds at least (its last document may go beyond).
CHUNK_WORDS = 2_000_000
#: Share of probability that the 256 byte pieces have together; it is not re-estimated.
BYTE_SHARE = 1e-3
MARK = "▁"
#: Words longer than this are done one at a time; matches are found for so many positions at once.
LONG, BLOCK = 2048, 65_536
#: Bytes of text for each bucket.
BUCKET_BYTES = 64 << 20
_R = np.uint64(0x9E3779B97F4A7C15)


def squeeze(*arrays) -> bytes:
    """Arrays or bytes, compressed together."""
    raw = b"".join(a if isinstance(a, bytes) else a.tobytes() for a in arrays)
    return struct.pack("<q", len(raw)) + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def unsqueeze(blob: bytes) -> bytes:
    return pa.Codec("zstd").decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)


class Pieces:
    """The existing pieces, with a hash table for each length; weights are set apart."""

    def __init__(self, model_path: str | None = None):
        import public_tokenizers
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(
            model_file=model_path or public_tokenizers.path("piece_bpe_32k.model"))
        self.size = sp.vocab_size()
        normal = [i for i in range(self.size)
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        text = {i: sp.id_to_piece(i) for i in normal}
        # pieces that only space runs would use cannot occur in a word
        normal = [i for i in normal if MARK not in text[i][1:]]
        self.end = self.size
        self.longest = max(len(text[i]) for i in normal)
        rank = {i: -sp.get_score(i) for i in normal}
        self.first = np.zeros(self.size + 1)
        for i in normal:
            self.first[i] = 1 / (1 + max(rank[i], 0))
        self.first[self.end] = self.first.max()
        self.first /= self.first.sum()
        self.tables, self.prefixes = [], []
        points = {i: np.frombuffer(text[i].encode("utf-32-le"), np.uint32).astype(np.uint64)
                  for i in normal}
        for n in range(1, self.longest + 1):
            some = [i for i in normal if len(points[i]) >= n]
            h = np.array([self.hash(points[i][:n]) for i in some], np.uint64)
            self.prefixes.append(np.unique(h))
            whole = [(x, i) for x, i in zip(h.tolist(), some) if len(points[i]) == n]
            whole.sort()
            self.tables.append((np.array([x for x, _ in whole], np.uint64),
                                np.array([i for _, i in whole], np.int64)))

    @staticmethod
    def hash(points) -> int:
        h = 0
        for p in points:
            h = (h * int(_R) + int(p) + 1) & (2 ** 64 - 1)
        return h

    def weights(self, shares: np.ndarray) -> np.ndarray:
        """Shares of pieces and end to log probabilities that leave ``BYTE_SHARE`` to the bytes."""
        with np.errstate(divide="ignore"):
            return np.log(shares * (1 - BYTE_SHARE))

    def edges(self, points: np.ndarray):
        """points: (words, n) code points. For each length a matrix of piece ids, -1: none."""
        m, n = points.shape
        out, h, live = [], np.zeros((m, n), np.uint64), np.ones((m, n), bool)
        for k in range(1, min(n, self.longest) + 1):
            h = h[:, :n - k + 1] * _R + points[:, k - 1:] + np.uint64(1)
            live = live[:, :n - k + 1]
            at = np.flatnonzero(live)
            if not len(at):
                break
            some = h.ravel()[at]
            found = np.full(m * (n - k + 1), -1, np.int64)
            table, ids = self.tables[k - 1]
            if len(table):
                i = np.minimum(np.searchsorted(table, some), len(table) - 1)
                hit = table[i] == some
                found[at[hit]] = ids[i[hit]]
            out.append(found.reshape(m, n - k + 1))
            prefix = self.prefixes[k - 1]
            i = np.minimum(np.searchsorted(prefix, some), len(prefix) - 1)
            go = np.zeros(m * (n - k + 1), bool)
            go[at[prefix[i] == some]] = True
            live = go.reshape(m, n - k + 1)
        return out


def _log_bytes(points: np.ndarray) -> np.ndarray:
    n = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    return n * np.log(BYTE_SHARE / 256)


def _step(options: list[np.ndarray]) -> np.ndarray:
    """Log of the sum of exponentials over ``options``."""
    if len(options) == 1:
        return options[0]
    x = np.stack(options)
    top = x.max(0)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return top + np.log(np.exp(x - top).sum(0))


def lattice(points: np.ndarray, pieces: Pieces, weights: np.ndarray, counts=None):
    """Log probability of each word of n code points; with ``counts``, also the expected
    counts of pieces."""
    m, n = points.shape
    ids = pieces.edges(points)
    padded = np.append(weights, -np.inf)  # id -1: no such piece
    logs = [padded[x] for x in ids]
    raw = _log_bytes(points)
    alpha = np.zeros((n + 1, m))
    for t in range(1, n + 1):
        alpha[t] = _step([alpha[t - 1] + raw[:, t - 1]] + [
            alpha[t - k - 1] + logs[k][:, t - k - 1] for k in range(min(t, len(logs)))])
    if counts is None:
        return alpha[n]
    beta = np.zeros((n + 1, m))
    for t in range(n - 1, -1, -1):
        beta[t] = _step([beta[t + 1] + raw[:, t]] + [
            beta[t + k + 1] + logs[k][:, t] for k in range(min(n - t, len(logs)))])
    expected = np.zeros(pieces.size + 1)
    for k, (x, w) in enumerate(zip(ids, logs)):
        a, b = alpha[:n - k].T, beta[k + 1:].T
        has = x >= 0
        post = np.exp(a[has] + w[has] + b[has] - np.broadcast_to(alpha[n][:, None], x.shape)[has])
        post *= np.broadcast_to(counts[:, None], x.shape)[has]
        expected += np.bincount(x[has], post, pieces.size + 1)
    return alpha[n], expected


def _matches(points: np.ndarray, a: int, z: int, pieces: Pieces):
    """(starts, ends, ids) of the pieces that start at a to z - 1, by start."""
    found = pieces.edges(points[None, a:z + pieces.longest - 1])
    at, n, ids = [], [], []
    for k, x in enumerate(found):
        hit = np.flatnonzero(x[0, :z - a] >= 0)
        at.append(hit + a)
        n.append(np.full(len(hit), k + 1))
        ids.append(x[0, hit])
    at, n, ids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, n, ids))
    order = np.argsort(at, kind="stable")
    return at[order], (at + n)[order], ids[order]


def _log_sum(options: list[float]) -> float:
    top = max(options)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in options))


def long_lattice(points: np.ndarray, pieces: Pieces, weights: np.ndarray, count=None):
    """`lattice` for one long word: its log probability; with ``count``, also expected counts."""
    n = len(points)
    raw = _log_bytes(points)
    blocks = [(a, min(a + BLOCK, n)) for a in range(0, n, BLOCK)]
    alpha = array("d", [0.0])
    coming: dict[int, list[float]] = {}  # what pieces bring to the ends ahead
    for a, z in blocks:
        starts, ends, ids = _matches(points, a, z, pieces)
        logs, ends = weights[ids].tolist(), ends.tolist()
        edges = np.searchsorted(starts, np.arange(a, z + 1)).tolist()
        step = raw[a:z].tolist()
        for t in range(a, z):
            here = alpha[t]
            for i in range(edges[t - a], edges[t - a + 1]):
                coming.setdefault(ends[i], []).append(here + logs[i])
            options = coming.pop(t + 1, [])
            options.append(here + step[t - a])
            alpha.append(options[0] if len(options) == 1 else _log_sum(options))
    if count is None:
        return alpha[n]
    beta = array("d", bytes(8 * (n + 1)))
    expected, known = np.zeros(pieces.size + 1), np.frombuffer(alpha)
    for a, z in reversed(blocks):
        starts, ends, ids = _matches(points, a, z, pieces)
        logs, far = weights[ids], ends.tolist()
        each = logs.tolist()
        edges = np.searchsorted(starts, np.arange(a, z + 1)).tolist()
        step = raw[a:z].tolist()
        for t in range(z - 1, a - 1, -1):
            options = [beta[far[i]] + each[i] for i in range(edges[t - a], edges[t - a + 1])]
            options.append(beta[t + 1] + step[t - a])
            beta[t] = options[0] if len(options) == 1 else _log_sum(options)
        post = np.exp(known[starts] + logs + np.frombuffer(beta)[ends] - known[n]) * count
        expected += np.bincount(ids, post, pieces.size + 1)
    return alpha[n], expected


def words_lattice(words: list[bytes], pieces: Pieces, weights: np.ndarray, counts=None):
    """The same over words of any lengths, those of one length together."""
    points = [np.frombuffer((MARK + w.decode("utf-8", "replace")).encode("utf-32-le"), np.uint32)
              for w in words]
    by_length: dict[int, list[int]] = {}
    for i, p in enumerate(points):
        by_length.setdefault(len(p), []).append(i)
    out, expected = np.zeros(len(words)), np.zeros(pieces.size + 1)
    for n, all_ in by_length.items():
        if n > LONG:
            for i in all_:
                p = points[i].astype(np.uint64)
                if counts is None:
                    out[i] = long_lattice(p, pieces, weights)
                else:
                    out[i], more = long_lattice(p, pieces, weights, counts[i])
                    expected += more
            continue
        room = max(1, 400_000 // n)  # bounded memory
        for a in range(0, len(all_), room):
            some = all_[a:a + room]
            matrix = np.stack([points[i] for i in some]).astype(np.uint64)
            if counts is None:
                out[some] = lattice(matrix, pieces, weights)
            else:
                out[some], more = lattice(matrix, pieces, weights, counts[some])
                expected += more
    return out, expected


def _chunk_rows(chunk: int, docs, buckets: int, folds: int, held_out: int):
    """docs: [(id, words)]: a body row and a row for each bucket of its words."""
    import xxhash

    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for _, ws in docs for w in ws), np.int64)
    words = list(number)
    bucket = np.fromiter((xxhash.xxh64_intdigest(w) % buckets for w in words), np.int64, len(words))
    order = np.argsort(bucket, kind="stable")  # words are numbered by bucket
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    ids = place[ids] if len(ids) else ids
    lens = np.array([len(ws) for _, ws in docs], np.int64)
    held = np.array([fold_number(i, folds) == held_out for i, _ in docs])
    doc_ids = null_back([-(2 ** 63) if i is None else i for i, _ in docs], pa)
    counts = np.bincount(ids[~np.repeat(held, lens)], minlength=len(words)).astype(np.int64)
    body = squeeze(struct.pack("<qq", len(docs), len(ids)), ids_of(doc_ids), lens,
                   held.astype(np.int8), ids.astype(np.int32))
    yield chunk, -1, int((~held).sum()), body, b""
    edges = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
    for b in np.unique(bucket).tolist():
        some = order[edges[b]:edges[b + 1]].tolist()
        yield (chunk, b, 0, squeeze(b" ".join([words[i] for i in some])),
               squeeze(counts[edges[b]:edges[b + 1]]))


def _encode(buckets: int, folds: int, held_out: int, chunk_words: int):
    names = ["chunk", "bucket", "train_docs", "body", "counts"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        chunk, docs, held = TaskContext.get().partitionId() << 32, [], 0

        def flush():
            rows = list(zip(*_chunk_rows(chunk, docs, buckets, folds, held_out)))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(rows, kinds)], names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                docs.append((key, text.as_py().lower().split()))
                held += len(docs[-1][1]) + 1
                if held > chunk_words:
                    yield flush()
                    chunk, docs, held = chunk + 1, [], 0
        if docs:
            yield flush()

    return run


def _merge_bucket(table: pa.Table) -> pa.Table:
    """One bucket: its distinct words and training counts, and each chunk's word numbers."""
    number, chunks, maps, n = {}, [], [], np.zeros(0, np.int64)
    for chunk, body, counts in zip(table.column("chunk"), table.column("body"),
                                   table.column("counts")):
        words = unsqueeze(body.as_py()).split(b" ")
        at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        n = np.concatenate((n, np.zeros(len(number) - len(n), np.int64)))
        n[at] += np.frombuffer(unsqueeze(counts.as_py()), np.int64)
        chunks.append(chunk.as_py())
        maps.append(squeeze(at))
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        "tokens": pa.array([int(n.sum())], pa.int64()),
        "types": pa.array([int((n > 0).sum())], pa.int64()),
        "words": pa.array([squeeze(b" ".join(number))], pa.binary()),
        "counts": pa.array([squeeze(n)], pa.binary()),
        "chunks": pa.array([chunks], pa.list_(pa.int64())),
        "maps": pa.array([maps], pa.list_(pa.binary()))})


_BUCKET = ("bucket int, tokens long, types long, words binary, counts binary, "
           "chunks array<long>, maps array<binary>")


def _bucket_words(words, counts):
    return (unsqueeze(words.as_py()).split(b" "),
            np.frombuffer(unsqueeze(counts.as_py()), np.int64))


def _expect(model_path, shares: np.ndarray):
    """Rows (piece, count) of this task's training words."""
    def run(batches):
        pieces = Pieces(model_path)
        weights, total = pieces.weights(shares), np.zeros(pieces.size + 1)
        for b in batches:
            for words, counts in zip(b.column(0), b.column(1)):
                words, counts = _bucket_words(words, counts)
                some = np.flatnonzero(counts).tolist()
                if some:
                    total += words_lattice([words[i] for i in some], pieces, weights,
                                           counts[some].astype(np.float64))[1]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])],
                                         ["piece", "n"])

    return run


def _answer(model_path, shares: np.ndarray):
    """For each chunk of each bucket: counts and log10 probabilities of the chunk's words."""
    def run(batches):
        pieces = Pieces(model_path)
        weights = pieces.weights(shares)
        for b in batches:
            for bucket, words, counts, chunks, maps in zip(*b.columns):
                words, counts = _bucket_words(words, counts)
                logs = words_lattice(words, pieces, weights)[0] / np.log(10)
                rows = []
                for m in maps.values:
                    at = np.frombuffer(unsqueeze(m.as_py()), np.int32)
                    rows.append(squeeze(counts[at], logs[at]))
                yield pa.RecordBatch.from_arrays(
                    [chunks.values, pa.array([bucket.as_py()] * len(rows), pa.int32()),
                     pa.array(rows, pa.binary())], ["chunk", "bucket", "answer"])

    return run


def _score_chunk(total: int, types: int, end_count: int, end_log: float):
    def base(c):
        return np.log10((c + 0.5) / (total + 0.5 * (types + 1)))

    def run(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        for body in bodies.column("body"):
            raw = unsqueeze(body.as_py())
            n, n_ids = struct.unpack("<qq", raw[:16])
            doc_ids = np.frombuffer(raw, np.int64, n, 16)
            lens = np.frombuffer(raw, np.int64, n, 16 + 8 * n)
            held = np.frombuffer(raw, np.int8, n, 16 + 16 * n).astype(bool)
            ids = np.frombuffer(raw, np.int32, n_ids, 16 + 17 * n)
            counts, logs = [np.zeros(0, np.int64)], [np.zeros(0)]
            order = np.argsort(answers.column("bucket").to_numpy())
            for i in order.tolist():
                answer = unsqueeze(answers.column("answer")[i].as_py())
                k = len(answer) // 16
                counts.append(np.frombuffer(answer, np.int64, k))
                logs.append(np.frombuffer(answer, np.float64, k, 8 * k))
            counts, logs = np.concatenate(counts), np.concatenate(logs)
            doc = np.repeat(np.arange(n), lens)
            sums = [np.bincount(doc, w[ids] if n_ids else None, n)
                    for w in ((counts > 0).astype(float), base(counts), logs)]
            for o, x in zip(out, (null_back(doc_ids, pa), pa.array(held), pa.array(lens + 1),
                                  pa.array(sums[0].astype(np.int64) + (end_count > 0)),
                                  pa.array(sums[1] + base(end_count)),
                                  pa.array(sums[2] + end_log))):
                o.append(x)
        names = ["id", "held_out", "n_tokens", "n_known", "base_score", "score"]
        return pa.table({k: pa.chunked_array(o) for k, o in zip(names, out)})

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    folds: int = 5, held_out: int = 1, rounds: int = 2,
                    model_path: str | None = None, buckets: int | None = None,
                    chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row per document: ``id_col``, held_out, n_tokens, n_known, train_tokens,
    base_score (unigram words), score (log10 of the marginal probability)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"),
                       text_of(text_col).cast("binary").alias("text"))
    if not buckets:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        buckets = max(2 * shuffle_partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    chunks = write_table(rows.mapInArrow(
        _encode(buckets, folds, held_out, chunk_words),
        "chunk long, bucket int, train_docs long, body binary, counts binary"), "lattice-chunks")
    merged = write_table(chunks.where("bucket >= 0").groupBy("bucket").applyInArrow(
        _merge_bucket, _BUCKET), "lattice-words")
    end = chunks.agg(F.sum("train_docs")).first()[0] or 0
    sums = merged.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v")).first()
    pieces = Pieces(model_path)
    shares = pieces.first
    for _ in range(rounds):
        found = merged.select("words", "counts").mapInArrow(
            _expect(model_path, shares), "piece int, n double").groupBy("piece").agg(
                F.sum("n").alias("n")).collect()  # as many as there are pieces
        n = np.where(shares > 0, 0.1, 0.0)
        for r in found:
            n[r["piece"]] += r["n"]
        n[pieces.end] = end + 0.1
        shares = n / n.sum()
    answers = merged.select("bucket", "words", "counts", "chunks", "maps").mapInArrow(
        _answer(model_path, shares), "chunk long, bucket int, answer binary")
    total, types = (sums["n"] or 0) + end, (sums["v"] or 0) + (end > 0)
    scored = chunks.where("bucket < 0").select("chunk", "body").groupBy("chunk").cogroup(
        answers.groupBy("chunk")).applyInArrow(
            _score_chunk(total, types, end, float(pieces.weights(shares)[pieces.end] / np.log(10))),
            "id long, held_out boolean, n_tokens long, n_known long, base_score double, "
            "score double")
    return scored.withColumn("train_tokens", F.lit(total).cast("long")).withColumnRenamed(
        "id", id_col)
