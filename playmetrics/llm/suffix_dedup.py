"""Removal of repeated byte strings with a multi-document suffix array built column by column.

Strings of ``width`` bytes are dealt out by minimiser: neighbouring strings that
share the least hash of their ``gram``-byte grams form a segment, which goes to the
minimiser's bucket. Equal strings have equal minimisers, so a bucket has all
occurrences of its strings. There, equal segments become one, and segments
that share a minimiser form a collection whose Burrows-Wheeler transform and
longest common prefixes are built by inserting one symbol of every segment each
round, from the last to the first: the rank of a symbol among the equal symbols
before it says where the longer suffix goes, and the least common prefix
between two neighbouring occurrences of a symbol, plus one, is the new common
prefix. Neighbours with a common prefix of ``width`` or more are the same string.

The transform, the prefixes and the positions are read and rewritten from front
to back each round. A collection is ``COLLECTION`` bytes or one minimiser's segments in one
bucket, so these streams stay in the task's memory instead of files on a machine's own disk.
The number of buckets follows the bytes sent. A minimiser with more than ``HOT`` bytes of
segments (a line that many documents share, each with other text around it) is dealt over
several: its segments are cut by where in a string the minimiser lies, and go by (minimiser,
that place's range, hash of the bytes that every string of the range has around it). Equal
strings have it in the same place with the same bytes around, so they still meet. Both numbers
are estimated on one document in ``SAMPLE``, chosen by a hash; they decide where segments go and
never what is found.

Before it sends anything, a task drops segments equal to an earlier one of its
own rows, so copies travel once from each chunk. Hashes only propose; segments
are compared byte by byte.

Null and empty texts have no bytes. A null id is smaller than any other; rows
with equal ids and different texts never remove bytes from each other, equal
rows fare alike.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from playmetrics.llm.common import NULL_ID, ids_of, text_of, write_table
from playmetrics.llm.minimisers import Minimisers, mixed, sized
from playmetrics.llm.superkmer_dedup import ragged, sliding_min

#: Bytes of text that a task works on together.
CHUNK = 2_500_000
#: Bytes of segments that a task gathers before it packs them for their buckets.
PACK = 48_000_000
#: Bytes of segments whose transform is built together.
COLLECTION = 250_000
#: Bytes of one minimiser's segments, and of a bucket's, that are about as many as a task should hold.
HOT, BUCKET_BYTES = 8_000_000, 32_000_000
#: One document in so many is looked at before, to size the buckets.
SAMPLE = 32
#: Ranges of a string's minimiser place by which a hot minimiser's segments are cut.
RANGES = 8
DONE = 255  # never a byte of UTF-8
_R = 0x9E3779B97F4A7C15
_RI = pow(_R, -1, 1 << 64)


def powers(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.cumprod(out)


#: Powers of ``_R`` and of its inverse, as many as were needed so far.
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


class Hashes:
    """Hashes of any ranges of ``flat`` in constant time; wraps on purpose."""

    def __init__(self, flat: np.ndarray):
        if len(_POWERS[0]) <= len(flat):
            _POWERS[:] = [powers(r, len(flat) + len(flat) // 8 + 1) for r in (_R, _RI)]
        self.up, down = _POWERS
        self.sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * down[:len(flat)], out=self.sums[1:])

    def of(self, starts, lens) -> np.ndarray:
        return mixed((self.sums[starts + lens] - self.sums[starts]) * self.up[starts])

    def every(self, width: int) -> np.ndarray:
        return mixed((self.sums[width:] - self.sums[:-width]) * self.up[:len(self.sums) - width])


def equal_ranges(flat, a, b, lens, step: int = 20_000) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), step):  # bounded memory
        n = lens[k:k + step]
        same = flat[ragged(a[k:k + step], n)] == flat[ragged(b[k:k + step], n)]
        out[k:k + step] = np.logical_and.reduceat(same, np.cumsum(n) - n)
    return out


def first_equal(flat, at, lens, hashes) -> np.ndarray:
    """For each range the first one in order that is equal, or itself."""
    order = np.lexsort((np.arange(len(at)), lens, hashes))
    h, n = hashes[order], lens[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (n[1:] != n[:-1])))
    lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.arange(len(at))
    some, lead = order[~new], lead[~new]
    ok = equal_ranges(flat, at[some], at[lead], lens[some])
    out[some[ok]] = lead[ok]  # a range of the same hash that differs stays on its own
    return out


def segments(flat, piece, hashes: Hashes, width: int, gram: int):
    """(start, strings, minimiser, its place, periodic) of the segments.

    ``piece``: number of each byte's text. Place: the minimiser's first, from the start."""
    n = len(flat) - width + 1
    span = width - gram + 1  # grams in a string
    empty = np.zeros(0, np.int64)
    if n <= 0:
        return empty, empty, np.zeros(0, np.uint64), empty, np.zeros(0, bool)
    grams = hashes.every(gram)
    least = sliding_min(grams, span)
    inside = piece[:n] == piece[width - 1:]
    new = np.concatenate(([True], (least[1:] != least[:-1]) | (piece[1:n] != piece[:n - 1])
                          | (inside[1:] != inside[:-1])))
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, n))[inside[starts]]
    starts = starts[inside[starts]]
    parts = -(-count // span)  # long runs of one minimiser are cut
    nth = ragged(np.zeros(len(parts), np.int64), parts)
    count = np.minimum(np.repeat(count, parts) - nth * span, span)
    starts = np.repeat(starts, parts) + nth * span
    # a minimiser twice in a segment: only then can the segment repeat a string of its own
    most = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    most = ~sliding_min(~most, span)  # the largest minimum of the strings that hold a gram
    at = np.flatnonzero(grams == most[:len(grams)])
    pair = np.flatnonzero(grams[at[1:]] == grams[at[:-1]])
    left, right = np.append(at[:-1][pair], 2 ** 60), np.append(at[1:][pair], 2 ** 60)
    periodic = right[np.searchsorted(left, starts)] <= starts + count - 1 + span - 1
    here = np.searchsorted(at, starts)
    while len(wrong := np.flatnonzero(grams[at[here]] != least[starts])):
        here[wrong] += 1
    return starts, count, least[starts], at[here] - starts, periodic


def suffix_order(flat: np.ndarray, at: np.ndarray, lens: np.ndarray):
    """(text, place, common prefix) of all suffixes of the texts flat[at:at + len], sorted.

    Ends are smaller than any symbol and differ from each other. Texts are under 255 long.
    """
    n = len(at)
    # the texts on their own, each after the one before and with a place for its end
    begin_of = np.cumsum(lens + 1) - lens - 1
    places = ragged(begin_of, lens)
    previous = np.full(int((lens + 1).sum()), DONE, np.uint8)
    previous[places + 1] = flat[ragged(at, lens)]
    bwt = previous[begin_of + lens]
    lcp = np.zeros(n + 1, np.uint8)  # and one more, so that a range can end at the last
    newest = np.arange(n)
    for r in range(1, int(lens.max()) + 1 if n else 1):
        live = np.flatnonzero(lens >= r)
        order, ranks, begin = _ranks(bwt)
        rank = ranks[newest[live]]
        by_rank = np.argsort(rank)
        live, rank = live[by_rank], rank[by_rank].astype(np.int64)
        p = newest[live]
        c = bwt[p].astype(np.int64)
        # common prefix with the one before, and of the one after with it
        before = np.where(rank > begin[c], order[np.maximum(rank - 1, 0)], -1)
        after = np.where(rank + 1 < begin[c + 1], order[np.minimum(rank + 1, len(order) - 1)], -1)
        # only where the one after was there before: a new one after a new one has its own
        alone = np.concatenate((rank[1:] != rank[:-1] + 1, [True]))
        common = _range_minima(lcp, np.concatenate((before, p)),
                               np.concatenate((p, np.where(alone, after, -1))))
        # from front to back: what is there, and the new ones in their places
        place = n + rank
        old = np.ones(len(lcp) + len(place), bool)
        old[place] = False
        bwt = _inserted(bwt, old[:-1], place, previous[(begin_of + lens)[live] - r])
        lcp = _inserted(lcp, old, place, common[:len(p)])
        then = alone & (place + 1 < len(bwt))
        lcp[place[then] + 1] = common[len(p):][then]
        newest[live] = place
    text, start = np.zeros(len(bwt), np.int64), np.zeros(len(bwt), np.int64)
    row, (_, ranks, _) = np.arange(n), _ranks(bwt)
    text[:n], start[:n] = row, lens
    for r in range(1, int(lens.max()) + 1 if n else 1):  # from each suffix to the one longer by one
        live = np.flatnonzero(lens >= r)
        row[live] = n + ranks[row[live]]
        text[row[live]], start[row[live]] = live, lens[live] - r
    return text, start, lcp[:-1]


def _ranks(bwt):
    """Places of the symbols in their order, the rank of each place, and where each symbol begins."""
    order = np.argsort(bwt, kind="stable")
    begin = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=256))))
    order = order[:begin[DONE]]
    ranks = np.empty(len(bwt), np.int32)
    ranks[order] = np.arange(len(order), dtype=np.int32)
    return order, ranks, begin


def _inserted(column, old, place, values):
    out = np.empty(len(old), column.dtype)
    out[old], out[place] = column, values
    return out


def _range_minima(lcp, a, b) -> np.ndarray:
    """1 + min(lcp[a + 1 .. b]) where a and b exist, else 0."""
    out = np.zeros(len(a), np.uint8)
    has = np.flatnonzero((a >= 0) & (b >= 0))
    if len(has):
        has = has[np.argsort(-a[has])]
        # from the last range to the first, so that what lies between two takes one step
        edges = np.column_stack((a[has], b[has])).ravel() + 1
        out[has] = np.minimum(np.minimum.reduceat(lcp, edges)[::2], 253) + 1
    return out


def later_occurrences(group, doc, h, start) -> np.ndarray:
    """Mask: in its group there is an earlier one, of a smaller doc or before it in the same text."""
    order = np.lexsort((start, h, doc, group))
    g, d, t = group[order], doc[order], h[order]
    new = np.concatenate(([True], g[1:] != g[:-1]))
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    text = new | np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
    first_here = np.maximum.accumulate(np.where(text, np.arange(len(g)), 0))
    out = np.zeros(len(g), bool)
    # a repeated row has the same places: they are not before each other
    out[order] = (d > d[first]) | (start[order] > start[order][first_here])
    return out


def merge_spans(doc, h, a, b):
    """Spans of each text, those that touch or overlap as one."""
    order = np.lexsort((a, h, doc))
    doc, h, a, b = doc[order], h[order], a[order], b[order]
    if not len(a):
        return doc, h, a, b
    text = np.concatenate(([True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])))
    # ends never fall inside a text; each text lies above the one before
    lift = np.cumsum(text) * (int(b.max()) + 1)
    reach = np.maximum.accumulate(b + lift)
    new = np.concatenate(([True], (a + lift)[1:] > reach[:-1]))
    return doc[new], h[new], a[new], np.maximum.reduceat(b, np.flatnonzero(new))


def cut_segments(at, lens, least, place, periodic, hashes: Hashes, width: int, gram: int):
    """(segment, start, len, place, hash) of pieces that have each string of the segments once.

    A piece holds the strings whose first minimiser is the one at ``place`` and lies in one range
    of places in the string; ``hash`` is of the bytes around it that all of these have."""
    seg, pos = np.flatnonzero(~periodic), (at + place)[~periodic]
    more = np.flatnonzero(periodic)
    if len(more):  # all its places, by the whole hash: a string's own bytes say which is its first
        n = lens[more] - gram + 1
        held, places = np.repeat(more, n), ragged(at[more], n)
        hit = hashes.of(places, gram) == least[held]
        seg, pos = np.concatenate((seg, held[hit])), np.concatenate((pos, places[hit]))
    order = np.lexsort((pos, seg))
    seg, pos = seg[order], pos[order]
    low, high = at[seg], np.minimum(pos, (at + lens)[seg] - width)
    again = np.flatnonzero(seg[1:] == seg[:-1]) + 1
    low[again] = np.maximum(low[again], pos[again - 1] + 1)
    low = np.maximum(low, pos + gram - width)
    room = width - gram + 1
    bounds = [room * j // RANGES for j in range(RANGES + 1)]
    out = []
    for j, (a, z) in enumerate(zip(bounds, bounds[1:])):
        first, last = np.maximum(low, pos - z + 1), np.minimum(high, pos - a)
        k = np.flatnonzero(first <= last)
        n = np.full(len(k), a + gram + room - z)
        core = hashes.of(pos[k] - a, n) + np.uint64(j)
        out.append((seg[k], first[k], last[k] - first[k] + width, pos[k] - first[k], core))
    return [np.concatenate(x) for x in zip(*out)]


def _equal_earlier(at, lens, hashes, flat, piece, doc, h, offset):
    """(spans of the ranges, sorted, that equal one of a smaller document or an earlier one of the
    same text; mask of the others)."""
    lead = first_equal(flat, at, lens, hashes)
    t, u = piece[at], piece[at[lead]]
    gone = (doc[t] > doc[u]) | ((doc[t] == doc[u]) & (h[t] == h[u]) & (lead != np.arange(len(at))))
    a = at[gone] + offset[t[gone]]
    return merge_spans(doc[t[gone]], h[t[gone]], a, a + lens[gone]), ~gone


def _chunk(pieces, width: int, gram: int, to: Minimisers):
    """pieces: [(id, text hash, offset, bytes)]: spans found, and the segments to send as
    (bucket, doc, h, start, len, minimiser, place, periodic, hash, bytes)."""
    pieces = sorted(pieces, key=lambda x: x[:3])
    flat = np.frombuffer(b"".join(x[3] for x in pieces), np.uint8)
    size = np.array([len(x[3]) for x in pieces])
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), size)
    doc, h, offset = (np.array([x[k] for x in pieces], np.int64) for k in range(3))
    offset = offset - (np.cumsum(size) - size)  # from a place in flat to one in the text
    hashes = Hashes(flat)
    at, count, least, place, periodic = segments(flat, piece, hashes, width, gram)
    lens = count + width - 1
    whole = hashes.of(at, lens)
    spans, k = _equal_earlier(at, lens, whole, flat, piece, doc, h, offset)
    t = piece[at]
    at, lens, t, least, place, periodic, whole = (
        x[k] for x in (at, lens, t, least, place, periodic, whole))
    bucket, which = to.bucket(least), to.hot(least)
    hot = np.flatnonzero(which >= 0)
    if len(hot):
        seg, a, n, p, core = cut_segments(at[hot], lens[hot], least[hot], place[hot], periodic[hot],
                                          hashes, width, gram)
        # equal pieces of unequal segments, which is most of a text that says one thing over and over
        order = np.argsort(a, kind="stable")
        seg, a, n, p, core = (x[order] for x in (seg, a, n, p, core))
        more, kept = _equal_earlier(a, n, hashes.of(a, n), flat, piece, doc, h, offset)
        spans = merge_spans(*(np.concatenate(x) for x in zip(spans, more)))
        seg, a, n, p, core = (x[kept] for x in (seg, a, n, p, core))
        seg, k = hot[seg], which < 0
        at, lens, place = (np.concatenate((x[k], y)) for x, y in ((at, a), (lens, n), (place, p)))
        bucket = np.concatenate((bucket[k], to.dealt(least[seg], which[seg], core)))
        t, least = (np.concatenate((x[k], x[seg])) for x in (t, least))
        periodic = np.concatenate((periodic[k], np.zeros(len(seg), bool)))
        whole = np.concatenate((whole[k], hashes.of(a, n)))
        order = np.lexsort((at, t))
        at, lens, place, bucket, t, least, periodic, whole = (
            x[order] for x in (at, lens, place, bucket, t, least, periodic, whole))
    return spans, (bucket, doc[t], h[t], at + offset[t], lens, least, place, periodic,
                   (whole >> np.uint64(32)).astype(np.uint32), flat[ragged(at, lens)])


def _packed(spans, sent, buckets: int):
    """Rows (bucket, kind, payload) of what `_chunk` gave for some chunks."""
    spans = merge_spans(*(np.concatenate(x) for x in zip(*spans)))
    if len(spans[0]):
        yield int(spans[1][0] % buckets), 1, b"".join(c.astype(np.int64).tobytes() for c in spans)
    bucket, doc, h, start, lens, least, place, periodic, whole, flat = (
        np.concatenate(x) for x in zip(*sent))
    if not len(doc):
        return
    at = np.cumsum(lens) - lens
    order = np.lexsort((least, bucket))
    edges = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) != 0, [True])))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()):
        k = order[a:z]
        # texts by number: the neighbours in `sent` that are of one text
        by_text = np.sort(k)
        new = np.concatenate(([True], (doc[by_text][1:] != doc[by_text][:-1])
                              | (h[by_text][1:] != h[by_text][:-1])))
        text = np.empty(len(k), np.int64)
        text[np.argsort(k)] = np.cumsum(new) - 1
        used = by_text[new]
        raw = b"".join([
            struct.pack("<qqq", len(k), len(used), int(lens[k].sum())),
            doc[used].tobytes(), h[used].tobytes(), text.astype(np.int32).tobytes(),
            start[k].astype(np.int64).tobytes(), lens[k].astype(np.uint16).tobytes(),
            (least[k] >> np.uint64(32)).astype(np.uint32).tobytes(), place[k].astype(
                np.uint16).tobytes(), periodic[k].astype(np.uint8).tobytes(), whole[k].tobytes(),
            flat[ragged(at[k], lens[k])].tobytes()])
        yield int(bucket[k[0]]), 0, struct.pack("<q", len(raw)) + pa.Codec("zstd", 3).compress(
            raw, asbytes=True)


def _unpacked(blob: bytes):
    raw = pa.Codec("zstd").decompress(blob[8:], struct.unpack("<q", blob[:8])[0], asbytes=True)
    n, texts, size = struct.unpack("<qqq", raw[:24])
    at = 24
    out = []
    for kind, many in ((np.int64, texts), (np.int64, texts), (np.int32, n), (np.int64, n),
                       (np.uint16, n), (np.uint32, n), (np.uint16, n), (np.uint8, n),
                       (np.uint32, n), (np.uint8, size)):
        out.append(np.frombuffer(raw, kind, many, at))
        at += out[-1].nbytes
    doc, h, text, start, lens, tag, place, periodic, whole, flat = out
    return (doc[text], h[text], start, lens.astype(np.int64), tag, place.astype(np.int64),
            periodic.astype(bool), whole, flat)


def _segments_sent(width: int, gram: int, to: Minimisers, chunk: int, count: bool = False):
    """Packed segments by bucket; with ``count`` (minimiser, bytes of its segments)."""
    def run(batches):
        pieces, held, seen, spans, sent = [], 0, set(), [], []

        def work():
            found, segments_ = _chunk(pieces, width, gram, to)
            spans.append(found)
            sent.append(segments_)
            pieces.clear()
            seen.clear()

        def flush():
            if count:
                least, lens = (np.concatenate([x[k] for x in sent]) for k in (5, 4))
                kinds, of = np.unique(least.view(np.int64), return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(
                    np.bincount(of, lens, len(kinds)).astype(np.int64))], ["least", "n"])
            rows = [] if count else list(_packed(spans, sent, to.buckets))
            spans.clear()
            sent.clear()
            for b, k, p in rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b], pa.int32()), pa.array([k], pa.int8()), pa.array([p], pa.binary())],
                    ["bucket", "kind", "payload"])

        for batch in batches:
            for key, h, value in zip(ids_of(batch.column(0)).tolist(), batch.column(1).to_pylist(),
                                     batch.column(2)):
                text = value.as_py()
                if len(text) < width or (key, h) in seen:
                    continue  # a repeated row fares like the first
                seen.add((key, h))
                for a in range(0, len(text) - width + 1, chunk):  # long texts in parts
                    pieces.append((key, h, a, text[a:a + chunk + width - 1]))
                    held += len(pieces[-1][3])
                    if held > chunk:
                        work()
                        seen.add((key, h))
                        held = 0
                        if sum(len(x[-1]) for x in sent) > PACK:
                            yield from flush()
        if pieces:
            work()
        if sent:
            yield from flush()

    return run


def minimiser_places(tag, place, periodic, at, lens, flat, gram: int):
    """(segment, place in ``flat``) of every minimiser: all its places where a segment has it twice."""
    once, more = np.flatnonzero(~periodic), np.flatnonzero(periodic)
    if not len(more):
        return once, at[once] + place[once]
    held, places = np.repeat(more, lens[more]), ragged(at[more], lens[more])
    grams = Hashes(flat[places]).every(gram) >> np.uint64(32)
    n = len(grams)
    hit = np.flatnonzero((grams == tag[held[:n]]) & (held[:n] == held[gram - 1:]))
    return np.concatenate((once, held[hit])), np.concatenate((at[once] + place[once], places[hit]))


def agreeing(seg, pos, tag, at, lens, flat, width: int, gram: int, parts: int) -> np.ndarray:
    """Mask of the minimisers around which another one has the same bytes.

    A string holds its first minimiser after 0 to ``width - gram`` bytes. That range falls into
    ``parts``; the least bytes before and after that a part leaves are compared.
    """
    room = width - gram + 1
    bounds = [room * j // parts for j in range(parts + 1)]
    out = np.zeros(len(seg), bool)
    for before, after in zip(bounds, (room - b for b in bounds[1:])):
        n = before + gram + after
        fits = np.flatnonzero((pos - before >= at[seg]) & (pos + gram + after <= (at + lens)[seg]))
        for_each = powers(_R, n)
        h = np.empty(len(fits), np.uint64)
        for a in range(0, len(fits), 20_000):  # bounded memory
            some = fits[a:a + 20_000]
            rows = flat[(pos[some] - before)[:, None] + np.arange(n)[None, :]].astype(np.uint64)
            h[a:a + 20_000] = mixed((rows + np.uint64(1)) @ for_each)
        _, same, times = np.unique(h ^ tag[seg[fits]].astype(np.uint64), return_inverse=True,
                                   return_counts=True)
        out[fits[times[same] > 1]] = True
    return out


def may_repeat(tag, place, periodic, at, lens, flat, width: int, gram: int) -> np.ndarray:
    """Segments that may share a string with another one, or have one twice."""
    seg, pos = minimiser_places(tag, place, periodic, at, lens, flat, gram)
    _, number, many = np.unique(tag[seg], return_inverse=True, return_counts=True)
    several = many[number] > 1
    seg, pos = seg[several], pos[several]
    for parts in (2, 8):  # few bytes first, then what is left by more
        keep = agreeing(seg, pos, tag, at, lens, flat, width, gram, parts)
        seg, pos = seg[keep], pos[keep]
    out = np.zeros(len(tag), bool)
    out[seg] = True
    return out


def repeated_in(doc, h, start, lens, tag, place, periodic, whole, flat, width: int, gram: int):
    """Spans (doc, h, start, end) of the repeated strings of one bucket's segments."""
    order = np.lexsort((start, h, doc))
    at = (np.cumsum(lens) - lens)[order]
    doc, h, start, lens, tag, place, periodic, whole = (
        x[order] for x in (doc, h, start, lens, tag, place, periodic, whole))
    lead = first_equal(flat, at, lens, (tag.astype(np.uint64) << np.uint64(32)) | whole)
    here = (doc == doc[lead]) & (h == h[lead])
    gone = (doc > doc[lead]) | (here & (start > start[lead]))
    found = [(doc[gone], h[gone], start[gone], start[gone] + lens[gone])]
    gone |= here & (lead != np.arange(len(lead)))  # the same place, from a repeated row
    doc, h, start, lens, tag, place, periodic, at = (
        x[~gone] for x in (doc, h, start, lens, tag, place, periodic, at))
    some = np.flatnonzero(may_repeat(tag, place, periodic, at, lens, flat, width, gram))
    some = some[np.argsort(tag[some], kind="stable")]
    # whole minimisers together, about COLLECTION bytes at a time
    batch = (np.cumsum(lens[some]) // COLLECTION)
    new = np.concatenate(([True], tag[some][1:] != tag[some][:-1]))[:len(some)]
    batch = batch[np.maximum.accumulate(np.where(new, np.arange(len(some)), 0))]
    edges = np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1], [True])))
    for a, z in zip(edges[:-1].tolist(), edges[1:].tolist()) if len(some) else ():
        s = some[a:z]
        text, place, lcp = suffix_order(flat, at[s], lens[s])
        group, repeat = np.cumsum(lcp < width), lcp >= width
        repeat[:-1] |= repeat[1:]
        mine, begin = s[text[repeat]], start[s[text[repeat]]] + place[repeat]
        later = later_occurrences(group[repeat], doc[mine], h[mine], begin)
        begin, mine = begin[later], mine[later]
        found.append((doc[mine], h[mine], begin, begin + width))
    return merge_spans(*(np.concatenate(x) for x in zip(*found)))


def _bucket(width: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        spans, parts = [], []
        for kind, payload in zip(table.column("kind"), table.column("payload")):
            blob = payload.as_py()
            if kind.as_py() == 1:
                spans.append(tuple(np.frombuffer(blob, np.int64).reshape(4, -1)))
            else:
                parts.append(_unpacked(blob))
        if parts:
            spans.append(repeated_in(*(np.concatenate(x) for x in zip(*parts)), width, gram))
        columns = [np.concatenate(x) for x in zip(*spans)] if spans else [np.zeros(0, np.int64)] * 4
        return pa.table({k: pa.array(c.astype(np.int64))
                         for k, c in zip(("id", "h", "start", "end"), columns)})

    return run


def _sized(rows: DataFrame, width: int, gram: int, buckets: int | None, chunk: int) -> Minimisers:
    """Buckets for ``rows`` (id, h, text), from a sample of them."""
    def counted(some):
        return some.mapInArrow(_segments_sent(width, gram, Minimisers({}, 1), chunk, True),
                               "least long, n long")

    room = width - gram + 1  # pieces hold more bytes than the segment they are cut from
    growth = -(-(RANGES * width + room) // (width + room))
    return sized(rows, counted, SAMPLE, HOT, BUCKET_BYTES, buckets, growth)


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, width: int = 100, gram: int = 24,
                   buckets: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(id, h, start, end): bytes start to end - 1 of the text go; spans may overlap.

    ``h``: XXH64 of the text, so that rows with equal ids stay apart; a null id is ``NULL_ID``.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_of(text_col))
                       .alias("h"), text_of(text_col).cast("binary").alias("text"))
    to = _sized(rows, width, gram, buckets, chunk)
    sent = rows.mapInArrow(_segments_sent(width, gram, to, chunk),
                           "bucket int, kind byte, payload binary")
    return sent.groupBy("bucket").applyInArrow(_bucket(width, gram),
                                               "id long, h long, start long, end long")


def _cut(batches):
    for batch in batches:
        out = [[], [], [], []]
        for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3)):
            text, gone, runs = text.as_py(), 0, 0
            kept = text
            if starts.is_valid:
                zero = np.zeros(len(starts.values), np.int64)
                _, _, a, b = merge_spans(zero, zero, starts.values.to_numpy(),
                                         ends.values.to_numpy())
                gone, runs = int((b - a).sum()), len(a)
                edges = [0, *np.ravel(np.column_stack((a, b))).tolist(), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2]))
            for o, x in zip(out, (len(text), gone, runs, kept)):
                o.append(x)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(o, pa.int64()) for o in out[:3]),
             pa.array(out[3], pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   width: int = 100, gram: int = 24, buckets: int | None = None,
                   chunk: int = CHUNK) -> DataFrame:
    """One row per document: ``id_col``, n_bytes, n_removed, n_spans, kept (binary)."""
    spans = write_table(repeated_spans(docs, id_col, text_col, width, gram, buckets, chunk),
                        "suffix-spans")
    spans = write_table(spans.groupBy("id", "h").agg(F.collect_list(F.struct("start", "end"))
                        .alias("s")).select("id", "h", F.col("s.start").alias("starts"),
                                            F.col("s.end").alias("ends")), "suffix-by-document")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("id"),
                       F.xxhash64(text_of(text_col)).alias("h"),
                       text_of(text_col).cast("binary").alias("text"))
    out = rows.join(spans, ["id", "h"], "left").select("id", "text", "starts", "ends").mapInArrow(
        _cut, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumn("id", F.when(F.col("id") != NULL_ID, F.col("id"))).withColumnRenamed(
        "id", id_col)
