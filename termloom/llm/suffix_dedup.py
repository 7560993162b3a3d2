"""Exact removal of byte strings that stand earlier in the corpus (suffix-array dedup).

A byte goes if a ``WINDOW``-byte string covers it that also starts earlier: in a
smaller doc_id, or in the same document at an earlier place.  Sorting a suffix
at every byte would move a hundred times the corpus, so the suffix array is
sparse: of each window the ``GRAM``-byte string with the least hash is its
anchor, and equal windows have their anchor at the same place.  Only anchors
are sorted.

1. Map: anchors of every document; a gram that a task sees twice leaves it once.
   The grams are dealt into hash ranges, and each range finds the repeated ones.
2. Map: around each repeated anchor the suffix (``WINDOW`` bytes to the right,
   then the bytes to the left, nearest first) is cut out.  Each task sorts its
   suffixes and exchanges them as front-coded runs: the length of the prefix
   shared with the predecessor and the remaining bytes.
3. Reduce: a loser tree merges the runs.  Every stream carries the length of the
   prefix it shares with the last output, so known prefixes are never compared
   again.  Equal neighbours are copies; suffixes that share the gram but not all
   of the rest are compared window by window through rolling hashes.
4. The spans found are gathered per document and cut from the text.

A gram that stands in HOT places or more, each with other text around it, would
bring them all into one task.  The windows around such an anchor are dealt out one
by one, by a hash of their WINDOW bytes: a task sends each of them once, however
often it sees it, and the earliest of a window's places is found where they meet.

Results for odd input: null text is empty; a null doc_id sorts before all others
and comes back as null; rows that repeat a doc_id with the same text count as one
document and each get its result; with other texts they are documents of their
own, in the order of the texts' hashes, null ids among them; an empty table gives
no rows; other columns are passed by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.bytescan import BYTE_CODE, U, flat, mix
from termloom.llm.common import NULL_ID, numbered, parts_for, small_batches, table, total_bytes, trim, written

WINDOW, GRAM = 100, 32
LEFT = WINDOW - GRAM
WIDTH = WINDOW + LEFT
BLOCK = 1 << 19
#: anchors that a task holds before it sends them on
FLUSH = 1 << 19
#: stands for what lies outside a text; never a byte of UTF-8
OUTSIDE = 0xFF
#: anchors have the least hashes of their windows, so they are hashed again before they are dealt out
AGAIN = U(0x5851F42D4C957F2D)
_B = 0x9E3779B97F4A7C15 | 1
#: places from which on a gram is split into windows, and how many grams at most are (those with the most places); no result depends on them
HOT, HOT_MOST = 8192, 1_000_000
#: bytes of text for each bucket: several of them share a task, so that tasks are about even
BUCKET_BYTES = 4 << 20
#: marks a run of windows
WINDOWS = b"w"


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place, by doubling."""
    h, span = BYTE_CODE[data], 1
    while span < GRAM:
        h = h[:-span] * U(pow(_B, span, 2**64)) + h[span:]
        span *= 2
    return mix(h)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in ``data``) and gram hashes of the anchors of all windows that lie inside one text."""
    places, hashes = [], []
    for b in range(int(offsets[0]), int(offsets[-1]) - WINDOW + 1, BLOCK):
        seg = data[b : min(int(offsets[-1]), b + BLOCK + WINDOW - 1)]
        n = len(seg) - WINDOW + 1
        h = gram_hashes(seg)
        v = (h & U(~0xFFFFFF & (2**64 - 1))) | np.arange(len(h), dtype=U)
        for step in (1, 2, 4, 8, 16, 32):
            v = np.minimum(v[:-step], v[step:])
        v = np.minimum(v[:n], v[LEFT + 1 - 64 : LEFT + 1 - 64 + n])
        cut = np.zeros(n + 1, np.int32)
        edges = offsets[np.searchsorted(offsets, b, "right") : np.searchsorted(offsets, b + n + WINDOW)] - b
        np.add.at(cut, np.minimum(np.maximum(edges - WINDOW + 1, 0), n), 1)
        np.add.at(cut, np.minimum(edges, n), -1)
        taken = np.zeros(len(h), bool)
        taken[(v[np.cumsum(cut[:n]) == 0] & U(0xFFFFFF)).astype(np.int64)] = True
        at = np.flatnonzero(taken)
        places.append(at + b)
        hashes.append(mix(h[at] ^ AGAIN))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, U)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(hashes)[first]


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """Hash ranges, so that an order by hash is one by bucket too."""
    return (((h >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def squeezed(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed: their high bytes hardly cost anything."""
    planes = values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unsqueezed(blob: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(blob[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = pa.decompress(blob[8:], n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(kind).ravel()


def _gaps(h: np.ndarray) -> np.ndarray:
    """Rising values as their differences; cumsum gives them back."""
    out = h.copy()
    out[1:] -= h[:-1]
    return out


ANCHOR_ROWS = "bucket long, hashes binary, counts binary, docs binary, places binary"
#: in the place of a range of documents: grams and in how many places they stand
GRAMS = -1


def _send_anchors(n_buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, d, p = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.argsort(h, kind="stable")
            h, d, p = h[order], d[order], p[order]
            first = np.ones(len(h), bool)
            first[1:] = h[1:] != h[:-1]
            many = np.zeros(len(h), bool)
            many[:-1] = ~first[1:]
            many |= ~first
            known_d, known_p = d[many], p[many]
            p = np.where(many, np.int32(-1), p)[first]
            times = np.diff(np.append(np.flatnonzero(first), len(h))).astype(np.int32)
            h, d = h[first], d[first]
            bucket = _bucket(h, n_buckets)
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            rows = [(int(bucket[s]), squeezed(_gaps(h[s:e])), squeezed(times[s:e]), squeezed(d[s:e]), squeezed(p[s:e])) for s, e in zip(edge[:-1], edge[1:])]
            for k, s in enumerate(range(0, len(known_d), 1 << 16)):
                rows.append((int(known_p[s] + known_d[s] + k) % n_buckets, b"", b"", squeezed(known_d[s : s + (1 << 16)]), squeezed(known_p[s : s + (1 << 16)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["bucket", "hashes", "counts", "docs", "places"])

        n = 0
        for batch in batches:
            data, offsets = flat(batch.column(1))
            docs = batch.column(0).to_numpy()
            at, h = anchors(data, offsets)
            if len(at):
                row = np.searchsorted(offsets, at, "right") - 1
                held.append((h, docs[row], (at - offsets[row]).astype(np.int32)))
                n += len(at)
                if n >= FLUSH:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()
        trim()

    return run


def _by_doc(docs: np.ndarray, values: list[np.ndarray], names: list[str]) -> pa.Table:
    """A row for each document with a list for each of ``values``."""
    order = np.argsort(docs, kind="stable")
    docs = docs[order]
    first = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    offsets = pa.array(np.append(first, len(docs)).astype(np.int32))
    return pa.table([pa.array(docs[first], pa.int64()), *(pa.ListArray.from_arrays(offsets, pa.array(v[order].astype(np.int32))) for v in values)], names=["doc", *names])


def _to_docs(docs: np.ndarray, values: list[np.ndarray], names: list[str], n_targets: int) -> pa.Table:
    """What was found, in a row for each range of documents that it goes to."""
    target = _bucket(mix(docs.view(U)), n_targets)
    order = np.argsort(target, kind="stable")
    target = target[order]
    edge = np.flatnonzero(np.diff(target, prepend=-1, append=-1))
    columns = [docs[order], *(v[order].astype(np.int32) for v in values)]
    rows = [(int(target[s]), *(squeezed(c[s:e]) for c in columns)) for s, e in zip(edge[:-1], edge[1:])]
    return pa.table([pa.array([r[i] for r in rows], pa.binary() if i else pa.int64()) for i in range(len(columns) + 1)], names=["target", "docs", *names])


def _gather(t: pa.Table) -> pa.Table:
    """A row for each document of one range, with all that was found in it."""
    names = t.column_names[2:]
    docs = np.concatenate([unsqueezed(x, np.int64) for x in t["docs"].to_pylist()])
    return _by_doc(docs, [np.concatenate([unsqueezed(x, np.int32) for x in t[c].to_pylist()]) for c in names], names)


def _find_repeated(t: pa.Table, n_targets: int, many_places: int) -> pa.Table:
    hashes = [np.cumsum(unsqueezed(x, U), dtype=U) if x else np.zeros(0, U) for x in t["hashes"].to_pylist()]
    docs = [unsqueezed(x, np.int64) for x in t["docs"].to_pylist()]
    places = [unsqueezed(x, np.int32) for x in t["places"].to_pylist()]
    known = [i for i, h in enumerate(hashes) if not len(h)]
    fresh = [i for i, h in enumerate(hashes) if len(h)]
    d, p = [docs[i] for i in known], [places[i] for i in known]
    often = None
    if fresh:
        h, hd, hp = (np.concatenate([x[i] for i in fresh]) for x in (hashes, docs, places))
        order = np.argsort(h)
        times = np.concatenate([unsqueezed(x, np.int32) for x in t["counts"].to_pylist() if x])[order].astype(np.int64)
        h, hd, hp = h[order], hd[order], hp[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.add.reduceat(times, head)
        hot = total >= many_places
        if hot.any():
            often = squeezed(h[head][hot].view(np.int64)), squeezed(np.minimum(total[hot], 2**31 - 1).astype(np.int32))
        same = h[1:] == h[:-1]
        many = np.zeros(len(h), bool)
        many[1:] |= same
        many[:-1] |= same
        many &= hp >= 0
        d, p = [*d, hd[many]], [*p, hp[many]]
    out = _to_docs(np.concatenate(d), [np.concatenate(p)], ["places"], n_targets)
    return pa.concat_tables([out, pa.table(dict(zip(out.column_names, ([GRAMS], *([x] for x in often)))), schema=out.schema)]) if often else out


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for h, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(unsqueezed(h, np.int64)), pa.array(unsqueezed(n, np.int32))], ["gram", "n"])


RUN_ROWS = "bucket long, shared binary, rest binary, docs binary, places binary"


def window_hashes(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each place of the anchor in a window: how many bytes stand before it, and the hash of that window of every key."""
    text = np.ascontiguousarray(np.concatenate([key[:, WINDOW:][:, ::-1], key[:, :WINDOW]], axis=1).T)
    h = np.zeros(len(key), U)
    for t in range(WINDOW):
        h = h + BYTE_CODE[text[LEFT + t]] * U(pow(_B, t, 2**64))
    far = U(pow(_B, WINDOW, 2**64))
    for j in range(LEFT + 1):
        if j:
            h = h * U(_B) + BYTE_CODE[text[LEFT - j]] - BYTE_CODE[text[LEFT - j + WINDOW]] * far
        yield j, mix(h)


def earliest(h: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of windows by hash, document and start: those that are the first of their hash, and the others."""
    order = np.lexsort((starts, docs, h))
    new = np.ones(len(order), bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    of = order[new][np.cumsum(new) - 1]
    own = new | (docs[order] == docs[of]) & (starts[order] == starts[of])
    return order[new], order[~own]


def _joined(docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of what windows cover together."""
    order = np.lexsort((starts, docs))
    docs, starts = docs[order], starts[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > starts[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(docs))[: len(first)] - 1
    return docs[first], starts[first], starts[last] + WINDOW


def _send_runs(n_buckets: int, hot: np.ndarray = np.zeros(0, U)):
    columns = np.concatenate([np.arange(WINDOW), -1 - np.arange(LEFT)])

    def suffixes(data, start, end, at):
        place = at[:, None] + columns
        outside = (place < start[:, None]) | (place >= end[:, None])
        key = data[np.clip(place, 0, max(0, len(data) - 1))]
        key[outside] = OUTSIDE
        return key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, d, p, h = (np.concatenate(x) for x in zip(*held))
            held.clear()
            rows = []
            if len(hot):
                often = hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h
                if often.any():
                    rows += _window_rows(key[often], d[often], p[often], n_buckets)
                    key, d, p, h = key[~often], d[~often], p[~often], h[~often]
            if len(key):
                rows += suffix_rows(key, d, p, h)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), *[pa.binary()] * 4))], ["bucket", "shared", "rest", "docs", "places"])

        def suffix_rows(key, d, p, h) -> list[tuple]:
            bucket = _bucket(h, n_buckets)
            raw = key.tobytes()
            whole = list(zip(bucket.tolist(), [raw[i : i + WIDTH] for i in range(0, len(raw), WIDTH)], d.tolist(), p.tolist()))
            order = np.array(sorted(range(len(whole)), key=whole.__getitem__), np.int64)
            del raw, whole
            key, d, p, bucket = key[order], d[order], p[order], bucket[order]
            differs = key[1:] != key[:-1]
            shared = np.zeros(len(key), np.int64)
            shared[1:] = np.where(differs.any(1), differs.argmax(1), WIDTH)
            shared[1:][bucket[1:] != bucket[:-1]] = 0
            copy = shared == WIDTH
            own_l, own_r = _inside(key)
            first = np.maximum.accumulate(np.where(copy, 0, np.arange(len(key))))
            gone = copy & (own_l + own_r >= WINDOW) & ((d != d[first]) | (p != p[first]))
            x = np.flatnonzero(gone)
            rows = _span_rows(d[x], p[x] - own_l[x], p[x] + own_r[x], n_buckets)
            keep = ~copy
            key, d, p, bucket, shared = key[keep], d[keep], p[keep], bucket[keep], shared[keep]
            edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for s, e in zip(edge[:-1], edge[1:]):
                k = shared[s:e].astype(np.uint8)
                rest = key[s:e][np.arange(WIDTH) >= k[:, None]]
                rows.append((int(bucket[s]), squeezed(k), squeezed(rest), squeezed(d[s:e]), squeezed(p[s:e])))
            return rows

        n = 0
        for batch in batches:
            data, offsets = flat(batch.column(1))
            docs = batch.column(0).to_numpy()
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            at_all = lists.flatten().to_numpy()
            row_all = np.repeat(np.arange(len(docs)), sizes)
            for s in range(0, len(at_all), 1 << 13):
                at, row = at_all[s : s + (1 << 13)].astype(np.int64), row_all[s : s + (1 << 13)]
                fits = at + GRAM <= (offsets[row + 1] - offsets[row])
                at, row = at[fits], row[fits]
                if not len(at):
                    continue
                key = suffixes(data, offsets[row], offsets[row + 1], offsets[row] + at)
                h = np.zeros(len(key), U)
                for i in range(GRAM):
                    h = h * U(_B) + BYTE_CODE[key[:, i]]
                held.append((key, docs[row], at.astype(np.int32), mix(mix(h) ^ AGAIN)))
                n += len(at)
                if n >= FLUSH // 8:
                    yield from flush()
                    n = 0
        if held:
            yield from flush()
        trim()

    return run


def _span_rows(docs: np.ndarray, lo: np.ndarray, hi: np.ndarray, n_buckets: int) -> list[tuple]:
    """Spans known to be repeated, on their way to any bucket."""
    rows = []
    for s in range(0, len(docs), 1 << 16):
        own = slice(s, s + (1 << 16))
        span = np.concatenate([lo[own], hi[own]]).astype(np.int32)
        rows.append(((abs(int(docs[s])) + int(lo[s])) % n_buckets, b"", b"", squeezed(docs[own]), squeezed(span)))
    return rows


def _window_rows(key: np.ndarray, d: np.ndarray, p: np.ndarray, n_buckets: int) -> list[tuple]:
    """The windows around anchors, each once, by their hash; where a task sees one again, it is known to be repeated."""
    own_l, own_r = _inside(key)
    h, of, starts = [], [], []
    for j, m in window_hashes(key):
        x = np.flatnonzero((own_l >= j) & (own_r >= WINDOW - j))
        h.append(m[x])
        of.append(x)
        starts.append(p[x].astype(np.int64) - j)
    h, of, starts = (np.concatenate(x) for x in (h, of, starts))
    first, again = earliest(h, d[of], starts)
    rows = _span_rows(*_joined(d[of[again]], starts[again]), n_buckets)
    bucket = _bucket(h[first], n_buckets)  # in order, as ``first`` is by hash
    edge = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
    for s, e in zip(edge[:-1], edge[1:]):
        x = first[s:e]
        rows.append((int(bucket[s]), WINDOWS, squeezed(_gaps(h[x])), squeezed(d[of[x]]), squeezed(starts[x].astype(np.int32))))
    return rows


def _inside(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far the text goes to the left and to the right of each anchor, as far as the key shows."""
    return (key[:, WINDOW:] != OUTSIDE).sum(1), (key[:, :WINDOW] != OUTSIDE).sum(1)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix of two equally long strings that share ``known`` bytes."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return len(a) - (x.bit_length() + 7) // 8


def front_decoded(shared: bytes, rest: bytes) -> Iterator[tuple[bytes, int]]:
    """The strings of a front-coded run, each with the prefix it shares with the one before."""
    key, at = b"", 0
    for k in shared:
        key = key[:k] + rest[at : at + WIDTH - k]
        at += WIDTH - k
        yield key, k


def merge_runs(runs: list[Iterator[tuple[bytes, int]]]) -> Iterator[tuple[bytes, int, int]]:
    """Merge sorted runs by a loser tree; yields (string, prefix shared with the last output, run).

    Each stream has the length of the prefix that its head shares with the last
    output.  The longer one wins a match without a look at a byte; only equal
    lengths are compared, from that length on.
    """
    n = len(runs)
    if not n:
        return
    heads: list[bytes] = [b""] * n
    known = [0] * n
    for s, run in enumerate(runs):
        heads[s], known[s] = next(run, (b"", -1))
        known[s] = min(known[s], 0)

    def match(s: int, t: int) -> tuple[int, int]:
        """Winner and loser; the loser's length is brought up to date."""
        if known[s] != known[t]:
            return (s, t) if known[s] > known[t] else (t, s)
        if known[s] < 0:
            return s, t
        a, b = heads[s], heads[t]
        common = common_prefix(a, b, known[s])
        if a < b or a == b and s < t:
            known[t] = common
            return s, t
        known[s] = common
        return t, s

    losers = [-1] * (2 * n)

    def build(node: int) -> int:
        if node >= n:
            return node - n
        win, losers[node] = match(build(2 * node), build(2 * node + 1))
        return win

    win = build(1) if n > 1 else 0
    while known[win] >= 0:
        yield heads[win], known[win], win
        heads[win], known[win] = next(runs[win], (b"", -1))
        node = (win + n) >> 1
        while node:
            t = losers[node]
            ks, kt = known[win], known[t]
            if ks < kt:
                win, losers[node] = t, win
            elif ks == kt and ks >= 0:
                win, losers[node] = match(win, t)
            node >>= 1


def covered(key: np.ndarray, docs: np.ndarray, places: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, starts and ends of what sorted suffixes show to stand earlier."""
    n = len(key)
    own_l, own_r = _inside(key)
    order = np.lexsort((places, docs))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    head = np.flatnonzero(shared < WIDTH)
    cls = np.cumsum(shared < WIDTH) - 1
    best = np.minimum.reduceat(rank, head)
    rep = order[best]
    of = rep[cls]
    full = (own_l + own_r >= WINDOW) & ((docs != docs[of]) | (places != places[of]))
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    lo[full], hi[full] = (places - own_l)[full], (places + own_r)[full]
    joins = shared[head] >= GRAM
    mates = joins.copy()
    mates[:-1] |= joins[1:]
    x = rep[mates]
    if len(x):
        x = x[np.argsort(rank[x])]
        for j, m_all in window_hashes(key[x]):
            fits = np.flatnonzero((own_l[x] >= j) & (own_r[x] >= WINDOW - j))
            if len(fits) < 2:
                continue
            m = m_all[fits]
            o = np.argsort(m, kind="stable")
            later = fits[o[1:][m[o[1:]] == m[o[:-1]]]]
            at = x[later]
            start = places[at] - j
            lo[at] = start
            hi[at] = np.maximum(hi[at], start + WINDOW)
    hit = lo >= 0
    return docs[hit], lo[hit], hi[hit]


def _merge_bucket(t: pa.Table, n_targets: int) -> pa.Table:
    d, lo, hi, runs, windows = [], [], [], [], []
    for shared, rest, docs, places in zip(*(t[c].to_pylist() for c in ("shared", "rest", "docs", "places"))):
        if shared == WINDOWS:
            windows.append((np.cumsum(unsqueezed(rest, U), dtype=U), unsqueezed(docs, np.int64), unsqueezed(places, np.int32).astype(np.int64)))
        elif shared:
            runs.append((unsqueezed(shared, np.uint8).tobytes(), unsqueezed(rest, np.uint8).tobytes(), unsqueezed(docs, np.int64), unsqueezed(places, np.int32)))
        else:
            span = unsqueezed(places, np.int32).reshape(2, -1)
            d.append(unsqueezed(docs, np.int64))
            lo.append(span[0].astype(np.int64))
            hi.append(span[1].astype(np.int64))
    if windows:
        h, wd, ws = (np.concatenate(x) for x in zip(*windows))
        _, again = earliest(h, wd, ws)
        for into, x in zip((d, lo, hi), _joined(wd[again], ws[again])):
            into.append(x)
    if runs:
        text, common, of = [], [], []
        for key, k, r in merge_runs([front_decoded(s, x) for s, x, _, _ in runs]):
            text.append(key)
            common.append(k)
            of.append(r)
        key = np.frombuffer(b"".join(text), np.uint8).reshape(-1, WIDTH)
        del text
        of = np.array(of)
        docs, places = np.empty(len(of), np.int64), np.empty(len(of), np.int64)
        for r, (_, _, rd, rp) in enumerate(runs):
            docs[of == r], places[of == r] = rd, rp
        common = np.array(common)
        common[0] = 0
        found = covered(key, docs, places, common)
        for into, x in zip((d, lo, hi), found):
            into.append(x)
        del key, runs, found
        trim()
    return _to_docs(np.concatenate(d), [np.concatenate(lo), np.concatenate(hi)], ["starts", "ends"], n_targets)


def repeated_spans(bodies: DataFrame, n_bytes: int, many_places: int = HOT) -> DataFrame:
    """(doc, starts, ends): unmerged spans of ``bodies`` (doc long, body binary) that stand earlier."""
    small_batches(bodies.sparkSession)
    n_buckets = parts_for(n_bytes, BUCKET_BYTES)
    repeated = bodies.mapInArrow(_send_anchors(n_buckets), ANCHOR_ROWS).groupBy("bucket").applyInArrow(lambda t: _find_repeated(t, n_buckets, many_places), "target long, docs binary, places binary")
    repeated = written(repeated, "repeated")
    grams = repeated.where(F.col("target") == GRAMS).select("docs", "places").mapInArrow(_grams, "gram long, n int")
    hot = np.sort(np.array([r["gram"] for r in grams.orderBy(F.desc("n"), "gram").limit(HOT_MOST).collect()], np.int64).view(U))  # at most HOT_MOST numbers
    places = repeated.where(F.col("target") != GRAMS).groupBy("target").applyInArrow(_gather, "doc long, places array<int>")
    return (
        bodies.join(places, "doc").select("doc", "body", "places").mapInArrow(_send_runs(n_buckets, hot), RUN_ROWS)
        .groupBy("bucket").applyInArrow(lambda t: _merge_bucket(t, n_buckets), "target long, docs binary, starts binary, ends binary")
        .groupBy("target").applyInArrow(_gather, "doc long, starts array<int>, ends array<int>")
    )


def merged(starts: np.ndarray, ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint maximal spans, clipped to ``size`` bytes."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.minimum(np.maximum.accumulate(ends[order]), size)
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(s)) - 1
    return s[first], e[last]


def _cut(size: int, spans) -> tuple[np.ndarray, np.ndarray]:
    if spans is None or not len(spans[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return merged(np.asarray(spans[0], np.int64), np.asarray(spans[1], np.int64), size)


def kept_bytes(body: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    if not len(s):
        return body
    edges = [0, *np.stack([s, e], 1).ravel().tolist(), len(body)]
    return b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _spans_of(batch: pa.RecordBatch, i_start: int) -> list:
    """For each row its starts and ends, or None."""
    lists = [batch.column(i) for i in (i_start, i_start + 1)]
    flats = [x.flatten().to_numpy() for x in lists]
    offs = [x.offsets.to_numpy() - x.offsets[0].as_py() if len(x) else np.zeros(1, int) for x in lists]
    void = lists[0].is_null().to_numpy(zero_copy_only=False)
    sizes = np.where(void, 0, np.diff(offs[0]))
    ends = np.cumsum(sizes)
    return [None if v or not n else (flats[0][e - n : e], flats[1][e - n : e]) for v, n, e in zip(void, sizes, ends)]


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        raw = memoryview(data)
        out = []
        for doc, spans, a, b in zip(batch.column(0).to_pylist(), _spans_of(batch, 2), offsets[:-1].tolist(), offsets[1:].tolist()):
            s, e = _cut(b - a, spans)
            digest = hashlib.sha256()
            edges = [0, *np.stack([s, e], 1).ravel().tolist(), b - a] if len(s) else [0, b - a]
            for x, y in zip(edges[::2], edges[1::2]):
                digest.update(raw[a + x : a + y])
            out.append((None if doc == NULL_ID else doc, b - a, int((e - s).sum()), len(s), digest.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*[pa.int64()] * 4, pa.string()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def bodies_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc, body) of numbered documents."""
    return docs.select(F.col("__tl_doc").alias("doc"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("body"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with what stands earlier cut from the texts; a code point that a cut would split goes whole.

    Every row and column stays; ``size_col``, if there, gets the new number of code points.
    """
    keyed, _ = numbered(docs, id_col, text_col)
    spans = repeated_spans(bodies_of(keyed, text_col), total_bytes(docs, text_col)).toDF("__tl_doc", "__tl_starts", "__tl_ends")
    names = docs.columns
    at = names.index(text_col)
    n_at = names.index(size_col) if size_col in names else None

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(at))
            texts = []
            for spans, old, a, b in zip(_spans_of(batch, batch.num_columns - 2), batch.column(at).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                s, e = _cut(b - a, spans)
                texts.append(old if not len(s) else kept_bytes(data[a:b].tobytes(), s, e).decode("utf-8", "ignore"))
            arrays = [*batch.columns[:-3]]
            arrays[at] = pa.array(texts, pa.string())
            if n_at is not None:
                arrays[n_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(batch.column(n_at).type)
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    joined = keyed.join(spans, "__tl_doc", "left")
    return joined.select(*names, "__tl_doc", "__tl_starts", "__tl_ends").mapInArrow(cut, docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    keyed, ids = numbered(docs, "doc_id", "text")
    bodies = bodies_of(keyed)
    spans = repeated_spans(bodies, total_bytes(docs, "text"))
    out = bodies.join(spans, "doc", "left").select("doc", "body", "starts", "ends").mapInArrow(_digests, DIGEST)
    if ids is None:
        return out
    back = ids.select(F.col("__tl_doc").alias("doc_id"), F.nullif(F.col("id"), F.lit(NULL_ID)).alias("id"))
    return out.join(back, "doc_id").select(F.col("id").alias("doc_id"), *out.columns[1:])
