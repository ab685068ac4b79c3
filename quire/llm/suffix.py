"""Exact removal of repeated 50-byte strings by a hash-compared suffix sort.

Text is dealt out in chunks of documents. Every 50-byte window is filed under the smallest hash of
its 22-byte grams (a content-defined key: equal windows have equal keys), and runs of windows with
one key form a segment. Three passes over the same chunked text follow:

1. keys that only one document has are dropped: each chunk sends its distinct keys to buckets, each
   bucket answers with a bit mask. A key under which very many different segments stand (around a
   line that many documents share) is split: its windows go to buckets under their own hashes, and
   those that only one document has are dropped too;
2. the segments under the other keys go to buckets, once per chunk and text, with their smallest
   document; there the suffixes at the ends of segments are sorted, which brings equal segments
   together, and then all windows of unequal segments under one key. The sort is a mergesort whose comparisons find the common extension of
   two suffixes by binary search over prefix polynomial hashes; the resulting order is verified on
   the bytes themselves, and sorted by bytes if a hash collision ever broke it. Windows equal to one
   of a smaller document are answered per segment as a bit mask;
3. each chunk turns the answers into removed bytes.

Chunks, buckets and arrays are of bounded size; a hot passage reaches a bucket once per chunk. Buckets
are of ``bucket_bytes`` up to 4096 of them, then grow to 16 times that, so that a row from a chunk to a
bucket holds several segments for longer.

Defined results: a null or empty text has 0 bytes and the sha256 of no bytes. Rows that repeat a
doc_id don't remove each other's bytes; a null doc_id counts as larger than every other. Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPAN, GRAM = 50, 22
WIDE, STEP, SLICE = SPAN - GRAM + 1, 1 << 15, 6_000
LAST = (1 << 63) - 1
_U = np.uint64
_tables: dict = {}


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(29)
    x *= _U(0xBF58476D1CE4E5B9)
    return x ^ (x >> _U(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte values, powers of the base and of its inverse modulo 2**64, for n positions."""
    if len(_tables.get("up", ())) < n:
        base = 0xD1342543DE82EF95
        _tables["byte"] = _mix(np.arange(1, 257, dtype=_U) * _U(0xA24BAED4963EE407))
        for name, b in (("up", base), ("down", pow(base, -1, 1 << 64))):
            p = np.full(max(n, 1 << 16), b, _U)
            p[0] = 1
            _tables[name] = np.multiply.accumulate(p)
    return _tables["byte"], _tables["up"][:n], _tables["down"][:n]


def _prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes; (P[i + n] - P[i]) * down[i] is the hash of n bytes from i."""
    byte, up, down = _powers(len(buf) + 1)
    p = np.zeros(len(buf) + 1, _U)
    np.cumsum(byte[buf] * up[:-1], out=p[1:])
    return p, down


def _least(h: np.ndarray) -> np.ndarray:
    """Minimum over WIDE neighbours from each position."""
    n = 1
    out = h
    while 2 * n <= WIDE:
        out = np.minimum(out[:-n], out[n:])
        n *= 2
    return np.minimum(out[: len(out) - (WIDE - n)], out[WIDE - n :]) if WIDE > n else out


class _Chunk:
    """The documents of a chunk and their segments, in a fixed order."""

    def __init__(self, rows: pa.Table) -> None:
        # one order in every pass, whatever order the rows arrived in
        held = sorted((LAST if i is None else i, x or b"", i is None) for i, x in zip(rows.column("doc_id").to_pylist(), rows.column("text").to_pylist()))
        texts = [x for _, x, _ in held]
        self.ids = [None if null else i for i, _, null in held]
        self.known = np.array([i for i, _, _ in held], np.int64)
        self.text = b"".join(texts)
        self.ends = np.cumsum([len(x) for x in texts], dtype=np.int64)
        self.begins = self.ends - [len(x) for x in texts]
        buf = np.frombuffer(self.text, np.uint8)
        found = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, _U)], [np.zeros(0, _U)]]
        for at in range(0, len(buf), STEP):
            part = buf[at : at + STEP + SPAN - 1]
            n = len(part) - SPAN + 1
            if n < 1:
                continue
            p, down = _prefix(part)
            key = _least(_mix((p[GRAM:] - p[:-GRAM]) * down[: len(p) - GRAM]))
            near = np.arange(np.searchsorted(self.ends, at, "right"), len(self.ends))
            ok, new = np.ones(n, bool), np.empty(n, bool)
            new[0], new[1:] = True, key[1:] != key[:-1]
            for d in near:
                a, b = int(self.ends[d]) - SPAN + 1 - at, int(self.ends[d]) - at
                if a >= n:
                    break
                ok[max(a, 0) : min(max(b, 0), n)] = False
                if b < n:
                    new[b] = True
            new[1:] |= ok[1:] != ok[:-1]
            s = np.flatnonzero(new)
            size = np.diff(np.append(s, n))
            use = ok[s]
            s, size = s[use], size[use]
            times = (size + 31) // 32
            if len(times) and times.max() > 1:
                rank = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                s, size = np.repeat(s, times) + 32 * rank, np.minimum(np.repeat(size, times) - 32 * rank, 32)
            for to, x in zip(found, (s + at, size, key[s], (p[s + size + SPAN - 1] - p[s]) * down[s])):
                to.append(x)
        self.segments = _Segments(self, *(np.concatenate(x) for x in found))

    def windows_of(self, segments: _Segments) -> _Segments:
        """Every window of segments, as a segment under its own hash."""
        offset = np.arange(segments.size.sum()) - np.repeat(np.cumsum(segments.size) - segments.size, segments.size)
        start = np.repeat(segments.start, segments.size) + offset
        byte, up, _ = _powers(SPAN)
        own = np.zeros(len(start), _U)
        buf = np.frombuffer(self.text, np.uint8)
        for k in range(SPAN):
            own += byte[buf[start + k]] * up[k]
        return _Segments(self, start, np.ones(len(start), np.int64), _mix(~own), own)

    def work(self, answers: pa.Table, n: int) -> tuple[_Segments, _Segments]:
        """Segments under shared keys, and windows shared by their own hash."""
        state = self.segments.answered(_told(answers, 1), n)
        wide = self.windows_of(self.segments.take(state == 2))
        return self.segments.take(state == 1), wide.take(wide.answered(_told(answers, 3), n) > 0) if len(wide.key) else wide


class _Segments:
    """Segments of a chunk sorted by key, with a hash of their text."""

    def __init__(self, chunk: _Chunk, start: np.ndarray, size: np.ndarray, key: np.ndarray, text: np.ndarray) -> None:
        self.chunk = chunk
        order = np.argsort(key, kind="stable")
        self.start, self.size, self.key, self.text = start[order], size[order], key[order], text[order]
        self.doc = np.searchsorted(chunk.ends, self.start, "right")
        new = np.ones(len(self.key), bool)
        new[1:] = self.key[1:] != self.key[:-1]
        self.head, self.of_key = np.flatnonzero(new), np.cumsum(new) - 1

    def take(self, which: np.ndarray) -> _Segments:
        i = np.flatnonzero(which)
        return _Segments(self.chunk, self.start[i], self.size[i], self.key[i], self.text[i])

    def questions(self, n: int) -> list[tuple[int, bytes, bytes, bytes, bytes]]:
        """Per bucket: keys; whether several documents have them; how many texts stand under them
        and a short hash of one text."""
        if not len(self.key):
            return []
        known = self.chunk.known[self.doc]
        many = np.minimum.reduceat(known, self.head) != np.maximum.reduceat(known, self.head)
        text = _mix(self.text)
        order = np.lexsort((text, self.of_key))
        new = np.ones(len(text), np.int64)
        new[1:] = (text[order][1:] != text[order][:-1]) | (self.of_key[order][1:] != self.of_key[order][:-1])
        count = np.minimum(np.add.reduceat(new, self.head), 255).astype(np.uint8)
        short = (text[order][self.head] >> _U(48)).astype(np.uint16)
        keys = self.key[self.head]
        low = (keys & _U(0xFFFFFFFF)).astype(np.uint32)
        return [(b, low[i:j].tobytes(), np.packbits(many[i:j]).tobytes(), count[i:j].tobytes(), short[i:j].tobytes()) for b, i, j in _buckets(keys, n)]

    def answered(self, told: dict[int, tuple[bytes, bytes]], n: int) -> np.ndarray:
        """Of every segment's key: 0 if one document has it, 2 if its windows go alone, else 1."""
        keys = self.key[self.head]
        out = np.zeros(len(keys), np.int8)
        for b, i, j in _buckets(keys, n):
            shared, split = (np.unpackbits(np.frombuffer(x, np.uint8), count=j - i) for x in told[b])
            out[i:j] = shared + (shared & split)
        return out[self.of_key]

    def texts(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct texts, their smallest documents and their keys; and each segment's text."""
        text, place, out, of, low, keys = self.chunk.text, {}, [], np.empty(len(self.key), np.int64), [], []
        for k, (s, m, d, key) in enumerate(zip(self.start.tolist(), self.size.tolist(), self.chunk.known[self.doc].tolist(), self.key.tolist())):
            x = text[s : s + m + SPAN - 1]
            i = place.setdefault(x, len(out))
            if i == len(out):
                out.append(x)
                low.append(d)
                keys.append(key)
            elif d < low[i]:
                low[i] = d
            of[k] = i
        return out, np.array(low, np.int64), np.array(keys, _U), of


def _buckets(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) over sorted keys."""
    if not len(keys):
        return []
    b = _bucket(keys, n)
    cuts = np.append(np.flatnonzero(np.diff(b, prepend=-1)), len(b))
    return [(int(b[i]), int(i), int(j)) for i, j in zip(cuts[:-1], cuts[1:])]


def _told(answers: pa.Table, kind: int) -> dict[int, tuple[bytes, bytes]]:
    return {b: (x, y) for b, k, x, y in zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "x", "y"))) if k == kind}


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)


def suffix_order(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of buf at ``at`` by their first SPAN bytes, and where in that order a
    suffix differs in them from the one before. Each has SPAN bytes at least."""
    n = len(at)
    p, down = _prefix(buf)
    eight = np.lib.stride_tricks.sliding_window_view(buf, 8)

    def word(i: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(eight[i]).view(">u8").ravel().astype(_U)

    def extension(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = np.zeros(len(i), np.int64)
        pi, pj, di, dj = p[i], p[j], down[i], down[j]
        for step in (32, 16, 8, 4, 2, 1):
            t = np.minimum(size + step, SPAN)
            same = (p[i + t] - pi) * di == (p[j + t] - pj) * dj
            size = np.where(same, t, size)
        return size

    def less(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        e = extension(i, j)
        k = np.minimum(e, SPAN - 1)
        return np.where(e == SPAN, i < j, buf[i + k] < buf[j + k])

    first = word(at)
    order = at[np.argsort(first, kind="stable")]
    first = np.sort(first, kind="stable")
    new = np.ones(n, bool)
    new[1:] = first[1:] != first[:-1]
    group = np.flatnonzero(new)
    sizes = np.diff(np.append(group, n))
    base, held = np.repeat(group, sizes), np.repeat(sizes, sizes)
    place, width = np.arange(n) - base, 1
    while len(sizes) and width < sizes.max():
        e = np.flatnonzero(held > width)  # of groups not yet in one run
        q, top, own = place[e], held[e], order[e]
        run = q // width
        left = np.minimum(run, run ^ 1) * width
        lo = np.minimum((run ^ 1) * width, top)
        begin, hi = lo.copy(), np.minimum(lo + width, top)
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            below = less(order[base[e[live]] + mid], own[live])
            lo[live] = np.where(below, mid + 1, lo[live])
            hi[live] = np.where(below, hi[live], mid)
            live = live[lo[live] < hi[live]]
        to = base[e] + left + (q - run * width) + (lo - begin)
        order = order.copy()
        order[to] = own
        width *= 2

    def differs(o: np.ndarray) -> tuple[np.ndarray, bool]:
        """By the bytes: where neighbours differ, and whether all are in order."""
        open_, ok, out = np.ones(max(n - 1, 0), bool), True, np.zeros(max(n - 1, 0), bool)
        for k in (0, 8, 16, 24, 32, 40, SPAN - 8):
            i = np.flatnonzero(open_)
            a, b = word(o[i] + k), word(o[i + 1] + k)
            ok &= bool((a <= b).all())
            out[i[a != b]] = True
            open_[i[a != b]] = False
        return np.append(True, out)[:n], ok

    parts, ok = differs(order)
    if not ok:
        order = at[np.lexsort([word(at + k) for k in (SPAN - 8, 40, 32, 24, 16, 8, 0)])]
        parts, _ = differs(order)
    return order, parts


ASK = "bucket long, chunk long, kind long, keys binary, many binary, count binary, short binary"
TOLD = "chunk long, bucket long, kind long, x binary, y binary"
PARTS = "bucket long, chunk long, kind long, texts binary, sizes binary, docs binary, keys binary"


def _rows(out: list[tuple], schema: str) -> pa.Table:
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table({c: pa.array([x[i] for x in out], kinds[k]) for i, (c, k) in enumerate(x.split() for x in schema.split(", "))})


def _passed(answers: pa.Table) -> list[tuple]:
    """Answers that go round with the next questions, so that no pass works them out again."""
    return list(zip(*(answers.column(c).to_pylist() for c in ("bucket", "kind", "x", "y"))))


def _ask_keys(n: int):
    def run(rows: pa.Table) -> pa.Table:
        chunk = rows.column("chunk")[0].as_py()
        return _rows([(b, chunk, 0, *rest) for b, *rest in _Chunk(rows).segments.questions(n)], ASK)

    return run


def _ask_windows(n: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _rows([], ASK)
        c, chunk = _Chunk(rows), rows.column("chunk")[0].as_py()
        split = c.segments.take(c.segments.answered(_told(answers, 1), n) == 2)
        asked = [(b, chunk, 0, *rest) for b, *rest in c.windows_of(split).questions(n)]
        return _rows(asked + [(b, chunk, k, x, y, None, None) for b, k, x, y in _passed(answers)], ASK)

    return run


def _answer_keys(kind: int, most_texts: int):
    def run(rows: pa.Table) -> pa.Table:
        old = pc.greater(rows.column("kind"), 0)
        out = [(r["chunk"], r["bucket"], r["kind"], r["keys"], r["many"]) for r in rows.filter(old).to_pylist()]
        rows = rows.filter(pc.invert(old))
        if not rows.num_rows:
            return _rows(out, TOLD)
        keys = [np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()]
        sizes = [len(k) for k in keys]
        many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(rows.column("many").to_pylist(), sizes)]).astype(bool)
        count = np.concatenate([np.frombuffer(x, np.uint8) for x in rows.column("count").to_pylist()]).astype(np.int64)
        short = np.concatenate([np.frombuffer(x, np.uint16) for x in rows.column("short").to_pylist()])
        _, of, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        several = times > 1
        several[of[many]] = True
        texts = np.bincount(of, weights=count - 1, minlength=len(times))
        pairs = np.unique(of.astype(np.int64) << 16 | short)  # distinct short hashes under a key
        texts += np.bincount(pairs >> 16, minlength=len(times))
        split = texts > most_texts
        cuts = np.cumsum(sizes)[:-1]
        masks = [[np.packbits(m).tobytes() for m in np.split(x[of], cuts)] for x in (several, split)]
        return _rows(out + list(zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist(), [kind] * len(keys), *masks)), TOLD)

    return run


def _send_segments(n: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            chunk = rows.column("chunk")[0].as_py()
            out += [(b, chunk, -k, x, y, None, None) for b, k, x, y in _passed(answers)]
            for kind, part in enumerate(_Chunk(rows).work(answers, n)):
                texts, low, keys, _ = part.texts()
                for b, i, j in _buckets(keys, n):
                    out.append((b, chunk, kind, pa.compress(b"".join(texts[i:j]), codec="zstd", asbytes=True), np.array([len(x) for x in texts[i:j]], np.uint8).tobytes(), low[i:j].tobytes(), (keys[i:j] & _U(0xFFFFFFFF)).astype(np.uint32).tobytes()))
        return _rows(out, PARTS)

    return run


def _equal(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The class of equal texts that each is in, and a text of every class. The suffixes at a text's
    first and last window are sorted; texts of one length whose two suffixes share SPAN bytes are equal,
    as no text is longer than two windows."""
    sizes = np.array([len(x) for x in texts], np.int64)
    first = np.cumsum(sizes) - sizes
    last = first + sizes - SPAN
    at = np.unique(np.concatenate([first, last]))
    order, parts = suffix_order(np.frombuffer(b"".join(texts), np.uint8), at)
    rank = np.empty(len(at), np.int64)
    rank[np.searchsorted(at, order)] = np.cumsum(parts) - 1
    both = (rank[np.searchsorted(at, first)] * len(at) + rank[np.searchsorted(at, last)]) * SPAN + sizes - SPAN
    _, one, of = np.unique(both, return_index=True, return_inverse=True)
    return of, one


def _answer_slice(texts: list[bytes], docs: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the smallest document that has it, and which of its windows a smaller one has."""
    of, one = _equal(texts)
    low = np.full(len(one), LAST, np.int64)
    np.minimum.at(low, of, docs)
    key = keys[one]
    mask = np.zeros(len(one), np.uint32)
    _, of_key, times = np.unique(key, return_inverse=True, return_counts=True)
    mixed = np.flatnonzero(times[of_key] > 1)
    if len(mixed):
        several = [texts[one[i]] for i in mixed]
        sizes = np.array([len(x) for x in several])
        begins = np.cumsum(sizes) - sizes
        windows = sizes - SPAN + 1
        seg = np.repeat(np.arange(len(several)), windows)
        offset = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begins[seg] + offset
        order, parts = suffix_order(np.frombuffer(b"".join(several), np.uint8), at)
        back = np.searchsorted(at, order)  # at is ascending
        own = low[mixed][seg[back]]
        heads = np.flatnonzero(parts)
        least = np.repeat(np.minimum.reduceat(own, heads), np.diff(np.append(heads, len(own))))
        hit = back[least < own]
        np.bitwise_or.at(mask, mixed[seg[hit]], np.uint32(1) << offset[hit].astype(np.uint32))
    return low[of], mask[of]


def _answer_segments(rows: pa.Table) -> pa.Table:
    old = pc.less(rows.column("kind"), 0)
    out = [(r["chunk"], r["bucket"], -r["kind"], r["texts"], r["sizes"]) for r in rows.filter(old).to_pylist()]
    rows = rows.filter(pc.invert(old))
    if not rows.num_rows:
        return _rows(out, TOLD)
    sizes = [np.frombuffer(x, np.uint8) for x in rows.column("sizes").to_pylist()]
    blobs = [pa.decompress(x, int(m.sum(dtype=np.int64)), codec="zstd", asbytes=True) for x, m in zip(rows.column("texts").to_pylist(), sizes)]
    docs = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("docs").to_pylist()])
    keys = np.concatenate([np.frombuffer(x, np.uint32) for x in rows.column("keys").to_pylist()])
    of = np.repeat(np.arange(len(sizes)), [len(m) for m in sizes])
    ends = np.concatenate([np.cumsum(m, dtype=np.int64) for m in sizes])
    begins = ends - np.concatenate(sizes)
    low, mask = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint32)
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.append(True, np.diff(keys[order]) > 0))
    cuts = np.unique(np.append(new[np.searchsorted(new, np.arange(0, len(keys), SLICE), "left").clip(max=len(new) - 1)], [0, len(keys)]))
    for a, b in zip(cuts[:-1], cuts[1:]):  # working memory for a slice of the keys at a time
        i = order[a:b]
        texts = [blobs[r][x:y] for r, x, y in zip(of[i].tolist(), begins[i].tolist(), ends[i].tolist())]
        low[i], mask[i] = _answer_slice(texts, docs[i], keys[i])
    cuts = np.cumsum([len(m) for m in sizes])[:-1]
    told = [[x.tobytes() for x in np.split(y, cuts)] for y in (low, mask)]
    return _rows(out + list(zip(rows.column("chunk").to_pylist(), rows.column("bucket").to_pylist(), [4 + k for k in rows.column("kind").to_pylist()], *told)), TOLD)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _removed(n: int, digest: bool):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if rows.num_rows:
            c = _Chunk(rows)
            edge = np.zeros(len(c.text) + 1, np.int32)
            for kind, part in enumerate(c.work(answers, n)):
                texts, _, keys, of = part.texts()
                low, mask, told = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.uint32), _told(answers, 4 + kind)
                for b, i, j in _buckets(keys, n):
                    low[i:j], mask[i:j] = np.frombuffer(told[b][0], np.int64), np.frombuffer(told[b][1], np.uint32)
                later = c.known[part.doc] > low[of]
                np.add.at(edge, part.start[later], 1)
                np.add.at(edge, part.start[later] + part.size[later] + SPAN - 1, -1)
                first, bits = part.start[~later], mask[of[~later]]
                first, bits = first[bits > 0], bits[bits > 0]
                for t in range(32):
                    s = first[(bits >> np.uint32(t)) & np.uint32(1) > 0] + t
                    np.add.at(edge, s, 1)
                    np.add.at(edge, s + SPAN, -1)
            gone = np.cumsum(edge[:-1]) > 0
            buf = np.frombuffer(c.text, np.uint8)
            for doc_id, a, b in zip(c.ids, c.begins.tolist(), c.ends.tolist()):
                g = gone[a:b]
                k = int(g.sum())
                kept = buf[a:b][~g].tobytes() if k else c.text[a:b]
                spans = int(np.count_nonzero(g[1:] & ~g[:-1])) + int(g[0]) if k else 0
                out.append((doc_id, b - a, k, spans, hashlib.sha256(kept).hexdigest().encode() if digest else kept))
        return _rows(out, RESULT)

    return run


def remove_repeats(docs: DataFrame, digest: bool = False, chunk_bytes: int = 1 << 20, bucket_bytes: int = 4 << 20, most_texts: int = 64) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept)`` per row: what is left of each document, or
    with ``digest`` its sha256 in hex as bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, buckets = max(256, -(-total // chunk_bytes)), max(128, min(-(-total // bucket_bytes), max(4096, -(-total // (16 * bucket_bytes)))))
    text = docs.select(F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.when(F.col("doc_id").isNull(), F.xxhash64("text"))), F.lit(chunks)).alias("chunk"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    grouped = lambda df: df.groupBy("chunk")
    first = text.groupBy("chunk").applyInArrow(_ask_keys(buckets), ASK).groupBy("bucket").applyInArrow(_answer_keys(1, most_texts), TOLD)
    windows = grouped(text).cogroup(grouped(first)).applyInArrow(_ask_windows(buckets), ASK)
    second = windows.groupBy("bucket").applyInArrow(_answer_keys(3, most_texts), TOLD)
    parts = grouped(text).cogroup(grouped(second)).applyInArrow(_send_segments(buckets), PARTS)
    third = parts.groupBy("bucket").applyInArrow(_answer_segments, TOLD)
    return grouped(text).cogroup(grouped(third)).applyInArrow(_removed(buckets, digest), RESULT)
