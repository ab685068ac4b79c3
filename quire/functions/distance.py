"""Edit distances of many pairs at once (I1), by Myers' bit vectors: a column of the table of distances
is a word of 64 bits for every 64 places of the shorter side, and one step takes a column of thousands
of pairs. Long pairs go one by one, with whole numbers as long as they are. All distances are exact."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs of a step; places of a side from which on a pair goes alone; symbols of a table of places.
PAIRS, LONG, SYMBOLS = 2048, 1024, 256
ONE = np.uint64(1)


def one_distance(p: np.ndarray, t: np.ndarray) -> int:
    """Edit distance of two sequences of codes."""
    places: dict[int, int] = {}
    for i, c in enumerate(p.tolist()):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(p)) - 1
    up, down = full, 0
    for c in t.tolist():
        eq = places.get(c, 0)
        v = eq | down
        x = (((eq & up) + up) ^ up) | eq
        plus, minus = (down | ~(x | up)) << 1 | 1, (up & x) << 1
        up, down = (minus | ~(v | plus)) & full, plus & v & full
    return len(t) + up.bit_count() - down.bit_count()


def _unlike(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What two sequences hold between a common beginning and a common end."""
    for _ in range(2):
        k = min(len(x), len(y))
        other = np.flatnonzero(x[:k] != y[:k])
        at = int(other[0]) if len(other) else k
        x, y = x[at:][::-1], y[at:][::-1]
    return x, y


def _table(codes: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(lengths), width), codes.dtype)
    out[np.arange(width) < lengths[:, None]] = codes
    return out


def _steps(p: np.ndarray, m: np.ndarray, t: np.ndarray, n: np.ndarray, symbols: int) -> np.ndarray:
    """Distances of rows of p (m places used) and t (n used, longest first); codes from 1 to symbols."""
    rows, blocks = len(m), -(-int(m.max()) // 64)
    if symbols <= SYMBOLS:
        places = np.zeros((blocks, rows * (symbols + 1)), np.uint64)
        base = np.arange(rows) * (symbols + 1)
        for i in range(int(m.max())):
            at = base + p[:, i]
            flat = places[i >> 6]
            flat[at] |= ONE << np.uint64(i & 63)
        places[:, base] = 0  # code 0 stands behind the end
    else:
        wide = np.zeros((rows, 64 * blocks), p.dtype)
        wide[:, : p.shape[1]] = p[:, : 64 * blocks]
    full = ~np.uint64(0)
    up, down = np.full((blocks, rows), full), np.zeros((blocks, rows), np.uint64)
    steps = int(n.max())
    live = np.searchsorted(-n, -np.arange(steps), side="left")  # rows with more than j places
    turned = np.ascontiguousarray(t.T)
    for j in range(steps):
        k = int(live[j])
        c = turned[j, :k]
        if symbols <= SYMBOLS:
            at = base[:k] + c
        else:
            eqs = np.packbits(wide[:k] == c[:, None], axis=1, bitorder="little").view("<u8")
        plus_in, minus_in = ONE, None
        for b in range(blocks):
            eq = places[b].take(at) if symbols <= SYMBOLS else eqs[:, b]
            u, d = up[b, :k], down[b, :k]
            v = eq | d
            if minus_in is not None:
                eq = eq | minus_in
            x = eq & u
            x += u
            x ^= u
            x |= eq
            minus = u & x
            plus = x
            plus |= u
            np.invert(plus, out=plus)
            plus |= d
            if b + 1 < blocks:
                plus_out, minus_out = plus >> np.uint64(63), minus >> np.uint64(63)
            plus <<= ONE
            plus |= plus_in
            minus <<= ONE
            if minus_in is not None:
                minus |= minus_in
            np.bitwise_and(plus, v, out=d)
            v |= plus
            np.invert(v, out=v)
            np.bitwise_or(minus, v, out=u)
            if b + 1 < blocks:
                plus_in, minus_in = plus_out, minus_out
    out = n.astype(np.int64)
    for b in range(blocks):
        used = np.clip(m - 64 * b, 0, 64)
        mask = np.where(used > 0, full >> (64 - np.maximum(used, 1)).astype(np.uint64), np.uint64(0))
        out += np.bitwise_count(up[b] & mask).astype(np.int64) - np.bitwise_count(down[b] & mask)
    return out


def distances(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of sequences, each side given as all its codes (above 0) in a row and
    the lengths of its sequences."""
    ea, eb = np.cumsum(la), np.cumsum(lb)
    sa, sb = ea - la, eb - lb
    out = np.maximum(la, lb).astype(np.int64)  # right where a side is empty
    short = np.flatnonzero((np.minimum(la, lb) > 0) & (out <= LONG))
    for i in np.flatnonzero((np.minimum(la, lb) > 0) & (out > LONG)):
        x, y = _unlike(a[sa[i] : ea[i]], b[sb[i] : eb[i]])
        out[i] = one_distance(*sorted((x, y), key=len))
    for at in range(0, len(short), PAIRS):
        rows = short[at : at + PAIRS]
        held = []
        for codes, start, length in ((a, sa, la), (b, sb, lb)):
            n = length[rows]
            where = np.repeat(start[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())
            held.append((codes[where], n))
        seen, codes = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        codes = codes.astype(np.uint8 if len(seen) < 256 else np.int32) + 1 if len(seen) != 255 else codes.astype(np.int32) + 1
        cut = len(held[0][0])
        width = int(out[rows].max())
        x, y = _table(codes[:cut], held[0][1], width), _table(codes[cut:], held[1][1], width)
        m, n = held[0][1], held[1][1]
        same = (m == n) & (x == y).all(axis=1)
        out[rows[same]] = 0
        other = np.flatnonzero(~same)
        swap = (m > n)[:, None]
        p, t = np.where(swap, y, x), np.where(swap, x, y)
        m, n = np.minimum(m, n), np.maximum(m, n)
        blocks = -(-m // 64)
        for k in np.unique(blocks[other]):
            some = other[blocks[other] == k]
            some = some[np.argsort(-n[some], kind="stable")]
            out[rows[some]] = _steps(p[some], m[some], t[some], n[some], len(seen))
    return out


def _chars(c: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(c.to_pylist()).encode("utf-32-le"), "<u4")
    return codes, pc.utf8_length(c).to_numpy(zero_copy_only=False).astype(np.int64)


def _words(c: pa.Array) -> tuple[pa.Array, np.ndarray]:
    parts = pc.split_pattern(c, " ")
    flat = parts.flatten()
    kept = pc.not_equal(flat, "")
    n = np.add.reduceat(np.append(kept.to_numpy(zero_copy_only=False), False).astype(np.int64), parts.offsets.to_numpy()[:-1]) if len(c) else np.zeros(0, np.int64)
    return flat.filter(kept), n


def _as_strings(s: pd.Series) -> pa.Array:
    return pa.array(s, pa.string(), from_pandas=True)


@F.pandas_udf(T.LongType())
def char_distance(r: pd.Series, h: pd.Series) -> pd.Series:
    """Edit distance of two texts in code points (I1); null where either is."""
    a, b = _as_strings(r), _as_strings(h)
    known = pc.and_(a.is_valid(), b.is_valid())
    out = distances(*_chars(a.filter(known)), *_chars(b.filter(known)))
    return _spread(out, known)


@F.pandas_udf(T.LongType())
def word_distance(r: pd.Series, h: pd.Series) -> pd.Series:
    """Edit distance of two texts in words between single spaces (I1); null where either is."""
    a, b = _as_strings(r), _as_strings(h)
    known = pc.and_(a.is_valid(), b.is_valid())
    (x, m), (y, n) = _words(a.filter(known)), _words(b.filter(known))
    codes = pa.concat_arrays([x, y]).dictionary_encode().indices.to_numpy(zero_copy_only=False) + 1
    out = distances(codes[: len(x)], m, codes[len(x) :], n)
    return _spread(out, known)


def _spread(values: np.ndarray, known: pa.Array) -> pd.Series:
    at = known.to_numpy(zero_copy_only=False)
    out = pd.Series(pd.array(np.zeros(len(at), np.int64), "Int64"))
    out[at] = values
    out[~at] = pd.NA
    return out
