"""Language identification with hyperdimensional profiles.

Every letter has a random sign vector of its own, seeded by the letter, and three rotations of it by
its place in a trigram. A trigram's vector binds (multiplies) its letters' vectors; a text's vector
bundles (adds) those of its trigrams, and a language's prototype bundles its training texts. A text
is given the language whose prototype has the largest cosine with it.

Because bundling is a sum, the inner product of a text with a prototype is the sum over its trigrams
of each trigram's inner product with the prototype. So a batch of texts is reduced to its distinct
trigrams, whose vectors meet all prototypes in one matrix product; no vector is built for a text.
The text's own length divides all cosines alike and cancels in the choice and in the score, the best
cosine's share of the positive cosines.

Letters of all scripts count, in lower case; runs of anything else are one word boundary. The driver
and every worker hold ``DIM`` numbers for each language that was learned and nothing that grows with
the texts.

Defined results: ``und`` with score 0 for a null or empty text, one without letters, or if nothing
was learned; equal cosines go to the language that sorts first; a very long text is read in pieces
that overlap, with the same trigrams as a whole; one row per row, repeated or not; extra columns are
ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIM, SEED = 2048, 20241
PIECE = 1 << 20
#: Trigrams looked up at a time, and those whose vectors are built at a time.
BATCH, ROWS = 1 << 21, 1 << 13
#: No letter has a code point from here on.
LAST = 0x34000
UNIT = 1 << 20


@lru_cache
def folds() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what is no letter."""
    return np.array([ord(c.lower()[0]) if c.isalpha() else 0 for c in map(chr, range(LAST))] + [0], np.int32)


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Signs of each letter, a row for each."""
    return np.stack([np.random.default_rng([SEED, int(x)]).integers(0, 2, DIM, np.int8) * 2 - 1 for x in letters]).astype(np.int8)


def trigrams(text: str, fold: np.ndarray, piece: int = PIECE) -> Iterator[np.ndarray]:
    """Trigrams of a text with a boundary at either end, three code points in one number, in pieces;
    each piece goes on from the last two letters of the one before."""
    tail = np.zeros(1, np.int64)
    for at in range(0, len(text), piece):
        cp = np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.concatenate([tail, fold[np.minimum(cp, LAST)], [0] if at + piece >= len(text) else []]).astype(np.int64)
        c = c[np.append(True, (c[1:] > 0) | (c[:-1] > 0))]
        yield c[:-2] << 42 | c[1:-1] << 21 | c[2:]
        tail = c[-2:]


class Letters:
    """Letters' vectors, each made once in a task."""

    def __init__(self) -> None:
        self.known, self.rows = {}, np.zeros((0, DIM), np.int8)

    def bound(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of trigrams."""
        parts = [codes >> 42, codes >> 21 & 0x1FFFFF, codes & 0x1FFFFF]
        new = [x for x in np.unique(np.concatenate(parts)).tolist() if x not in self.known]
        if new:
            self.known.update((x, len(self.rows) + i) for i, x in enumerate(new))
            self.rows = np.concatenate([self.rows, letter_vectors(np.array(new))])
        out = None
        for place, part in zip((2, 1, 0), parts):
            own, of = np.unique(part, return_inverse=True)
            v = np.roll(self.rows[[self.known[x] for x in own.tolist()]], place, axis=1)[of]
            out = v if out is None else out * v
        return out.astype(np.float32)


def bundle(codes: np.ndarray, letters: Letters | None = None) -> np.ndarray:
    """Hypervector of all these trigrams."""
    own, times = np.unique(codes, return_counts=True)
    letters, out = letters or Letters(), np.zeros(DIM)
    for at in range(0, len(own), ROWS):
        out += times[at : at + ROWS].astype(np.float64) @ letters.bound(own[at : at + ROWS])
    return out


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes of docs(text, lang); only a vector per language reaches the driver."""
    fold = docs.sparkSession.sparkContext.broadcast(folds())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, total, held, size = Letters(), {}, {}, 0

        def settle() -> None:
            for lang, codes in held.items():
                total[lang] = total.get(lang, 0) + bundle(np.concatenate(codes), letters)
            held.clear()

        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for g in trigrams(text, fold.value):
                    held.setdefault(lang, []).append(g)
                    size += len(g)
                    if size > BATCH:
                        settle()
                        size = 0
        settle()
        for lang, v in total.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang]), "v": pa.array([np.rint(v).astype(np.int64)], pa.list_(pa.int64()))})

    parts = docs.where("text is not null and lang is not null").select(F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, "lang string, v array<bigint>")
    rows = parts.select("lang", F.posexplode("v").alias("d", "x")).groupBy("lang", "d").agg(F.sum("x").alias("x")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r.lang, np.zeros(DIM))[r.d] = r.x
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """``(doc_id, lang_pred, score)`` per row."""
    langs = sorted(prototypes)
    unit = [prototypes[x] / max(np.linalg.norm(prototypes[x]), 1e-12) for x in langs]
    context = docs.sparkSession.sparkContext
    fold, profiles = context.broadcast(folds()), context.broadcast(np.stack(unit, axis=1).astype(np.float32) if langs else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = Letters()
        for b in batches:
            texts = b.column(1).to_pylist()
            cos, lettered = np.zeros((len(texts), max(len(langs), 1)), np.int64), np.zeros(len(texts), bool)
            codes, of, held = [], [], 0

            def settle() -> None:
                sizes = np.array([len(g) for g in codes])
                own, back = np.unique(np.concatenate(codes), return_inverse=True)
                # as whole numbers, so that sums don't depend on how texts fall into batches
                points = np.concatenate([np.rint(letters.bound(own[at : at + ROWS]) @ profiles.value * UNIT) for at in range(0, len(own), ROWS)]).astype(np.int64)
                np.add.at(cos, of, np.add.reduceat(points[back], np.cumsum(sizes) - sizes, axis=0))
                codes.clear()
                of.clear()

            for i, text in enumerate(texts if langs else ()):
                for g in trigrams(text or "", fold.value):
                    if len(g):
                        lettered[i] |= bool(((g >> 21 & 0x1FFFFF) > 0).any() or (g >> 42).any() or (g & 0x1FFFFF).any())
                        codes.append(g)
                        of.append(i)
                        held += len(g)
                if held > BATCH:
                    settle()
                    held = 0
            if codes:
                settle()
            best, above = cos.argmax(axis=1), np.maximum(cos, 0)
            total = above.sum(axis=1)
            share = np.where(lettered & (total > 0), above.max(axis=1) / np.maximum(total, 1), 0.0)
            names = [langs[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(share, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
