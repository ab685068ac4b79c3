"""Token ids in sorted-string-table shards.

A shard is one immutable file: data blocks of entries sorted by key, a sparse block index, a Bloom
filter over keys and a footer. Within a block a key is stored as the length it shares with the key
before it and the rest (restarting in full at each block); the index holds the last key of every
block, so a lookup asks the Bloom filter, binary-searches the index, and reads one block.

    block   entries  varint shared, varint rest, varint value bytes, rest of key, value
    index   entries  key (KEY bytes), u64 offset, u32 length, u32 crc32 of the block
    bloom   u32 hash count, bits
    footer  u64 index offset, u32 blocks, u64 bloom offset, u32 bloom bytes, u64 documents,
            u64 ids, u8 bytes an id, 8 bytes magic

A key is a null flag, the doc_id as big-endian unsigned (sign bit flipped) and the copy number of a
repeated id, so byte order is ascending doc_id order with nulls first. A value holds the ids of one
document as little-endian unsigned integers.

Executors write shards through ``pyarrow.fs`` to the shared folder under a name of their own and
rename when complete, so a lost or repeated task never leaves half a shard under its final name.

Defined results: a null or empty text has the end id only; rows that repeat a doc_id are separate
entries in the order of their text; a text longer than a block is a block of its own; extra columns
are ignored; an empty table gives no shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import sys
import types
import unicodedata
import uuid
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, scratch_path, values

MAGIC, KEY = b"QUIRESST", 13
FOOTER, INDEX = "<QIQIQQB8s", f"<{KEY}sQII"
BLOCK, BLOOM_BITS, BLOOM_HASHES = 64 << 10, 10, 7
#: Text of a shard; there are more shards if the session asks for more shuffle partitions.
SHARD_BYTES = 256 << 20
END_ID = 2


def key_of(doc_id: int | None, copy: int = 0) -> bytes:
    return struct.pack(">BQI", doc_id is not None, ((doc_id or 0) + (1 << 63)) if doc_id is not None else 0, copy)


def id_of(key: bytes) -> int | None:
    known, n, _ = struct.unpack(">BQI", key)
    return n - (1 << 63) if known else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        c = b[at]
        at += 1
        n |= (c & 127) << shift
        if c < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Writes one shard; keys must come in ascending order."""

    def __init__(self, sink, id_bytes: int) -> None:
        self.sink, self.id_bytes = sink, id_bytes
        self.at = self.docs = self.ids = 0
        self.last, self.block, self.index, self.keys = b"", bytearray(), [], []

    def add(self, key: bytes, value: bytes) -> None:
        if key <= self.last:
            raise ValueError("keys must ascend")
        shared = len(os.path.commonprefix([self.last, key])) if self.block else 0
        self.block += _varint(shared) + _varint(KEY - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.docs += 1
        self.ids += len(value) // self.id_bytes
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.index.append(struct.pack(INDEX, self.last, self.at, len(self.block), zlib.crc32(self.block)))
            self.sink.write(bytes(self.block))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _probes(key, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        index = b"".join(self.index)
        self.sink.write(index)
        self.sink.write(struct.pack("<I", BLOOM_HASHES) + bytes(bloom))
        self.sink.write(struct.pack(FOOTER, self.at, len(self.index), self.at + len(index), 4 + len(bloom), self.docs, self.ids, self.id_bytes, MAGIC))


class Reader:
    """Reads a shard from a random-access file."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        at, blocks, bloom_at, bloom_size, self.docs, self.ids, self.id_bytes, magic = struct.unpack(FOOTER, self._read(size - struct.calcsize(FOOTER), struct.calcsize(FOOTER)))
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.index = list(struct.iter_unpack(INDEX, self._read(at, blocks * struct.calcsize(INDEX))))
        self.bloom = self._read(bloom_at, bloom_size)[4:]

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, crc = self.index[i]
        b = self._read(at, size)
        if zlib.crc32(b) != crc:
            raise ValueError("damaged block")
        key, at = b"", 0
        while at < len(b):
            shared, at = _read_varint(b, at)
            rest, at = _read_varint(b, at)
            n, at = _read_varint(b, at)
            key = key[:shared] + b[at : at + rest]
            at += rest
            yield key, b[at : at + n]
            at += n

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> bytes | None:
        bits = len(self.bloom) * 8
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, bits)):
            return None
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        return next((v for k, v in self._block(lo) if k == key), None) if lo < len(self.index) else None


#: No cut between white space and a space.
CUT = re.compile(r"(?<=[^\s\u180e]) ")


def _patterns() -> tuple[re.Pattern, re.Pattern]:
    """What byte-level pre-tokens are, and the characters that this does not hold for: those that Unicode
    has not assigned and those beyond its first plane."""
    kinds = defaultdict(list)
    for i in range(1 << 16):
        c = unicodedata.category(chr(i))
        kinds["S" if c[0] == "Z" or i in (*range(9, 14), 0x85) else "?" if c in ("Cn", "Cs") else c[0] if c[0] in "LN" else "O"].append(i)

    def ranges(kind: str) -> str:
        at = np.array(kinds[kind])
        return "".join(f"\\u{x[0]:04x}-\\u{x[-1]:04x}" for x in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1))

    letter, number, other, space = map(ranges, "LNOS")
    # the library tries the contractions first; nothing before them here begins with their sign
    return re.compile(f" ?[{letter}]+| ?[{number}]+|'(?:[stmd]|re|ve|ll)| ?[{other}]+|[{space}]+(?![^{space}])|[{space}]+"), re.compile(f"[{ranges('?')}\U00010000-\U0010ffff]")


PRE_TOKEN, FOREIGN = _patterns()


class Merges:
    """Byte-pair encoding of many short words at once.

    A word is a column of byte places. Each round merges, in every word that still has a pair of the
    merges, the pair of lowest rank, the first of equals; a token stays at its first place, and a
    number for each word has a bit for each place where a token begins.
    """

    WIDTHS = (4, 8, 12, 16, 24, 32)
    NONE = np.int32(2**31 - 1)

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        self.byte = np.array([vocab[c] for c in BYTE_LETTERS], np.int32)
        pairs = {}
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            pairs[vocab[a] << 32 | vocab[b]] = rank, vocab[a + b]
        keys = sorted(pairs)
        self.keys = np.array([*keys, 1 << 62], np.int64)
        self.rank = np.array([*(pairs[k][0] for k in keys), 0], np.int32)
        self.made = np.zeros(len(merges), np.int32)
        for rank, token in pairs.values():
            self.made[rank] = token
        self.first = self.ranked(*(self.byte[np.arange(1 << 16) >> s & 255] for s in (8, 0)), 0)

    def ranked(self, a: np.ndarray, b: np.ndarray, place: np.ndarray | int) -> np.ndarray:
        """Ranks of pairs with their places in the last five bits, ``NONE`` where there is no merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.rank[at] << 5 | place, self.NONE)

    def encode(self, words: list[bytes], kind: str) -> list[bytes]:
        """Ids of words of 1 to 32 bytes, packed as ``kind``."""
        out: list[bytes] = [b""] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        buf = np.frombuffer(b"".join(words) + bytes(32), np.uint8)
        group = np.searchsorted(self.WIDTHS, size)
        for g, width in enumerate(self.WIDTHS):
            own = np.flatnonzero(group == g)
            for own in np.split(own, range(20_000, len(own), 20_000)) if len(own) else ():
                token, bits = self._merge(buf[start[own] + np.arange(width)[:, None]], size[own])
                ids = token.T[(bits[:, None] >> np.arange(width) & 1).astype(bool)].astype(kind)
                ends = (np.cumsum(np.bitwise_count(bits), dtype=np.int64) * ids.itemsize).tolist()
                packed = ids.tobytes()
                for i, a, b in zip(own.tolist(), [0, *ends], ends):
                    out[i] = packed[a:b]
        return out

    def _merge(self, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        token, own, place = self.byte[b], np.arange(b.shape[1]), np.arange(len(b), dtype=np.int32)[:, None]
        bits = (1 << size) - 1
        # of the pair that begins at a place: its rank and the place
        pair = np.full(b.shape, self.NONE, np.int32)
        found = self.first[b[:-1].astype(np.int32) << 8 | b[1:]]
        np.copyto(pair[:-1], found | place[:-1], where=(found != self.NONE) & (place[1:] < size))
        while True:
            least = pair.min(axis=0)
            live = least != self.NONE
            if not live.all():
                pair, own, least = pair[:, live], own[live], least[live]
            if not len(own):
                return token, bits
            at, of = least & 31, np.arange(len(own))
            new, bit = self.made[least >> 5], 1 << at.astype(np.int64)
            before, behind = bits[own] & (bit - 1), bits[own] & -2 * bit
            gone = behind & -behind
            behind ^= gone
            bits[own] ^= gone
            token[at, own] = new
            pair[np.bitwise_count(gone - 1), of] = pair[at, of] = self.NONE
            # the pairs with the tokens behind and before
            i, j = np.flatnonzero(behind), np.flatnonzero(before)
            after = np.bitwise_count((behind[i] & -behind[i]) - 1)
            left = np.frexp(before[j].astype(np.float64))[1] - 1
            pair[at[i], i] = self.ranked(new[i], token[after, own[i]], at[i])
            pair[left, j] = self.ranked(token[left, own[j]], new[j], left)


class Encoder(dict):
    """Ids of texts by a file of the tokenizers library, added tokens of the file (``<|endoftext|>``)
    recognised in texts as the library does; as a table, the ids of pre-tokens.

    Where the file is plain byte-level BPE, texts are cut into pre-tokens here, and those that the
    table does not hold are encoded for many texts at once (:class:`Merges`). The table is bounded:
    it is emptied between groups of texts once it is full. Other files, and texts with an added token
    that takes in spaces or words around it, are encoded whole by the library.
    """

    #: Characters of texts that are encoded at once; longer texts are cut. Bytes of long words held.
    GROUP, LONG = 1 << 20, 16 << 20

    def __init__(self, path: str, held: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.of, self.held = Tokenizer.from_file(path), held
        self.kind = "I" if self.of.get_vocab_size() > 1 << 16 else "H"
        self.id_bytes = 4 if self.kind == "I" else 2
        parts = json.loads(self.of.to_str())
        model, added = parts["model"], parts["added_tokens"]
        plain = parts["pre_tokenizer"] == BYTE_LEVEL and not any(parts[k] for k in ("normalizer", "truncation", "padding"))
        plain = plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        self.merges = Merges(model["vocab"], model["merges"]) if plain and all(c in model["vocab"] for c in BYTE_LETTERS) else None
        self.wide = [t["content"] for t in added if " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        self.added = {t["content"]: self.pack([t["id"]]) for t in added}
        self._forget()
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(f"({'|'.join(map(re.escape, longest))})") if added else None

    def pack(self, ids: list[int]) -> bytes:
        return array(self.kind, ids).tobytes()

    def whole(self, text: str) -> bytes:
        return self.pack(self.of.encode(text, add_special_tokens=False).ids)

    def pre_tokens(self, text: str) -> list[str]:
        """Pre-tokens and added tokens of a text."""
        if self.marks and self.marks.search(text):
            parts = self.marks.split(text)
            return [x for i, part in enumerate(parts) for x in ([part] if i % 2 else self._pre_tokens(part))]
        return self._pre_tokens(text)

    def _pre_tokens(self, text: str) -> list[str]:
        if text.isascii() or not FOREIGN.search(text):
            return PRE_TOKEN.findall(text)
        out: list[str] = []
        for i, piece in enumerate(CUT.split(text)):
            piece = " " + piece if i else piece
            out += [piece[a:b] for _, (a, b) in self.of.pre_tokenizer.pre_tokenize_str(piece)] if FOREIGN.search(piece) else PRE_TOKEN.findall(piece)
        return out

    def _forget(self) -> None:
        self.clear()
        self.update(self.added)
        self.long = 0

    def _learn(self, tokens: set[str]) -> None:
        if len(self) > self.held or self.long > self.LONG:
            self._forget()
        new = [t for t in tokens if t not in self]
        raw = [t.encode() for t in new]
        short = [i for i, b in enumerate(raw) if len(b) <= Merges.WIDTHS[-1]]
        self.update(zip([new[i] for i in short], self.merges.encode([raw[i] for i in short], self.kind)))
        for t, b in zip(new, raw):
            if len(b) > Merges.WIDTHS[-1]:
                self[t] = self.pack([x.id for x in self.of.model.tokenize("".join(map(BYTE_LETTERS.__getitem__, b)))])
                self.long += len(b)

    def encode(self, texts: list[str], end: bytes) -> Iterator[bytes]:
        """Ids of each text with ``end`` behind them."""
        at = 0
        while at < len(texts):
            to, size = at + 1, len(texts[at])
            while to < len(texts) and (size := size + len(texts[to])) <= self.GROUP:
                to += 1
            for ids in self._encode(texts[at:to]):
                yield ids + end
            at = to

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not self.merges or self.wide and any(t in x for x in texts for t in self.wide):
            return list(map(self.whole, texts))
        if len(texts[0]) > self.GROUP:
            return [b"".join(self._look_up([x])[0] for x in self._cuts(texts[0]))]
        return self._look_up(texts)

    def _look_up(self, texts: list[str]) -> list[bytes]:
        tokens = list(map(self.pre_tokens, texts))
        self._learn(set().union(*tokens))
        return [b"".join(map(self.__getitem__, x)) for x in tokens]

    def _cuts(self, text: str) -> Iterator[str]:
        """Parts of a long text that encode on their own: byte-level pre-tokens never reach back over a
        space that follows a non-space."""
        at = 0
        while (m := CUT.search(text, at + self.GROUP // 2)) is not None:
            yield text[at : m.start()]
            at = m.start()
        yield text[at:]


def _encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file, kept between its tasks."""
    kept = sys.modules.setdefault("_quire_worker", types.ModuleType("_quire_worker")).__dict__
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def _byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: visible Latin-1 characters stand
    for themselves, the others for the code points from 256 on, in order."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(other)) for b in range(256)]


BYTE_LETTERS = _byte_letters()
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


MANIFEST = "shard int, path string, first_id long, docs long, ids long, bytes long"


def write_shards(docs: DataFrame, tokenizer: str, folder: str, shards: int | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode all documents into shards under ``folder`` in ascending doc_id order; the manifest,
    one row per shard. ``tokenizer`` is the path of a tokenizers file that executors see too."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        end, sink, writer = encoder.pack([end_id]), None, None
        for b in batches:
            for rows in batched(values(b), 256):
                for (part, doc_id, _), ids in zip(rows, encoder.encode([text or "" for *_, text in rows], end)):
                    if writer is None:
                        fs, root = _filesystem(folder)
                        fs.create_dir(root, recursive=True)
                        shard, own = part, f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                        sink = fs.open_output_stream(own)
                        writer, first, before, copy = Writer(sink, encoder.id_bytes), doc_id, (), 0
                    copy = copy + 1 if before == (doc_id,) else 0
                    before = (doc_id,)
                    writer.add(key_of(doc_id, copy), ids)
        if writer is not None:
            writer.close()
            size = sink.tell()
            sink.close()
            final = f"{root}/{shard:06d}.sst"
            fs.move(own, final)
            at = f"{folder}/{shard:06d}.sst"
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [at], "first_id": pa.array([first], pa.int64()), "docs": pa.array([writer.docs], pa.int64()), "ids": pa.array([writer.ids], pa.int64()), "bytes": pa.array([size], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").select(F.spark_partition_id().alias("shard"), "doc_id", "text")
    manifest = cut(ordered.mapInArrow(run, MANIFEST))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for left in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(folder, ".[0-9]*-*")) or ():
        fs.delete(left.getPath(), False)  # by attempts that were lost
    return manifest


def read_shards(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document, read back from the shards; ``start``
    counts the ids of all documents before, ids are little-endian unsigned 32-bit integers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, at = _filesystem(path)
                with fs.open_input_file(at) as source:
                    reader, rows, size = Reader(source), [], 0
                    kind = np.dtype("<u4" if reader.id_bytes == 4 else "<u2")
                    for key, value in reader:
                        ids = np.frombuffer(value, kind)
                        rows.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                        start += len(ids)
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows)

    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    before = (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before")
    return manifest.select("path", before).repartition(n, "path").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))


def token_table(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write shards and read them back: ``(doc_id, start, n_tokens, ids)``."""
    return read_shards(write_shards(docs, tokenizer, folder or scratch_path(docs.sparkSession)))
