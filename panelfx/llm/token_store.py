"""Token-id output: shards of independently compressed zstandard frames.

A shard is a valid zstandard file: frames of little-endian uint32 ids, then a skippable frame that holds the document
index, then the seek table of the public "seekable format" (a skippable frame with each frame's compressed size, size
and the low 32 bits of the XXH64 of its content, and a footer). A reader fetches the tail, then only the frames that
hold the documents asked for, and checks each frame against its checksum.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, filesystem, group_starts, mix, offset_powers, saved, shared_dir

SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Ids in a frame, about; a document is never cut.
FRAME_IDS = 1 << 16
#: Distinct pieces of text whose ids a worker remembers: so many of late, and at most as many from before.
CACHE = 200_000
#: Characters whose pieces are found in one go.
AT_ONCE = 500_000

# The published pre-tokenisation pattern of the byte-level BPE vocabulary (fixed value), for texts of _PLAIN characters,
# where [^\W\d_] is \p{L} and \d is \p{N}. Texts with other characters go to the library whole: its Unicode tables decide.
_PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\u00a1-\u00a9\u00ab-\u00b1\u00b4-\u00b8\u00bb\u00bf-\u024f\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u2010-\u2015\u2018-\u201f\u2026\u20ac]")

#: Kinds of the _PLAIN characters: white space, letter, digit, other; and a random number for each.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KIND = np.array([_SPACE if chr(c).isspace() else _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _OTHER for c in range(0x20AD)], np.uint8)
_CHAR = np.random.default_rng(20240701).integers(1, 2**63, len(_KIND), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def piece_starts(cp: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the pieces of _PIECES begin in the code points of several _PLAIN texts laid end to end. starts: where those
    texts that aren't empty begin."""
    kind, n = _KIND[cp], len(cp)
    begins = np.zeros(n + 1, bool)  # of a text; n ends the last
    begins[starts], begins[n] = True, True
    cut = begins.copy()
    cut[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut)
    end = run[1:]
    end = end[(kind[run[:-1]] == _SPACE) & ~begins[end]]  # of white space with a word behind it: its last character stands apart,
    cut[end - 1] = True
    cut[end[cp[end - 1] == 0x20]] = False  # and goes with the word if it is a blank
    at = np.flatnonzero(cp == 0x27)
    at = at[cut[at] & ~begins[at + 1]]
    if len(at):  # 's 't 'm 'd 're 've 'll
        low = np.append(cp, 0).astype(np.int64)
        one, two = low[at + 1], np.where(begins[at + 1], 0, low[np.minimum(at + 2, n)])
        two[begins[np.minimum(at + 2, n)]] = 0
        short = np.isin(one, [*b"stmd"])
        pair = np.isin(one << 8 | two, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])
        cut[at[short | pair] + 1] = False
        cut[at[short] + 2] = True
        cut[at[pair] + 3] = True
    return np.flatnonzero(cut[:n])


def byte_letters() -> dict[int, str]:
    """The byte-level vocabulary's letter for each byte: printable bytes stand for themselves, the others follow from
    U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts, as little-endian uint32 bytes, by a byte-level BPE of the tokenizers library. As that encodes
    each piece of its pre-tokenisation alone, the ids of a piece are asked for once and then remembered."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.letters = byte_letters()
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        probe = "It's  a (test),\n\n of 12 words\t\u2026 na\u00efve  "
        try:
            self.by_piece = self._by_piece(probe) == self._whole(probe)
        except Exception:  # another kind of vocabulary
            self.by_piece = False

    def _piece(self, piece: str) -> bytes:
        tokens = self.tok.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))
        return np.array([t.id for t in tokens], "<u4").tobytes()

    def _known(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece. What was asked for lately stays when the memory is full."""
        if len(self.ids) > CACHE:
            self.ids, self.old = {}, self.ids
        ids, out = self.ids, []
        for p in pieces:
            x = ids.get(p)
            if x is None:
                ids[p] = x = self.old.get(p) or self._piece(p)
            out.append(x)
        return out

    def _by_piece(self, text: str) -> bytes:
        return b"".join(self._known(_PIECES.findall(text)))

    def _all_by_piece(self, texts: list[str]) -> list[bytes]:
        """As _by_piece for each text. Pieces with the same 64 bits of hash in these texts are looked up once."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = "".join(texts)
        cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
        if not len(cp):
            return [b""] * len(texts)
        begin = np.cumsum(sizes) - sizes
        start = piece_starts(cp, begin[sizes > 0])
        end = np.append(start[1:], len(cp))
        up, down = offset_powers(len(cp))
        acc = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CHAR[cp] * up)])
        h = mix((acc[end] - acc[start]) * down[start] + (end - start).astype(np.uint64))
        order = np.argsort(h)
        first = group_starts(h[order])
        which = np.empty(len(h), np.int64)
        which[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        rep = order[first]
        known = self._known([text[a:b] for a, b in zip(start[rep].tolist(), end[rep].tolist(), strict=True)])
        flat, n = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        count = n[which]
        stop = np.cumsum(count)
        ids = flat[np.repeat((np.cumsum(n) - n)[which] - (stop - count), count) + np.arange(stop[-1])]
        edge = np.concatenate([[0], stop])[np.searchsorted(start, np.append(begin, len(cp)))]
        return [ids[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]

    def _whole(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _is_plain(self, text: str) -> bool:
        return self.by_piece and not _NOT_PLAIN.search(text) and not any(s in text for s in self.special)

    def __call__(self, text: str) -> bytes:
        return self._by_piece(text) if self._is_plain(text) else self._whole(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        out, held, size = [b""] * len(texts), [], 0

        def found() -> None:
            for i, ids in zip(held, self._all_by_piece([texts[i] for i in held]), strict=True):
                out[i] = ids
            held.clear()

        for i, t in enumerate(texts):
            if len(t) > AT_ONCE or not self._is_plain(t):
                out[i] = self(t)
                continue
            if size + len(t) > AT_ONCE:
                found()
                size = 0
            held.append(i)
            size += len(t)
        found()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class ShardWriter:
    """Writes one shard; documents come in the order in which they are kept."""

    def __init__(self, uri: str, level: int = 3):
        fs, path = filesystem(uri)
        fs.create_dir(os.path.dirname(path), recursive=True)
        self.out, self.zstd = fs.open_output_stream(path, compression=None), zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []  # doc id, has id, frame, ids
        self.held: list[bytes] = []
        self.n = 0
        self.per_frame: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        if self.n and self.n + n > FRAME_IDS:
            self.flush()
        self.held.append(ids)
        self.n += n
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), n))

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.per_frame.append((len(self.held), self.n))
            self.held, self.n = [], 0

    def close(self) -> list[tuple[int, int]]:
        """(documents, ids) of each frame."""
        self.flush()
        index = np.array(self.index, dtype=np.int64).reshape(-1, 4).astype("<i8").tobytes()
        packed = zlib.compress(index, 6)
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(packed)) + packed)
        table = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + len(footer)) + table + footer)
        self.out.close()
        return self.per_frame


class ShardReader:
    """Random access to a shard: the tail once, then single frames."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.f = fs.open_input_file(path)
        size = self.f.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError(f"no seek table at the end of {uri}")
        table = self._at(size - 9 - 12 * n, 12 * n)
        self.frames = [struct.unpack_from("<III", table, 12 * i) for i in range(n)]
        self.offset = np.concatenate([[0], np.cumsum([f[0] for f in self.frames])]).astype(np.int64)
        at = int(self.offset[-1])
        magic, length = struct.unpack("<II", self._at(at, 8))
        if magic != SKIPPABLE_INDEX:
            raise ValueError(f"no document index in {uri}")
        self.index = np.frombuffer(zlib.decompress(self._at(at + 8, length)), "<i8").reshape(-1, 4)

    def _at(self, offset: int, length: int) -> bytes:
        self.f.seek(offset)
        return self.f.read(length)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.frames[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offset[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def documents(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        ids, at = self.frame(k), 0
        for doc, known, _, n in self.index[self.index[:, 2] == k].tolist():
            yield (doc if known else None), ids[at : at + n]
            at += n

    def fetch(self, doc_id: int) -> list[np.ndarray]:
        """All documents of this id (repeats included); decompresses only their frames."""
        hit = self.index[(self.index[:, 0] == doc_id) & (self.index[:, 1] == 1)]
        return [ids for k in np.unique(hit[:, 2]).tolist() for d, ids in self.documents(k) if d == doc_id]

    def close(self) -> None:
        self.f.close()


def write_tokens(docs: DataFrame, tokenizer_path: str, uri: str, end_id: int = 0) -> DataFrame:
    """Encode every whole text (null: empty), append end_id, and write shards below uri in ascending doc_id order (null
    ids first; equal ids in order of their texts). Returns the manifest: shard, path, frame, docs, ids. Documents are
    dealt to shards by ranges of (doc_id, text hash): a repeated id can't overfill one. A task that is run again writes
    a file under a new name; only the files that the manifest names count."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")

    def encode(batches):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path, out = f"{uri}/shard-{shard:06d}-{uuid.uuid4().hex}.zst", None
        end = struct.pack("<I", end_id)
        for batch, texts in chunks(batches, "text"):
            if out is None:
                out, enc = ShardWriter(path), encoder(tokenizer_path)
            for d, ids in zip(batch.column(0).to_pylist(), enc.encode([t.decode() for t in texts]), strict=True):
                out.add(d, ids + end)
        if out is not None:
            made = out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "path": path, "frame": k, "docs": d, "ids": n} for k, (d, n) in enumerate(made)], schema=_MANIFEST)

    return saved(ordered.mapInArrow(encode, "shard int, path string, frame int, docs long, ids long"), "token-manifest")


_MANIFEST = pa.schema([("shard", pa.int32()), ("path", pa.string()), ("frame", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64())])


def with_starts(manifest: DataFrame) -> DataFrame:
    """Adds start: the ids in all frames before. Shard totals are summed over shards (one row each), frames within
    their shard."""
    per_shard = manifest.groupBy("shard").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = per_shard.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("shard").orderBy("frame").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(base, "shard").select("*", (F.col("base") + F.coalesce(F.sum("ids").over(within), F.lit(0))).alias("start"))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Read the shards back frame by frame: doc_id, start, n_tokens, ids_crc32, ids. Frames are read by the task that
    has their row; nothing but a frame is held."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = with_starts(manifest).select("path", "frame", "start").repartition(parts, "path", "frame")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int64()))])

    def load(batches):
        for batch in batches:
            held, reader = None, None
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            for path, frame, start in rows:
                if path != held:
                    if reader:
                        reader.close()
                    held, reader = path, ShardReader(path)
                docs, starts, counts, crcs, lists = [], [], [], [], []
                for d, ids in reader.documents(frame):
                    docs.append(d)
                    starts.append(start)
                    counts.append(len(ids))
                    crcs.append(zlib.crc32(ids.tobytes()))
                    lists.append(ids)
                    start += len(ids)
                flat = np.concatenate(lists).astype(np.int64) if lists else np.zeros(0, np.int64)
                off = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], schema=schema)
            if reader:
                reader.close()

    return frames.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def digest(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files; the ids stay in the tasks."""
    spark = manifest.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frames = with_starts(manifest).select("path", "frame", "start").repartition(parts, "path", "frame")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def load(batches):
        for batch in batches:
            readers: dict[str, ShardReader] = {}
            for path, frame, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                reader = readers.setdefault(path, None) or ShardReader(path)
                readers[path] = reader
                out = []
                for d, ids in reader.documents(frame):
                    out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
            for r in readers.values():
                r.close()

    return frames.mapInArrow(load, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_tokens(spark: SparkSession, docs: DataFrame, tokenizer_path: str, uri: str | None = None) -> DataFrame:
    """Write docs as token shards and return their digest as read back from the files. No rows in, no rows out."""
    return digest(write_tokens(docs, tokenizer_path, uri or shared_dir(spark, "tokens")))
