"""What the corpus operators share: the shared folder, bounded chunks of text, vectorised word hashes, block-wise sums."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time inside a task; a longer single text makes a chunk of its own.
CHUNK_BYTES = 2_000_000
#: Rows of a chunk, and of an Arrow batch, at most.
CHUNK_ROWS = 4096
BATCH_ROWS = 2048

_U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of a folder. Texts are long: Arrow batches are kept to BATCH_ROWS rows, unless the session asks for less."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which driver and executors share. Where that is unset, as in
    tests on one machine, a local folder is set for the session."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    uri = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    return uri


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    shared_dir(spark, "unused")


def checkpointed(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage and survives lost executors."""
    uri = shared_dir(df.sparkSession, label)
    df.write.parquet(uri)
    return df.sparkSession.read.schema(df.schema).parquet(uri)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def open_mapped(uri: str) -> np.ndarray:
    """The file's bytes as a read-only memory map. A remote file is first copied to a nameless local file, which the
    system frees with the map."""
    fs, path = filesystem(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        with open(path, "rb") as f:
            return _mapped(f)
    with tempfile.TemporaryFile() as f:
        with fs.open_input_stream(path, compression=None) as src:
            while block := src.read(1 << 22):
                f.write(block)
        f.flush()
        return _mapped(f)


def _mapped(f) -> np.ndarray:
    if not os.fstat(f.fileno()).st_size:
        return np.zeros(0, np.uint8)
    return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), np.uint8)


def write_bytes(uri: str, *parts: bytes) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        for p in parts:
            out.write(p)


def crc_mod(col: Column, n: int) -> Column:
    """crc32 of the value's text, modulo n (null counts as remainder 0)."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def py_crc_mod(value: int | None, n: int) -> int:
    return 0 if value is None else zlib.crc32(str(value).encode()) % n


def chunks(batches: Iterator[pa.RecordBatch], text: str, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty), each of bounded total length."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)) if len(col) else np.zeros(0, np.int64)
        begin, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and (total + n > max_bytes or i - begin >= CHUNK_ROWS):
                yield batch.slice(begin, i - begin), [x or b"" for x in col.slice(begin, i - begin).to_pylist()]
                begin, total = i, 0
            total += n
        if len(col) > begin:
            yield batch.slice(begin), [x or b"" for x in col.slice(begin).to_pylist()]


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(_U) | _U(1)
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.ones(size, _U)
        out[1:] = _U(base)
        have = np.multiply.accumulate(out)
        if size <= 4 * CHUNK_BYTES:
            _POWERS[base] = have
    return have


def offset_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0 to n - 1 of the hashes' odd base, and of its inverse."""
    return _powers(_R, n)[:n], _powers(_RINV, n)[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x = x * _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def combine(*hs: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of equally long hash arrays."""
    out = np.full(len(hs[0]), 0x51ED270B35AE5A1D, _U)
    for h in hs:
        out = mix(out * _U(0x9FB21C651E98DF25) + h)
    return out


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of several texts, A-Z lower-cased unless not fold: byte spans, text index and 64-bit
    hash of each."""

    def __init__(self, texts: list[bytes], fold: bool = True):
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        self.n_texts = len(texts)
        self.text_start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]) if len(texts) else np.zeros(0, np.int64)
        self.raw = b" ".join(texts)
        if fold:
            self.raw = self.raw.translate(_LOWER)
        buf = np.frombuffer(self.raw, np.uint8)
        solid = ~_SPACE[buf]
        edge = np.flatnonzero(np.diff(solid, prepend=False, append=False))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.text = np.searchsorted(self.text_start, self.starts, "right") - 1
        self.counts = np.bincount(self.text, minlength=self.n_texts) if self.n_texts else np.zeros(0, np.int64)
        self.buf = buf

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, _U)
        n = len(self.buf)
        acc = _BYTE[self.buf]
        acc *= _powers(_R, n)[:n]
        np.cumsum(acc, out=acc)
        lo = np.where(self.starts > 0, acc[self.starts - 1], _U(0))
        return mix((acc[self.ends - 1] - lo) * _powers(_RINV, n)[self.starts] + (self.ends - self.starts).astype(_U))


def shingle_hashes(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every run of width words; a shorter text gives one shingle of all its words, an empty
    one none."""
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, np.int64)
    per = np.where(counts >= width, counts - width + 1, 0)
    text = np.repeat(np.arange(len(counts)), per)
    at = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + first[text]
    out = combine(*(hashes[at + k] for k in range(width))) if len(at) else np.zeros(0, _U)
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        more = np.array([_fold(hashes[first[i] : first[i] + counts[i]]) for i in short.tolist()], _U)
        out, text = np.concatenate([out, more]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        out, text = out[order], text[order]
    return out, text


def _fold(hs: np.ndarray) -> int:
    out = np.full(1, 0x2545F4914F6CDD1D, _U)
    for h in hs:
        out = mix(out * _U(0x9FB21C651E98DF25) + h + _U(7))
    return int(out[0])


def summed_table(df: DataFrame, fn, size: int, rows: int = 1, block: int = 1 << 16) -> np.ndarray:
    """The sum over all tasks of a dense table of rows x size int64 counts. fn(batches) returns one task's table; only
    its non-zero cells travel, cut in blocks, so the shuffle is balanced and the result, of fixed size whatever the
    input, is all that the driver receives."""
    total = rows * size

    def local(batches):
        t = np.asarray(fn(batches)).reshape(-1)
        ids, cells, counts = [], [], []
        for b in range(0, total, block):
            part = t[b : b + block]
            at = np.flatnonzero(part)
            if len(at):
                ids.append(b // block)
                cells.append(at.astype(np.uint32).tobytes())
                counts.append(part[at].astype(np.int64).tobytes())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(cells, pa.binary()), pa.array(counts, pa.binary())], ["block", "cells", "counts"])

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                s = sums.setdefault(b, np.zeros(block, np.int64))
                s[np.frombuffer(c, np.uint32)] += np.frombuffer(v, np.int64)
        if sums:
            cells = [np.flatnonzero(s).astype(np.uint32) for s in sums.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums), pa.int32()), pa.array([c.tobytes() for c in cells], pa.binary()), pa.array([zlib.compress(s[c].tobytes(), 1) for c, s in zip(cells, sums.values(), strict=True)], pa.binary())],
                ["block", "cells", "counts"],
            )

    schema = "block int, cells binary, counts binary"
    blocks = df.mapInArrow(local, schema).repartition(max(1, min(total // block, 64)), "block").mapInArrow(merge, schema)
    out = np.zeros(-(-total // block) * block, np.int64)
    for r in blocks.collect():
        out[r.block * block + np.frombuffer(r.cells, np.uint32).astype(np.int64)] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out[:total].reshape(rows, size)


def group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
