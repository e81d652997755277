"""Interpolated modified Kneser-Ney model, counted in Spark, kept as sorted hash arrays, mapped by workers for scoring.

Counting. A task turns its texts into word hashes and counts its distinct words and word pairs; blocks of sorted keys
travel to the shard that owns them, where they are merged. A shard holds a range of hashes. Pairs belong to the shard of
their first word; the pairs of a very frequent first word are dealt to shards by the second, so no word makes a shard
large. Nothing but per-shard totals reaches the driver.

Files, in the shared folder, all little-endian arrays sorted by hash:
    words-S: word hash u64 | backed-off log probability's value f64 | weight of the backed-off model after the word f64 | total of pairs after the word u32 x 2 (total, count)
    pairs-S, triples-S: rows of counts, keyed by the hash of the words: a header, frequent combinations of counts, written-out counts, buckets of the hash's upper bits, its next 32 bits (u32), and a byte for the counts

The order is two or three. Order two: pairs, backed off to continuation counts of single words, backed off to a uniform
distribution. Order three: triples, backed off to pairs counted by the distinct words before them (pairs at a text's begin,
which have none, by their occurrences), and so on. For triples, words travel as their ranks in the vocabulary, four bytes
in planes. Triples are dealt as the pair of their first words is; those of two very frequent words by all three.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, combine, group_starts, open_mapped, saved, shared_dir, write_bytes

_U = np.uint64
END = int(combine(np.array([0x454E44], _U))[0])
#: Keys that a task gathers before it sends them on.
HOLD = 1_000_000


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with an end after each text, and the text index of each."""
    w = Words(texts)
    h = w.hashes()
    n = np.asarray(w.counts, np.int64)
    out = np.full(len(h) + len(texts), END, _U)
    at = np.arange(len(h)) + w.text
    out[at] = h
    return out, np.repeat(np.arange(len(texts)), n + 1)


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return combine(a, b)


def _varint(x: np.ndarray) -> bytes:
    """Counts as bytes, 255 followed elsewhere by the number itself: counts | large counts."""
    big = x[x >= 255].astype("<u8")
    return np.minimum(x, 255).astype(np.uint8).tobytes() + big.tobytes()


def _unvarint(raw: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", offset=n)
    return out


def _counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys = np.sort(keys)
        s = group_starts(keys)
        return keys[s], np.diff(np.append(s, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    s = group_starts(keys)
    return keys[s], np.add.reduceat(weights[order], s) if len(s) else np.zeros(0, np.int64)


_WORD_BLOCK = "shard int, keys binary, a binary"
#: Bytes of text for each shard, about: what a shard holds in memory follows from it.
SHARD_BYTES = 32_000_000


def _dealt(blocks: DataFrame, shards: int) -> DataFrame:
    """Blocks dealt by shard, those of a shard one after the other."""
    return blocks.repartition(shards, "shard").sortWithinPartitions("shard")


def _shards_of(batches):
    """Each shard of a partition with its rows (without the shard's number), one shard in memory at a time."""
    now, rows = None, []
    for batch in batches:
        for s, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if s != now and rows:
                yield now, rows
                rows = []
            now = s
            rows.append(row)
    if rows:
        yield now, rows


def word_counts(docs: DataFrame, shards: int) -> DataFrame:
    """shard, keys (sorted word hashes, u64), counts (u64) of all tokens of docs.text."""

    def local(batches):
        held, n = [], 0

        def send():
            k, c = _counted(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
            s = _shard(k, shards)
            cuts = np.searchsorted(s, np.arange(shards + 1))
            rows = [(i, k[a:b].tobytes(), _varint(c[a:b])) for i, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())) if b > a]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["shard", "keys", "a"])

        for _, texts in chunks(batches, "text"):
            held.append(_counted(tokens(texts)[0]))
            n += len(held[-1][0])
            if n > HOLD:
                k, c = _counted(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
                held, n = [(k, c)], 0
                if len(k) > HOLD:
                    yield send()
                    held = []
        if held:
            yield send()

    def merge(batches):
        for s, rows in _shards_of(batches):
            parts = [(np.frombuffer(k, _U), _unvarint(a, len(k) // 8)) for k, a in rows]
            k, c = _counted(np.concatenate([x for x, _ in parts]), np.concatenate([y for _, y in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k.tobytes()], pa.binary()), pa.array([c.astype("<u8").tobytes()], pa.binary())], ["shard", "keys", "a"])

    return _dealt(docs.select("text").mapInArrow(local, _WORD_BLOCK), shards).mapInArrow(merge, _WORD_BLOCK)


def _sum_columns(keys: np.ndarray, *cols: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    s = group_starts(keys)
    return (keys[s], *(np.add.reduceat(c[order], s) if len(s) else c[:0] for c in cols))


def _by_shard(s: np.ndarray):
    order = np.argsort(s, kind="stable")
    g = group_starts(s[order])
    for x, y in zip(g.tolist(), np.append(g[1:], len(s)).tolist()):
        yield int(s[order[x]]), order[x:y]


def _planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32, byte by byte: the upper bytes, mostly equal, are then compressed away."""
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _squeezed(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw) if raw else b""


def _loosened(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw) if raw else b""


#: Keys of a bucket of a file, about; a key's upper bits are its bucket, the next 32 are stored.
BUCKET = 16


def _write_keyed(path: str, key: np.ndarray, *cols: np.ndarray) -> None:
    """A file of sorted keys with counts: rows of counts are told apart by one byte, the number of a frequent combination,
    or 255 for a row that is written out."""
    n = len(key)
    bits = max(0, int(n // BUCKET).bit_length())
    bounds = np.searchsorted(key >> _U(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)) if bits else np.array([0, n])
    low = (key << _U(bits)) >> _U(32)
    packed = np.zeros(n, np.uint64)
    fits = np.ones(n, bool)
    room = 60 // len(cols)
    for i, c in enumerate(cols):
        fits &= c < 1 << room
        packed |= np.minimum(c, (1 << room) - 1).astype(_U) << _U(room * i)
    kinds, inv, times = np.unique(packed[fits], return_inverse=True, return_counts=True)
    top = np.sort(np.argsort(-times, kind="stable")[:255])
    number = np.full(len(kinds), 255, np.uint8)
    number[top] = np.arange(len(top), dtype=np.uint8)
    code = np.full(n, 255, np.uint8)
    code[fits] = number[inv]
    out = np.flatnonzero(code == 255)
    combos = np.stack([(kinds[top] >> _U(room * i)) & _U((1 << room) - 1) for i in range(len(cols))])
    wide = "<u8" if any(len(c) and int(c.max()) >= 1 << 32 for c in cols) else "<u4"
    write_bytes(
        path, np.array([n, bits, len(top), len(out), np.dtype(wide).itemsize], "<u8").tobytes(), combos.astype("<u8").tobytes(), b"".join(c[out].astype(wide).tobytes() for c in cols),
        out.astype("<u4").tobytes(), bounds.astype("<u4").tobytes(), low.astype("<u4").tobytes(), code.tobytes(),
    )


class Keyed:
    """A mapped file of sorted keys with counts. An unseen key is taken for a seen one with a chance of about
    BUCKET / 2^32."""

    def __init__(self, path: str, width: int):
        raw = open_mapped(path)
        self.n, self.bits, combos, out, wide = raw[:40].view("<u8").tolist()
        at = 40

        def part(kind: str, size: int) -> np.ndarray:
            nonlocal at
            x = raw[at : at + size * np.dtype(kind).itemsize].view(kind)
            at += size * np.dtype(kind).itemsize
            return x

        self.combos = part("<u8", combos * width).reshape(width, combos).astype(np.int64)
        self.large = part(f"<u{wide}", out * width).reshape(width, out)
        self.out = part("<u4", out)
        self.bounds, self.low, self.code = part("<u4", (1 << self.bits) + 1), part("<u4", self.n), part("u1", self.n)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of keys, and whether they are there: a binary search in each key's bucket."""
        bucket = (key >> _U(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(key), np.int64)
        want = ((key << _U(self.bits)) >> _U(32)).astype(np.uint32)
        lo, hi = self.bounds[bucket].astype(np.int64), self.bounds[bucket + 1].astype(np.int64)
        end = hi.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = open_ & (self.low[np.minimum(mid, self.n - 1)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        at = np.minimum(lo, self.n - 1)
        return at, (lo < end) & (self.low[at] == want)

    def counts(self, at: np.ndarray) -> np.ndarray:
        """A row for each column."""
        code = self.code[at]
        out = np.zeros((len(self.large), len(at)), np.int64)
        known = code < 255
        out[:, known] = self.combos[:, code[known]]
        if not known.all():
            out[:, ~known] = self.large[:, np.searchsorted(self.out, at[~known])]
        return out


@dataclass
class Vocabulary:
    """All words of the training texts, as files of sorted hashes. A word's id is its rank."""

    shards: int
    paths: dict[int, str]
    starts: np.ndarray  # first id of each shard, and the number of words
    hot: np.ndarray  # ids of very frequent words, sorted


class Ids:
    """A worker's view of the vocabulary."""

    def __init__(self, vocab: Vocabulary):
        self.v, self.maps = vocab, {}

    def _keys(self, s: int) -> np.ndarray:
        if s not in self.maps:
            self.maps[s] = open_mapped(self.v.paths[s]).view(_U) if s in self.v.paths else np.zeros(0, _U)
        return self.maps[s]

    def of(self, h: np.ndarray) -> np.ndarray:
        """Ids of hashes, all of them in the vocabulary."""
        out = np.zeros(len(h), np.int64)
        for s, at in _by_shard(_shard(h, self.v.shards)):
            out[at] = self.v.starts[s] + np.searchsorted(self._keys(s), h[at])
        return out

    def hashes(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), _U)
        for s, at in _by_shard(_id_shard(ids, self.v)):
            out[at] = self._keys(s)[ids[at] - self.v.starts[s]]
        return out


def _id_shard(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    return np.searchsorted(v.starts, ids, "right") - 1


def _is_hot(ids: np.ndarray, v: Vocabulary) -> np.ndarray:
    return v.hot[np.minimum(np.searchsorted(v.hot, ids), len(v.hot) - 1)] == ids if len(v.hot) else np.zeros(len(ids), bool)


def triple_key(*ids: np.ndarray) -> np.ndarray:
    return combine(*(x.astype(_U) for x in ids))


def _triple_shard(a: np.ndarray, b: np.ndarray, c: np.ndarray, v: Vocabulary) -> np.ndarray:
    s = _id_shard(a, v)
    one, two = _is_hot(a, v), _is_hot(b, v)
    x = one & ~two
    s[x] = _shard(triple_key(a[x], b[x]), v.shards)
    x = one & two
    s[x] = _shard(triple_key(a[x], b[x], c[x]), v.shards)
    return s


@dataclass
class Model:
    """What workers need: where the arrays are, and constants."""

    uri: str
    shards: int
    hot: np.ndarray  # first words whose pairs are dealt by the second, sorted
    words: dict[int, str]
    pairs: dict[int, str]
    train_tokens: int
    vocabulary: int
    floor: float  # backed-off probability of an unknown word
    d2: tuple[float, float, float]  # discounts of pair counts
    vocab: Vocabulary | None = None  # from here on, order three only
    triples: dict[int, str] | None = None
    d3: tuple[float, float, float] | None = None


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three discounts of the modified method from counts of counts; 0.5, 1, 1.5 where those are missing."""
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k) for x, k in zip(d, (1.0, 2.0, 3.0), strict=True))


def _discount(c: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(c >= 3, d[2], np.where(c == 2, d[1], np.where(c == 1, d[0], 0.0)))


def train(docs: DataFrame, order: int = 2) -> Model:
    """The model of docs.text (null: empty; each text's end is a token), of order 2 or 3. Without rows, every token has
    probability 1."""
    if order not in (2, 3):
        raise ValueError(f"order {order}: 2 or 3")
    spark = docs.sparkSession
    size = int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    shards = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    uri = shared_dir(spark, "kneser-ney")
    counts = saved(word_counts(docs, shards), "word-counts")

    def totals(batches):
        for b in batches:
            for k, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                c = np.frombuffer(a, "<u8")
                yield pa.RecordBatch.from_arrays([pa.array([len(k) // 8], pa.int64()), pa.array([int(c.sum())], pa.int64())], ["v", "n"])

    t = counts.mapInArrow(totals, "v long, n long").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    if not t.n:
        return Model(uri, shards, np.zeros(0, _U), {}, {}, 0, 0, 1.0, discounts(0, 0, 0, 0))
    v, n = int(t.v), int(t.n)
    limit = max(1, n // (8 * shards))  # fewer than 8 * shards words are as frequent as this

    def frequent(batches):
        for b in batches:
            for k, a in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                hot = np.frombuffer(k, _U)[np.frombuffer(a, "<u8") >= limit]
                yield pa.RecordBatch.from_arrays([pa.array(hot.view(np.int64), pa.int64())], ["h"])

    hot = np.sort(np.array([r.h for r in counts.mapInArrow(frequent, "h long").collect()], np.int64).view(_U))

    vocab = triples = d3 = None
    if order == 2:
        pairs = saved(_pair_counts(docs, shards, hot, uri), "pair-shards")
    else:
        vocab = _vocabulary(counts, shards, hot, uri)
        both = saved(_triple_counts(docs, vocab, hot, uri), "pair-shards")
        pairs, files = both.where("path is not null"), both.where("tpath is not null")
        triples = {r.shard: r.tpath for r in files.select("shard", "tpath").collect()}
        d3 = discounts(*(int(x or 0) for x in files.select("t1", "t2", "t3", "t4").groupBy().sum().first()))
    # counts of counts, over shards
    n_of = pairs.select("n1", "n2", "n3", "n4").groupBy().sum().first()
    d2 = discounts(*(int(x or 0) for x in n_of))
    stats = saved(_word_stats(pairs, shards, d2, vocab), "word-stats")
    n_of = stats.select("n1", "n2", "n3", "n4", "total").groupBy().sum().first()
    d1 = discounts(*(int(x or 0) for x in n_of[:4]))
    total = int(n_of[4] or 0)
    mass = sum(d * int(k or 0) for d, k in zip(d1, (n_of[0], n_of[1], None), strict=True))
    n3plus = stats.agg(F.sum("n3plus")).first()[0] or 0
    mass += d1[2] * int(n3plus)
    gamma = mass / total if total else 1.0
    floor = gamma / (v + 1)
    words = _write_words(stats, counts, uri, d1, total, floor)
    return Model(uri, shards, hot, {r.shard: r.path for r in words.collect()}, {r.shard: r.path for r in pairs.select("shard", "path").collect()}, n, v, floor, d2, vocab, triples, d3)


_PAIR_MAP = "shard int, a binary, runs binary, b binary, n binary"


def _pair_shard(a: np.ndarray, b: np.ndarray, shards: int, hot: np.ndarray) -> np.ndarray:
    s = _shard(a, shards)
    if len(hot):
        is_hot = hot[np.minimum(np.searchsorted(hot, a), len(hot) - 1)] == a
        s[is_hot] = _shard(combine(a[is_hot], b[is_hot]), shards)
    return s


_PAIR_SHARD = "shard int, path string, a binary, first binary, b binary, second binary, n1 long, n2 long, n3 long, n4 long"


def _finished(s: int, path: str, a: np.ndarray, b: np.ndarray, c: np.ndarray, *more: np.ndarray, ids=None) -> pa.RecordBatch:
    """Writes a shard's distinct pairs, sorted by first word, with their counts (and more columns); its row, with words by
    hash, or by id in planes if ids are given."""
    key = pair_key(a, b)
    order = np.argsort(key)
    _write_keyed(path, key[order], *(x[order] for x in (c, *more)))
    a, b = ids or (a, b)
    told = (lambda x: _squeezed(_planes(x))) if ids else (lambda x: x.tobytes())
    g = group_starts(a)
    ends = [np.add.reduceat(x, g) for x in (c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c >= 3).astype(np.int64))]
    vb, vc = _counted(b)
    first = np.stack(ends).astype("<u4") if c.sum() < 2**32 else np.stack(ends).astype("<u8")
    ns = [int((c == k).sum()) for k in (1, 2, 3, 4)]
    return pa.RecordBatch.from_arrays(
        [pa.array([x], t) for x, t in zip((s, path, told(a[g]), first.tobytes(), told(vb), _varint(vc), *ns), (pa.int32(), pa.string(), *[pa.binary()] * 4, *[pa.int64()] * 4), strict=True)],
        ["shard", "path", "a", "first", "b", "second", "n1", "n2", "n3", "n4"],
    )


def _pair_counts(docs: DataFrame, shards: int, hot: np.ndarray, uri: str) -> DataFrame:
    """Counts pairs and writes each shard's file; returns a row per shard with its path, its counts of counts, and its
    sums by first and by second word."""

    def sent(a, b, c):
        s = _pair_shard(a, b, shards, hot)
        order = np.argsort(s, kind="stable")  # a, b stay sorted within
        a, b, c, s = a[order], b[order], c[order], s[order]
        cuts = np.searchsorted(s, np.arange(shards + 1)).tolist()
        rows = []
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                g = group_starts(a[x:y])
                rows.append((i, a[x:y][g].tobytes(), np.diff(np.append(g, y - x)).astype("<u4").tobytes(), b[x:y].tobytes(), _varint(c[x:y])))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "a", "runs", "b", "n"])

    def merged(held):
        a, b, c = (np.concatenate([x[i] for x in held]) for i in range(3))
        key = pair_key(a, b)
        order = np.argsort(key, kind="stable")
        key = key[order]
        g = group_starts(key)
        first = order[g]
        a, b, c = a[first], b[first], np.add.reduceat(c[order], g) if len(g) else c[:0]
        order = np.lexsort((b, a))
        return a[order], b[order], c[order]

    def local(batches):
        held, n = [], 0
        for _, texts in chunks(batches, "text"):
            h, text = tokens(texts)
            a = np.concatenate([np.array([END], _U), h[:-1]])
            a[np.concatenate([[True], text[1:] != text[:-1]])] = END
            held.append((a, h, np.ones(len(h), np.int64)))
            n += len(h)
            if n > HOLD:
                yield sent(*merged(held))
                held, n = [], 0
        if held:
            yield sent(*merged(held))

    def merge(batches):
        for s, parts in _shards_of(batches):
            held = []
            for a, runs, b, c in parts:
                b = np.frombuffer(b, _U)
                held.append((np.repeat(np.frombuffer(a, _U), np.frombuffer(runs, "<u4")), b, _unvarint(c, len(b))))
            del parts
            a, b, c = merged(held)
            del held
            yield _finished(s, f"{uri}/pairs-{s:06d}-{uuid.uuid4().hex}", a, b, c)

    return _dealt(docs.select("text").mapInArrow(local, _PAIR_MAP), shards).mapInArrow(merge, _PAIR_SHARD)


def _vocabulary(counts: DataFrame, shards: int, hot: np.ndarray, uri: str) -> Vocabulary:
    def write(batches):
        for b in batches:
            for s, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                path = f"{uri}/vocabulary-{s:06d}-{uuid.uuid4().hex}"
                write_bytes(path, k)
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path], pa.string()), pa.array([len(k) // 8], pa.int64())], ["shard", "path", "n"])

    rows = counts.select("shard", "keys").mapInArrow(write, "shard int, path string, n long").collect()
    sizes = np.zeros(shards + 1, np.int64)
    for r in rows:
        sizes[r.shard + 1] = r.n
    vocab = Vocabulary(shards, {r.shard: r.path for r in rows}, np.cumsum(sizes), np.zeros(0, np.int64))
    if vocab.starts[-1] >= 2**32:
        raise ValueError(f"{vocab.starts[-1]} distinct words: ids have four bytes")
    # ranks of the few frequent words, in the workers
    paths = counts.sparkSession.createDataFrame([(h,) for h in hot.view(np.int64).tolist()], "h long")

    def ranks(batches):
        for b in batches:
            h = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(_U)
            yield pa.RecordBatch.from_arrays([pa.array(Ids(vocab).of(h), pa.int64())], ["i"])

    vocab.hot = np.sort(np.array([r.i for r in paths.mapInArrow(ranks, "i long").collect()], np.int64))
    return vocab


def _triple_counts(docs: DataFrame, v: Vocabulary, hot: np.ndarray, uri: str) -> DataFrame:
    """Counts triples and writes each shard's file, then the pairs' files. Rows as from _pair_counts, a pair's count being
    the number of distinct words before it, or its occurrences at a text's begin; and rows with the path and the counts of
    counts of a shard of triples. Columns of a pair's file: count, then of the triples that begin with it the occurrences,
    and how many occur once, twice, more often."""
    shards, low = v.shards, 2**32 - 1
    shared = docs.sparkSession.sparkContext.broadcast(v)
    row = "shard int, a binary, runs binary, b binary, c binary, n binary, tpath string, t1 long, t2 long, t3 long, t4 long"
    types = (pa.int32(), *[pa.binary()] * 5, pa.string(), *[pa.int64()] * 4)
    names = ["shard", "a", "runs", "b", "c", "n", "tpath", "t1", "t2", "t3", "t4"]

    def batch(rows):
        rows = [(i, *map(_squeezed, row[:5]), *row[5:]) for i, *row in rows]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types, strict=True)], names)

    def blocks(s, a, *cols):
        """Rows for each shard; within, a stays sorted."""
        order = np.argsort(s, kind="stable")
        cuts = np.searchsorted(s[order], np.arange(shards + 1)).tolist()
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            if y > x:
                at = order[x:y]
                g = group_starts(a[at])
                yield i, _planes(a[at][g]), _varint(np.diff(np.append(g, y - x))), *(c[at] for c in cols)

    def firsts(a, runs):
        a = _unplanes(a)
        return np.repeat(a, _unvarint(runs, len(a)))

    def merged(two, c, n):
        """Sorted distinct triples (first two words in one number) with their counts."""
        order = np.lexsort((c, two))
        two, c = two[order], c[order]
        g = np.flatnonzero(np.concatenate([[True], (two[1:] != two[:-1]) | (c[1:] != c[:-1])])) if len(c) else np.zeros(0, np.int64)
        return two[g], c[g], np.add.reduceat(n[order], g, dtype=np.int64) if len(g) else n[:0].astype(np.int64)

    def sent(held):
        two, c, n = merged(*(np.concatenate([x[i] for x in held]) for i in range(3)))
        a, b, c = two >> 32 & low, two & low, c.astype(np.int64)
        return batch([(i, a_, runs, _planes(b_), _planes(c_), _varint(n_), None, *[None] * 4) for i, a_, runs, b_, c_, n_ in blocks(_triple_shard(a, b, c, shared.value), a, b, c, n)])

    def local(batches):
        ids = Ids(shared.value)
        end = int(ids.of(np.array([END], _U))[0])
        held, n = [], 0
        for _, texts in chunks(batches, "text"):
            h, text = tokens(texts)
            kinds, inv = np.unique(h, return_inverse=True)
            c = ids.of(kinds)[inv]
            begin = np.concatenate([[True], text[1:] != text[:-1]])
            b = np.concatenate([[end], c[:-1]])
            b[begin] = end
            a = np.concatenate([[end], b[:-1]])
            a[begin] = end
            held.append((a << 32 | b, c.astype(np.uint32), np.ones(len(c), np.int32)))
            n += len(c)
            if n > HOLD:
                yield sent(held)
                held, n = [], 0
        if held:
            yield sent(held)

    def merge(batches):
        ids = Ids(shared.value)
        end = int(ids.of(np.array([END], _U))[0])
        for s, rows in _shards_of(x.select(range(6)) for x in batches):
            parts = [[_loosened(x) for x in row] for row in rows]
            del rows
            two = np.concatenate([firsts(a, runs).astype(np.int64) << 32 | _unplanes(b) for a, runs, b, _, _ in parts])
            c = np.concatenate([_unplanes(c) for *_, c, _ in parts])
            n = np.concatenate([_unvarint(n, len(c) // 4) for *_, c, n in parts])
            del parts
            two, c, n = merged(two, c, n)
            begin = two & low == end  # the end of a text stands before its begin, and nowhere else
            opening, opened = end << 32 | c[begin].astype(np.int64), n[begin]
            two, c, n = two[~begin], c[~begin], n[~begin]
            key = triple_key(two >> 32 & low, two & low, c)
            order = np.argsort(key)
            key = key[order]
            path = f"{uri}/triples-{s:06d}-{uuid.uuid4().hex}"
            _write_keyed(path, key, n[order])
            del key, order
            yield batch([(s, b"", b"", b"", b"", b"", path, *(int((n == k).sum()) for k in (1, 2, 3, 4)))])
            g = group_starts(two)
            context = [np.add.reduceat(x, g, dtype=np.int64) if len(g) else n[:0] for x in (n, n == 1, n == 2, n >= 3)]
            front = two[g]
            two <<= 32
            two |= c
            del c, n, g
            after, before = _counted(two)
            del two
            none = np.zeros(len(after) + len(opening), np.int64)
            key, *cols = _sum_columns(np.concatenate([front, after, opening]), np.concatenate([np.zeros(len(front), np.int64), before, opened]), *(np.concatenate([x, none]) for x in context))
            del front, after, before, none, context
            a, b = key >> 32 & low, key & low
            del key
            to = _id_shard(a, shared.value)
            x = _is_hot(a, shared.value)
            to[x] = _pair_shard(ids.hashes(a[x]), ids.hashes(b[x]), shards, hot)
            order = np.lexsort((b, a))
            for i, a_, runs, b_, *cols_ in blocks(to[order], a[order], b[order], *(x[order] for x in cols)):
                parts = [_varint(x) for x in cols_]
                yield batch([(i, a_, runs, _planes(b_), np.array([len(p) for p in parts], "<u8").tobytes(), b"".join(parts), None, *[None] * 4)])

    def finish(batches):
        ids = Ids(shared.value)
        for s, rows in _shards_of(batches):
            parts = []
            for a, runs, b, sizes, raw, tpath, *t in rows:
                if tpath is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([y], k) for y, k in zip((s, *[None] * 9, tpath, *t), out_types, strict=True)], out_names)
                    continue
                a, runs, b, sizes, raw = map(_loosened, (a, runs, b, sizes, raw))
                cuts = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<u8").astype(np.int64))]).tolist()
                parts.append((a, runs, b, [raw[p:q] for p, q in zip(cuts[:-1], cuts[1:])]))
            del rows
            if not parts:
                continue
            key = np.concatenate([firsts(a, runs).astype(_U) << _U(32) | _unplanes(b) for a, runs, b, _ in parts])
            order = np.argsort(key, kind="stable")
            key = key[order]
            g = group_starts(key)
            key = key[g]
            cols = []
            for i in range(5):
                cols.append(np.add.reduceat(np.concatenate([_unvarint(raw[i], len(b) // 4) for _, _, b, raw in parts])[order], g))
            del parts, order, g
            by_id = (key >> _U(32)).astype(np.int64), (key & _U(low)).astype(np.int64)
            del key
            done = _finished(s, f"{uri}/pairs-{s:06d}-{uuid.uuid4().hex}", *map(ids.hashes, by_id), *cols, ids=by_id)
            yield pa.RecordBatch.from_arrays([*done.columns, pa.array([None], pa.string()), *[pa.array([None], pa.int64())] * 4], out_names)

    out_names = ["shard", "path", "a", "first", "b", "second", "n1", "n2", "n3", "n4", "tpath", "t1", "t2", "t3", "t4"]
    out_types = (pa.int32(), pa.string(), *[pa.binary()] * 4, *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 4)
    triples = _dealt(docs.select("text").mapInArrow(local, row), shards).mapInArrow(merge, row)
    return _dealt(triples, shards).mapInArrow(finish, f"{_PAIR_SHARD}, tpath string, t1 long, t2 long, t3 long, t4 long")


_STATS = "shard int, keys binary, total long, cont binary, gamma binary, sum binary, n1 long, n2 long, n3 long, n4 long, n3plus long"


def _word_stats(pairs: DataFrame, shards: int, d2: tuple[float, float, float], vocab: Vocabulary | None) -> DataFrame:
    """By word shard: word, distinct words before it, weight after it, and total after it. With a vocabulary, words travel
    by id; ids are ranks by hash, so both ascend together."""

    def words(raw):
        return _unplanes(_loosened(raw)).astype(np.int64) if vocab else np.frombuffer(raw, _U)

    def told(k):
        return _squeezed(_planes(k)) if vocab else k.tobytes()

    def cuts(k):
        return np.searchsorted(k, vocab.starts).tolist() if vocab else np.searchsorted(_shard(k, shards), np.arange(shards + 1)).tolist()

    def split(batches):
        for batch in batches:
            for a, first, b, second in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
                ka, kb = words(a), words(b)
                ends = np.frombuffer(first, "<u4" if len(first) == 16 * len(ka) else "<u8").astype(np.int64).reshape(4, -1)
                cont = _unvarint(second, len(kb))
                ca, cb = cuts(ka), cuts(kb)
                rows = []
                for s in range(shards):
                    x, y, p, q = ca[s], ca[s + 1], cb[s], cb[s + 1]
                    if y > x or q > p:
                        rows.append((s, told(ka[x:y]), ends[:, x:y].astype("<u8").tobytes() if ends.size and ends.max() >= 2**32 else b"4" + ends[:, x:y].astype("<u4").tobytes(), told(kb[p:q]), _varint(cont[p:q])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "a", "first", "b", "second"])

    def merge(batches):
        for s, rows in _shards_of(batches):
            parts = []
            for a, first, b, second in rows:
                ka, kb = words(a), words(b)
                ends = np.frombuffer(first, "<u4", offset=1) if len(first) % 8 == 1 else np.frombuffer(first, "<u8")
                parts.append((ka, ends.astype(np.int64).reshape(4, -1), kb, _unvarint(second, len(kb))))
            ka, *ends = _sum_columns(np.concatenate([p[0] for p in parts]), *np.concatenate([p[1] for p in parts], axis=1))
            kb, cont = _sum_columns(np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts]))
            keys = np.union1d(ka, kb)
            c = np.zeros(len(keys), np.int64)
            c[np.searchsorted(keys, kb)] = cont
            total, gamma = np.zeros(len(keys), np.int64), np.ones(len(keys))
            at = np.searchsorted(keys, ka)
            total[at] = ends[0]
            gamma[at] = (d2[0] * ends[1] + d2[1] * ends[2] + d2[2] * ends[3]) / ends[0]
            ns = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            keys = Ids(vocab).hashes(keys) if vocab else keys
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in zip((s, keys.tobytes(), int(c.sum()), _varint(c), gamma.tobytes(), _varint(total), *ns, int((c >= 3).sum())), (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 3, *[pa.int64()] * 5), strict=True)],
                ["shard", "keys", "total", "cont", "gamma", "sum", "n1", "n2", "n3", "n4", "n3plus"],
            )

    return _dealt(pairs.mapInArrow(split, "shard int, a binary, first binary, b binary, second binary"), shards).mapInArrow(merge, _STATS)


def _write_words(stats: DataFrame, counts: DataFrame, uri: str, d1, total: int, floor: float) -> DataFrame:
    joined = stats.select("shard", "keys", "cont", "gamma", "sum").join(counts.select("shard", F.col("keys").alias("wkeys"), F.col("a").alias("wcounts")), "shard")

    def write(batches):
        for batch in batches:
            for s, k, cont, gamma, after, wk, wc in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                keys, wkeys = np.frombuffer(k, _U), np.frombuffer(wk, _U)
                n = len(keys)
                c = _unvarint(cont, n)
                p = np.maximum(c - _discount(c, d1), 0) / max(total, 1) + floor
                count = np.zeros(n, np.int64)
                at = np.searchsorted(wkeys, keys)
                at = np.minimum(at, len(wkeys) - 1)
                ok = wkeys[at] == keys
                count[ok] = np.frombuffer(wc, "<u8")[at[ok]].astype(np.int64)
                path = f"{uri}/words-{s:06d}-{uuid.uuid4().hex}"
                write_bytes(path, np.array([n], "<u8").tobytes(), keys.tobytes(), p.tobytes(), gamma, _unvarint(after, n).astype("<u8").tobytes(), count.astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([path], pa.string())], ["shard", "path"])

    return saved(joined.mapInArrow(write, "shard int, path string"), "word-files")


class Scorer:
    """A worker's view of the model: arrays are mapped when first needed."""

    def __init__(self, model: Model):
        self.m, self.maps = model, {}
        self.ids = Ids(model.vocab) if model.vocab else None

    def _words(self, s: int):
        if ("w", s) not in self.maps:
            path = self.m.words.get(s)
            if path is None:
                self.maps["w", s] = (np.zeros(0, _U), *[np.zeros(0)] * 2, *[np.zeros(0, np.int64)] * 2)
            else:
                raw = open_mapped(path)
                n = int(raw[:8].view("<u8")[0])
                cut = [raw[8 + 8 * n * i : 8 + 8 * n * (i + 1)] for i in range(5)]
                self.maps["w", s] = (cut[0].view(_U), cut[1].view("<f8"), cut[2].view("<f8"), cut[3].view("<i8"), cut[4].view("<i8"))
        return self.maps["w", s]

    def _keyed(self, kind: str, s: int, width: int):
        if (kind, s) not in self.maps:
            path = (self.m.pairs if kind == "p" else self.m.triples).get(s)
            self.maps[kind, s] = Keyed(path, width) if path is not None else None
        return self.maps[kind, s]

    def _counts(self, kind: str, shard: np.ndarray, key: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((width, len(key)), np.int64)
        for s, at in _by_shard(shard):
            file = self._keyed(kind, s, width)
            if file is not None and file.n:
                at = at[np.argsort(key[at])]  # ascending look-ups stay within few pages
                pos, ok = file.find(key[at])
                out[:, at[ok]] = file.counts(pos[ok])
        return out

    def words(self, h: np.ndarray):
        """Backed-off probability, weight after, total after, count, for distinct hashes."""
        p, gamma = np.full(len(h), self.m.floor), np.ones(len(h))
        total, count = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        for s, at in _by_shard(_shard(h, self.m.shards)):
            keys, *cols = self._words(s)
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, h[at]), len(keys) - 1)
                ok = keys[pos] == h[at]
                for out, col in zip((p, gamma, total, count), cols, strict=True):
                    out[at[ok]] = col[pos[ok]]
        return p, gamma, total, count

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A row a column of the pairs' files."""
        return self._counts("p", _pair_shard(a, b, self.m.shards, self.m.hot), pair_key(a, b), 5 if self.m.triples is not None else 1)

    def triples(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Counts of triples of hashes in the vocabulary."""
        kinds, inv = np.unique(np.concatenate([a, b, c]), return_inverse=True)
        a, b, c = np.split(self.ids.of(kinds)[inv], 3)
        return self._counts("t", _triple_shard(a, b, c, self.m.vocab), triple_key(a, b, c), 1)[0]

    def score(self, texts: list[bytes]):
        """n_tokens, n_known, log10 probability and the smoothed single-word log10 probability of each text."""
        h, text = tokens(texts)
        kinds, inv = np.unique(h, return_inverse=True)
        p, gamma, total, count = self.words(kinds)
        end = np.searchsorted(kinds, np.array([END], _U))[0]
        prev = np.concatenate([[end], inv[:-1]])
        prev[np.concatenate([[True], text[1:] != text[:-1]])] = end
        code = prev * np.int64(len(kinds)) + inv
        distinct, dinv = np.unique(code, return_inverse=True)
        da, db = distinct // len(kinds), distinct % len(kinds)
        cols = np.zeros((5 if self.m.triples is not None else 1, len(distinct)), np.int64)
        maybe = np.flatnonzero((total[da] > 0) & (count[db] > 0))  # other pairs can't have been seen
        cols[:, maybe] = self.pairs(kinds[da[maybe]], kinds[db[maybe]])
        c = cols[0]
        seen = total[da] > 0
        prob = np.where(seen, np.maximum(c - _discount(c, self.m.d2), 0) / np.maximum(total[da], 1) + gamma[da] * p[db], p[db])
        prob = prob[dinv]
        if self.m.triples is not None:
            prob = self._third(kinds, text, inv, dinv, da, cols, prob)
        lp = np.log10(prob)
        base = np.log10((count + 0.5) / (self.m.train_tokens + 0.5 * (self.m.vocabulary + 1)))[inv]
        starts = group_starts(text)
        return (np.diff(np.append(starts, len(text))), np.add.reduceat((count > 0)[inv].astype(np.int64), starts), np.add.reduceat(lp, starts), np.add.reduceat(base, starts))


    def _third(self, kinds, text, inv, dinv, da, cols, prob):
        """Probabilities after two words, given those after one. A text's first word has no second one before it."""
        at = np.flatnonzero(np.concatenate([[False], text[1:] == text[:-1]]))
        at = at[cols[1][dinv[at - 1]] > 0]  # the words before have been seen before a word
        before = dinv[at - 1]
        code, back = np.unique(before * np.int64(len(kinds)) + inv[at], return_inverse=True)
        first, last = code // len(kinds), code % len(kinds)
        some = np.zeros(len(code), np.int64)
        some[back] = at
        n = np.zeros(len(code), np.int64)
        maybe = np.flatnonzero(cols[0][dinv[some]] > 0)  # other triples can't have been seen
        if len(maybe):
            n[maybe] = self.triples(kinds[da[first[maybe]]], kinds[inv[some[maybe] - 1]], kinds[last[maybe]])
        total = cols[1][first]
        gamma = (self.m.d3[0] * cols[2][first] + self.m.d3[1] * cols[3][first] + self.m.d3[2] * cols[4][first]) / total
        out = prob.copy()
        out[at] = (np.maximum(n - _discount(n, self.m.d3), 0) / total)[back] + gamma[back] * prob[at]
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every text (null: empty, its end alone).
    The model's arrays are mapped from the shared folder; only their paths travel."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches):
        s = Scorer(shared.value)
        for batch, texts in chunks(batches, "text"):
            n, known, lp, base = s.score(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), shared.value.train_tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(lp, pa.float64()), pa.array(10 ** np.minimum(-lp / n, 300), pa.float64())],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(apply, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
