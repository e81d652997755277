"""Line dedup by an exact set-similarity join.

A line is its set of words (A-Z lower-cased). Lines with equal sets form a class, told apart by 96 hash bits; the classes
are joined: words are ordered by rarity (a counting sketch of fixed size gives the order; any total order is right), the
rarest words of each set (prefix filter) index it, and pairs that meet under a word pass the length and positional
filters, and a bitmap filter (128 parity bits of each set differ in no more bits than the sets do in words), before their
sets are fetched and the Jaccard similarity is verified. A line goes if an earlier line, by (doc_id, line number), matches.

Postings travel as blocks of columns, dealt by ranges of the word's hash whose number follows from the number of postings,
so a task holds one range of bounded size at a time. Words that may stand in more prefixes than a range holds are dealt by
the class instead, counted, and met cell by cell: first inside cells, where most members of a large group of near copies
find an earlier one; the rest then visit the word's other cells.

Under a word, each class asks for its earliest candidate first; those that no candidate settled ask for more and more, until
every pair that passes the filters is settled. So a group of near copies costs a few comparisons a class, and no group emits
all its pairs. Later rounds read the postings of the words still open, and the sets of the classes that they compare.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, chunks, group_starts, mix, saved

_U = np.uint64
THRESHOLD = 0.8
BUCKETS = 1 << 24
#: Steps of a frequency class for each doubling of the count.
STEPS = 6
#: Bits of the filter that tells which classes' sets are fetched; when it fills up, more sets than needed are fetched.
BLOOM = 1 << 26
FIRST_ROUND, GROWTH = 1, 256
#: Postings that a task gathers before it sends them on; those of a range, about.
HOLD, RANGE = 600_000, 600_000
#: A word that may have more postings is met in cells of about CELL postings.
FREQUENT, CELL = 600_000, 4096
#: Parts that a word's rows are dealt to when they learn how many they are.
SALTS = 8
#: Pairs looked at in one go, inside a task.
PAIRS = 500_000
#: Runs of a word up to this size are met in one go.
RUN = 512


def need(a, b, t: float = THRESHOLD):
    """Words that sets of a and b words must share."""
    return np.ceil(t / (1 + t) * (a + b) - 1e-9)


def prefix_length(n):
    return n - np.ceil(THRESHOLD * n - 1e-9).astype(np.int64) + 1


#: A word of up to LONG bytes is hashed eight bytes at a time, beside the others; a longer one by itself.
LONG = 64
_SOLID = bytes(b not in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D) for b in range(256))
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words raw[starts:ends]; at least eight bytes of raw follow the last one."""
    eight = np.ndarray(max(0, len(raw) - 7), "<u8", raw, strides=(1,))
    size = ends - starts
    h = mix((eight[starts] & _FIRST[np.minimum(size, 8)]) ^ size.astype(_U) * _U(0x9FB21C651E98DF25))
    k, at = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(at):
        h[at] = mix(h[at] ^ (eight[starts[at] + k] & _FIRST[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    for j in np.flatnonzero(size > LONG).tolist():
        h[j] = int.from_bytes(hashlib.blake2b(raw[starts[j] : ends[j]], digest_size=8).digest(), "little")
    return h


def _line_order(h: np.ndarray, line: np.ndarray, code: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """h and code by (line, code, h), of words whose lines ascend. One sort of a packed key does it, unless different words
    agree in the hash bits of the key. Without code, all are 0."""
    if code is None:
        code = np.zeros(len(h), np.uint8)
    if not len(h):
        return h, code
    if int(line[-1]) < 1 << 24:
        key = line.astype(_U) << _U(40)
        key |= code.astype(_U) << _U(32)
        key |= h >> _U(32)
        order = np.argsort(key)
        k, x = key[order], h[order]
        if not ((k[1:] == k[:-1]) & (x[1:] != x[:-1])).any():
            return x, (k >> _U(32)).astype(np.uint8)
    order = np.lexsort((h, line << 8 | code))
    return h[order], code[order]


class Lines:
    """Sets of the non-blank lines of several texts: text, line number, size, class keys, and words ordered by rarity."""

    def __init__(self, texts: list[bytes], rarity: np.ndarray | None = None):
        raw = b"".join((b" ", b"\n".join(texts), b"         ")).translate(_LOWER)
        solid = np.frombuffer(raw.translate(_SOLID), bool)
        edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
        starts, ends = edge[0::2], edge[1::2]
        self.all_hashes = h = word_hashes(raw, starts, ends)
        newlines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        words = np.diff(np.searchsorted(starts, newlines), prepend=0, append=len(starts))  # of each line
        line = np.repeat(np.arange(len(words)), words)
        h, code = _line_order(h, line, None if rarity is None else rarity[(h >> _U(40)).astype(np.int64)])
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
        self.words, line, self.code = h[fresh], line[fresh], code[fresh]
        self.start = group_starts(line)
        self.size = np.diff(np.append(self.start, len(line)))
        line = line[self.start]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.searchsorted(newlines, np.cumsum(lens + 1) - lens)  # a text's first line
        self.text = np.searchsorted(base, line, "right") - 1
        self.line = (line - base[self.text] if len(line) else line).astype(np.int32)
        self.k1 = self._sums(mix(self.words ^ _U(0x1234567))).view(np.int64)
        self.k2 = (self._sums(mix(self.words * _U(0x9E3779B97F4A7C15) + _U(1))) >> _U(32)).astype(np.uint32).view(np.int32)

    def _sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.start) if len(self.start) else np.zeros(0, _U)

    def bits(self) -> list[np.ndarray]:
        """128 parity bits of each set, in two halves."""
        one, high = _U(1) << (self.words >> _U(3) & _U(63)), (self.words >> _U(9) & _U(1)).astype(bool)
        return [np.bitwise_xor.reduceat(np.where(h, one, _U(0)), self.start).view(np.int64) if len(self.start) else np.zeros(0, np.int64) for h in (high, ~high)]


_TEXT = ["doc_id", "text_hash", "lines", "k1", "k2", "n_lines"]


def first_scan(docs: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """From one pass over the texts: every text's non-blank lines (doc_id, text_hash, arrays of line numbers and class
    keys, and the number of lines), the frequency class of each bucket of words (0: the bucket's word occurs once in all), and the
    number of postings. A task's counts travel as blocks beside its lines."""
    block = 1 << 18

    def scan(batches):
        total = np.zeros(BUCKETS, np.int32)
        for batch, texts in chunks(batches, "text"):
            s = Lines(texts)
            b = np.sort((s.all_hashes >> _U(40)).astype(np.uint32))
            g = group_starts(b)
            total[b[g]] += np.diff(np.append(g, len(b))).astype(np.int32)
            edges = pa.array(np.searchsorted(s.text, np.arange(len(texts) + 1)).astype(np.int32))
            posts = np.bincount(s.text, np.where(s.size >= 4, prefix_length(s.size), 0), minlength=len(texts)).astype(np.int64)
            lists = [pa.ListArray.from_arrays(edges, pa.array(c)) for c in (s.line, s.k1, s.k2)]
            m = len(texts)
            yield pa.RecordBatch.from_arrays([pa.array(_ids(batch.column(0))), batch.column(1), *lists, pa.array([(x.count(b"\n") + 1) * there for x, there in zip(texts, batch.column(2).is_valid().to_pylist())], pa.int32()), pa.array(posts), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary())], names)
        for k in range(0, BUCKETS, block):
            at = np.flatnonzero(total[k : k + block])
            if len(at):
                nothing = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int32(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*nothing, pa.array([k // block], pa.int32()), pa.array([at.astype(np.uint32).tobytes()], pa.binary()), pa.array([total[k + at].tobytes()], pa.binary())], names)

    def merge(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums.setdefault(k, np.zeros(block, np.int64))[np.frombuffer(cells, np.uint32)] += np.frombuffer(counts, np.int32)
        for k, x in sums.items():
            code = np.minimum(255, np.round(STEPS * np.log2(np.maximum(x, 1)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([code.tobytes()], pa.binary())], ["block", "codes"])

    names = [*_TEXT, "posts", "block", "cells", "counts"]
    scanned = saved(docs.mapInArrow(scan, "doc_id long, text_hash long, lines array<int>, k1 array<long>, k2 array<int>, n_lines int, posts long, block int, cells binary, counts binary"), "lines")
    blocks = scanned.where("cells is not null").select("block", "cells", "counts").repartition(BUCKETS // block, "block").mapInArrow(merge, "block int, codes binary")
    codes = np.zeros(BUCKETS, np.uint8)
    for r in blocks.collect():  # one byte a bucket
        codes[r.block * block : (r.block + 1) * block] = np.frombuffer(r.codes, np.uint8)
    texts = scanned.where("cells is null")
    return texts.select(*_TEXT), codes, int(texts.agg(F.sum("posts")).first()[0] or 0)


def _ids(column: pa.Array) -> np.ndarray:
    """doc_ids; null is the largest long."""
    return np.array([2**63 - 1 if x is None else x for x in column.to_pylist()], np.int64)


#: A block's columns: the word's upper 40 bits as differences, the class, its parity bits, its first place, its size, and the
#: word's position. Numbers that are mostly small are laid out byte by byte, so that the shuffle's compression takes the zeros.
_COLUMNS = (("word", "<u8", True), ("k1", "<i8", False), ("k2", "<i4", False), ("bits1", "<i8", False), ("bits2", "<i8", False), ("doc_id", "<i8", True), ("line", "<i4", True), ("n", "<i4", True), ("i", "<i4", True))


def _packed(cols: list[np.ndarray]) -> bytes:
    out = []
    for x, (_, kind, planes) in zip(cols, _COLUMNS, strict=True):
        raw = np.ascontiguousarray(x.astype(kind)).view(np.uint8)
        out.append(raw.reshape(-1, np.dtype(kind).itemsize).T.tobytes() if planes else raw.tobytes())
    return b"".join(out)


def _unpacked(raw: bytes, n: int) -> list[np.ndarray]:
    out, at = [], 0
    for _, kind, planes in _COLUMNS:
        size = np.dtype(kind).itemsize
        x = np.frombuffer(raw, np.uint8, n * size, at)
        out.append((x.reshape(size, n).T.copy() if planes else x).view(kind).ravel())
        at += n * size
    out[0] = np.cumsum(out[0], dtype=np.uint64)
    return out


def _postings(docs: DataFrame, rarity, ranges: int, parts: int) -> DataFrame:
    """Blocks (range, n, block) of a row for each prefix word of each distinct set of a chunk. Words that may be too
    frequent for a range go to the ranges after the last."""
    frequent = STEPS * np.log2(FREQUENT)

    def apply(batches):
        table = rarity.value
        held: list[list[np.ndarray]] = []

        def send():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            word, to = cols[0], cols.pop()
            order = np.argsort(word)  # ranges ascend with the word
            if int(to.max()) >= ranges:
                order = order[np.argsort(to[order], kind="stable")]
            to = to[order]
            cols = [c[order] for c in cols]
            g = group_starts(to)
            rows = []
            for a, b in zip(g.tolist(), np.append(g[1:], len(to)).tolist()):
                part = [c[a:b] for c in cols]
                part[0] = np.diff(part[0], prepend=_U(0))
                rows.append((int(to[a]), b - a, _packed(part)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["range", "n", "block"])

        for batch, texts in chunks(batches, "text"):
            s = Lines(texts, table)
            doc = _ids(batch.column(0))[s.text]
            first = np.lexsort((s.line, doc, s.k2, s.k1))
            fresh = np.ones(len(first), bool)
            fresh[1:] = (s.k1[first][1:] != s.k1[first][:-1]) | (s.k2[first][1:] != s.k2[first][:-1])
            rep = first[fresh]
            rep = rep[s.size[rep] >= 4]  # smaller sets match only if they are equal
            plen = prefix_length(s.size[rep])
            row = np.repeat(rep, plen)
            i = np.arange(len(row)) - np.repeat(np.cumsum(plen) - plen, plen)
            at = s.start[row] + i
            shared = s.code[at] > 0  # a word that occurs once can't be shared
            row, i, at = row[shared], i[shared], at[shared]
            word = s.words[at] >> _U(24)
            to = ((word >> _U(8)) * _U(ranges) >> _U(32)).astype(np.int64)
            if (hot := s.code[at] >= frequent).any():
                to[hot] = ranges + (s.k1[row[hot]].view(_U) % _U(parts)).astype(np.int64)
            held.append([word, s.k1[row], s.k2[row], *(x[row] for x in s.bits()), doc[row], s.line[row], s.size[row], i, to])
            if sum(len(c[0]) for c in held) > HOLD:
                yield send()
        if sum(len(c[0]) for c in held):
            yield send()

    return docs.mapInArrow(apply, "range long, n int, block binary")


def _passing(n, i, bits, a, b):
    """The pairs of positions that pass the length, positional and bitmap filters. bits: two unsigned halves."""
    na, nb = n[a], n[b]
    ok = np.flatnonzero((na >= THRESHOLD * nb - 1e-9) & (nb >= THRESHOLD * na - 1e-9))
    if len(ok) < len(a):
        a, b, na, nb = a[ok], b[ok], na[ok], nb[ok]
    spare = na + nb - 2 * need(na, nb)
    ok = np.flatnonzero(np.bitwise_count(bits[0][a] ^ bits[0][b]) + np.bitwise_count(bits[1][a] ^ bits[1][b]) <= spare)
    a, b, na, nb, spare = a[ok], b[ok], na[ok], nb[ok], spare[ok]
    ok = 2 * np.minimum(na - i[a], nb - i[b]) >= na + nb - spare
    return a[ok], b[ok]


def candidates_in_runs(word, n, i, bits, asked, serves, lo: int, hi: int, kept: np.ndarray | None = None):
    """Within runs of equal words (rows in order of place), in pieces of bounded size: (earlier, later, beyond) positions
    of each asked row's passing earlier candidates number lo to hi that serve; beyond: rows that have more. kept, a mask, is
    set for those and for the rows that may be candidates of theirs, from the first on."""
    kept = np.zeros(len(word), bool) if kept is None else kept
    g = group_starts(word)
    size = np.diff(np.append(g, len(word)))

    def keep(a, b):
        use = asked[b] & serves[a]
        a, b = a[use], b[use]
        o = np.lexsort((a, b))
        a, b = a[o], b[o]
        s = group_starts(b)
        rank = np.arange(len(b)) - np.repeat(s, np.diff(np.append(s, len(b))))
        use, more = (rank >= lo) & (rank < hi), np.unique(b[rank >= hi])
        if len(more):
            kept[more] = kept[a[np.isin(b, more)]] = True
        return a[use], b[use], more

    small = np.flatnonzero((size > 1) & (size <= RUN))
    if len(small):  # in order of size, a row meets the rows before it that aren't too small
        run = np.repeat(np.arange(len(small)), size[small])
        rows = np.arange(len(run)) - np.repeat(np.cumsum(size[small]) - size[small], size[small]) + g[small][run]
        key = run << 32 | n[rows]
        o = np.argsort(key, kind="stable")
        key, rows, run = key[o], rows[o], run[o]
        low = np.searchsorted(key, run << 32 | np.ceil(THRESHOLD * n[rows] - 1e-9).astype(np.int64))
        count = np.arange(len(rows)) - low
        ends = np.cumsum(count)
        tail = np.flatnonzero(np.diff(run, append=-1)) + 1  # ends of runs
        x = done = 0
        while x < len(rows):
            y = int(tail[max(np.searchsorted(ends[tail - 1], done + PAIRS, "right") - 1, np.searchsorted(tail, x, "right"))])
            c = count[x:y]
            b = np.repeat(np.arange(x, y), c)
            a = np.arange(len(b)) - np.repeat(np.cumsum(c) - c - low[x:y], c)
            a, b = _passing(n, i, bits, rows[a], rows[b])
            yield keep(np.minimum(a, b), np.maximum(a, b))
            x, done = y, int(ends[y - 1])
    for at in np.flatnonzero(size > RUN).tolist():  # by classes of size; a row stops when it has found enough
        x, m = int(g[at]), int(size[at])
        kind = np.floor(np.log(n[x : x + m]) / -np.log(THRESHOLD)).astype(np.int64)
        for k in np.unique(kind[asked[x : x + m]]).tolist():
            ask = x + np.flatnonzero((kind == k) & asked[x : x + m])
            serve = x + np.flatnonzero((np.abs(kind - k) <= 1) & serves[x : x + m])
            for c in range(0, len(ask), 64):
                later = ask[c : c + 64]
                stop = int(np.searchsorted(serve, later[-1]))
                got_a, got_b, found = [], [], np.zeros(len(later), np.int64)
                for y in range(0, stop, PAIRS // 64):
                    live = later[found <= hi]
                    if not len(live):
                        break
                    earlier = serve[y : min(y + PAIRS // 64, stop)]
                    b, a = np.repeat(live, len(earlier)), np.tile(earlier, len(live))
                    ok = a < b
                    a, b = _passing(n, i, bits, a[ok], b[ok])
                    got_a.append(a)
                    got_b.append(b)
                    found += np.bincount(np.searchsorted(later, b), minlength=len(later))
                if got_a:
                    found = keep(np.concatenate(got_a), np.concatenate(got_b))
                    if len(found[2]):  # not all of their candidates were looked at
                        kept[serve[:stop]] = True
                    yield found


_POST = ["word", "k1", "k2", "bits1", "bits2", "doc_id", "line", "n", "i"]
#: kind 0: a pair of classes, the later one first, the earlier one (p1, p2, size m, first place p_doc and p_line) beside it; kind 1: a posting of a class
#: that has further candidates under the word (asked), or that may be one of those candidates; kind 2: a posting of a word that may be frequent.
_MET = "kind byte, word long, k1 long, k2 int, bits1 long, bits2 long, doc_id long, line int, n int, i int, p1 long, p2 int, m int, p_doc long, p_line int, asked boolean, serves boolean"
_MET_NAMES = [x.split()[0] for x in _MET.split(", ")]
_MET_TYPES = [{"byte": pa.int8(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[x.split()[1]] for x in _MET.split(", ")]


def _row_batch(kind: int, cols: dict[str, np.ndarray], m: int) -> pa.RecordBatch:
    given = {"kind": np.full(m, kind, np.int8)} | cols
    return pa.RecordBatch.from_arrays([pa.array(given[c]).cast(t) if c in given else pa.nulls(m, t) for c, t in zip(_MET_NAMES, _MET_TYPES, strict=True)], _MET_NAMES)


def first_postings(word, k1, k2, doc, line) -> np.ndarray:
    """The order by (word, place, class) of a class's earliest posting under each word; words of one posting are left out.
    Sorts of packed keys do it, unless a key is too narrow, or unequal classes agree in one."""
    o = np.argsort(word)
    same = word[o][1:] == word[o][:-1]
    o = o[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(o) else o
    if not len(o):
        return o
    w, rank = word[o], np.unique(doc[o], return_inverse=True)[1].astype(_U)
    run = np.concatenate([[0], np.cumsum(w[1:] != w[:-1])]).astype(_U)
    n_run, n_rank, n_line = (int(x.max()).bit_length() for x in (run, rank, line[o]))
    if n_run + n_rank + n_line <= 64 and n_run <= 24:
        key = run << _U(n_rank + n_line) | rank << _U(n_line) | line[o].astype(_U)
        p = np.argsort(key)
        key, o, run = key[p], o[p], run[p]
        one, two = k1[o], k2[o]
        if not ((key[1:] == key[:-1]) & ((one[1:] != one[:-1]) | (two[1:] != two[:-1]))).any():
            key = run << _U(40) | one.view(_U) >> _U(24)
            p = np.argsort(key)
            key, one, two = key[p], one[p], two[p]
            if not ((key[1:] == key[:-1]) & ((one[1:] != one[:-1]) | (two[1:] != two[:-1]))).any():
                return o[np.sort(np.minimum.reduceat(p, group_starts(key)))]
    o = o[np.lexsort((line[o], doc[o], k2[o], k1[o], word[o]))]
    w, one, two = word[o], k1[o], k2[o]
    o = o[np.concatenate([[True], (w[1:] != w[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])]
    return o[np.lexsort((k2[o], k1[o], line[o], doc[o], word[o]))]


def _settled(cols: list[np.ndarray], asked: np.ndarray, serves: np.ndarray, lo: int, hi: int):
    """Rows of kinds 0 and 1 for whole runs of words, in any order."""
    o = first_postings(*(cols[c] for c in (0, 1, 2, 5, 6)))
    cols, asked, serves = [c[o] for c in cols], asked[o], serves[o]
    word, k1, k2, bits1, bits2, doc, line, n, i = cols
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    further, kept = np.zeros(len(word), bool), np.zeros(len(word), bool)

    def fresh():
        """One row a pair, whatever words it meets under here."""
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        pairs.clear()
        o = np.lexsort((k2[a], k1[a], k2[b], k1[b]))
        a, b = a[o], b[o]
        new = np.ones(len(a), bool)
        new[1:] = (k1[a][1:] != k1[a][:-1]) | (k1[b][1:] != k1[b][:-1]) | (k2[a][1:] != k2[a][:-1]) | (k2[b][1:] != k2[b][:-1])
        a, b = a[new], b[new]
        return _row_batch(0, {"k1": k1[b], "k2": k2[b], "doc_id": doc[b], "line": line[b], "n": n[b], "p1": k1[a], "p2": k2[a], "m": n[a], "p_doc": doc[a], "p_line": line[a]}, len(a))

    for a, b, more in candidates_in_runs(word, n.astype(np.int64), i.astype(np.int64), (bits1.view(_U), bits2.view(_U)), asked, serves, lo, hi, kept):
        further[more] = True
        if len(a):
            pairs.append((a, b))
            if sum(len(x) for x, _ in pairs) > 300_000:
                yield fresh()
    if pairs:
        yield fresh()
    if further.any():
        at = np.flatnonzero(kept)
        for x in range(0, len(at), 100_000):
            y = at[x : x + 100_000]
            yield _row_batch(1, dict(zip(_POST, (c[y] for c in (word.view(np.int64), *cols[1:])), strict=True)) | {"asked": further[y], "serves": serves[y]}, len(y))


def _meet_blocks(blocks: DataFrame, ranges: int, hi: int, parts: int) -> DataFrame:
    """The first round: ranges of postings, one at a time."""

    def apply(batches):
        now, held = -1, []

        def out():
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            every = np.ones(len(cols[0]), bool)
            yield from _settled(cols, every, every, 0, hi)

        for batch in batches:
            for r, n, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if r != now and held:
                    yield from out()
                now, cols = r, _unpacked(raw.as_buffer(), n)
                if r < ranges:
                    held.append(cols)
                else:
                    yield _row_batch(2, dict(zip(_POST, (cols[0].view(np.int64), *cols[1:]), strict=True)), n)
        if held:
            yield from out()

    return blocks.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(apply, _MET)


def _meet_rows(rows: DataFrame, lo: int, hi: int) -> DataFrame:
    """A later round, on postings with asked (whether the class asks) and serves (whether others may meet it)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def apply(batches):
        held: list[np.ndarray] | None = None

        def out(cols):
            return _settled([cols[0].view(_U), *cols[1:9]], cols[9].astype(bool), cols[10].astype(bool), lo, hi)

        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held = new if held is None else [np.concatenate([x, y]) for x, y in zip(held, new, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if cut > 100_000:
                yield from out([c[:cut] for c in held])
                held = [c[cut:] for c in held]
        if held is not None and len(held[0]):
            yield from out(held)

    return rows.select(*_POST, "asked", "serves").repartition(parts, "word").sortWithinPartitions("word").mapInArrow(apply, _MET)


def _bit(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The filter's bit of a place."""
    return (mix(doc.view(_U) * _U(0x9E3779B97F4A7C15) + line.astype(_U)) >> _U(38)).astype(np.int64)


def _bloom(places: DataFrame) -> np.ndarray:
    """A bitmap of the places (doc_id, line)."""

    def local(batches):
        bits = np.zeros(BLOOM, bool)
        for b in batches:
            bits[_bit(*(b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)))] = True
        packed = np.packbits(bits).reshape(64, -1)
        some = [i for i in range(64) if packed[i].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([zlib.compress(packed[i].tobytes(), 1) for i in some], pa.binary())], ["block", "bits"])

    def merge(batches):
        out: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(raw), np.uint8)
                out[i] = out[i] | x if i in out else x
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in out.values()], pa.binary())], ["block", "bits"])

    schema = "block int, bits binary"
    bits = np.zeros((64, BLOOM // 512), np.uint8)
    for r in places.mapInArrow(local, schema).repartition(16, "block").mapInArrow(merge, schema).collect():
        bits[r.block] = np.frombuffer(zlib.decompress(r.bits), np.uint8)
    return bits.ravel()


def lines_at(texts: list[bytes], ids: np.ndarray, bits: np.ndarray) -> list[bytes]:
    """The lines of the texts whose places (text's id, line number) the bitmap has, uncut otherwise."""
    raw = b"\n".join(texts)
    newlines = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    starts, ends = np.concatenate([[0], newlines + 1]), np.append(newlines, len(raw))
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.searchsorted(starts, np.cumsum(lens + 1) - lens - 1)
    count = np.diff(np.append(base, len(starts)))
    at = _bit(np.repeat(ids, count), np.arange(len(starts)) - np.repeat(base, count))
    hit = np.flatnonzero(bits[at >> 3] & (128 >> (at & 7)).astype(np.uint8))
    return [raw[a:b] for a, b in zip(starts[hit].tolist(), ends[hit].tolist(), strict=True)]


def _sets(docs: DataFrame, places: DataFrame) -> DataFrame:
    """k1, k2, words: the sets of the classes that stand at the places (doc_id, line), and of a few others. A pass over the
    texts looks for the places; only the lines found are read as words."""
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(places))

    def apply(batches):
        bits = bloom.value
        for batch, texts in chunks(batches, "text"):
            s = Lines(lines_at(texts, _ids(batch.column(0)), bits))
            o = np.lexsort((s.k2, s.k1))
            fresh = np.ones(len(o), bool)
            fresh[1:] = (s.k1[o][1:] != s.k1[o][:-1]) | (s.k2[o][1:] != s.k2[o][:-1])
            hit = o[fresh]
            n = s.size[hit]
            where = np.repeat(s.start[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array(s.k1[hit]), pa.array(s.k2[hit]), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(s.words[where].view(np.int64)))], ["k1", "k2", "words"])

    found = docs.select("doc_id", "text").mapInArrow(apply, "k1 long, k2 int, words array<long>")
    return found.groupBy("k1", "k2").agg(F.first("words").alias("words"))  # repeated rows have the same places


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The later classes (k1, k2) of the pairs that are similar. sets may hold more classes than needed."""
    earlier = sets.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("words").alias("others"))
    same = pairs.join(sets, ["k1", "k2"]).join(earlier, ["p1", "p2"]).withColumn("s", F.size(F.array_intersect("words", "others")))
    return same.where(F.col("s") >= F.lit(THRESHOLD) * (F.col("n") + F.col("m") - F.col("s")) - 1e-9).select("k1", "k2")


def _pairs(met: DataFrame) -> DataFrame:
    return met.where("kind = 0").select("k1", "k2", "doc_id", "line", "n", "p1", "p2", "p_doc", "p_line", "m").distinct()


def _places(pairs: DataFrame) -> DataFrame:
    """Where the pairs' classes stand first."""
    return pairs.select("doc_id", "line").unionByName(pairs.select(F.col("p_doc").alias("doc_id"), F.col("p_line").alias("line")))


def _in_cells(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows of the words under which some class asks, their words split in cells by class where a word has more than CELL
    rows; and the rows of such words, with word0, cell and cells."""
    words = rows.groupBy("word").agg(F.count("*").alias("count"), F.max("asked").alias("any")).where("any")
    words = words.select("word", F.ceil(F.col("count") / CELL).cast("int").alias("cells"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    cut = rows.withColumn("salt", F.pmod(F.xxhash64("k2", "k1"), F.lit(SALTS)).cast("int")).join(words, ["word", "salt"]).drop("salt")
    cut = cut.withColumn("cell", F.pmod(F.xxhash64("k1", "k2"), F.col("cells")).cast("int")).withColumn("word0", F.col("word"))
    cut = saved(cut.withColumn("word", F.when(F.col("cells") == 1, F.col("word")).otherwise(F.xxhash64("word", "cell"))), "line-cells")
    return cut.drop("word0", "cell", "cells"), cut.where("cells > 1")


def _still_open(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows of the words under which a class that isn't gone asks; those that are gone don't ask. Only rows that ask are told
    from those gone: the others are many, and most of their words are settled."""
    asks = rows.where("asked").join(gone.withColumn("__gone", F.lit(True)), ["k1", "k2"], "left")
    asks = asks.withColumn("asked", F.col("__gone").isNull()).drop("__gone")
    words = asks.where("asked").select("word").distinct()
    return asks.unionByName(rows.where("not asked")).join(words, "word", "left_semi")


def _later_rounds(docs: DataFrame, rows: DataFrame, gone: DataFrame) -> DataFrame:
    """gone, with the classes that the candidates in rows (asked: of classes that ask) settle."""
    own, apart = _in_cells(_still_open(rows, gone).withColumn("serves", F.lit(True)))
    if own.isEmpty():
        return gone
    visit = apart.where("asked").withColumn("cell", F.explode(F.filter(F.sequence(F.lit(0), F.col("cells") - 1), lambda c: c != F.col("cell"))))
    visit = visit.withColumn("word", F.xxhash64("word0", "cell")).withColumn("serves", F.lit(False)).drop("word0", "cell", "cells")
    rows, lo, hi = own.unionByName(visit), 0, FIRST_ROUND * GROWTH
    while True:
        met = saved(_meet_rows(rows, lo, hi), "line-pairs")
        pairs = saved(_pairs(met), "line-pairs")
        gone = saved(_verified(pairs, _sets(docs, _places(pairs))).unionByName(gone).distinct(), "line-gone")
        rows = saved(_still_open(met.where("kind = 1").select(*_POST, "asked", "serves"), gone), "line-open")
        if rows.isEmpty():
            return gone
        lo, hi = hi, hi * GROWTH


def matches(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All texts with their non-blank lines (doc_id, text_hash, lines, k1, k2; null doc_id last) and the classes (k1, k2)
    that match an earlier one."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _text_hash("text").alias("text_hash"), F.col("text").cast("string").alias("text"))
    texts, codes, total = first_scan(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(parts, -(-total // RANGE))
    blocks = _postings(docs.select("doc_id", "text"), spark.sparkContext.broadcast(codes), ranges, parts)
    met = saved(_meet_blocks(blocks, ranges, FIRST_ROUND, parts), "line-pairs")
    pairs, open_ = _pairs(met), met.where("kind = 1").select(*_POST, "asked")
    heavy = met.where("kind = 2").select(*_POST)
    if not heavy.isEmpty():  # first inside a cell, where most classes of a large group of near copies find an earlier one
        own, _ = _in_cells(heavy.withColumn("asked", F.lit(True)))
        pairs = pairs.unionByName(_pairs(_meet_rows(own.withColumn("serves", F.lit(True)), 0, FIRST_ROUND)))
        open_ = open_.unionByName(heavy.withColumn("asked", F.lit(True)))
    pairs = saved(pairs, "line-pairs")
    gone = saved(_verified(pairs, _sets(docs, _places(pairs))).distinct(), "line-gone")
    return texts, _later_rounds(docs, open_, gone)


def _text_hash(column: str):
    return F.xxhash64(F.col(column).cast("string"))


def _staying(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """doc_id, text_hash and line of the first line of each class that isn't gone. Lines travel as blocks by ranges of the
    class key; a line that is in every text is cut down to one row a task before."""
    spark = texts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = int(texts.agg(F.sum(F.size("lines"))).first()[0] or 0)
    ranges = max(parts, -(-n // RANGE))

    def firsts(k1, k2, doc, line, th):
        o = np.lexsort((th, line, doc, k2, k1))
        k1, k2 = k1[o], k2[o]
        new = np.ones(len(o), bool)
        new[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
        return k1[new], k2[new], *(c[o[new]] for c in (doc, line, th))

    def sent(cols):
        to = ((cols[0].view(_U) >> _U(32)) * _U(ranges) >> _U(32)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        g = group_starts(to[order])
        rows = []
        for a, b in zip(g.tolist(), np.append(g[1:], len(to)).tolist()):
            at = order[a:b]
            rows.append((int(to[at[0]]), b - a, b"".join(c[at].tobytes() for c in cols)))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary()), strict=True)], ["range", "n", "block"])

    def local(batches):
        held, m = [], 0
        for b in batches:
            lines, k1, k2 = (b.column(i) for i in (2, 3, 4))
            row = np.repeat(np.arange(len(b)), lines.value_lengths().to_numpy(zero_copy_only=False))
            held.append([k1.flatten().to_numpy(), k2.flatten().to_numpy(), b.column(0).to_numpy()[row], lines.flatten().to_numpy(), b.column(1).to_numpy()[row]])
            m += len(row)
            if m > HOLD:
                yield sent(firsts(*(np.concatenate(c) for c in zip(*held, strict=True))))
                held, m = [], 0
        if m:
            yield sent(firsts(*(np.concatenate(c) for c in zip(*held, strict=True))))

    def leaving(batches):
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            none = np.full(len(k1), -1, np.int64)
            if len(k1):
                yield sent((k1, k2, none, none.astype(np.int32), none))

    def merge(batches):
        now, held, left = -1, [], []

        def out():
            if not held:
                return
            cols = firsts(*(np.concatenate(c) for c in zip(*held, strict=True)))
            if left:
                key = [np.concatenate([c, *(x[i] for x in left)]) for i, c in enumerate(cols[:2])]
                o = np.lexsort((np.arange(len(key[0])) < len(cols[0]), key[1], key[0]))  # those that leave stand first
                a, b = o[:-1], o[1:]
                hit = b[(key[0][a] == key[0][b]) & (key[1][a] == key[1][b]) & (a >= len(cols[0]))]
                keep = np.ones(len(cols[0]), bool)
                keep[hit[hit < len(cols[0])]] = False
                cols = [c[keep] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (cols[2], cols[4], cols[3])], ["doc_id", "text_hash", "line"])

        for b in batches:
            for r, m, raw, leave in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r != now:
                    yield from out()
                    now, held, left = r, [], []
                at, cols = 0, []
                for kind in ("<i8", "<i4", "<i8", "<i4", "<i8"):
                    cols.append(np.frombuffer(raw, kind, m, at))
                    at += m * np.dtype(kind).itemsize
                (left if leave else held).append(cols)
        yield from out()

    schema = "range long, n int, block binary"
    both = texts.mapInArrow(local, schema).withColumn("leave", F.lit(False)).unionByName(gone.mapInArrow(leaving, schema).withColumn("leave", F.lit(True)))
    return both.repartition(parts, "range").sortWithinPartitions("range").mapInArrow(merge, "doc_id long, text_hash long, line int")


def marked_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text), n_lines and removed (sorted line numbers, from 0) of every row of docs. A
    null text has no line, an empty one one.

    A non-blank line goes if an earlier one, by (doc_id, line number, text hash; for lines of different words the class keys
    instead of the text hash), null ids last, has a Jaccard similarity of 0.8 or more of their word sets (whether or not
    that one stays). Blank lines stay. Rows with equal doc_id and text lose the same lines."""
    texts, gone = matches(docs)
    stay = _staying(texts, gone).groupBy("doc_id", "text_hash").agg(F.collect_list("line").alias("stay"))
    rows = texts.select("doc_id", "text_hash", "n_lines", "lines").join(stay, ["doc_id", "text_hash"], "left")
    removed = F.array_sort(F.array_except("lines", F.coalesce("stay", F.array().cast("array<int>"))))
    return rows.select(F.when(F.col("doc_id") == F.lit(2**63 - 1), None).otherwise(F.col("doc_id")).alias("doc_id"), "text_hash", "n_lines", removed.alias("removed"))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash and removed of the texts that lose lines, once each."""
    return marked_lines(docs).where(F.size("removed") > 0).select("doc_id", "text_hash", "removed").dropDuplicates(["doc_id", "text_hash"])


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the text of the lines that stay, and removed: the numbers of those that went."""
    gone = removed_lines(docs).select(F.col("doc_id").alias("__d"), F.col("text_hash").alias("__h"), F.col("removed").alias("__removed"))
    rows = docs.drop("removed")
    joined = rows.join(gone, rows["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (_text_hash("text") == F.col("__h")), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("__removed", i))
    text = F.when(F.col("__removed").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[(text.alias(c) if c == "text" else F.col(f"`{c}`")) for c in rows.columns], F.coalesce("__removed", F.array().cast("array<int>")).alias("removed"))
