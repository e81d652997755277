"""Substring dedup: words covered by a passage of `window` words that stands anywhere else are removed.

1. Anchors. In each window one of its runs of ANCHOR words is the anchor: the one with the smallest hash, the first of
   equals. Equal windows have equal anchors in equal places. Anchors that stand in two places are counted in Spark.
2. Passages are confirmed: windows with a recurring anchor are counted by 96 bits of hash; a window that stands in two
   places (copies of a text count once) recurs, and the first place of it, in order of the texts' hashes, is its home.
   Runs of home windows, cut into pieces of PIECE windows, are read from their texts: every recurring window is in
   exactly one piece.
3. Automata. Texts are dealt to buckets of about BUCKET_BYTES; a bucket gets the pieces that share an anchor with its
   texts. Phrases of a bucket's pieces (an anchor with what all its windows share) are compiled into an Aho-Corasick
   automaton, a shard of the automaton of all passages that holds what this bucket needs, and the bucket's texts stream
   through it. Wherever a phrase is found, text and piece are laid side by side and compared word by word: equal runs of at least `window` words are
   recurring windows. So a text passes one automaton once, whatever the number of shards.
4. Texts that are copies of each other are removed whole, if they have a window at all.

Filters of bounded size (Bloom) spare work in scans; what they let pass in excess is sorted out by the joins behind them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, chunks, mix, saved

WINDOW = 35
#: Words of an anchor, windows of a piece, bytes of texts in a bucket.
ANCHOR, PIECE, BUCKET_BYTES = 12, 256, 6_000_000
#: Bytes of texts whose windows are hashed in one go: their arrays are about seventy times as large.
SCAN_BYTES = 1_000_000
#: An anchor in more pieces than this leads to them by its whole windows, one key each.
CROWDED = 64
#: Bits of a Bloom filter, at most.
BLOOM_BITS = 1 << 28

_U = np.uint64
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_I1, _I2 = pow(_B1, -1, 2**64), pow(_B2, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(h: np.ndarray, width: int, base: int = _B1, inverse: int = _I1) -> np.ndarray:
    """The hash of every run of width words (polynomial in the words' hashes)."""
    n = len(h)
    if n < width:
        return np.zeros(0, _U)
    total = np.concatenate([np.zeros(1, _U), np.cumsum(h * _powers(base, n))])
    return mix((total[width:] - total[:-width]) * _powers(inverse, n)[: n - width + 1] + _U(width))


def least_in_window(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of width values, where its smallest is (the first of equals)."""
    at, have = np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        have += step
    return at


class Windows:
    """The windows of several texts: text, start (in words of that text), the anchor's hash."""

    def __init__(self, texts: list[bytes], window: int):
        w = Words(texts, fold=False)
        self.h, self.counts = w.hashes(), w.counts
        self.window = window
        first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        per = np.maximum(self.counts - window + 1, 0).astype(np.int64)
        self.text = np.repeat(np.arange(len(texts)), per)
        self.start = np.arange(len(self.text)) - np.repeat(np.cumsum(per) - per, per)
        self.word = self.start + first[:-1][self.text]
        size = min(ANCHOR, window)
        g = run_hashes(self.h, size)
        where = least_in_window(g, window - size + 1) if len(g) >= window - size + 1 else np.zeros(0, np.int64)
        self.anchor_word = where[self.word]
        self.anchor = g[self.anchor_word]
        self.first = first

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, position and hash of every anchor, each once."""
        new = np.concatenate([[True], (self.anchor_word[1:] != self.anchor_word[:-1]) | (self.text[1:] != self.text[:-1])])
        new = new[: len(self.text)]
        return self.text[new], (self.anchor_word - self.first[:-1][self.text])[new], self.anchor[new]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of every window, of 64 and of 32 bits."""
        if not len(self.word):
            return np.zeros(0, _U), np.zeros(0, np.int32)
        second = run_hashes(mix(self.h ^ _U(0x2545F4914F6CDD1D)), self.window, _B2, _I2)[self.word]
        return run_hashes(self.h, self.window)[self.word], (second >> _U(32)).astype(np.uint32).view(np.int32)


class Bloom:
    """A Bloom filter of 64-bit keys in blocks of 2^16 bits; a key has three bits in one block."""

    def __init__(self, blocks: int):
        self.blocks = blocks
        self.bits = np.zeros(blocks << 13, np.uint8)

    @staticmethod
    def sized(n: int) -> Bloom:
        return Bloom(max(1, min(BLOOM_BITS >> 16, 1 << max(0, (n * 16 - 1)).bit_length() >> 16)))

    def block_of(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys ^ _U(0x94D049BB133111EB)) >> _U(20)).astype(np.int64) % self.blocks

    @staticmethod
    def places(keys: np.ndarray) -> list[np.ndarray]:
        x = mix(keys ^ _U(0xBF58476D1CE4E5B9))
        return [(x >> _U(16 * k) & _U(0xFFFF)).astype(np.int64) for k in range(3)]

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = self.block_of(keys) << 13
        out = np.ones(len(keys), bool)
        for p in self.places(keys):
            out &= (self.bits[base + (p >> 3)] >> (p & 7).astype(np.uint8) & 1).astype(bool)
        return out


def bloom(df: DataFrame, n: int) -> Bloom:
    """A filter of the n keys in df's only column (long), made in tasks block by block; the driver gets blocks of 8 kB, of
    BLOOM_BITS in all at most."""
    out = Bloom.sized(n)

    def deal(batches):
        for batch in batches:
            k = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(out.block_of(k.view(_U))), pa.array(k)], ["b", "k"])

    def fill(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            b, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for x in np.unique(b).tolist():
                bits = held.setdefault(x, np.zeros(1 << 16, bool))
                for p in Bloom.places(k[b == x].view(_U)):
                    bits[p] = True
        if held:
            packed = [np.packbits(v, bitorder="little").tobytes() for v in held.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array(packed, pa.binary())], ["b", "bits"])

    for r in df.mapInArrow(deal, "b long, k long").repartition("b").mapInArrow(fill, "b long, bits binary").collect():
        out.bits[r.b << 13 : (r.b + 1) << 13] = np.frombuffer(r.bits, np.uint8)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    """t, u (together the text's identity), text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(text).select(F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u"), "text")


def _place(t: np.ndarray, at: np.ndarray) -> np.ndarray:
    return mix(t.view(_U) + at.astype(_U) * _U(_B2)).view(np.int64)


def _longs(*columns: np.ndarray) -> list[pa.Array]:
    return [pa.array(c.view(np.int64) if c.dtype == _U else c) for c in columns]


def _t_of(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False)


def recurring_anchors(texts: DataFrame, window: int) -> DataFrame:
    """m: the hashes of anchors that stand in two places."""

    def emit(batches):
        for batch, raw in chunks(batches, "text"):
            x = Windows(raw, window)
            text, at, m = x.anchors()
            place = _place(_t_of(batch)[text], at)
            order = np.argsort(m, kind="stable")
            m, place = m[order], place[order]
            if len(m):
                s = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
                yield pa.RecordBatch.from_arrays(
                    _longs(m[s], np.minimum.reduceat(place, s), np.maximum.reduceat(place, s)), ["m", "lo", "hi"]
                )

    places = texts.mapInArrow(emit, "m long, lo long, hi long").groupBy("m").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return saved(places.where("lo <> hi").select("m"), "anchors")


def home_windows(texts: DataFrame, window: int, anchors) -> DataFrame:
    """t, starts: the windows that recur, at their homes. anchors: a broadcast filter of recurring anchors."""

    def emit(batches):
        for batch, raw in chunks(batches, "text", SCAN_BYTES):
            x = Windows(raw, window)
            w, v = x.hashes()
            hit = np.flatnonzero(anchors.value.has(x.anchor))
            t = _t_of(batch)[x.text[hit]]
            w, v, start = w[hit], v[hit], x.start[hit]
            order = np.lexsort((start, t, w))
            w, v, t, start = w[order], v[order], t[order], start[order]
            if len(w):
                s = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                e = np.append(s[1:], len(w)) - 1
                many = (t[s] != t[e]) | (start[s] != start[e])
                columns = [*_longs(w[s]), pa.array(v[s]), pa.array(t[s]), pa.array(start[s].astype(np.int32)), pa.array(many)]
                yield pa.RecordBatch.from_arrays(columns, ["w", "v", "t", "at", "many"])

    found = texts.mapInArrow(emit, "w long, v int, t long, at int, many boolean")
    counted = found.groupBy("w", "v").agg(
        F.min("t").alias("t"), F.max("t").alias("other"), F.min_by("at", "t").alias("at"),
        F.min("at").alias("low"), F.max("at").alias("high"), F.max("many").alias("many"),
    )
    recur = counted.where("many or t <> other or low <> high").select("t", "at")
    return saved(recur.groupBy("t").agg(F.sort_array(F.collect_list("at")).alias("starts")), "homes")


def runs_of(starts: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Runs of successive starts, cut at size: (first start, starts)."""
    cut = np.flatnonzero(np.diff(starts, prepend=-2) != 1).tolist() + [len(starts)]
    return [(int(starts[i]), min(size, y - i)) for x, y in zip(cut, cut[1:]) for i in range(x, y, size)]


def pieces(texts: DataFrame, homes: DataFrame, window: int, size: int = PIECE) -> DataFrame:
    """piece (a hash), words: the recurring passages at their homes, in pieces."""
    spark = texts.sparkSession
    at_home = spark.sparkContext.broadcast(bloom(homes.select("t"), homes.count()))

    def only_homes(batches):
        for batch in batches:
            seen, keep = set(), []
            for i, (t, hit) in enumerate(zip(batch.column(0).to_pylist(), at_home.value.has(_t_of(batch).view(_U)).tolist())):
                if hit and t not in seen:
                    seen.add(t)
                    keep.append(i)
            if keep:
                yield batch.take(pa.array(keep)).select(["t", "text"])

    def cut(batches):
        for batch in batches:
            ids, words = [], []
            for t, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                split = text.encode().split()
                for x, n in runs_of(np.array(starts), size):
                    ids.append((t ^ (x * _B2 >> 3)) & (1 << 63) - 1)
                    words.append(b" ".join(split[x : x + n + window - 1]))
                if sum(map(len, words)) > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], ["piece", "words"])
                    ids, words = [], []
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.binary())], ["piece", "words"])

    near = texts.select("t", "text").mapInArrow(only_homes, "t long, text string").groupBy("t").agg(F.first("text").alias("text"))
    joined = near.join(homes, "t").select("t", "text", "starts").mapInArrow(cut, "piece long, words binary")
    return saved(joined, "pieces")


def keys_of(x: Windows, crowded: Bloom | None) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each anchor; an anchor in very many pieces gives the hashes of its windows instead."""
    text, _, m = x.anchors()
    if crowded is None:
        return text, m
    many = crowded.has(m)
    w = crowded.has(x.anchor)
    whole = mix(x.hashes()[0][w] ^ _U(_B1))
    return np.concatenate([text[~many], x.text[w]]), np.concatenate([m[~many], whole])


def routes(texts: DataFrame, found: DataFrame, window: int, buckets: int, anchors) -> DataFrame:
    """bucket, piece: the pieces that a bucket's texts may hold."""
    spark = texts.sparkSession

    def piece_keys(crowded):
        def emit(batches):
            for batch, raw in chunks(batches, "words"):
                text, key = keys_of(Windows(raw, window), crowded and crowded.value)
                yield pa.RecordBatch.from_arrays(_longs(key, _t_of(batch)[text]), ["key", "piece"])

        return emit

    def text_keys(batches):
        for batch, raw in chunks(batches, "text", SCAN_BYTES):
            x = Windows(raw, window)
            text, key = keys_of(x, crowded and crowded.value)
            if crowded is None:
                hit = anchors.value.has(key)
                text, key = text[hit], key[hit]
            bucket = _t_of(batch).view(_U) % _U(buckets)
            pair = np.unique(np.stack([key, bucket[text]]), axis=1)
            yield pa.RecordBatch.from_arrays(_longs(pair[0], pair[1]), ["key", "bucket"])

    per_anchor = found.mapInArrow(piece_keys(None), "key long, piece long").groupBy("key").count().where(f"count > {CROWDED}").select("key")
    per_anchor = saved(per_anchor, "crowded")
    n = per_anchor.count()
    crowded = spark.sparkContext.broadcast(bloom(per_anchor, n)) if n else None
    of_pieces = found.mapInArrow(piece_keys(crowded), "key long, piece long").distinct()
    of_texts = texts.select("t", "text").mapInArrow(text_keys, "key long, bucket long").distinct()
    return of_texts.join(of_pieces, "key").select("bucket", "piece").distinct()


def cores(x: Windows) -> tuple[list[int], list[int], list[int]]:
    """For each anchor of each text: text, begin and end (in its words) of what the windows with that anchor have in common,
    the anchor at least."""
    new = np.flatnonzero(np.concatenate([[True], (x.anchor_word[1:] != x.anchor_word[:-1]) | (x.text[1:] != x.text[:-1])])[: len(x.text)])
    last = np.append(new[1:], len(x.text)) - 1
    return x.text[new].tolist(), x.start[last].tolist(), (x.start[new] + x.window).tolist()


class Automaton:
    """The pieces of a bucket. For each anchor of a piece, what all windows with that anchor share is a phrase of the
    automaton: every window holds a phrase, and few pieces share one. Words have codes of equal length, whose first letter is of another kind than the rest, so
    that phrases are found at words only."""

    def __init__(self, passages: list[bytes], window: int):
        self.window = window
        found, first, size = [], 0, 0  # (passage, begin, end) of each core, of some passages at a time
        for k, p in enumerate(passages, 1):
            size += len(p)
            if size > SCAN_BYTES // 2 or k == len(passages):
                found += [(i + first, a, b) for i, a, b in zip(*cores(Windows(passages[first:k], window)), strict=True)]
                first, size = k, 0
        ids: dict[bytes, int] = {}
        for p in passages:
            for w in p.split():
                if w not in ids:
                    ids[w] = len(ids)
        self.width = n = 3 if len(ids) < 1 << 18 else 5
        low = [chr(0x80 + k) for k in range(64)]
        self.code = {w: chr(0x40 + (i & 63)) + "".join([low[i >> 6 * k & 63] for k in range(1, n)]) for w, i in ids.items()}
        self.unknown = "!" * n
        coded = ["".join([self.code[w] for w in p.split()]) for p in passages]
        self.pieces = [self._ids(c).astype(np.int32) for c in coded]
        payload: dict[str, list[int]] = {}
        for p, a, b in found:
            payload.setdefault(coded[p][a * n : b * n], []).append((p << 40) - b)
        del found, coded, ids
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: For each phrase its pieces, and where in them it ends: piece << 40, less that place.
        self.places = [np.array(v, np.int64) for v in payload.values()]
        for k, phrase in enumerate(payload):
            self.tree.add_word(phrase, k)
        self.tree.make_automaton()

    def _ids(self, coded: str) -> np.ndarray:
        """The words' ids from their codes (-1: no word of a piece)."""
        x = np.frombuffer(coded.encode("latin-1"), np.uint8).reshape(-1, self.width)
        out = (x[:, 0] & 63).astype(np.int64)
        for k in range(1, self.width):
            out |= (x[:, k] & 63).astype(np.int64) << 6 * k
        out[x[:, 0] == 0x21] = -1
        return out

    def covered(self, words: list[bytes]) -> np.ndarray | None:
        """Which words lie in a window that a piece has too; None if no word does."""
        if len(words) < self.window or not self.places:
            return None
        unknown, code = self.unknown, self.code.get
        coded = "".join([code(w, unknown) for w in words])
        got = list(self.tree.iter(coded))
        if not got:
            return None
        ends, which = np.array(got, np.int64).T
        ends = (ends + 1) // self.width + (1 << 39)
        shifts = [self.places[k] + e for e, k in zip(ends.tolist(), which.tolist())]  # where a piece's first word would stand
        ids, out = self._ids(coded), np.zeros(len(words), bool)
        for s in np.unique(np.concatenate(shifts)).tolist():
            piece, shift = self.pieces[s >> 40], (s & (1 << 40) - 1) - (1 << 39)
            lo, hi = max(shift, 0), min(shift + len(piece), len(words))
            if hi - lo < self.window or out[lo:hi].all():
                continue
            same = ids[lo:hi] == piece[lo - shift : hi - shift]
            if same.all():
                out[lo:hi] = True
                continue
            edge = np.flatnonzero(np.diff(same, prepend=False, append=False))
            for x, y in zip(edge[0::2].tolist(), edge[1::2].tolist()):
                if y - x >= self.window:
                    out[lo + x : lo + y] = True
        return out


def _streamed(batches, window: int, with_kept: bool) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket: its pieces first, then its texts (once each)."""
    held, passages, tree, seen, out, size = None, [], None, set(), [], 0
    for batch in batches:
        for bucket, kind, t, u, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != held:
                held, passages, tree, seen = bucket, [], None, set()
            if kind == 0:
                passages.append(body)
                continue
            if (t, u) in seen:
                continue
            seen.add((t, u))
            if tree is None:
                tree, passages = Automaton(passages, window), []
            words = body.split()
            gone = tree.covered(words)
            left = words if gone is None else [w for w, g in zip(words, gone.tolist()) if not g]
            kept = b" ".join(left)
            row = {"t": t, "u": u, "n_words": len(words), "n_removed": len(words) - len(left), "kept_sha256": hashlib.sha256(kept).hexdigest()}
            if with_kept:
                row["kept"] = kept.decode()
                size += len(kept)
            out.append(row)
            if len(out) >= 2048 or size > 4_000_000:
                yield pa.RecordBatch.from_pylist(out, schema=_RESULT if with_kept else pa.schema(list(_RESULT)[:-1]))
                out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_RESULT if with_kept else pa.schema(list(_RESULT)[:-1]))


_RESULT = pa.schema([("t", pa.int64()), ("u", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])


def _once(buckets: int):
    """Each distinct text of a task once, with its bucket."""

    def emit(batches):
        seen = set()
        for batch in batches:
            keep = []
            for i, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if key not in seen:
                    seen.add(key)
                    keep.append(i)
            part = batch.take(pa.array(keep, pa.int64()))
            bucket = (_t_of(part).view(_U) % _U(buckets)).view(np.int64)
            columns = [pa.array(bucket), pa.array(np.ones(len(part), np.int32)), part.column(0), part.column(1), part.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", "kind", "t", "u", "body"])

    return emit


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_kept: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_kept, kept (the words that stay, joined by
    one space). A word is removed if a window of that many words covers it whose words stand anywhere else too, in the
    same text or in another row's; all windows are judged on the input. Null and empty texts have no words. Rows with
    equal texts, repeated rows included, are copies of each other; texts below a window keep all words. Other columns
    are ignored; no rows in, no rows out."""
    spark: SparkSession = docs.sparkSession
    texts = _texts(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = recurring_anchors(texts, window)
    filter_ = spark.sparkContext.broadcast(bloom(anchors, anchors.count()))
    homes = home_windows(texts, window, filter_)
    found = pieces(texts, homes, window)
    keys = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = keys.select("doc_id", F.xxhash64("text").alias("t"), F.xxhash64(F.lit(7), "text").alias("u"), F.octet_length("text").alias("bytes"))
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(1, int(total // BUCKET_BYTES))
    wanted = routes(texts, found, window, buckets, filter_).join(found, "piece")
    nothing = F.lit(0).cast("long")
    rows = wanted.select("bucket", F.lit(0).alias("kind"), nothing.alias("t"), nothing.alias("u"), F.col("words").alias("body"))
    rows = rows.unionByName(texts.mapInArrow(_once(buckets), "bucket long, kind int, t long, u long, body binary"))
    dealt = rows.repartition(max(parts, min(buckets, 100_000)), "bucket").sortWithinPartitions("bucket", "kind")
    schema = "t long, u long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_kept else "")
    judged = saved(dealt.mapInArrow(lambda b: _streamed(b, window, with_kept), schema), "judged")
    copies = keys.groupBy("t", "u").agg((F.count("*") > 1).alias("copied"))
    whole = F.col("copied") & (F.col("n_words") >= window)
    none = hashlib.sha256(b"").hexdigest()
    done = judged.join(copies, ["t", "u"]).select(
        "t", "u", "n_words", F.when(whole, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, none).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *([F.when(whole, "").otherwise(F.col("kept")).alias("kept")] if with_kept else []),
    )
    return keys.select("doc_id", "t", "u").join(done, ["t", "u"]).drop("t", "u")
