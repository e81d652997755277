"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by the size of their shingle set (powers of two). For a partition with sizes below u, a document
is cut into windows of 2u shingles, u apart, so a passage of up to u shingles lies whole in one of them and its Jaccard
similarity with the window is at least t*q / (2u + (1 - t) q) for containment t and size q > u/2: over 0.19 for t = 0.8,
whatever the document's length. A signature has 4 permutations of 64 bins (one-permutation hashing: the smallest value
in each bin), or 16 permutations for small sizes; each bin is a band of one row. The chance that a pair misses all bands is
below 1e-8: a lone shingle stands against at most three others of its window in 64 bins, 16 times.

A window can only collide with an item if one of its shingles is a minimum of the item's; windows without any such
shingle (one look-up in a bitmap each) are not signed.

A candidate pair is kept if the document's set of shingles contains at least t of the item's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, mix, shingle_hashes

_U = np.uint64
BINS = 64
#: Permutations of items below SMALL shingles, and of others.
SMALL, MANY, FEW = 32, 16, 4
_ODD = np.random.default_rng(97).integers(1, 2**63, MANY, dtype=np.int64).astype(_U) * _U(2) + _U(1)
#: Shingles of benchmark items that are searched for in one pass over the documents; more items make more passes.
BLOCK_SHINGLES = 2_000_000


def signature(h: np.ndarray, permutations: int) -> np.ndarray:
    """The band (a hash of permutation, bin and the bin's smallest value) of each bin that isn't empty."""
    bands = []
    for k in range(permutations):
        x = mix(h * _ODD[k])  # the bin in its upper bits, then the value
        x = np.sort(x)
        b = x >> _U(58)
        first = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
        bands.append(mix(x[first] + _U(k)))
    return np.concatenate(bands)


def permutations_of(u: int) -> int:
    return MANY if u <= SMALL else FEW


def _minima(h: np.ndarray, permutations: int) -> np.ndarray:
    """The shingles of a set that are the smallest of some bin under some permutation."""
    out = []
    for k in range(permutations):
        x = mix(h * _ODD[k])
        order = np.argsort(x)
        b = x[order] >> _U(58)
        out.append(h[order[np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))]])
    return np.unique(np.concatenate(out))


class Index:
    """The items of one block: shingle sets, and the bands of each size partition as sorted arrays. Its size is bounded by
    BLOCK_SHINGLES: eight bytes a shingle, and at most a band for each shingle and permutation."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, _ in items]
        self.sets = [h for _, h in items]
        of: dict[int, list[int]] = {}
        for at, h in enumerate(self.sets):
            if len(h):
                of.setdefault(1 << int(len(h)).bit_length(), []).append(at)
        self.parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for u, rows in of.items():
            signed = [signature(self.sets[at], permutations_of(u)) for at in rows]
            bands = np.concatenate(signed)
            item = np.repeat(np.array(rows, np.int32), [len(x) for x in signed])
            order = np.argsort(bands, kind="stable")
            # shingles that are some item's minimum: only windows with one of them can collide
            keys = np.unique(np.concatenate([_minima(self.sets[at], permutations_of(u)) for at in rows]))
            self.parts[u] = bands[order], item[order], keys
        keys = [p[2] for p in self.parts.values()]
        self.all = np.unique(np.concatenate(keys)) if keys else np.zeros(0, _U)
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(self.all >> _U(42)).astype(np.int64)] = True

    def maybe(self, h: np.ndarray) -> np.ndarray:
        """Positions of shingles that are some item's minimum."""
        at = np.flatnonzero(self.bits[(h >> _U(42)).astype(np.int64)])
        if len(at) and len(self.all):
            pos = np.minimum(np.searchsorted(self.all, h[at]), len(self.all) - 1)
            at = at[self.all[pos] == h[at]]
        return at

    def candidates(self, h: np.ndarray, at: np.ndarray) -> set[int]:
        """Items that collide with a window of the document h (its shingles in order); at: positions from maybe()."""
        found: set[int] = set()
        for u, (bands, item, keys) in self.parts.items():
            own = at[np.isin(h[at], keys)]
            for w in np.unique(np.concatenate([own // u, np.maximum(own // u - 1, 0)])).tolist() if len(own) else []:
                mine = signature(h[w * u : w * u + 2 * u], permutations_of(u))
                low, high = np.searchsorted(bands, mine), np.searchsorted(bands, mine, "right")
                for x, y in zip(low[high > low].tolist(), high[high > low].tolist()):
                    found.update(item[x:y].tolist())
        return found


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The shingles of each text, in order. Fewer words: one shingle of all; none: no shingle."""
    w = Words(texts)
    h, text = shingle_hashes(w.hashes(), np.asarray(w.counts, np.int64), width)
    return np.split(h, np.searchsorted(text, np.arange(1, len(texts)))) if texts else []


def find(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, item_id, item_size (distinct shingles), containment: pairs with at least `threshold` of the item's
    shingles in the document. Words are lower-cased (A-Z). Texts of fewer than `width` words have one shingle, all their
    words; texts without words (null too) take part in no pair. Repeated rows of either table give one row a distinct
    (doc_id, item_id, size, containment). The benchmark, the stated query set, is searched in blocks of at most
    BLOCK_SHINGLES shingles (a block holds one item at least); a block is what is broadcast."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    weighed = items.select("item_id", F.length("text").alias("n")).groupBy().agg(F.sum("n").alias("n"), F.count("*").alias("rows")).first()
    blocks = max(1, -(-int(weighed.n or 0) // (2 * BLOCK_SHINGLES)))  # a word has two characters at least
    out = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect() if blocks > 1 else items.orderBy("item_id", "text").collect()
        sets = shingle_sets([(r.text or "").encode() for r in rows], width)
        shared = spark.sparkContext.broadcast(Index([(r.item_id, np.unique(s)) for r, s in zip(rows, sets, strict=True) if len(s)]))
        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_search(shared, width, threshold), "doc_id long, item_id long, item_size long, containment double")
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _search(shared, width: int, threshold: float):
    def apply(batches):
        index = shared.value
        for batch, texts in chunks(batches, "text"):
            w = Words(texts)
            h, text = shingle_hashes(w.hashes(), np.asarray(w.counts, np.int64), width)
            hits = index.maybe(h)
            if not len(hits):
                continue
            ids, out = batch.column(0).to_pylist(), []
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            for d in np.unique(text[hits]).tolist():
                own = h[bounds[d] : bounds[d + 1]]
                have = None
                for i in index.candidates(own, hits[text[hits] == d] - bounds[d]):
                    have = np.unique(own) if have is None else have
                    n = int(np.isin(index.sets[i], have).sum())
                    if n >= threshold * len(index.sets[i]) - 1e-9:
                        out.append((ids[d], index.ids[i], len(index.sets[i]), n / len(index.sets[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "item_size", "containment"])

    return apply


def remove(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs without the rows that contain an item. Rows are judged by their texts: of rows that share a doc_id, or have
    none, those with other texts stay."""
    text = F.col("text").cast("string")
    bad = find(docs.select(F.xxhash64(text).alias("doc_id"), "text"), benchmark, width, threshold)
    bad = bad.select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.xxhash64(docs["text"].cast("string")) == F.col("__bad"), "left_anti")
