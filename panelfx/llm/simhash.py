"""SimHash near-duplicates found through Golay-code keys.

Two fingerprints with at most 3 differing bits agree on one of four 16-bit blocks (pigeonhole), and then one half of the
other 48 bits has at most one error. A half's first 23 bits are decoded in the perfect Golay code [23, 12, 7]: the keys
are the 12-bit indices of all codewords at distance 4 or less, 1 or 6 of them. If words x and y differ in one bit, the
codeword nearest to x (distance 3 at most) is at distance 4 at most from y: they share a key. So a fingerprint gets a
key for each block, half and codeword, of 28 bits and a kind, about 42 in all, and linked fingerprints meet in a
bucket. There, distances are verified and the links reduced to a spanning forest.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chunks, group_starts, saved
from .components import components

_U = np.uint64
BITS = 3
#: Runs up to this size are compared pair by pair; longer ones are refined first.
SMALL = 64


def fingerprints_of(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprint of each text: bit i is set if it is set in over half of the XXH64 of its shingles."""
    w = Words(texts)
    n_words = np.asarray(w.counts, np.int64)
    solid = b" ".join(w.raw.split())
    lens = w.ends - w.starts
    end = np.cumsum(lens + 1) - 1
    start = end - lens
    per = np.where(n_words >= width, n_words - width + 1, np.minimum(n_words, 1))
    first = np.cumsum(n_words) - n_words
    text = np.repeat(np.arange(len(texts)), per)
    at = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per) + first[text] if len(text) else np.zeros(0, np.int64)
    last = at + np.minimum(width, n_words[text]) - 1 if len(text) else at
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(solid[a:b], seed) for a, b in zip(start[at].tolist(), end[last].tolist())), _U, len(at))
    out = np.zeros(len(texts), _U)
    if len(h):
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        s = group_starts(text)
        counts = np.add.reduceat(bits, s, axis=0, dtype=np.int32)
        major = 2 * counts > per[text[s]][:, None]
        out[text[s]] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """docs' columns and fp: the fingerprint as a signed long. Null and empty texts, and texts without words: 0."""
    from pyspark.sql.types import LongType, StructField, StructType

    fields = [f for f in docs.schema.fields if f.name != "fp"]

    def apply(batches):
        for batch, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fingerprints_of(texts, width).view(np.int64))], [*batch.schema.names, "fp"])

    return docs.select(*[f"`{f.name}`" for f in fields]).mapInArrow(apply, StructType([*fields, StructField("fp", LongType())]))


_GENERATOR = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(22, 10, -1):
        x ^= np.where(x >> i & 1, _GENERATOR << (i - 11), 0)
    return x


@lru_cache
def golay_errors() -> tuple[np.ndarray, np.ndarray]:
    """For each of the 2,048 syndromes: the error patterns of weight 4 or less that have it (1 or 6; padded with -1)."""
    patterns = np.array([sum(1 << i for i in c) for k in range(5) for c in combinations(range(23), k)], np.int64)
    s = _syndrome(patterns)
    table, n = np.full((2048, 6), -1, np.int64), np.zeros(2048, np.int64)
    for p, k in zip(patterns.tolist(), s.tolist()):
        table[k, n[k]] = p
        n[k] += 1
    return table, n


def golay_keys(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within distance 4 of each 23-bit word, and the row of each."""
    table, n = golay_errors()
    s = _syndrome(x.astype(np.int64))
    row, col = np.nonzero(table[s] >= 0)
    return (x.astype(np.int64)[row] ^ table[s[row], col]) >> 11, row


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key of each fingerprint, and the fingerprint's row."""
    keys, rows = [], []
    for block in range(4):
        exact = (fp >> _U(16 * block) & _U(0xFFFF)).astype(np.int64)
        rest = (fp & _U((1 << 16 * block) - 1)) | (fp >> _U(16) & _U(~((1 << 16 * block) - 1) & (1 << 48) - 1)) if block else fp >> _U(16)
        for half in range(2):
            index, row = golay_keys((rest >> _U(24 * half) & _U(0x7FFFFF)).astype(np.int64))
            keys.append((np.int64(2 * block + half) << 28) | exact[row] << 12 | index)
            rows.append(row)
    return np.concatenate(keys), np.concatenate(rows)


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, x: int) -> int:
        p = self.p
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    def union(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.p[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        p = np.array(self.p)
        while (q := p[p])is not None and not np.array_equal(q, p):
            p = q
        self.p = p.tolist()
        return p


def link_run(fp: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """A spanning forest (pairs of positions) of the links within one bucket. Long runs: neighbours in several bit orders
    are tried first; then, as 3 errors leave 3 of 6 segments exact, only members that agree on 3 segments and aren't
    connected yet are compared."""
    forest, out = Forest(len(fp)), []

    def add(i, j):
        for a, b in zip(i.tolist(), j.tolist()):
            if forest.union(a, b):
                out.append((a, b))

    def compare(at):
        """All members of at against each other, in blocks; blocks within one component are left out."""
        lab = forest.labels()[at]
        order = np.argsort(lab, kind="stable")
        at, lab = at[order], lab[order]
        for x in range(0, len(at), 512):
            for y in range(x, len(at), 512):
                if lab[x] == lab[min(x + 512, len(at)) - 1] == lab[y] == lab[min(y + 512, len(at)) - 1]:
                    continue
                p, q = at[x : x + 512], at[y : y + 512]
                i, j = np.nonzero(np.bitwise_count(fp[p][:, None] ^ fp[q][None]) <= bits)
                new = lab[x : x + 512][i] != lab[y : y + 512][j]
                add(p[i[new]], q[j[new]])

    if len(fp) > 512:
        for shift in range(0, 64, 8):
            turned = (fp << _U(shift)) | (fp >> _U(64 - shift)) if shift else fp
            o = np.argsort(turned)
            for gap in (1, 2, 3):
                near = np.flatnonzero(np.bitwise_count(fp[o[:-gap]] ^ fp[o[gap:]]) <= bits)
                add(o[near], o[near + gap])
        edges = [0, 11, 22, 33, 44, 54, 64]
        seg = [_U(((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1)) for k in range(6)]
        for three in combinations(range(6), 3):
            masked = fp & (seg[three[0]] | seg[three[1]] | seg[three[2]])
            o = np.argsort(masked, kind="stable")
            g = group_starts(masked[o])
            lab = forest.labels()
            sizes = np.diff(np.append(g, len(o)))
            split = np.maximum.reduceat(lab[o], g) != np.minimum.reduceat(lab[o], g)
            for k in np.flatnonzero((sizes > 1) & split).tolist():
                compare(o[g[k] : g[k] + sizes[k]])
    else:
        compare(np.arange(len(fp)))
    return out


def link_sorted(keys: np.ndarray, fp: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys, as pairs of fingerprints."""
    g = group_starts(keys)
    n = np.diff(np.append(g, len(keys)))
    left, right = [], []
    small = (n > 1) & (n <= SMALL)
    for size in np.unique(n[small]).tolist():
        first = g[n == size]
        i, j = np.triu_indices(size, 1)
        for c in range(0, len(first), max(1, 1_000_000 // len(i))):
            base = first[c : c + max(1, 1_000_000 // len(i))][:, None]
            a, b = fp[(base + i).ravel()], fp[(base + j).ravel()]
            near = np.bitwise_count(a ^ b) <= bits
            left.append(a[near])
            right.append(b[near])
    for k in np.flatnonzero(n > SMALL).tolist():
        run = np.unique(fp[g[k] : g[k] + n[k]])
        if pairs := link_run(run, bits):
            i, j = np.array(pairs).T
            left.append(run[i])
            right.append(run[j])
    if not left:
        return np.zeros(0, _U), np.zeros(0, _U)
    return np.concatenate(left), np.concatenate(right)


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """u, v: a spanning set of the links between the distinct fingerprints (column fp). Buckets are dealt by key and
    sorted in the JVM; a task holds one bucket's fingerprints (8 bytes each) at a time."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def emit(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
            for x in range(0, len(fp), 20_000):
                k, row = keys_of(fp[x : x + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(fp[x : x + 20_000][row].view(np.int64))], ["k", "fp"])

    def meet(batches):
        hk, hf = np.zeros(0, np.int64), np.zeros(0, _U)
        sent: set[tuple[int, int]] = set()

        def out(k, f):
            a, b = link_sorted(k, f, bits)
            new = set(zip(a.view(np.int64).tolist(), b.view(np.int64).tolist())) - sent
            if len(sent) < 500_000:
                sent.update(new)
            if new:
                u, v = zip(*new)
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            hk = np.concatenate([hk, batch.column(0).to_numpy(zero_copy_only=False)])
            hf = np.concatenate([hf, batch.column(1).to_numpy(zero_copy_only=False).view(_U)])
            cut = int(np.searchsorted(hk, hk[-1])) if len(hk) else 0
            if cut > 100_000:
                yield from out(hk[:cut], hf[:cut])
                hk, hf = hk[cut:], hf[cut:]
        if len(hk):
            yield from out(hk, hf)

    keyed = distinct.select("fp").mapInArrow(emit, "k long, fp long").repartition(parts, "k").sortWithinPartitions("k")
    return keyed.mapInArrow(meet, "u long, v long")


def _marked(docs: DataFrame, width: int) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    return saved(fingerprints(rows, width).select("doc_id", "th", "fp"), "fingerprints")


def _named(marked: DataFrame, bits: int) -> DataFrame:
    """fp, component_id, root of every distinct fingerprint."""
    distinct = saved(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    tree = components(links(distinct, bits))
    rooted = distinct.join(tree, distinct.fp == tree.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "component_id", "root")


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable by links of at most `bits`
    differing bits (null ids are larger than any). One row per row of docs; equal fingerprints are linked."""
    marked = _marked(docs, width)
    return marked.join(_named(marked, bits), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, width: int = 3, bits: int = BITS) -> DataFrame:
    """One row of each group, all columns kept: the one with the smallest (doc_id, text hash), null ids last. Of rows that
    repeat that doc_id and text one stays. Groups hold fingerprints, so rows with equal doc_id but texts in different groups
    are no duplicates of each other."""
    marked = _marked(docs, width)
    group = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
    first = marked.groupBy("fp").agg(F.min(group).alias("first")).join(_named(marked, bits), "fp").groupBy("root").agg(F.min("first").alias("first"))
    # few rows repeat a doc_id and a text: only those are dropped by comparing
    times = marked.groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.lit(True).alias("again"))
    keep = first.select(F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t"))
    keep = saved(keep.join(times, keep["__d"].eqNullSafe(F.col("d")) & (F.col("__t") == F.col("t")), "left").select("__d", "__t", F.coalesce("again", F.lit(False)).alias("__again")), "kept")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64(docs["text"].cast("string")) == F.col("__t"))
    once = docs.join(keep.where("not __again"), same, "left_semi")
    if keep.where("__again").isEmpty():
        return once
    return once.unionByName(docs.join(keep.where("__again"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
