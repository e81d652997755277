"""Nearest neighbours by inner product through collision-counting hashing.

Vectors are reduced to Euclidean form (an extra coordinate makes all norms equal, so the nearest point has the largest
inner product), and projected on m random Gaussian lines. The index is cut into partitions; in each, every line has one
array of the projections in sorted order, written once to the shared folder and mapped by the tasks that search. A query's
window on a line is centred at its own projection; virtual rehashing widens all windows by a factor round by round. A
vector that lies in the windows of at least THRESHOLD of the lines is verified: its exact inner product, in double
precision.

A query stops in a partition once its k-th best verified vector is nearer than `reach` times the windows' radius. A vector
at distance d falls into a line's window of radius r with a chance of 2 Phi(r / d) - 1, so one within that distance has
enough collisions with a chance of CERTAIN at least: each true neighbour is found with that chance, whatever the data.
"""

from __future__ import annotations

import json
import math
import uuid
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import open_mapped, saved, shared_dir, write_bytes

#: Lines; first radius, as a multiple of the projections' median absolute deviation; its growth a round; share of the lines
#: whose windows must hold a vector; chance that a true neighbour is verified; rounds until all vectors are.
LINES, START, GROWTH, THRESHOLD, CERTAIN, ROUNDS = 32, 1.0, 1.2, 0.6, 0.95, 60
#: Queries of one pass over the index (their vectors are what is broadcast).
QUERY_BLOCK = 20_000


def reach(lines: int, need: int, certain: float = CERTAIN) -> float:
    """The distance, in radii, up to which a vector has `need` collisions on that many lines with the chance `certain`."""

    def enough(p: float) -> float:
        return sum(math.comb(lines, k) * p**k * (1 - p) ** (lines - k) for k in range(need, lines + 1))

    low, high = 0.0, 1.0
    for _ in range(50):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) >= certain else (mid, high)
    return 1 / NormalDist().inv_cdf((1 + min(high, 1 - 1e-12)) / 2)


def valid(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, v (doubles): rows with an id and a vector that isn't null, empty or zero and whose components are all
    finite."""
    v = F.col(embedding).cast(ArrayType(DoubleType()))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


class Partition:
    """Distinct vectors of one index partition: m sorted arrays of projections, and the positions in their order. Copies
    count once and carry their ids; a repeated row is one."""

    FIELDS = ("ids", "starts", "x", "order", "sorted")

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray, largest: float, scale: float, lines: np.ndarray) -> Partition:
        self = cls()
        x = np.ascontiguousarray(x + 0.0)  # one zero
        _, first, group = np.unique(x.view(np.dtype((np.void, x.itemsize * x.shape[1]))).ravel(), return_index=True, return_inverse=True)
        self.x = x[first]
        pair = np.unique(np.stack([group.ravel(), ids]), axis=1)
        self.ids, self.starts = pair[1], np.concatenate([[0], np.cumsum(np.bincount(pair[0]))])
        unit = self.x * scale
        extra = np.sqrt(np.maximum(largest**2 - (unit**2).sum(1), 0))
        p = unit @ lines[:, :-1].T + extra[:, None] * lines[:, -1]
        order = np.argsort(p, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(p, order.T, 0).T.copy()
        self.order = order.astype(np.intp)
        return self

    def save(self, uri: str) -> None:
        arrays = [np.ascontiguousarray(getattr(self, f)) for f in self.FIELDS]
        head = json.dumps([[str(a.dtype), a.shape] for a in arrays]).encode()
        head += b" " * (-len(head) % 8)
        write_bytes(uri, len(head).to_bytes(8, "little"), head, *(a.tobytes() + b"\0" * (-a.nbytes % 8) for a in arrays))

    @classmethod
    def load(cls, uri: str) -> Partition:
        self, raw = cls(), open_mapped(uri)
        at = 8 + int.from_bytes(raw[:8].tobytes(), "little")
        for f, (dtype, shape) in zip(cls.FIELDS, json.loads(raw[8:at].tobytes()), strict=True):
            n = np.dtype(dtype).itemsize * math.prod(shape)
            setattr(self, f, raw[at : at + n].view(dtype).reshape(shape))
            at += n + -n % 8
        return self

    def search(self, q: np.ndarray, own: np.ndarray, k: int, lines: np.ndarray, largest: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row of q: ids and scores of the best k verified ids other than own; ties to the smaller id."""
        n, m = len(self.x), len(lines)
        need = math.ceil(THRESHOLD * m)
        far = reach(m, need)
        unit = q / np.abs(q).max(1, keepdims=True)
        unit /= np.sqrt((unit**2).sum(1, keepdims=True))
        c = unit @ lines[:, :-1].T * largest  # scaled to the common norm; the extra coordinate is 0
        spread = float(np.median(np.abs(self.sorted - np.median(self.sorted, 1, keepdims=True)))) or largest
        counts = [np.zeros(n, np.uint8) for _ in q]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        out: list = [None] * len(q)
        live = np.arange(len(q))
        lo = hi = None
        radius, rounds = START * spread, 0
        while len(live):
            a = np.stack([np.searchsorted(s, c[live, j] - radius) for j, s in enumerate(self.sorted)], 1)
            b = np.stack([np.searchsorted(s, c[live, j] + radius, "right") for j, s in enumerate(self.sorted)], 1)
            more = []
            for r, i in enumerate(live.tolist()):
                if lo is None:
                    new = [o[x:y] for o, x, y in zip(self.order, a[r].tolist(), b[r].tolist())]
                else:
                    new = [o[x:y] for o, x, y in zip(self.order, a[r].tolist(), lo[r].tolist())]
                    new += [o[x:y] for o, x, y in zip(self.order, hi[r].tolist(), b[r].tolist())]
                before = counts[i]
                counts[i] = before + np.bincount(np.concatenate(new), minlength=n).astype(np.uint8)
                reached = counts[i] >= need
                at = np.flatnonzero(reached & (before < need))  # verified once, when they reach the threshold
                if len(at):
                    best[i] = self._merged(best[i], at, self.x.take(at, axis=0) @ q[i], k)
                done = self._best(best[i], unit[i], own[i], k, far * radius, largest, final=rounds >= ROUNDS or bool(reached.all()))
                if done is None:
                    more.append(r)
                else:
                    out[i], counts[i], best[i] = done, None, None
            lo, hi, live = a[more], b[more], live[more]
            rounds += 1
            radius = radius * GROWTH if rounds < ROUNDS else np.inf
        return out

    @staticmethod
    def _merged(have, at, s, k):
        """The verified vectors among which the k best are: k + 1 and their ties."""
        at, s = np.concatenate([have[0], at]), np.concatenate([have[1], s])
        if len(at) > 4 * (k + 1):
            top = np.flatnonzero(s >= np.partition(s, len(s) - k - 1)[len(s) - k - 1])
            at, s = at[top], s[top]
        return at, s

    def _best(self, have, unit, own, k, within, largest, final):
        """The k best ids among the verified vectors; None if the k-th isn't near enough to stop."""
        at, s = have
        if not final:
            if len(at) <= k:
                return None
            kth = np.partition(s, len(s) - k)[len(s) - k]
            low = at[np.flatnonzero(s == kth)[0]]
            if self._distance(low, unit, largest) > within:  # the k-th is no farther than what copies and own leave
                return None
        some = np.minimum(np.diff(self.starts)[at], k + 1)  # of copies, the smallest ids; own may be among them
        ids = self.ids[np.repeat(self.starts[at] - np.cumsum(some) + some, some) + np.arange(some.sum())]
        where, s = np.repeat(at, some), np.repeat(s, some)
        order = np.lexsort((ids, -s))
        order = order[ids[order] != own]
        order = order[np.sort(np.unique(ids[order], return_index=True)[1])][:k]  # an id's best row
        if not final and (len(order) < k or self._distance(where[order[-1]], unit, largest) > within):
            return None
        return ids[order], s[order]

    def _distance(self, i, unit, largest) -> float:
        """Of the lifted vectors, which have the common norm."""
        x = self.x[i]
        size = np.abs(x).max()
        cosine = float((x / size) @ unit) * size * self.scale / largest
        return largest * math.sqrt(max(2 - 2 * cosine, 0.0))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, per_partition: int = 20_000, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest of those verified, nearest first, ties to the smaller
    vec_id. vectors and queries: vec_id, v as from valid(), of one length (others are refused by an error). A row that
    repeats a vec_id and its vector counts once. Rows of one vec_id with different vectors are one candidate, of the best
    score, and one query, answered by the best scores of its vectors; a query's own vec_id is no candidate.

    Every vector is indexed, in partitions dealt by a hash of id and vector, so neither copies nor order make one large;
    their sorted arrays are built once. Queries are a stated set and pass in blocks; a partition sends on k rows a query.
    Lengths are compared on a common scale, a power of two, so very large and very small components neither overflow nor
    vanish; scores are of the vectors as they are."""
    spark = vectors.sparkSession
    size = F.array_max(F.transform("v", F.abs))
    norm = F.log2(size) + F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.pow(x / size, F.lit(2.0)))) / 2
    stats = vectors.select(F.count("*").alias("n"), F.max(norm).alias("m"), F.max(F.size("v")).alias("dim")).first()
    schema = "query_id long, vec_id long, score double"
    if not stats.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    power = min(max(math.floor(stats.m), -1000), 1000)
    scale, largest = math.ldexp(1.0, -power), 2.0 ** (stats.m - power) * (1 + 1e-9)
    lines = np.random.default_rng(seed).standard_normal((LINES, int(stats.dim) + 1))
    parts = max(1, -(-int(stats.n) // per_partition))
    home = shared_dir(spark, "nearest")

    def build(batches):
        ids, xs = [], []
        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column(0).to_numpy(zero_copy_only=False))
                xs.append(matrix(batch.column(1)))
        if ids:
            uri = f"{home}/{uuid.uuid4().hex}"
            Partition.build(np.concatenate(ids), np.concatenate(xs), largest, scale, lines).save(uri)
            yield pa.RecordBatch.from_arrays([pa.array([uri])], ["uri"])

    dealt = vectors.select("vec_id", "v").repartition(parts, "vec_id", "v").distinct()
    index = saved(dealt.mapInArrow(build, "uri string"), "index")
    index = index.repartitionByRange(max(parts, index.count()), "uri")  # evenly, whatever the names
    n_q = queries.count()
    blocks = max(1, -(-n_q // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        # a block of the stated query set passes through the driver at a time
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).select("vec_id", "v").distinct().toArrow()
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), matrix(rows.column(1)), lines, largest))

        def probe(batches, shared=shared):
            q_ids, q, ls, big = shared.value
            for batch in batches:
                for uri in batch.column(0).to_pylist():
                    part = Partition.load(uri)
                    part.scale = scale
                    for i in range(0, len(q_ids), 256):
                        got = part.search(q[i : i + 256], q_ids[i : i + 256], k, ls, big)
                        columns = [np.repeat(q_ids[i : i + 256], [len(g[0]) for g in got]), *(np.concatenate([g[j] for g in got]) for j in (0, 1))]
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

        part = index.mapInArrow(probe, schema)
        if blocks > 1:  # each block's rows are written before the next block is fetched
            part = saved(_nearest(part, k), "neighbours").drop("rank")
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    return _nearest(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _nearest(found: DataFrame, k: int) -> DataFrame:
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
