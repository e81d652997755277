"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents fall into blocks by a hash of doc_id and text. A source is taken in passes: a whole number of
passes takes every block, and the rest of its target is made up of blocks in a permuted order, and of documents of the
one block that would exceed it. A drawn block is a unit. Units of all sources are dealt to output shards: a binary tree
over the shards splits, at each node, the source quotas (units a source) by a multivariate hypergeometric draw in
proportion to the shards on either side, down to exact quotas of each source for each shard. A shard then draws disjoint
consecutive ranges of each source's permuted units, and its documents are shuffled locally by a keyed hash.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from .common import checkpointed

WEIGHTS = (3.0, 1.0, 2.0)
#: Blocks of a source; with very many sources fewer, so that about CELLS blocks in all reach the driver, and one of each
#: source at least.
BLOCKS, CELLS = 256, 2_000_000


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> dict[str | None, float]:
    """Words to take from each source: by weight (cycled over sources in code-point order, null last), no more than
    cap times the source, the excess shared again by weight among the others until none is above."""
    order = sorted((s for s, _ in sizes), key=lambda s: (s is None, s or ""))
    size = dict(sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(order)}
    left, open_ = share * sum(size.values()), list(order)
    out: dict[str | None, float] = {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > cap * size[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in full:
            out[s] = cap * size[s]
        left -= sum(out[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    return out


def split_quotas(quotas: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Exact quotas of each source for each shard (shards x sources): recursive halving; each node's left side gets a
    multivariate hypergeometric draw of as many units as its part of the shards."""
    if shards == 1:
        return quotas[None]
    left = shards // 2
    n = int(round(int(quotas.sum()) * left / shards))
    draw, rest, of = np.zeros_like(quotas), n, int(quotas.sum())
    for i, q in enumerate(quotas.tolist()):  # the marginal of each source given those before
        x = int(rng.hypergeometric(q, of - q, rest)) if rest and q else 0
        draw[i], rest, of = x, rest - x, of - q
    return np.concatenate([split_quotas(draw, left, rng), split_quotas(quotas - draw, shards - left, rng)])


def _keys(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """docs with __source, __size, __t (text hash), __h (the permutation's hash) and __block."""
    out = docs.withColumn("__source", F.col("source").cast("string")).withColumn("__t", F.xxhash64(F.col("text").cast("string")))
    out = out.withColumn("__h", F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("__t"))).withColumn("__block", F.pmod("__h", F.lit(blocks)).cast("int"))
    return out.withColumn("__size", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"))


def draws(sized: DataFrame, weights, share: float, cap: float, shards: int, blocks: int, seed: int) -> DataFrame:
    """__s, __b, __source_size, __target, __shards (the output shard of each copy of the block), __most (null, or the words
    that the last copy of the block where the part pass ends may have). At most `blocks` rows a source."""
    found = sized.groupBy("__source", "__block").agg(F.sum("__size").alias("n")).collect()
    words: dict[str | None, dict[int, int]] = {}
    for r in found:
        words.setdefault(r["__source"], {})[r["__block"]] = int(r.n)
    size = {s: sum(w.values()) for s, w in words.items()}
    want = targets(list(size.items()), weights, share, cap)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    units: list[list[int]] = []  # by source: blocks in permuted order, a unit for each copy
    edge: dict[str | None, tuple[int, int]] = {}
    for i, s in enumerate(order):
        rng = np.random.default_rng([seed, i])
        passes = int(want[s] // size[s]) if size[s] else 0
        left = want[s] - passes * size[s]
        perm = [int(b) for b in rng.permutation(blocks) if int(b) in words[s]]
        own = [b for _ in range(passes) for b in perm]
        for b in perm if left >= 1 else ():
            own.append(b)
            if words[s][b] > left:
                edge[s] = (b, int(round(left)))
                break
            left -= words[s][b]
        units.append(own)
    quotas = split_quotas(np.array([len(u) for u in units], np.int64), shards, np.random.default_rng([seed, 1 << 20])) if order else np.zeros((shards, 0), np.int64)
    rows = []
    for i, s in enumerate(order):
        ends = np.cumsum(quotas[:, i]).tolist()
        of: dict[int, list[int]] = {}
        for k, b in enumerate(units[i]):
            of.setdefault(b, []).append(bisect.bisect_right(ends, k))
        cut, most = edge.get(s, (None, 0))
        rows += [(s, b, size[s], float(want[s]), of.get(b, []), most if b == cut else None) for b in words[s]]
    schema = StructType([StructField("__s", StringType()), StructField("__b", IntegerType()), StructField("__source_size", LongType()), StructField("__target", DoubleType()), StructField("__shards", ArrayType(IntegerType())), StructField("__most", LongType())])
    return sized.sparkSession.createDataFrame(rows, schema)


def _in_block(rows: DataFrame, table: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(table), F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__block") == F.col("__b"))).drop("__s", "__b")


def _stops(sized: DataFrame, table: DataFrame) -> DataFrame:
    """table with __stop: where the part pass ends in its last block, whose documents are taken in order of (hash, doc_id,
    text hash) while that brings the words taken nearer to the target. Only keys of those blocks are sorted, one block of
    each source."""
    w = Window.partitionBy("__source", "__block").orderBy("__h", "doc_id", "__t").rowsBetween(Window.unboundedPreceding, 0)
    cut = _in_block(sized, table.where("__most is not null")).withColumn("__sum", F.sum("__size").over(w))
    over = cut.where(F.col("__sum") * 2 - F.col("__size") > F.col("__most") * 2)
    stop = over.groupBy(F.col("__source").alias("__cs"), F.col("__block").alias("__cb")).agg(F.min(F.struct("__h", "doc_id", "__t")).alias("__stop"))
    return table.join(F.broadcast(stop), F.col("__s").eqNullSafe(F.col("__cs")) & (F.col("__b") == F.col("__cb")), "left").drop("__cs", "__cb")


def _drawn(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (from _keys) with __source_size, __target and __shards."""
    beyond = F.col("__stop").isNotNull() & (F.struct(F.col("__h"), F.col("doc_id").cast("long").alias("doc_id"), F.col("__t")) >= F.col("__stop"))
    taken = F.when(beyond, F.slice("__shards", F.lit(1), F.size("__shards") - 1)).otherwise(F.col("__shards"))
    return _in_block(rows, table).withColumn("__shards", taken)


def _table(docs: DataFrame, weights, share, cap, shards, blocks, seed) -> tuple[DataFrame, DataFrame, int]:
    sources = int(docs.select(F.approx_count_distinct("source", 0.05)).first()[0])
    blocks = max(1, min(blocks, CELLS // (sources + 1)))
    sized = checkpointed(_keys(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"), blocks, seed).drop("text", "source"))
    shards = shards or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sized, checkpointed(_stops(sized, draws(sized, weights, share, cap, shards, blocks, seed))), blocks


def plan(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, shards: int | None = None, blocks: int = BLOCKS, seed: int = 17) -> DataFrame:
    """One row for each row of docs: doc_id, source, size (words; null text: 0), source_size, target, copies (how often
    the mix takes it), taken (copies * size) and shards (the output shard of each copy). Reruns agree: the permutations
    hash (doc_id, text). No rows in, no rows out."""
    sized, table, _ = _table(docs, weights, share, cap, shards, blocks, seed)
    copies = F.size("__shards").cast("long")
    return _drawn(sized, table).select("doc_id", F.col("__source").alias("source"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), copies.alias("copies"), (copies * F.col("__size")).alias("taken"), F.col("__shards").alias("shards"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, shards: int | None = None, blocks: int = BLOCKS, seed: int = 17) -> DataFrame:
    """The mixed documents: docs' columns, each row as often as the plan takes it, dealt to output shards and shuffled
    within them by a keyed hash. The texts move once."""
    _, table, blocks = _table(docs, weights, share, cap, shards, blocks, seed)
    out = _drawn(_keys(docs, blocks, seed), table).withColumn("__shard", F.explode("__shards"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = out.select(*[f"`{c}`" for c in docs.columns], "__shard", "__h").repartition(parts, "__shard")
    return dealt.sortWithinPartitions("__shard", F.xxhash64(F.lit(seed + 1), "__h")).select(*[f"`{c}`" for c in docs.columns])
