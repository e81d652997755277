"""Language identification by mixture inference.

Each language has a model of hashed letter trigrams, counted in Spark. A text is a sequence of units of a few words;
a unit's likelihood under a language is the product of its trigrams'. Expectation-maximisation finds the proportions of
the languages in each text, for nested language sets (the best one, the best two, ...); the set with the highest
penalised log-likelihood is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

from .common import chunks, summed_table

BUCKET_BITS = 18
#: Cells of the model at most: with very many languages, each gets fewer buckets.
CELLS = 1 << 25
WORDS_PER_UNIT = 4
EM_STEPS = 12


def _letter_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, lower-cased, with everything but letters as 0; text index and word index of each position. Each
    text begins and ends with a 0."""
    strings = [t.decode() for t in texts]
    joined = " " + " ".join(strings) + " "
    low = joined.lower()
    if len(low) != len(joined):  # a few letters have longer lower-case forms
        strings = [s.lower() for s in strings]
        low = " " + " ".join(strings) + " "
    u = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    letter = _is_letter(u)
    c = np.where(letter, u, 0)
    lens = np.fromiter((len(s) + 1 for s in strings), np.int64, len(strings))
    text = np.concatenate([[0], np.repeat(np.arange(len(strings)), lens)])
    return c, text, np.cumsum(letter & ~np.concatenate([[False], letter[:-1]]))


_LETTER = np.array([chr(i).isalpha() for i in range(0x3000)])


def _is_letter(u: np.ndarray) -> np.ndarray:
    out = _LETTER[np.minimum(u, len(_LETTER) - 1)]
    if len(far := np.flatnonzero(u >= len(_LETTER))):
        kinds, inverse = np.unique(u[far], return_inverse=True)
        out[far] = np.array([chr(k).isalpha() for k in kinds])[inverse]
    return out


def _trigrams(c: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram ending at each position, and the positions: those with a letter, and word ends."""
    c = c.astype(np.uint64)
    a, b, d = c[:-2], c[1:-1], c[2:]
    at = np.flatnonzero(b > 0)
    h = (a[at] * np.uint64(0x9E3779B97F4A7C15) + b[at] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (d[at] * np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(64 - bits)).astype(np.int64), at + 1


def train(docs: DataFrame, bits: int = BUCKET_BITS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (languages x buckets, float32) of trigrams. docs: text, lang (rows without lang
    are left out). Counts cover every row; the table has 2^bits buckets a language, or fewer, so that it keeps to CELLS."""
    rows = docs.where(F.col("lang").isNotNull()).select(F.col("text"), F.col("lang").cast("string").alias("lang"))
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    while len(langs) << bits > CELLS and bits > 8:
        bits -= 1
    buckets = 1 << bits
    if not langs:
        return [], np.zeros((0, buckets), np.float32)
    index = {x: i for i, x in enumerate(langs)}

    def count(batches):
        total = np.zeros((len(langs), buckets), np.int64)
        for batch, texts in chunks(batches, "text"):
            c, text, _ = _letter_codes(texts)
            h, at = _trigrams(c, bits)
            lang = np.array([index[x] for x in batch.column("lang").to_pylist()], np.int64)
            total += np.bincount(lang[text[at]] * buckets + h, minlength=len(langs) * buckets).reshape(total.shape)
        return total

    counts = summed_table(rows, count, buckets, len(langs)).astype(float)
    p = (counts + 0.05) / (counts.sum(1, keepdims=True) + 0.05 * buckets)
    return langs, np.log(p).astype(np.float32)


def em(like: np.ndarray, text: np.ndarray, n_texts: int, allowed: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) and log-likelihoods, over units (units x languages log-likelihoods, sorted by
    text); allowed: texts x languages."""
    starts = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
    own = text[starts]
    top = like.max(1)
    e = np.exp(like - top[:, None])
    pi = np.where(allowed, 1.0, 0.0)
    pi /= pi.sum(1, keepdims=True)
    n = np.diff(np.append(starts, len(text)))
    for _ in range(steps):
        r = e * np.repeat(pi[own], n, 0)
        r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
        pi[own] = np.add.reduceat(r, starts, 0) / n[:, None]
    mix = np.log(np.maximum((e * np.repeat(pi[own], n, 0)).sum(1), 1e-300)) + top
    ll = np.zeros(n_texts)
    ll[own] = np.add.reduceat(mix, starts)
    return pi, ll


def infer(texts: list[bytes], logp: np.ndarray, penalty: float = 3.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages) of each text under its best language set, and whether it has any letter."""
    n, k = len(texts), len(logp)
    c, text, word = _letter_codes(texts)
    h, at = _trigrams(c, logp.shape[1].bit_length() - 1)
    if not len(at) or not k:
        return np.zeros((n, k)), np.bincount(text[at], minlength=n) > 0
    tg_text = text[at]
    has = np.bincount(tg_text, minlength=n) > 0
    first = np.full(n, 0, np.int64)
    seen, begin = np.unique(tg_text, return_index=True)
    first[seen] = word[at][begin]
    unit = (word[at] - first[tg_text]) // WORDS_PER_UNIT
    cut = np.flatnonzero(np.concatenate([[True], (unit[1:] != unit[:-1]) | (tg_text[1:] != tg_text[:-1])]))
    like = np.stack([np.add.reduceat(row[h].astype(np.float64), cut) for row in logp], 1)
    utext = tg_text[cut]
    units = np.bincount(utext, minlength=n)
    total = np.zeros((n, k))
    ustart = np.flatnonzero(np.concatenate([[True], utext[1:] != utext[:-1]]))
    total[utext[ustart]] = np.add.reduceat(like, ustart, 0)
    full, _ = em(like, utext, n, np.ones((n, k), bool))
    order = np.argsort(-full + -1e-9 * (total - total.max(1, keepdims=True)), axis=1, kind="stable")
    best, best_value = None, None
    some = (full > 1e-9).sum(1)  # languages without a share add nothing
    for size in range(1, max(1, int(some.max())) + 1):
        allowed = np.zeros((n, k), bool)
        np.put_along_axis(allowed, order[:, :size], True, 1)
        if size == 1:
            one = total.argmax(1)
            allowed[:] = False
            allowed[np.arange(n), one] = True
        pi, ll = em(like, utext, n, allowed)
        value = ll - penalty * (size - 1) * np.log(np.maximum(units, 2))
        if best is None:
            best, best_value = pi, value
        else:
            better = value > best_value
            best, best_value = np.where(better[:, None], pi, best), np.where(better, value, best_value)
    return np.where(has[:, None], best, 0.0), has


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """docs' columns and lang_pred (the language of the largest share; `und` for texts that are null or have no letter,
    or without any learnt language), score (that share, 0 for und), lang_set and lang_shares (all languages of the
    chosen set, largest first). Columns of these names in docs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(logp)
    new = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lang_set", ArrayType(StringType())), StructField("lang_shares", ArrayType(DoubleType()))]
    names = {f.name for f in new}
    fields = [f for f in docs.schema.fields if f.name not in names]
    kept = docs.select(*[f"`{f.name}`" for f in fields])

    def apply(batches):
        table = shared.value
        for batch, texts in chunks(batches, "text"):
            pi, has = infer(texts, table)
            pred, score, sets, shares = [], [], [], []
            for row, known in zip(pi, has & (len(langs) > 0), strict=True):
                if not known:
                    pred.append("und"), score.append(0.0), sets.append([]), shares.append([])
                    continue
                order = [i for i in np.argsort(-row, kind="stable").tolist() if row[i] > 0]
                pred.append(langs[order[0]])
                score.append(min(1.0, float(row[order[0]])))
                sets.append([langs[i] for i in order])
                shares.append([float(row[i]) for i in order])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))], [*batch.schema.names, *(f.name for f in new)])

    return kept.mapInArrow(apply, StructType([*fields, *new]))
