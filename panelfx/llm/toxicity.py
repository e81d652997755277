"""Toxicity: a noisy-channel decoder restores disguised words, then learnt word evidence scores the restored text.

Channel. A word may have been written with look-alike signs (l0ser, m*ron), drawn-out letters (stuuupid, stuupid) or
spaced-out letters (i d i o t, i.d.i.o.t). Each such span becomes a lattice: one column for each sign, with the letters that
it may stand for and their costs. Viterbi finds the restored word of the highest probability under a character trigram
model counted over all documents. Letters that the model doesn't know have one column with one option, themselves. A word of
plain letters has one path only and is kept as it is; one with a doubled letter stands for itself and for what is decoded.

Evidence. For each word and word beginning (4 to 7 letters) of labelled texts: in how many toxic texts and in how many
different contexts (pairs with the word before) within them it occurs, and in how many other texts. The smaller of texts
and contexts is its support, so that a passage copied into many toxic texts doesn't make its ordinary words evidence. A text's score is the noisy-or of
its features' probabilities.
"""

from __future__ import annotations

import math
import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import chunks, crc_mod, saved, summed_table

# The letters of the model and the look-alike table.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâäãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "<": "c", "¡": "i", "*": "abcdefghijklmnopqrstuvwxyz", "#": "h", "%": "o", "&": "a",
}
SUBSTITUTE, WILD, REPEAT, DOUBLE, UNKNOWN = 1.5, 3.0, 0.5, 4.0, 3.5  # costs, in nats; UNKNOWN: of a letter outside the model
A = len(LETTERS) + 1  # 0: outside a word
_CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
_CODES = np.zeros(0x180, np.int64)
for _c, _i in _CODE.items():
    _CODES[ord(_c)] = _i

_GAP = re.compile(r"[ \t.\-_~]+")
_INNER = re.compile(r"[^\w@$!*+|€]+")
_DECOR = re.compile(r"([^\w\s])\1{2,}$|^([^\w\s])\2{2,}")  # a word's trimmings, as in word!!! or ***word
_DRAWN, _DOUBLED = re.compile(r"(.)\1\1"), re.compile(r"(.)\1")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W_]|[@$!*+|€])(?:[ \t.\-_*~]{1,4}(?:[^\W_]|[@$!*+|€])(?![^\W_])){2,}")
_TRIM = " \t\r\n.,;:?\"'()[]{}<>«»“”‘’…-–—_/\\=^`~"


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of (letter, letter, letter) over the words of all texts, as a cube of fixed size A x A x A."""

    def count(batches):
        total = np.zeros(A**3, np.int64)
        for _, texts in chunks(batches, "text"):
            s = "  ".join(t.decode().lower() for t in texts)
            u = np.frombuffer(("  " + s + " ").encode("utf-32-le"), np.uint32)
            c = np.where(u < len(_CODES), _CODES[np.minimum(u, len(_CODES) - 1)], 0)
            a, b, d = c[:-2], c[1:-1], c[2:]
            total += np.bincount((np.where(b > 0, a, 0) * A + b) * A + d, minlength=A**3)
        return total

    return summed_table(docs.select("text"), count, A**3)[0]


def char_model(counts: np.ndarray) -> np.ndarray:
    """log P(letter | two letters before), trigram smoothed by bigram smoothed by unigram; cube A x A x A."""
    c3 = counts.reshape(A, A, A).astype(float)
    c2 = c3.sum(0)
    c2[0] = c3[0, 0]
    c1 = c2.sum(0) + 0.5
    p1 = c1 / c1.sum()
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    return np.log((c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5))


class Restorer:
    """Decodes lattices under the character model; remembers up to 200,000 spans of up to 64 signs."""

    def __init__(self, logp: np.ndarray):
        self.logp, self.memo = logp.tolist(), {}

    def lattice(self, span: str, doubled: bool = False) -> list[tuple[list[tuple[int, float, str]], float | None]]:
        """Columns of (code, cost, letter), and the cost of skipping a column that repeats the one before, if it may be.
        Signs that neither are letters nor look like one have no column. doubled: a letter that stands twice may be one."""
        cols = []
        for m in re.finditer(r"(.)\1*", span, re.S):
            ch, n = m[1], len(m[0])
            if ch in _CODE:
                options = [(_CODE[ch], 0.0, ch)]
            elif ch in LOOKALIKE:
                cost = WILD if ch == "*" else SUBSTITUTE
                options = [(_CODE[x], cost, x) for x in LOOKALIKE[ch]]
            elif ch.isalpha():
                options = [(0, UNKNOWN, ch)]
            else:
                continue
            skip = REPEAT if n >= 3 else DOUBLE if doubled and ch.isalpha() else None
            cols += [(options, skip if k else None) for k in range(min(n, 3))]
        return cols

    def decode(self, span: str, doubled: bool = False) -> str:
        """The most probable word (Viterbi over pairs of letters)."""
        if (span, doubled) in self.memo:
            return self.memo[span, doubled]
        lp = self.logp
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # chains of letters, last first
        for options, skip in self.lattice(span, doubled):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (s, text) in best.items():
                row = lp[a][b]
                for x, cost, letter in options:
                    v = s + (row[x] if x else 0.0) - cost
                    if (b, x) not in after or v > after[b, x][0]:
                        after[b, x] = (v, (letter, text))
                if skip is not None:
                    v = s - skip
                    if (a, b) not in after or v > after[a, b][0]:
                        after[a, b] = (v, text)
            best = after
        chain = max(((s + lp[a][b][0], -i, text) for i, ((a, b), (s, text)) in enumerate(best.items())), default=(0, 0, None))[2]
        letters = []
        while chain:
            letters.append(chain[0])
            chain = chain[1]
        word = "".join(reversed(letters))
        if len(span) <= 64:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[span, doubled] = word
        return word

    def _read(self, w: str) -> list[str]:
        """What a span stands for: its best reading, and the one without its doubled letters if the model prefers that and
        knows its like."""
        best = w if w.isalpha() and not _DRAWN.search(w) else self.decode(w)
        other = self.decode(w, True) if _DOUBLED.search(w) else best
        return [best] if other == best or not self._likely(other) else [best, other]

    def _likely(self, word: str) -> bool:
        """Whether the letters, one by one, have a mean probability of a tenth at least."""
        a = b = 0
        total = 0.0
        for ch in word:
            x = _CODE.get(ch, 0)
            total += self.logp[a][b][x] if x else -UNKNOWN
            a, b = b, x
        return total >= len(word) * math.log(0.1)

    def token(self, token: str) -> list[str]:
        """The words that a token (lower-cased, without white space) stands for."""
        w = _DECOR.sub("", token.strip(_TRIM)).strip(_TRIM)
        if w.isalpha():
            return self._read(w)
        core = w.rstrip("!+")
        if core.isalpha():
            return self._read(core)
        if not core:
            return []
        parts = [p for p in _INNER.split(core) if p]  # at signs that don't look like letters
        out = self._read(core)
        if len(parts) > 1:
            for p in parts:
                out += self._read(p)
            for short, run in groupby(parts, lambda p: len(p) <= 2):  # single signs beside whole words
                run = list(run)
                if short and 2 < len(run) < len(parts):
                    out += self._read("".join(run))
        return list(dict.fromkeys(x for x in out if x))

    def spaced(self, text: str) -> list[str]:
        """Words written with spaced-out letters."""
        return [w for span in _SPACED.findall(text) if (w := self.decode(_GAP.sub("", span)))]

    def words(self, text: str) -> list[str]:
        """The restored words of a text, in order; those of spaced-out spans last."""
        text = text.lower()
        return [w for t in text.split() for w in self.token(t)] + self.spaced(text)


def features(word: str) -> tuple[str, ...]:
    return (word, *(word[:k] + "~" for k in range(4, 8) if len(word) > k))


def evidence(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_rows: int = 40_000, min_contexts: int = 5) -> dict[str, float]:
    """Feature: probability that a text is toxic given the feature, for those that are evidence: whose share of toxic
    texts is above the overall share by more than chance over all features explains (Chernoff bound). labels: doc_id,
    toxic. Beginnings count words that aren't
    evidence themselves, three at least. Fitted on the max_rows labelled rows whose doc_id hashes lowest (all, if fewer),
    which bounds the evidence too."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known = saved(known, "labels")
    n_toxic, n_all = (int(x or 0) for x in known.agg(F.sum("toxic"), F.count("*")).first())
    if not n_toxic or n_toxic == n_all:
        return {}
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")
    shared = spark.sparkContext.broadcast(model)

    def count(batches):
        restore = Restorer(shared.value)
        contexts: set[tuple[str, int]] = set()
        texts_with: dict[str, list[int]] = {}

        def send():
            rows = [*((f, c, 0, 0) for f, c in contexts), *((f, None, p, n) for f, (n, p) in texts_with.items())]
            contexts.clear()
            texts_with.clear()
            for i in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 20_000]), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["word", "context", "pos", "neg"])

        for batch, texts in chunks(batches, "text"):
            for t, y in zip(texts, batch.column("toxic").to_pylist(), strict=True):
                ws = restore.words(t.decode())
                if y:
                    contexts.update((w, hash_text(before)) for before, w in zip(["", *ws], ws))
                for w in set(ws):
                    texts_with.setdefault(w, [0, 0])[int(y)] += 1
            if len(contexts) + len(texts_with) > 400_000:
                yield from send()
        yield from send()

    parts = rows.mapInArrow(count, "word string, context long, pos long, neg long")
    each = parts.groupBy("word", "context").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    words = saved(each.groupBy("word").agg(F.count("context").alias("contexts"), F.sum("pos").alias("docs"), F.sum("neg").alias("neg")), "words")
    base = n_toxic / n_all

    def sure(found: DataFrame) -> DataFrame:
        found = found.where("docs + neg >= 3")
        tried = max(1, found.count())
        pos = F.least("contexts", "docs").cast("double")
        n = pos + F.col("neg")
        share = pos / n
        chance = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0))
        hit = found.where((F.col("contexts") >= min_contexts) & (share >= 0.6) & (chance > math.log(tried) + 0.5))
        return hit.select("word", pos.alias("pos"), "neg")

    whole = saved(sure(words), "toxic-words")
    rest = words.join(F.broadcast(whole.select("word")), "word", "left_anti")
    begin = F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda k: F.when(F.length("word") > k, F.concat(F.substring("word", F.lit(1), k), F.lit("~")))))
    stems = rest.where("length(word) > 4").select(begin.alias("stem"), "contexts", "docs", "neg").where("stem is not null")
    stems = stems.groupBy(F.col("stem").alias("word")).agg(F.sum("contexts").alias("contexts"), F.sum("docs").alias("docs"), F.sum("neg").alias("neg"), F.count("*").alias("words")).where("words >= 3").drop("words")
    best = whole.unionByName(sure(saved(stems, "stems")))
    return {r.word: r.pos / (r.pos + r.neg + 0.5) for r in best.collect()}


def hash_text(s: str) -> int:
    return zlib.crc32(s.encode())


def score_text(text: str, restore: Restorer, weight: dict[str, float], memo: dict[str, float]) -> float:
    """Noisy-or over the distinct tokens; a word counts by its best feature. 0.01 without evidence."""
    text = text.lower()
    doubt = 0.99
    for t in set(text.split()):
        p = memo.get(t)
        if p is None:
            p = memo[t] = max((weight.get(f, 0.0) for w in restore.token(t) for f in features(w)), default=0.0)
        if p:
            doubt *= 1 - min(p, 0.9999)
    for w in restore.spaced(text):
        doubt *= 1 - min(0.9999, max((weight.get(f, 0.0) for f in features(w)), default=0.0))
    return 1 - doubt


def score_texts(docs: DataFrame, model: np.ndarray, weight: dict[str, float]) -> DataFrame:
    """docs' columns and score: double, 0 to 1. Null and empty texts score 0.01. The model and the weights are of
    bounded size and broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast((model, weight))
    fields = [f for f in docs.schema.fields if f.name != "score"]
    docs = docs.select(*[f"`{f.name}`" for f in fields])

    def score(batches):
        lp, w = shared.value
        restore, memo = Restorer(lp), {}
        for batch, texts in chunks(batches, "text"):
            if len(memo) > 500_000:
                memo.clear()
            s = [score_text(t.decode(), restore, w, memo) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(score, StructType([*fields, StructField("score", DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1) -> tuple[np.ndarray, dict[str, float]]:
    """Character model over all texts; evidence from labels of rows outside the held-out fold."""
    model = char_model(trigram_counts(docs))
    return model, evidence(docs, labels.where(crc_mod(F.col("doc_id"), folds) != held_out), model)


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """docs' columns, score and predicted (1 from threshold on). Empty tables give empty results; without labels every
    score is 0.01."""
    return score_texts(docs, *train(docs, labels)).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
