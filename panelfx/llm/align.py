"""Alignment of two tokenizers' tokens by lockstep merging.

Both tokenizers cut the same bytes, so a document is two ascending lists of token ends. Where an A token and a B token
end together they are linked, and the document is cut into groups. The lists of all documents of a batch are merged at
once: one state vector holds each lane's pointers into A and B; a step compares all pairs of ends, emits the equal ones
as links and cuts, and moves on the pointer that is behind (both, if equal). Lanes that are through leave the vector.
A document is spread over lanes of LANE tokens of A: a lane's part of B follows from the end of its first token of A, so
a very long document takes as many steps as a short one.

Linked tokens end together, so one's bytes are the end of the other's: the pairs that can ever be linked follow from the
two vocabularies alone. Corpus-wide counts are a table of that fixed size, which tasks sum and the driver broadcasts.
"""

from __future__ import annotations

import hashlib
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, saved, summed_table
from .token_store import Encoder

#: Tokens of A in a lane.
LANE = 256


class PlainEncoder(Encoder):
    """Byte-level BPE; the strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tok.encode_special_tokens = True
        self.special = []
        letters = {ord(c): b for b, c in self.letters.items()}
        vocab = self.tok.get_vocab()
        self.bytes: list[bytes] = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(letters[ord(c)] for c in token) if all(ord(c) in letters for c in token) else token.encode()


class PieceEncoder:
    """Ids of whole texts by a sentencepiece model, which precedes them with a space and marks spaces with U+2581."""

    def __init__(self, path: str):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = [
            bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]

    def __call__(self, text: str) -> bytes:
        return np.array(self.sp.encode(text), "<u4").tobytes()


@lru_cache(maxsize=2)
def encoders(a_path: str, b_path: str) -> tuple[PlainEncoder, PieceEncoder]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return PlainEncoder(a_path), PieceEncoder(b_path)


def possible_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """All (A id << 32 | B id) that can end together, ascending: one's bytes are the end of the other's."""
    of_a: dict[bytes, list[int]] = {}
    of_b: dict[bytes, list[int]] = {}
    for ids, tokens in ((of_a, a), (of_b, b)):
        for i, t in enumerate(tokens):
            if t:
                ids.setdefault(t, []).append(i)
    out = [(i, j) for t, js in of_b.items() for k in range(len(t)) for i in of_a.get(t[k:], ()) for j in js]
    out += [(i, j) for t, is_ in of_a.items() for k in range(1, len(t)) for j in of_b.get(t[k:], ()) for i in is_]
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return np.unique(pairs[:, 0] << 32 | pairs[:, 1])


@lru_cache(maxsize=2)
def _pairs(a_path: str, b_path: str) -> np.ndarray:
    a, b = encoders(a_path, b_path)
    return possible_pairs(a.bytes, b.bytes)


def lanes(a_end: np.ndarray, a_first: np.ndarray, b_end: np.ndarray, b_first: np.ndarray, width: int = LANE):
    """The lanes of documents whose token ends lie one after another in a_end and b_end (ascending over all documents);
    a_first and b_first: where each document's begin, and the totals. Returns each lane's first and last positions."""
    n = np.diff(a_first)
    per = -(-n // width)
    doc = np.repeat(np.arange(len(n)), per)
    a_lo = a_first[:-1][doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * width
    a_hi = np.minimum(a_lo + width, a_first[1:][doc])
    starts = a_lo == a_first[:-1][doc]
    b_lo = np.where(starts, b_first[:-1][doc], np.searchsorted(b_end, a_end[np.maximum(a_lo - 1, 0)], "right")) if len(doc) else a_lo
    b_hi = np.where(a_hi == a_first[1:][doc], b_first[1:][doc], np.append(b_lo[1:], len(b_end))[: len(doc)])
    return a_lo, a_hi, b_lo, b_hi


def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_lo, a_hi, b_lo, b_hi) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in A and in B) of the tokens that end together, in order."""
    at = np.stack([a_lo, b_lo]).astype(np.int64)
    stop = np.stack([a_hi, b_hi]).astype(np.int64)
    links_a, links_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    going = (at < stop).all(axis=0)
    while going.any():
        if not going.all():
            at, stop = at[:, going], stop[:, going]
        x, y = a_end[at[0]], b_end[at[1]]
        met = x == y
        links_a.append(at[0][met])
        links_b.append(at[1][met])
        at[0] += x <= y
        at[1] += y <= x
        going = (at < stop).all(axis=0)
    a, b = np.concatenate(links_a), np.concatenate(links_b)
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


class Aligned:
    """The tokens of a batch of texts and their links. Texts without tokens (empty, or not restored by their tokens'
    bytes) have none."""

    def __init__(self, texts: list[bytes], a: PlainEncoder, b: PieceEncoder, a_len: np.ndarray, b_len: np.ndarray):
        ids_a, ids_b, self.size = [], [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            whole = b" " + t
            x = y = b""
            if t:
                text = t.decode()
                x, y = a(" " + text), b(text)
                if not (_restores(x, a.bytes, whole) and _restores(y, b.bytes, whole)):
                    x = y = b""
            ids_a.append(x)
            ids_b.append(y)
            self.size[i] = len(whole) if x else 0
        self.a, self.b = (np.frombuffer(b"".join(p), "<u4").astype(np.int64) for p in (ids_a, ids_b))
        self.n_a, self.n_b = (np.fromiter((len(x) // 4 for x in p), np.int64, len(p)) for p in (ids_a, ids_b))
        self.a_first, self.b_first = (np.concatenate([[0], np.cumsum(n)]) for n in (self.n_a, self.n_b))
        self.a_end, self.b_end = np.cumsum(a_len[self.a]), np.cumsum(b_len[self.b])
        self.link_a, self.link_b = lockstep(self.a_end, self.b_end, *lanes(self.a_end, self.a_first, self.b_end, self.b_first))
        self.doc = np.searchsorted(self.a_first, self.link_a, "right") - 1
        self.n_links = np.bincount(self.doc, minlength=len(texts))

    def group_texts(self, a_text: np.ndarray, b_text: np.ndarray) -> list[str]:
        """Each document's groups: `a1,a2|b1;a3|b2,b3`. a_text, b_text: by id and what follows it, for a token within a
        group and one at its end."""
        ends_a, ends_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        ends_a[self.link_a], ends_b[self.link_b] = 1, 1
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        # tokens of group g: first its A tokens, then its B tokens
        before_a, before_b = np.searchsorted(group_b, group_a), np.searchsorted(group_a, group_b, "right")
        out = np.empty(len(self.a) + len(self.b), object)
        out[np.arange(len(self.a)) + before_a] = a_text[self.a * 2 + ends_a]
        out[np.arange(len(self.b)) + before_b] = b_text[self.b * 2 + ends_b]
        first = (self.a_first + self.b_first).tolist()
        flat = out.tolist()
        return ["".join(flat[x:y])[:-1] for x, y in zip(first, first[1:])]


def _restores(ids: bytes, tokens: list[bytes], whole: bytes) -> bool:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist())) == whole


@lru_cache(maxsize=4)
def _endings(n: int, at_end: str) -> np.ndarray:
    """Decimal ids with what follows: a comma within a group, at_end behind its last token."""
    return np.array([f"{i}{e}" for i in range(n) for e in (",", at_end)], object)


_LINKED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string()), ("gap", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))])


def links(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups, gap, times. groups is the text of the
    groups, or, unless keep_groups, its sha256 in hex ('' without tokens). gap and times are the document's linked id
    pairs, as differences of their ascending places in possible_pairs, and how often each is linked."""

    def apply(batches):
        a, b = encoders(a_path, b_path)
        pairs = _pairs(a_path, b_path)
        a_len, b_len = (np.array([len(t) for t in e.bytes], np.int64) for e in (a, b))
        a_text, b_text = _endings(len(a.bytes), "|"), _endings(len(b.bytes), ";")
        for batch, texts in chunks(batches, "text"):
            x = Aligned(texts, a, b, a_len, b_len)
            place = np.searchsorted(pairs, x.a[x.link_a] << 32 | x.b[x.link_b])
            cell, times = np.unique(x.doc * len(pairs) + place, return_counts=True)
            doc, place = np.divmod(cell, len(pairs))
            first = np.searchsorted(doc, np.arange(len(texts) + 1))
            gap = np.diff(place, prepend=0)
            heads = first[:-1][first[:-1] < first[1:]]
            gap[heads] = place[heads]
            groups = x.group_texts(a_text, b_text)
            if not keep_groups:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            off = pa.array(first.astype(np.int32))
            lists = [pa.ListArray.from_arrays(off, pa.array(v.astype(np.int32))) for v in (gap, times)]
            longs = [pa.array(v) for v in (x.n_a, x.n_b, x.n_links, x.n_links)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(groups, pa.string()), *lists], schema=_LINKED)

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups string, gap array<int>, times array<int>"
    return rows.mapInArrow(apply, schema)


def _cells(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, place and times of every linked pair of a batch of links()."""
    gap, times = (batch.column(batch.schema.get_field_index(c)) for c in ("gap", "times"))
    first = gap.offsets.to_numpy().astype(np.int64)
    flat = gap.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(batch)), np.diff(first))
    total = np.concatenate([[0], np.cumsum(flat)])
    place = total[1:] - total[first - first[0]][:-1][row] if len(flat) else flat
    return row, place, times.flatten().to_numpy().astype(np.int64)


def pair_counts(linked: DataFrame, n_pairs: int) -> np.ndarray:
    """How often each possible pair is linked in all documents."""

    def count(batches):
        out = np.zeros(n_pairs, np.int64)
        for batch in batches:
            _, place, times = _cells(batch)
            np.add.at(out, place, times)
        return out

    return summed_table(linked.select("gap", "times"), count, n_pairs)[0]


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id's (ties included)."""
    b = pairs & 0xFFFFFFFF
    top = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(top, b, counts)
    return (counts == top[b]) & (counts > 0)


def align(docs: DataFrame, a_path: str, b_path: str, keep_groups: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair's count is the highest of
    its B id's), count_sum (the counts of all links), groups_sha256 (or, with keep_groups, groups).

    A is a byte-level BPE of the tokenizers library, given the text behind a space; B a sentencepiece model that adds the
    space itself. Null and empty texts, and texts that their tokens' bytes don't restore, have no tokens: zeros and ''.
    Each row counts, also if it repeats another; other columns are ignored. No rows in, no rows out."""
    spark = docs.sparkSession
    linked = saved(links(docs, a_path, b_path, keep_groups), "links")
    pairs = _pairs(a_path, b_path)
    counts = pair_counts(linked, len(pairs))
    shared = spark.sparkContext.broadcast((counts, best_pairs(pairs, counts)))

    def apply(batches):
        counts, best = shared.value
        for batch in batches:
            row, place, times = _cells(batch)
            n_best = np.zeros(len(batch), np.int64)
            total = np.zeros(len(batch), np.int64)
            np.add.at(n_best, row, times * best[place])
            np.add.at(total, row, times * counts[place])
            own = [batch.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_best), pa.array(total), batch.column(5)], names)

    groups = "groups" if keep_groups else "groups_sha256"
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", groups]
    return linked.mapInArrow(apply, ", ".join(f"{n} long" for n in names[:-1]) + f", {groups} string")
