"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page becomes the sequence of its leaf blocks (runs of text between block-level tags), each with features of the tags
around it and of its text. The field has weights for (feature, label) and (label, label); it is trained on labelled
pages (see html_training) by gradient ascent on the log-likelihood, and decoded by Viterbi.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A quote begins a value only after an equals sign; elsewhere it is a character like any other.
_ATTRIBUTES = r"""(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|$)|<(script|style|template|noscript|svg|iframe|textarea)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|$)|<[!?][^>]*(?:>|$)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_ATTRIBUTES})(?:>|$)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
# Tags that begin and end blocks, and those without content.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "body": {"head", "title"}}
_LEAVES_P = BLOCK - {"button", "label", "option", "select", "textarea", "body", "head", "html", "title"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}


_CONTROLS = {"select", "option", "optgroup", "button"}


class Node:
    """An open block tag. Its features are those of the tags around it and its own; equal sets are shared, so that depth
    costs no memory. known: the only features that are kept, if given."""

    __slots__ = ("tag", "feats", "control")

    def __init__(self, tag: str, names: list[str], parent: Node | None, known):
        own = {"name=" + n for n in names} | ({"in=" + tag} if tag not in ("html", "body") else set())
        if known is not None:
            own &= known
        above = parent.feats if parent else frozenset()
        self.tag, self.feats = tag, above if own <= above else above | own
        self.control = tag in _CONTROLS or (parent is not None and parent.control)


_ROOT = Node("none", [], None, frozenset())


def blocks(page: str, known=None) -> list[tuple[str, Node, int]]:
    """(text, innermost open block tag, characters inside links) of each leaf block with text; form controls' text is left
    out. Takes time in proportion to the page, however deep its tags are nested."""
    out: list[tuple[str, Node, int]] = []
    stack: list[Node] = []
    open_: dict[str, int] = {}
    parts: list[str] = []
    linked = at = in_link = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            node = stack[-1] if stack else _ROOT
            if text and not node.control:
                out.append((text, node, min(linked, len(text))))
            parts.clear()
        linked = 0

    def close():
        open_[stack.pop().tag] -= 1

    for m in _TAG.finditer(page):
        if m.start() > at:
            raw = page[at : m.start()]
            parts.append(raw)
            if in_link:
                linked += len(raw.strip())
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m[2] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCK:
            continue
        flush()
        if m[2]:
            if open_.get(name):
                while stack[-1].tag != name:
                    close()
                close()
            in_link = 0
        else:
            if name in _LEAVES_P and stack and stack[-1].tag == "p":
                close()
            while stack and name in _CLOSES and stack[-1].tag in _CLOSES[name]:
                close()
            if name in _HEADINGS and stack and stack[-1].tag in _HEADINGS:
                close()
            if name not in VOID and not m[4].endswith("/"):
                words = [x for g in _NAMES.findall(m[4]) for y in g if y for x in re.split(r"[^a-z]+", y.lower()) if x]
                stack.append(Node(name, words, stack[-1] if stack else None, known))
                open_[name] = open_.get(name, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out


def featurize(seq: list[tuple[str, Node, int]]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for k, (text, node, linked) in enumerate(seq):
        f = ["bias", "tag=" + node.tag, *node.feats]
        words = text.count(" ") + 1
        f.append(f"words={min(words.bit_length(), 8)}")
        share = linked / len(text)
        f.append("links=" + ("none" if share < 0.05 else "some" if share < 0.5 else "most"))
        f.append("end=" + ("stop" if text[-1] in ".!?…" else "other"))
        f.append("commas" if "," in text else "nocommas")
        if "©" in text or "|" in text:
            f.append("sign")
        if k == 0:
            f.append("first")
        if k == len(seq) - 1:
            f.append("last")
        out.append(f)
    return out


class Field:
    """The trained field: labels 0 (other) and 1 (main text)."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move, self.known = names, emit, move, frozenset(names)
        self._rows = {n: (float(emit[i, 0]), float(emit[i, 1])) for n, i in names.items()}

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi)."""
        if not feats:
            return []
        (m00, m01), (m10, m11) = self.move.tolist()
        back, s0, s1 = [], 0.0, 0.0
        for k, f in enumerate(feats):
            e0 = e1 = 0.0
            for n in f:
                if r := self._rows.get(n):
                    e0 += r[0]
                    e1 += r[1]
            if k:
                a, b, c, d = s0 + m00, s1 + m10, s0 + m01, s1 + m11
                back.append((int(b > a), int(d > c)))
                s0, s1 = max(a, b), max(c, d)
            s0 += e0
            s1 += e1
        y = [int(s1 > s0)]
        for b in reversed(back):
            y.append(b[y[-1]])
        return y[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 120, rate: float = 0.3, l2: float = 0.5) -> Field:
    """Maximum likelihood with an L2 prior, by Adam on the exact gradient (forward-backward). pages: features and labels
    of each block sequence; a bounded training set, fitted on the driver."""
    names: dict[str, int] = {}
    for feats, _ in pages:
        for f in feats:
            for n in f:
                names.setdefault(n, len(names))
    longest = max(len(y) for _, y in pages)
    n_pages = len(pages)
    # dense tensors: pages x positions x features is small for a bounded training set
    x = np.zeros((n_pages, longest, len(names)), np.float32)
    y = np.full((n_pages, longest), -1)
    for p, (feats, labels) in enumerate(pages):
        y[p, : len(labels)] = labels
        for k, f in enumerate(feats):
            x[p, k, [names[n] for n in f]] = 1
    there = y >= 0
    gold = np.eye(2)[np.maximum(y, 0)] * there[..., None]
    w, t = np.zeros((len(names), 2)), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    pair_gold = np.einsum("pki,pkj->ij", gold[:, :-1], gold[:, 1:])
    for step in range(1, rounds + 1):
        e = x @ w.astype(np.float32)
        alpha, beta = np.zeros((n_pages, longest, 2)), np.zeros((n_pages, longest, 2))
        alpha[:, 0] = e[:, 0]
        for k in range(1, longest):
            a = np.logaddexp(alpha[:, k - 1, 0, None] + t[0], alpha[:, k - 1, 1, None] + t[1]) + e[:, k]
            alpha[:, k] = np.where(there[:, k, None], a, alpha[:, k - 1])
        for k in range(longest - 2, -1, -1):
            b = np.logaddexp(t[:, 0] + (e[:, k + 1, 0] + beta[:, k + 1, 0])[:, None], t[:, 1] + (e[:, k + 1, 1] + beta[:, k + 1, 1])[:, None])
            beta[:, k] = np.where(there[:, k + 1, None], b, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        prob = np.exp(alpha + beta - z[:, None, None]) * there[..., None]
        pair = np.exp(alpha[:, :-1, :, None] + t[None, None] + (e + beta)[:, 1:, None, :] - z[:, None, None, None]) * there[:, 1:, None, None]
        gw = np.einsum("pkf,pki->fi", x, gold - prob) - l2 * w
        gt = pair_gold - pair.sum((0, 1)) - l2 * t
        for i, (v, g) in enumerate(((w, gw), (t, gt))):
            m, s = moments[2 * i], moments[2 * i + 1]
            m *= 0.9
            m += 0.1 * g
            s *= 0.99
            s += 0.01 * g * g
            v += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return Field(names, w, t)


def main_text(page: str | None, field: Field) -> str:
    seq = blocks(page or "", field.known)
    return "\n\n".join(b[0] for b, y in zip(seq, field.decode(featurize(seq)), strict=True) if y)


def extract(pages: DataFrame, field: Field) -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty html, and pages without main text: an empty text. The
    field's size is bounded by its training set."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    def apply(batches):
        f = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(h, f) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(apply, "page_id long, url string, text string, n_chars long")
