"""Alignment of two tokenizers against a plain retelling of the contract."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from panelfx.llm import align, queries

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "hello world", "a ", "  a  b ", "<s> x", "<0x41> <unk>", "é日本\x00 x", "a▁b", "fi ﬁ ½", "<|endoftext|> y",
    "\n\nx\r\n\ty", "a\n b \n", "ªº² 日本語　x\x85", "hello world", "word " * 30_000,
]


@pytest.fixture(scope="module")
def tools():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {chr(b): b for b in [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]}
    letters |= {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in letters)}
    return tok, sp, letters


def told(tools, texts):
    tok, sp, letters = tools
    docs = []
    for t in texts:
        whole = (" " + (t or "")).encode()
        ids = [tok.encode(" " + t, add_special_tokens=False).ids, sp.encode(t)] if t else [[], []]
        raw = [
            [bytes(letters[c] for c in tok.id_to_token(i)) for i in ids[0]],
            [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i in ids[1] for p in [sp.id_to_piece(i)]],
        ]
        if any(b"".join(r) != whole for r in raw):
            ids, raw = [[], []], [[], []]
        ends = [np.cumsum([len(x) for x in r]).tolist() for r in raw]
        groups, links = [], []
        at = [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = [ends[k].index(cut, at[k]) + 1 for k in (0, 1)]
            part = [ids[k][at[k] : upto[k]] for k in (0, 1)]
            at = upto
            groups.append("|".join(",".join(map(str, p)) for p in part))
            links.append((part[0][-1], part[1][-1]))
        docs.append((len(ids[0]), len(ids[1]), groups, links))
    counts = Counter(x for d in docs for x in d[3])
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [
        (a, b, len(g), len(x), sum(counts[p] == top[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for a, b, g, x in docs
    ]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_query_by_brute_force(spark, tools):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op13_token_alignment(spark, SF).collect()
    want = told(tools, [r.text for r in rows])
    assert sorted((r.doc_id, *(r[c] for c in COLUMNS)) for r in found) == sorted((r.doc_id, *w) for r, w in zip(rows, want))


def test_odd_texts(spark, tools):
    short = [t for t in ODD if len(t or "") < 1000]
    df = spark.createDataFrame([(i if i != 3 else None, t, 1, "x") for i, t in enumerate(short)], "doc_id long, text string, n_a int, gap string")
    got = sorted(((-1 if r.doc_id is None else r.doc_id), *(r[c] for c in COLUMNS)) for r in align.align(df, A, B).collect())
    assert got == sorted((-1 if i == 3 else i, *w) for i, w in enumerate(told(tools, short)))
    assert align.align(df.limit(0), A, B).count() == 0


def test_long_text_and_lanes(tools, monkeypatch):
    a, b = align.encoders(A, B)
    sizes = [np.array([len(t) for t in e.bytes]) for e in (a, b)]
    texts = [t.encode() for t in ODD if t]
    whole = align.Aligned(texts, a, b, *sizes)
    for width in (1, 3, 100_000):
        x = align.lanes(whole.a_end, whole.a_first, whole.b_end, whole.b_first, width)
        got = align.lockstep(whole.a_end, whole.b_end, *x)
        assert np.array_equal(got[0], whole.link_a) and np.array_equal(got[1], whole.link_b)
    same = np.isin(whole.a_end, whole.b_end)
    assert np.array_equal(np.flatnonzero(same), whole.link_a)


def test_groups_kept(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None)], "doc_id long, text string")
    r = align.align(df, A, B, keep_groups=True).orderBy("doc_id").collect()
    assert r[0].groups.count(";") + 1 == r[0].n_groups and r[0].groups.count("|") == r[0].n_groups and r[1].groups == ""


def test_possible_pairs():
    a, b = [b"ab", b"b", b"xab", b""], [b"ab", b"b", b"c", b"b"]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x))}
    assert {(int(p) >> 32, int(p) & 0xFFFFFFFF) for p in align.possible_pairs(a, b)} == want


def test_special_strings_are_plain(tools):
    a, _ = align.encoders(A, B)
    ids = np.frombuffer(a(" x <|endoftext|> y"), "<u4").tolist()
    assert ids == tools[0].encode(" x <|endoftext|> y", add_special_tokens=False).ids and 50256 not in ids


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello world")], "doc_id long, text string").withColumns({c: F.lit(1) for c in COLUMNS})
    assert align.align(df, A, B).columns == ["doc_id", *COLUMNS]
