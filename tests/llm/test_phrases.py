"""Substring dedup against brute force."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from panelfx.llm import phrases, queries

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def told(texts, window):
    """(words, removed, kept words) of each text."""
    split = [(t or "").encode().split() for t in texts]
    times = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if times[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_by_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    found = queries.op11_substring_dedup(spark, SF).collect()
    want = sorted((r.doc_id, n, g, sha(k)) for r, (n, g, k) in zip(rows, told([r.text for r in rows], 35)))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in found) == want
    assert sum(w[2] for w in want) > 0


def test_query_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(queries.ORACLES["op11_substring_dedup"]).fetchall()
    found = queries.op11_substring_dedup(spark, SF).collect()
    assert sorted(tuple(r) for r in found) == sorted(want)


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_repeats(spark, monkeypatch, seed):
    """Few different words, periodic texts, passages in each other, anchors in very many pieces, small buckets."""
    monkeypatch.setattr(phrases, "ANCHOR", 3)
    monkeypatch.setattr(phrases, "PIECE", 4)
    monkeypatch.setattr(phrases, "CROWDED", 3)
    monkeypatch.setattr(phrases, "BUCKET_BYTES", 900)
    draw = random.Random(seed)
    texts = [" ".join(draw.choice("abc") for _ in range(draw.randint(0, 40))) for _ in range(60)]
    passage = [draw.choice(["xa", "xb", "xc", "xd"]) for _ in range(30)]
    for _ in range(60):
        a, n = draw.randint(0, 20), draw.randint(3, 20)
        texts.append(" ".join([str(draw.random()), *passage[a : a + n], str(draw.random())]))
    texts += ["z " * 50, "p q " * 20, texts[3], texts[70], texts[70], None, "", " \n", "one two"]
    for window in (7, 9):
        want = sorted((i, *w) for i, w in enumerate(told(texts, window)))
        df = spark.createDataFrame(list(enumerate(texts)), DOC).repartition(5)
        got = phrases.remove_repeats(df, window, with_kept=True).collect()
        assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got) == want
        assert all(r.kept_sha256 == sha(r.kept) for r in got)


def test_odd_rows(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    long = " ".join(f"v{i}" for i in range(60_000))
    rows = [
        (1, passage), (1, passage), (None, f"a {passage} b"), (2, None), (3, ""), (3, ""), (4, "\t \n"), (5, long), (6, "é\x85x " * 40), (7, "A " + passage.upper()),
        (8, long[:4000] + " tail"), (9, " ".join(f"w{i}" for i in range(34))),
    ]
    df = spark.createDataFrame(rows, DOC).withColumns({c: F.lit(1) for c in ("t", "u", "piece", "bucket", "n_words", "kept")})
    want = [(d, n, g, sha(k)) for (d, _), (n, g, k) in zip(rows, told([t for _, t in rows], 35))]
    got = phrases.remove_repeats(df)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert phrases.remove_repeats(df.limit(0)).count() == 0


def test_least_in_window():
    g = np.random.default_rng(1).integers(0, 9, 400).astype(np.uint64)
    for width in (1, 2, 5, 24):
        want = [i + int(np.argmin(g[i : i + width])) for i in range(len(g) - width + 1)]
        assert phrases.least_in_window(g, width).tolist() == want


def test_bloom(spark):
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 4000)
    df = spark.createDataFrame([(int(k),) for k in keys], "k long")
    x = phrases.bloom(df, 4000)
    assert x.has(keys.view(np.uint64)).all()
    others = np.random.default_rng(3).integers(-(2**62), 2**62, 20_000)
    assert x.has(others.view(np.uint64)).mean() < 0.05
    assert not phrases.bloom(df.limit(0), 0).has(keys.view(np.uint64)).any()


def test_automaton_needs_little_beside_itself():
    """op11_substring_dedup took more than 3,000 MB of an executor: what is built on the way was 68 times the passages."""
    import tracemalloc

    rng = np.random.default_rng(8)
    passages = [" ".join(f"w{k}" for k in rng.integers(0, 20_000, 290).tolist()).encode() for _ in range(600)]
    phrases.Automaton(passages[:5], 35)
    tracemalloc.start()
    tree = phrases.Automaton(passages, 35)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(map(len, passages))
    words = b"x y".split() + passages[599].split()[100:160] + b"z".split()
    assert tree.covered(words).tolist() == [False] * 2 + [True] * 60 + [False]
