"""Repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import suffix_dedup as S
from assaylake.llm.common import table


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:-1]
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((str(d), len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "copies": F.lit(9), "n": F.lit(0), "n_chars": F.length("text").cast("long")})


def made(seed):
    rng = np.random.default_rng(seed)
    word = lambda n: " ".join("".join(rng.choice(list("abcdé"), rng.integers(1, 6))) for _ in range(n))
    shared = [word(120 + 40 * k) for k in range(4)]
    rows = [(i, word(60) + shared[i % 4][:rng.integers(380, 700)] + word(40)) for i in range(60)]
    rows += [(100 + i, word(20) + shared[0] + word(int(rng.integers(1, 30)))) for i in range(40)]
    long = word(400)
    rows += [(200 + i, long[:500 * i] + "Z" + long[500 * i:]) for i in range(5)]
    rows += [(300, "To " * 400), (301, "x" + "To " * 300), (302, "Thhaen " * 100), (303, "q" * 900), (304, long + long), (305, None), (306, ""), (307, "abc")]
    rows += [(None, shared[1] * 2), (310, shared[2]), (311, shared[2]), (311, shared[2]), (312, "k" * 399), (313, "k" * 399), (314, word(30) + "é" * 400), (315, "é" * 300)]
    return rows


@pytest.mark.parametrize("hot", [4000, 8])
def test_repeated_spans_against_brute_force(spark, hot, monkeypatch):
    monkeypatch.setattr(S, "HOT_SEGMENTS", hot)
    rows = made(hot)
    got = sorted((str(r["doc_id"]), *r[1:]) for r in S.repeated_spans(frame(spark, rows)).collect())
    assert got == brute(rows, S.LENGTH)


def test_documents_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((str(r["doc_id"]), *r[1:]) for r in S.repeated_spans(docs).collect())
    assert got == brute(rows, S.LENGTH)


def test_cut_text_keeps_rows_and_columns(spark):
    rows = made(3)
    docs = frame(spark, rows)
    got = S.cut_text(docs)
    assert got.columns == docs.columns
    got = sorted((str(r["doc_id"]), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in got.collect())
    want = brute(rows, S.LENGTH)
    same = sum(g == (w[0], w[4]) for g, w in zip(got, sorted((w[0], *w[1:]) for w in want)))
    assert len(got) == len(rows) and same >= len(rows) - 25  # cuts inside a letter drop its other bytes
    assert S.repeated_spans(frame(spark, [])).count() == 0 and S.cut_text(frame(spark, [])).count() == 0


@pytest.mark.parametrize("text", [b"", b"a", b"ab", b"banana", b"mississippi", b"aaaaaaaaaaaaaaaaaaa", b"abcabcabcabcab"])
def test_suffix_ranks(text):
    names = np.frombuffer(text, np.uint8).astype(np.int64)
    ranks = S.suffix_ranks(names, 1, 10**9)
    want = sorted(range(len(text)), key=lambda i: text[i:])
    assert [int(i) for i in np.argsort(ranks)] == want


def test_suffix_ranks_of_random_names():
    rng = np.random.default_rng(5)
    for n, k in ((50, 2), (301, 3), (1000, 300), (500, 5_000_000)):
        names = rng.integers(1, k, n)
        want = sorted(range(n), key=lambda i: names[i:].tolist())
        assert np.argsort(S.suffix_ranks(names, 1, 10**9)).tolist() == want
