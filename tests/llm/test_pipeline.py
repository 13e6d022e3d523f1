"""The pipeline's stage of repeated passages, and all stages, against plain rules."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as P


def cut(texts, length):
    """Each text without the bytes of strings of `length` bytes that start more than once; a torn letter goes."""
    texts = [(t or "").encode() for t in texts]
    seen, out = Counter(t[i:i + length] for t in texts for i in range(len(t) - length + 1)), []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        out.append(bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore"))
    return out


def test_passages_of_fifty_words_go_and_other_text_stays(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randrange(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    passages = [say(rng.randrange(51, 60)) for _ in range(12)]
    rows = [[say(rng.randrange(1, 200)), "en"] for _ in range(150)]
    clean = [r[0] for r in rows[60:]]
    for k in range(60):  # a third of the rows hold the first passage, the others come twice or more
        rows[k][0] += " " + passages[0 if k < 36 else 1 + k % 11] + " " + say(rng.randrange(1, 30))
    rows += [[None, "en"], ["", None], ["short", "en"], ["x" * 199, "en"], ["x" * 199, "en"]]
    docs = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.repeats(spark, docs, None)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert [got[k] or "" for k in range(len(rows))] == cut([t for t, _ in rows], P.PASSAGE_BYTES)
    assert not any(p in (t or "") for p in passages for t in got.values())
    assert [got[k] for k in range(60, 150)] == clean
    assert all(r["n_chars"] == len(r["text"] or "") for r in out.where(F.col("doc_id") < 60).collect())
