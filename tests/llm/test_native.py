"""Exact dedup, sharding and quotation linking against brute force, with the defined cases of their docstrings."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from assaylake.llm import chat, exact_dedup, sharding

ODD = [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50_000), (7, "x" * 50_000), (None, "abc"), (None, None)]


def frame(spark, rows, schema="doc_id long, text string"):
    # a clashing extra column must not matter
    return spark.createDataFrame(rows, schema).withColumns({"digest": F.lit("mine"), "uid": F.lit(1), "shard": F.lit(3), "size": F.lit(None)})


def test_exact_groups_against_brute_force(spark):
    rows = ODD + [(100 + i, "Hot") for i in range(300)]
    got = exact_dedup.exact_groups(frame(spark, rows), support=0.01).collect()
    lower = lambda t: (t or "").translate(str.maketrans(exact_dedup.UPPER, exact_dedup.LOWER))
    groups = defaultdict(list)
    for d, t in rows:
        groups[lower(t)].append(d)
    assert len(got) == len(rows)
    for r in got:
        same = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(same) and r["keep_id"] == max((d for d in same if d is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_keep_one_keeps_columns_and_one_row_each(spark):
    docs = frame(spark, ODD)
    kept = exact_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == sorted([(2, "aBC"), (4, ""), (5, "É"), (6, "é"), (7, "x" * 50_000)])


@pytest.mark.parametrize("n", [0, 1, 2, 97, 1000])
def test_permutation_is_a_bijection(spark, n):
    got = sharding.with_position(spark.range(n).withColumnRenamed("id", "row_number"), n).collect()
    assert sorted(r["position"] for r in got) == list(range(n))
    if n > 90:
        assert [r["position"] for r in got] != list(range(n))


def test_shards_differ_by_one_row_and_slots_have_no_gaps(spark):
    rows = ODD + [(5000, "same")] * 400
    docs = frame(spark, rows)
    got = sharding.shard_rows(docs, shards=7).collect()
    again = sharding.shard_rows(docs.repartition(5), shards=7).collect()
    key = lambda r: (str(r["doc_id"]), r["size"], r["text_crc32"], r["shard"], r["slot"])
    assert Counter(map(key, got)) == Counter(map(key, again))
    sizes = Counter(r["shard"] for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sum(sizes.values()) == len(rows)
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    want = Counter((str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want


MAIL = [
    (1, 0, "a", "Hello all,\nthe build is broken.\n\nPlease help."),
    (1, 1, "b", "> the build  is BROKEN.\nSince when?"),
    (1, 2, "c", "Other topic."),
    (1, 3, "a", ">> the build is broken.\n> Since when?\nSince noon."),
    (1, 4, "d", "> Other topic.\nYes."),
    (1, 5, "e", "> never written by anyone\nHm."),
    (1, None, "f", None),
    (1, 7, "g", "> Since noon.\n> Yes.\nBoth."),
    (2, 0, "a", "> Other topic.\nnot in this conversation"),
    (None, 0, "a", "Lone."), (None, 1, "b", "> lone.\nok"),
    (1, 5, "e", "> never written by anyone\nHm."),
]


def test_replies_follow_quotes(spark):
    got = chat.reply_ordered(frame(spark, MAIL, "conv_id long, turn long, role string, text string")).collect()
    assert len(got) == len(MAIL)
    reply = {(r["conv_id"], r["turn"]): (r["reply_to"], r["thread"], r["depth"]) for r in got}
    assert reply[1, 1] == (0, 0, 1) and reply[1, 2] == (None, 2, 0) and reply[1, 3] == (1, 0, 2)
    assert reply[1, 4] == (2, 2, 1) and reply[1, 5] == (None, 5, 0) and reply[2, 0] == (None, 0, 0)
    # "Since noon." is turn 3, "Yes." turn 4: the lines of one passage, the latest author counts
    assert reply[1, 7] == (4, 2, 2) and reply[None, 1] == (0, 0, 1)
    body = {(r["conv_id"], r["turn"]): (r["body"], r["n_quotes"], r["n_linked"]) for r in got}
    assert body[1, 3] == ("Since noon.", 2, 2) and body[1, None] == ("", 0, 0) and body[1, 5] == ("Hm.", 1, 0)
    order = [r["turn"] for r in sorted((r for r in got if r["conv_id"] == 1), key=lambda r: r["position"])]
    assert order == [None, 0, 1, 3, 2, 4, 7, 5, 5]
    for c in (1, 2, None):
        places = sorted(r["position"] for r in got if r["conv_id"] == c)
        assert places == list(range(len(places)))


def test_empty_tables(spark):
    assert exact_dedup.exact_groups(frame(spark, [])).count() == 0
    assert sharding.shard_rows(frame(spark, [])).count() == 0
    assert chat.reply_ordered(frame(spark, [], "conv_id long, turn long, role string, text string")).count() == 0
