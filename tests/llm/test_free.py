"""BPE, archives, vector dedup and packing against libraries, round trips and brute force."""

import hashlib
import io
import struct
import zipfile
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import bpe, embedding_dedup, packing, warc
from assaylake.llm.common import shared_folder, table

TEXTS = [None, "", " ", "Hello  World's don't 123 ñandú", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul ǅ ß", "á \x1c\x1d \x85　​﻿|", "<|endoftext|>x<|startoftext|> <|endoftext",
         "x" * 3000, "!!??** ## éàü 漢字かな 🎉🎉 ½ Ⅷ ①", "the " * 20_000, "it'LL I'M we'Re", "\n\t\r", "Hello  World's don't 123 ñandú"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


def frame(spark, texts):
    rows = [(i if i != 5 else None, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ids": F.lit("x"), "n_tokens": F.lit(-1), "uid": F.lit(2), "length": F.lit(3)})


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_equals_the_library(spark, library, sf_dir):
    texts = TEXTS + [r[0] for r in table(spark, sf_dir, "documents").select("text").collect()]
    got = bpe.token_digests(frame(spark, texts)).collect()
    want = []
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i if i != 5 else None, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    order = lambda r: (r[0] is None, r[0])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert bpe.token_digests(frame(spark, [])).count() == 0


def test_bpe_round_trip(spark, library):
    encoded = bpe.encode(frame(spark, TEXTS))
    got = {r["doc_id"]: r["text"] for r in bpe.decode(encoded).collect()}
    for i, t in enumerate(TEXTS):
        if i != 5:
            assert got[i] == library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_archives_round_trip(spark):
    long, short = "<p>" + "y" * 200, "tiny"
    rows = [(5, "u5", long), (3, "u3", long), (3, "u3", long), (None, None, long), (1, "a\nb", short), (2, None, short), (9, "u9", None), (8, "ü", "é" * 60), (7, "z", "q" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "first": F.lit(2)})
    manifest = warc.write_archives(pages, package_bytes=2000)
    assert manifest.count() > 1
    got = warc.read_archives(manifest).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h or "" for p, u, h in rows if p == r["page_id"])
        data = html.encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["payload"] == (data if r["record_type"] == "response" else None)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got if r["page_id"] in (3, 5, None))
    assert kinds == [("3", "response", None), ("3", "revisit", 3), ("5", "revisit", 3), ("None", "revisit", 3)]
    assert {r["page_id"]: r["url"] for r in got}[1] == "a%0Ab" and {r["page_id"]: r["url"] for r in got}[2] is None
    assert warc.read_archives(warc.write_archives(pages.where("false"))).count() == 0


class Held:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


def test_directory_reads_zip64():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/a", b"abc")
        with z.open("indexes/ü", "w", force_zip64=True) as m:
            m.write(b"12345")
    data = out.getvalue()
    got = warc.directory(Held(data), len(data))
    assert [(n, m, s) for n, m, _, s in got] == [("archive/a", 0, 3), ("indexes/ü", 0, 5)]
    for (name, _, local, size), want in zip(got, (b"abc", b"12345")):
        at = warc.member_start(Held(data), local)
        assert data[at:at + size] == want
    # the same directory behind a ZIP64 end record, with its sizes and offsets moved to the extra field
    name, body = b"archive/x", b"hello"
    local = warc.LOCAL + struct.pack("<HHHHHIIIHH", 45, 0, 0, 0, 0, zlib.crc32(body), warc.FULL32, warc.FULL32, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, 5, 5) + body
    extra = struct.pack("<HHQQQ", 1, 24, 5, 5, 0)
    central = warc.CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0, 0, 0, 0, zlib.crc32(body), warc.FULL32, warc.FULL32, len(name), len(extra), 0, 0, 0, 0, warc.FULL32) + name + extra
    end64 = warc.END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(central), len(local))
    locator = warc.LOCATOR64 + struct.pack("<IQI", 0, len(local) + len(central), 1)
    end = warc.END + struct.pack("<HHHHIIH", 0, 0, warc.FULL16, warc.FULL16, warc.FULL32, warc.FULL32, 0)
    data = local + central + end64 + locator + end
    assert warc.directory(Held(data), len(data)) == [("archive/x", 0, 0, 5)]
    at = warc.member_start(Held(data), 0)
    assert data[at:at + 5] == body
    with pytest.raises(ValueError):
        warc.directory(Held(b"nothing"), 7)


def test_compressed_members_are_refused(spark, tmp_path):
    path = f"{shared_folder(spark, 'zip')}.zip".removeprefix("file:")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("indexes/a", "x" * 100)
    with pytest.raises(ValueError):
        list(warc.record_ranges(path))


def brute_vectors(rows, threshold):
    good = [k for k, (v, e, l) in enumerate(rows) if l is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    links, parent = defaultdict(set), {k: k for k in range(len(rows))}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in good:
        for b in good:
            if a < b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.float32(rows[k][1]).astype(float) for k in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[a].add(b), links[b].add(a)
                    parent[top(a)] = top(b)
    least = defaultdict(lambda: None)
    for k, (v, _, _) in enumerate(rows):
        if v is not None and (least[top(k)] is None or v < least[top(k)]):
            least[top(k)] = v
    return sorted((str(v), len(links[k]), str(least[top(k)])) for k, (v, _, _) in enumerate(rows))


def test_vector_links_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centre = rng.standard_normal((6, 16))
    rows = [(i, (centre[i % 6] + rng.standard_normal(16) * 0.22 * (i % 5)).tolist(), i % 3) for i in range(240)]
    rows += [(1000 + i, (centre[0] + rng.standard_normal(16) * 0.01).tolist(), 0) for i in range(150)]  # a hot bucket of several blocks
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [None] + [1.0] * 15, 1), (903, [float("nan")] * 16, 1), (904, [float("inf")] * 16, 1), (905, rows[3][1], None),
             (3, rows[3][1], 0), (None, rows[3][1], 0), (906, [1.0, 2.0], 1), (907, [], 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"uid": F.lit(1), "codes": F.lit("c"), "n": F.lit(0)})
    got = embedding_dedup.near_duplicates(vectors, block=32).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in got) == brute_vectors(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in got)
    assert embedding_dedup.near_duplicates(vectors.where("false")).count() == 0


def check_packing(got, capacity):
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing_keeps_every_token(spark, library, sf_dir):
    texts = TEXTS + [r[0] for r in table(spark, sf_dir, "documents").select("text").collect()]
    got = packing.pack_documents(frame(spark, texts), shard_items=150).collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
    total = 0
    for i, t in enumerate(texts):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        total += len(ids)
        for k, r in enumerate(sorted(by_doc[i if i != 5 else None], key=lambda r: r["piece"])):
            part = ids[4096 * k:4096 * (k + 1)]
            assert (r["piece"], r["start"], r["length"], r["ids_crc32"]) == (k, 4096 * k, len(part), zlib.crc32(part.tobytes()))
    assert sum(r["length"] for r in got) == total
    n = check_packing(got, 4096)
    assert n <= -(-total // 4096) + 3
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_genetic_steps_keep_the_items():
    rng = np.random.default_rng(3)
    lengths = rng.integers(300, 1900, 400).tolist()
    one = packing.best_fit([], range(400), lengths, 4096)
    two = packing.best_fit([], sorted(range(400), key=lambda i: -lengths[i]), lengths, 4096)
    child = packing.mutated(packing.crossover(one, two, lengths, 4096, rng), lengths, 4096, rng)
    assert sorted(i for b in child for i in b) == list(range(400))
    best, done = packing.evolve(lengths, [one], 4096, rng)
    assert done >= 1 and len(best) <= len(one) and sorted(i for b in best for i in b) == list(range(400))
    assert all(sum(lengths[i] for i in b) <= 4096 for b in best)


def test_breeding_beats_its_random_parents(monkeypatch):
    rng, lengths = np.random.default_rng(4), np.random.default_rng(5).integers(200, 2400, 600).tolist()
    parents = [packing.best_fit([], rng.permutation(600).tolist(), lengths, 4096) for _ in range(6)]
    crossed, plain = [], packing.crossover
    monkeypatch.setattr(packing, "crossover", lambda *a: crossed.append(1) or plain(*a))
    best, done = packing.evolve(lengths, parents, 4096, rng)
    assert len(best) < min(map(len, parents)) and len(crossed) == 3 * done and sorted(i for b in best for i in b) == list(range(600))


def test_generations_are_reported_and_bins_are_few(spark):
    rng = np.random.default_rng(6)
    lengths = np.minimum(rng.lognormal(6.2, 1.1, 1200).astype(int) + 1, 4096).tolist()
    parts = spark.createDataFrame([(k, 0, 0, n, 7) for k, n in enumerate(lengths)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(parts, shard_items=400).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(1200))
    assert all(r["generations"] >= 2 for r in got if r["length"] < 4096)  # one an epoch at least
    shards = {r["sequence_id"] >> 33 for r in got if r["length"] < 4096}
    assert len({r["sequence_id"] for r in got}) <= -(-sum(lengths) // 4096) + 2 * len(shards)


def test_long_words_equal_the_library_in_linear_time(library, monkeypatch):
    import random
    import time
    rng = random.Random(2)
    words = ["".join(rng.choice(a) for _ in range(n)) for n in (1, 2, 3, 511, 512, 513, 2000) for a in ("ab", "etaoinshrdlu", "漢字仮名", "aé")]
    enc = bpe.Encoder(bpe.default_vocabulary())
    for w in words:
        want = library.encode(w, add_special_tokens=False).ids
        monkeypatch.setattr(bpe, "LONG_WORD", 10 ** 9)
        assert [enc.ids[p] for p in enc.parts(w)] == want
        monkeypatch.setattr(bpe, "LONG_WORD", 0)  # the heap for all
        assert [enc.ids[p] for p in enc.parts(w)] == want
    monkeypatch.undo()
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(100_000))
    start = time.process_time()
    assert enc.encode(long) == library.encode(long, add_special_tokens=False).ids and long not in enc.cache
    assert time.process_time() - start < 20


def test_a_hot_page_is_archived_in_several_tasks(spark):
    rows = [(k, "u", "<p>hot</p>" * 40 if k % 3 else f"page {k} " * 30) for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("x"), "first": F.lit(1)})
    got = warc.marked(pages).withColumn("task", F.spark_partition_id()).collect()
    hot = [r for r in got if r["page_id"] % 3]
    assert len(got) == 400 and len({r["task"] for r in hot}) > 1
    assert all(r["refers_to"] == (1 if r["page_id"] > 1 else None) for r in hot) and sum(r["is_revisit"] for r in got) == len(hot) - 1


def test_chunks_equal_the_library_on_odd_letters(library):
    import random
    rng = random.Random(1)
    letters = [chr(c) for c in range(256)] + list("Σςİıſß漢 <|endoftext|>'sAÀ×ŸĀµ") + [" "] * 40 + list("ABCabc.,;") * 6
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(3000)]
    texts += ["<|ENDOFTEXT|> A <|endoftext|> B", "don'T O'S l'É x\xa0y\x85z a\x1cb", "Ἄ é É", "ÀÉÎÕÜ ÿ Ÿ ß ẞ µ", "yİ; İ.", "Word, WORD. word", ""]
    chunks = packing.ChunkIds(bpe.default_vocabulary())
    for k in range(0, len(texts), 400):
        for t, ids in zip(texts[k:k + 400], chunks(texts[k:k + 400])):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids


def test_marks_behind_a_word_are_no_new_chunk(library, monkeypatch):
    """op8_genetic_packing: a word before stars, dollars or brackets went to the library anew with every mark, at three times the time."""
    marks = [m + n for m in packing.MARKS for n in ("", m + m, ".", "'")]
    texts = [f"{w}{m} {w}" for w in ("Word", "Été", "x", "漢字", "don't", "É\u0301", "a1") for m in marks] + ["x<| y", "x<|endoftext|>.", "x=\u0338 y", "x^'s"]
    chunks, sent = packing.ChunkIds(bpe.default_vocabulary()), []
    whole = chunks._chunks
    monkeypatch.setattr(chunks, "_chunks", lambda c: sent.extend(c) or whole(c))
    for t, ids in zip(texts, chunks(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    assert not any(c in (f"Word{m}", f"word{m}") for c in sent for m in packing.MARKS)


@pytest.mark.parametrize("hashes", ["good", "all alike"])
def test_different_chunks_are_told_apart_whatever_their_hash(monkeypatch, hashes):
    import random
    rng = random.Random(3)
    if hashes == "all alike":
        monkeypatch.setattr(packing, "combine", lambda a, b: np.zeros(len(a), np.uint64))
        monkeypatch.setattr(packing, "mix", lambda a: np.zeros(len(a), np.uint64))
    words = [b"a", b"a\x00", b"a\x00\x00", b"\xff" * 8, b"\xff" * 16, b"\xff" * 17, b"x" * 15, b"x" * 16, b"x" * 17, b"x" * 5000, b"ab" * 8 + b"c", b"\x00", b"\x01" + b"\x00" * 7]
    for count in (0, 1, 400):
        text = b"".join(rng.choice(words) + rng.choice([b" ", b"\t\n", b"\x0b  \x0c\r"]) for _ in range(count)) + b" " * (packing.SHORT + 1)
        starts, ends, group, firsts = packing.different_chunks(np.frombuffer(text, np.uint8))
        assert [text[a:b] for a, b in zip(starts, ends)] == text.split()
        assert [text[starts[k]:ends[k]] for k in firsts[group]] == text.split()
        if hashes == "good":
            assert len(firsts) == len(set(text.split()))


def test_ids_of_texts_side_by_side(library):
    texts = ["", " ", "a b", "\n", "漢 a", "a\x1cb c", "A B", "x" * 40 + " y " + "x" * 40, "<|endoftext|> a", "é\xa0É\x85a", "b" * 16, "  b", "\x00 a\x00"]
    for some in (texts, texts[::-1], [""], ["", ""], [], ["漢"]):
        chunks = packing.ChunkIds(bpe.default_vocabulary())
        for _ in range(2):
            assert [np.frombuffer(i, "<u4").tolist() for i in chunks(some)] == [library.encode(t, add_special_tokens=False).ids for t in some]
