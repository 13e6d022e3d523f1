"""Lexical search, page extraction and collocations against brute force, with the defined cases of their docstrings."""

import math
import random
import re
from collections import Counter
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaylake.llm import collocations, extraction, lexical
from assaylake.llm.common import table

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(rng, n, many=40):
    return " ".join(f"w{min(int(rng.expovariate(0.15)), many)}" for _ in range(n))


# ---- search -----------------------------------------------------------------------------------------------------

def ranked(docs, items, top=10):
    counts = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    size, total = sum(1 for _, c in counts if c), sum(sum(c.values()) for _, c in counts)
    df = Counter(w for _, c in counts for w in c)
    out = []
    for item, text in items:
        asked, scores = set(TERM.findall((text or "").translate(LOWER))), []
        for d, c in counts:
            n = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * (10 + 90 * n * size // total))) for w in asked if w in c)
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, k + 1, None if none else d, -s) for k, (s, none, d) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=str)


def frames(spark, docs, items):
    # clashing extra columns must not matter
    return (spark.createDataFrame(docs, "doc_id long, text string").withColumns({"n": F.lit("x"), "sketch": F.lit(1), "query": F.lit(2), "found": F.lit(3)}),
            spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "rank": F.lit(1), "query": F.lit("q")}))


def made_docs():
    rng = random.Random(3)
    docs = [(i, words(rng, rng.randrange(1, 200))) for i in range(150)]
    docs += [(1000 + i, "Same TEXT w1 w2 É") for i in range(80)]  # a third alike: ties
    docs += [(5, "w3 " * 100_000), (6, None), (7, ""), (8, "...!"), (None, "w1 w39 Ünique"), (None, "w1 w39 Ünique"), (9, docs[9][1]), (2000, "a" * 200_000), (2001, "ab" + "\x00" + "É")]
    items = [(1, "w1 w2 w3 w1"), (2, "w39, W38; w37 ünique"), (2, "Ünique same text"), (None, "É text"), (4, None), (5, ""), (6, "nowhere"), (7, words(rng, 300)), (8, "a" * 200_000)]
    return docs, items


@pytest.mark.parametrize("room, block", [(lexical.ROOM, lexical.BLOCK_TERMS), (1, 20)])
def test_search_against_brute_force(spark, room, block, monkeypatch):
    monkeypatch.setattr(lexical, "ROOM", room)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)  # several blocks of queries
    docs, items = made_docs()
    got = lexical.search(*frames(spark, docs, items))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == ranked(docs, items)


def test_search_of_all_documents(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, lexical.search(docs, items).collect()), key=str) == want


def test_search_of_empty_tables(spark):
    docs, items = frames(spark, [], [])
    some, asked = frames(spark, [(1, "a")], [(1, "a"), (2, None)])
    assert lexical.search(docs, asked).count() == lexical.search(some, items).count() == lexical.search(docs, items).count() == 0
    assert lexical.search(some, asked).collect()[0]["doc_id"] == 1


def test_bounds_are_never_below_scores():
    rng = random.Random(1)
    texts = [words(rng, n).encode() for n in (1, 5, 50, 3000)] + [b"w1 " * 1000]
    rows = [{"query": q, "term": f"w{rng.randrange(45)}", "w": rng.randrange(9000)} for q in range(6) for _ in range(20)]
    block = lexical.Block(rows, 100, 5000)
    for t in texts:
        counts = Counter(lexical.terms(t))
        assert (block.bounds(lexical.sketch(counts).tobytes(), sum(counts.values())) >= block.scores(t)).all()


# ---- pages ------------------------------------------------------------------------------------------------------

def texts_of(spark, rows, **more):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("mine"), "host": F.lit("x"), "blocks": F.lit(1), "uid": F.lit("u"), "key": F.lit(0)})
    got = extraction.main_text(pages, **more)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    return sorted(map(tuple, got.collect()), key=str)


def one(spark, html):
    ((_, _, text, n),) = texts_of(spark, [(1, "http://a.example/x", html)])
    assert n == len(text)
    return text


ONE_PAGE = [
    (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("<article><h1>T &amp; U</h1><p><b>x<br><p>y</article><p>z", "T & U\n\nx\n\ny"),
    ("<p>1 < 2 &am &xyz; &eacute; &#65;&#x42; a&ampb</p>", "1 < 2 &am &xyz; é AB a&b"), ("<p>a<!-- <p>no --> b<!----> c", "a b c"), ("<div>a<div>b</div>c</div>", "a\n\nb\n\nc"),
    ("<script>var t='</p>';</script><p>x</p><style>p{}</style><noscript><p>n</p></noscript>", "x"), ("<header>H</header><main><header><h1>T</h1></header><p>x</p></main><footer>F</footer>", "T\n\nx"),
    ("<div class='ad'>buy</div><p>x</p><div id=comments><article><p>me</p></article></div>", "x"), ("<div class=\"has-sidebar\"><p>x</p></div><aside>s</aside>", "x"),
    ("<article><p>x</p><div class='share social'>s</div><form><p>q</p></form><section class=\"reader comments\"><p>c</p></section></article>", "x"),
    ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", "a\n\nb\n\nc\n\nd\n\ne"), ("<p>a</b></i>b</p></body></html><p>c", "ab\n\nc"), ("<title>T</title><p title='a>b'>x</p>", "x"),
    ("<p>cut <a href='", "cut"), ("<p>a b\tc</p>", "a b c"), ("<select><option>o</select><p hidden>h</p><p>x</p>", "x"), ("<html><head><meta charset=u><p>x", "x"), ("<script>never closed <p>x", "")]


def test_single_pages(spark):
    got = texts_of(spark, [(k, f"http://{k}.example/", html) for k, (html, _) in enumerate(ONE_PAGE)])
    assert {k: t for k, _, t, _ in got} == {k: want for k, (_, want) in enumerate(ONE_PAGE)} and all(n == len(t) for _, _, t, n in got)


def test_long_and_deep_pages(spark):
    assert one(spark, "<article>" + "<p>word" * 50_000 + "</article>") == "\n\n".join(["word"] * 50_000)
    assert one(spark, "<div>" * 30_000 + "x" + "<p>y" * 2000) == "\n\n".join(["x"] + ["y"] * 2000) and one(spark, "<a <b \"" * 30_000) == ""
    assert one(spark, "<p>" + "y" * 3_000_000) == "y" * 3_000_000


def test_subtrees_that_recur_on_a_host_go(spark):
    page = lambda k: f"<div><div class=top><a href=/>Home</a> News {'daily'}</div><div><h2>Title {k}</h2><p>Body {k}</p><p>Read our terms.</p></div><div>Imprint</div></div>"
    rows = [(k, f"https://Me@a.example:80/{k}", page(k)) for k in range(6)] + [(10, "https://b.example/", page(0)), (11, None, page(1)), (None, "not an address", page(2)), (12, "https://c.example", page(3))]
    rows += [(20 + k, "https://copies.example/", page(9)) for k in range(12)]  # copies of one page are no template
    got = {r[0]: r[2] for r in texts_of(spark, rows)}
    whole = lambda k: f"Home News daily\n\nTitle {k}\n\nBody {k}\n\nRead our terms.\n\nImprint"
    assert all(got[k] == f"Title {k}\n\nBody {k}" for k in range(6))
    assert got[10] == whole(0) and got[11] == whole(1) and got[None] == whole(2) and all(got[20 + k] == whole(9) for k in range(12))


def test_article_text_stays_though_it_recurs(spark):
    rows = [(k, "http://a.example/", f"<nav>{k}</nav><article><h1>Same</h1><p>Passage on every page.</p><div><a href=1>More</a> <a href=2>Next</a></div><p>Own {k}</p></article>") for k in range(40)]
    got = texts_of(spark, rows)
    assert all(t == f"Same\n\nPassage on every page.\n\nOwn {k}" for k, _, t, _ in got)
    assert texts_of(spark, rows[:3])[0][2] == "Same\n\nPassage on every page.\n\nMore Next\n\nOwn 0"  # too few pages to tell
    few = texts_of(spark, [(k, "http://a.example/", f"<p>{k}</p>" + "<div>t</div>" * (k < 4)) for k in range(50)], min_share=10)
    assert few[0][2] == "0\n\nt"  # on too small a share of the host


def test_pages_of_the_table(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    got = {r["page_id"]: r["text"] for r in extraction.main_text(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)
    assert extraction.main_text(pages.where("false")).count() == 0


# ---- collocations -----------------------------------------------------------------------------------------------

def mined(rows, least, longest, top, share):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    gone = set()
    for (lang, w), a in often.items():
        parts = {w[i:j] for i in range(len(w)) for j in range(i + 2, len(w) + 1)} - {w}
        gone |= {(lang, p) for p in parts if 100 * a >= share * f[lang, p]}
    out = []
    for (lang, w), a in often.items():
        if (lang, w) not in gone:
            score, k = min((10 ** 6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.append((lang, -score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    out.sort()
    rank, final = Counter(), []
    for lang, score, a, phrase, left, right in out:
        rank[lang] += 1
        if rank[lang] <= top:
            final.append((lang, rank[lang], phrase.decode(), -a, left, right, n[lang], -score))
    return final


def made_texts():
    rng = random.Random(8)
    rows = [(f"{words(rng, 30, 25)}. {words(rng, 12, 25)}; New York City, new york\tcity  {words(rng, 4)}\r\nto be OR not to be", rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    rows += [("hot pair in a third of all rows", "en")] * 90  # repeated rows
    rows += [(None, "en"), ("", None), (" \t ", "en"), (".,;:!?", "fr"), ("x", "x\ty\n"), ("É é \x00 \x1f a b. " * 30, "x\ty\n"), ("ab " * 60_000, "long"), ("y" * 300_000, "long")]
    return rows


@pytest.mark.parametrize("least, longest, top, share, shard, step", [(10, 3, 2000, 50, 400_000, 4 << 20), (3, 5, 40, 80, 50, 300), (1, 2, 5, 0, 7, 1)])
def test_collocations_against_brute_force(spark, least, longest, top, share, shard, step, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD_ROWS", shard)  # many shards
    monkeypatch.setattr(collocations, "SLICE_BYTES", step)  # and slices
    rows = made_texts() if step > 1 else made_texts()[120:180]
    docs = spark.createDataFrame(rows, "text string, lang string").withColumns({"slice": F.lit("x"), "phrase": F.lit(1), "n": F.lit(2), "words": F.lit(3)})
    got = sorted(map(tuple, collocations.collocations(docs, least, longest, top, share).collect()))
    assert got == sorted(mined(rows, least, longest, top, share))


def test_collocations_of_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    want = mined([(r["text"], r["lang"]) for r in docs.collect()], 10, 3, 2000, 50)
    assert sorted(map(tuple, collocations.collocations(docs).collect())) == sorted(want)
    assert collocations.collocations(docs.where("false")).count() == 0
    assert collocations.collocations(docs.withColumn("text", F.lit("a, b"))).count() == 0


def test_scores_beyond_64_bits(spark):
    a, left, right = 9 * 10 ** 11, 10 ** 12 - 1, 10 ** 12 - 7
    assert 10 ** 6 * a * a > np.iinfo(np.int64).max < left * right
    got = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(collocations.score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 10 ** 6 * a * a // (left * right)
