"""Ranked lexical search with hashed max-sketches.

A document's sketch folds the impacts of all its terms into coordinatewise maxima: each term is hashed to PROBES coordinates, and a
coordinate holds the largest term frequency that met it. Within a document the impact grows with the term frequency alone, so
that maximum is also the one of the impacts, and a sketch can be made before the sizes of the corpus are known. The smallest of
a query term's coordinates is an upper bound of its impact; the weighted sum over a query's terms bounds its score from above.

1. One pass over the documents writes the index: length, sketch and text of each document, and the document counts of the terms.
2. One pass over the sketches looks all terms of a block of queries up at once; the documents with the highest bounds of each query
   are scored exactly, which gives every query a score that its last place reaches at least.
3. A second pass scores exactly the documents whose bound reaches that threshold for some query; all others are proven to lie below. As the
   text lies beside the sketch, no text is shuffled. A task returns at most `top` rows a query.

Defined cases: a null text has no term; a query without terms, or of terms that no document holds, gets no rows; each row of the queries is a
query of its own, also with a repeated or null id; each row of the documents is a document, and of equal scores the smaller id
comes first, a null id last; empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import slices, stored, text_of

TOP = 10
#: Coordinates per different term (before rounding up to a power of two) and coordinates a term is folded into. On 10,000 documents and 200
#: queries the bounds leave 0.2 % of the pairs, where 0.1 % are in the result; with 4 and 2 they leave 20 %.
ROOM, PROBES = 16, 3
#: Distinct (query, term) entries looked up in one pass; what a task holds of the queries is bounded by it.
BLOCK_TERMS = 200_000
#: A frequency of this or more is stored as this and bounds nothing.
MOST = 255
#: No impact exceeds this, whatever the frequency.
LIMIT = 1_000_000
_SPACES = bytes(c if c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c > 127 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Maximal runs of digits, ASCII letters and characters beyond ASCII; only A-Z lower-cased."""
    return text.translate(_SPACES).split()


def _coordinates(crc: np.ndarray, size: int) -> list[np.ndarray]:
    mixed = crc * np.uint64(0x9E3779B97F4A7C15)
    return [((mixed >> np.uint64(20 * p)) & np.uint64(size - 1)).astype(np.int64) for p in range(PROBES)]


def _crc(words) -> np.ndarray:
    return np.array([zlib.crc32(w) + 1 for w in words], np.uint64)


def sketch(counts: Counter) -> np.ndarray:
    """Coordinatewise maxima of the frequencies of a document's terms."""
    size = 1 << max(3, (ROOM * len(counts) - 1).bit_length())
    tf = np.minimum(np.fromiter(counts.values(), np.int64, len(counts)), MOST).astype(np.uint8)
    out, crc = np.zeros(size, np.uint8), _crc(counts)
    order = np.argsort(tf, kind="stable")  # where coordinates repeat the last assignment, the largest, stays
    at = np.concatenate([c[order] for c in _coordinates(crc, size)])
    ordered = np.tile(tf[order], PROBES)
    last = np.argsort(ordered, kind="stable")
    out[at[last]] = ordered[last]
    return out


def build_index(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sketch, data) per document with a term, and (term, df)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "data"):
            n, cells, kept, df = [], [], [], Counter()
            for k, data in enumerate(batch.column("data").to_pylist()):
                words = terms(data)
                if words:
                    counts = Counter(words)
                    df.update(counts.keys())
                    n.append(len(words))
                    cells.append(sketch(counts).tobytes())
                    kept.append(k)
            if not kept:
                continue
            # the first row of a slice carries the document counts of its terms
            words = pa.array([list(df)] + [None] * (len(kept) - 1), pa.list_(pa.string()))
            times = pa.array([list(df.values())] + [None] * (len(kept) - 1), pa.list_(pa.int64()))
            rows = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n, pa.int64()), pa.array(cells, pa.binary()), rows.column("data"), words, times],
                                             names=["doc_id", "n", "sketch", "data", "terms", "times"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_of(text).cast("binary").alias("data"))
    index = stored(rows.mapInArrow(run, "doc_id long, n long, sketch binary, data binary, terms array<string>, times array<long>"), "lexical-index")
    pairs = index.where("terms IS NOT NULL").select(F.explode(F.arrays_zip("terms", "times")).alias("e"))
    df = pairs.groupBy(F.col("e.terms").alias("term")).agg(F.sum("e.times").alias("df"))
    return index.select("doc_id", "n", "sketch", "data"), df


def _query_terms(queries: DataFrame, text: str, item_id: str) -> DataFrame:
    """(query, item_id, term), each term once a query; `query` numbers the rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sorted(set(terms(d))) for d in batch.column("data").to_pylist()]
            at = np.repeat(np.arange(batch.num_rows), [len(e) for e in each])
            yield pa.RecordBatch.from_arrays(
                [batch.column("query").take(pa.array(at)), batch.column("item_id").take(pa.array(at)), pa.array([w.decode() for e in each for w in e], pa.string())],
                names=["query", "item_id", "term"])

    rows = queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_id).cast("long").alias("item_id"), text_of(text).cast("binary").alias("data"))
    return rows.mapInArrow(run, "query long, item_id long, term string")


class Block:
    """The terms of a block of queries, laid out for one lookup a document."""

    def __init__(self, rows, n_docs: int, n_terms: int):
        rows = sorted((r["query"], r["term"].encode(), r["w"]) for r in rows)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.queries = sorted({r[0] for r in rows})
        words = sorted({r[1] for r in rows})
        self.place = {w: k for k, w in enumerate(words)}
        self.crc = _crc(words)
        place = {q: k for k, q in enumerate(self.queries)}
        self.start = np.searchsorted(np.array([place[r[0]] for r in rows]), np.arange(len(self.queries)))
        self.term = np.array([self.place[r[1]] for r in rows], np.int64)
        self.weight = np.array([r[2] for r in rows], np.int64)

    def _impacts(self, tf: np.ndarray, n: int) -> np.ndarray:
        tf = tf.astype(np.int64)
        return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * self.n_docs) // self.n_terms))

    def _sums(self, impact: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.weight * impact[self.term], self.start)

    def bounds(self, cell: bytes, n: int) -> np.ndarray:
        """Of one document the upper bound of each query's score."""
        folded = np.frombuffer(cell, np.uint8)
        most = np.minimum.reduce([folded[c] for c in _coordinates(self.crc, len(folded))])
        table = self._impacts(np.arange(MOST + 1), n)
        table[MOST] = LIMIT
        return self._sums(table[most])

    def scores(self, data: bytes) -> np.ndarray:
        """Exact scores of one text."""
        words, impact = terms(data), np.zeros(len(self.crc), np.int64)
        if words:
            hits = [(k, c) for w, c in Counter(words).items() if (k := self.place.get(w)) is not None]
            if hits:
                at, tf = np.array(hits, np.int64).T
                impact[at] = self._impacts(tf, len(words))
        return self._sums(impact)


class Best:
    """The `top` highest entries of each query, by value, then smaller id; rows come in chunks."""

    def __init__(self, queries: int, top: int):
        self.top, self.values, self.ids = top, np.zeros((0, queries), np.int64), np.zeros((0, queries), np.int64)

    def add(self, values: list[np.ndarray], ids: list[int]) -> None:
        if not values:
            return
        values = np.concatenate((self.values, np.stack(values)))
        ids = np.concatenate((self.ids, np.repeat(np.array(ids, np.int64)[:, None], values.shape[1], 1)))
        order = np.lexsort((ids, -values), axis=0)[:self.top]
        self.values, self.ids = np.take_along_axis(values, order, 0), np.take_along_axis(ids, order, 0)

    def batch(self, queries: list[int]) -> pa.RecordBatch:
        at = np.nonzero(self.values > 0)
        ids = self.ids[at]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(queries, np.int64)[at[1]]), pa.array(ids, mask=ids == _NO_ID), pa.array(self.values[at])], names=["query", "doc_id", "score"])


_NO_ID = np.iinfo(np.int64).max  # stands for a null id, which comes last


def _ids(array: pa.Array) -> list[int]:
    return [_NO_ID if x is None else x for x in array.to_pylist()]


_FOUND = "query long, doc_id long, score long"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "sketch"):
        for k in range(0, batch.num_rows, 512):
            yield batch.slice(k, 512)


def _highest_bounds(index: DataFrame, block, top: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.queries), top)
        for part in _chunks(batches):
            best.add([block.bounds(c, n) for c, n in zip(part.column("sketch").to_pylist(), part.column("n").to_pylist())], _ids(part.column("doc_id")))
        yield best.batch(block.queries)

    return index.select("doc_id", "n", "sketch").mapInArrow(run, _FOUND)


def _scored(index: DataFrame, block, top: int, least: np.ndarray | None = None, last: np.ndarray | None = None) -> DataFrame:
    """The highest exact scores of each query, at most `top` a query and task. With thresholds only documents whose bound reaches
    that of some query are scored; an equal bound counts up to the id that holds the threshold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.queries), top)
        for part in _chunks(batches):
            ids, texts, scores, of = _ids(part.column("doc_id")), part.column("data"), [], []
            for k, (c, n) in enumerate(zip(part.column("sketch").to_pylist(), part.column("n").to_pylist())):
                if least is not None:
                    bound = block.bounds(c, n)
                    if not ((bound > least) | ((bound == least) & (bound > 0) & (ids[k] <= last))).any():
                        continue
                scores.append(block.scores(texts[k].as_py()))
                of.append(ids[k])
            best.add(scores, of)
        yield best.batch(block.queries)

    return index.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _search_block(index: DataFrame, block: Block, top: int) -> DataFrame:
    # at most `top` ids a query of the block
    first = stored(_ranked(_highest_bounds(index, block, top), top).select(F.col("doc_id").alias("found")).distinct(), "lexical-first")
    chosen = index.join(F.broadcast(first), F.col("doc_id").eqNullSafe(F.col("found")), "left_semi")
    seen = _ranked(_scored(chosen, block, top), top).where(F.col("rank") == top).collect()  # one row a query of the block
    place = {q: k for k, q in enumerate(block.queries)}
    least, last = np.zeros(len(place), np.int64), np.full(len(place), _NO_ID)
    for r in seen:
        least[place[r["query"]]] = r["score"]
        last[place[r["query"]]] = _NO_ID if r["doc_id"] is None else r["doc_id"]
    return _ranked(_scored(index, block, top, least, last), top)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, text: str = "text", doc_id: str = "doc_id",
           query_text: str = "text", item_id: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` highest-scoring documents of every query, scores above 0 only."""
    index, df = build_index(docs, text, doc_id)
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    asked = stored(_query_terms(queries, query_text, item_id), "lexical-queries")
    odds = (F.lit(2.0) * F.lit(size["n"]) + 2.0) / (F.lit(2.0) * F.col("df") + 1.0)
    # terms that no document holds add nothing
    weighted = asked.join(df, "term").withColumn("w", F.floor(F.lit(1000.0) * F.log(odds)).cast("long"))
    weighted = stored(weighted, "lexical-weights")
    blocks = max(1, -(-weighted.count() // BLOCK_TERMS))
    out = None
    for k in range(blocks):  # by far most query sets are one block
        part = weighted.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == k).select("query", "term", "w").collect()
        if part:
            found = stored(_search_block(index, Block(part, size["n"], size["l"]), top), "lexical-found")
            out = found if out is None else out.unionByName(found)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    names = asked.select("query", "item_id").distinct()
    return out.join(names, "query").select("item_id", "rank", "doc_id", "score")
