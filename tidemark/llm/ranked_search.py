"""Ranked lexical search by Fagin's threshold algorithm over blocks of documents.

Two passes read the corpus, and nothing of it is shuffled but a few winners:
1. statistics: documents with a term, all terms, and the document frequency of each of the queries' terms, added up by task;
2. search: each task cuts its documents into blocks of bounded bytes and indexes each. A block has one list a query term, sorted by impact (the
   term's share of a score), and a forward index of the impacts by document. For each query the threshold algorithm takes the
   next entries of its lists in turn, `STEP` of each list a round, looks every document it has not met up in the forward index for
   its whole score, and stops when the threshold (the sum of the impacts last seen) falls strictly below the k-th score: an unmet document of
   an equal score may still have the smaller id. The k best of a query are carried from block to block, so later blocks stop sooner.
A task gives k rows a query at most; they are ranked in two steps (by shares of tasks, then all), so no query meets in one task.

Queries are taken in groups of at most `most` bytes of text (so the terms broadcast are bounded); each group is two passes more, never a
larger broadcast. Scores are whole numbers of 64 bits; the length factor is computed with whole numbers of any size.

Terms are the maximal runs of digits, letters A-Z and characters beyond ASCII; only A-Z are lower-cased. Null and empty texts have none and
are never found; an item without terms, or whose terms no document has, gives no rows. Equal scores are ordered by ascending doc_id
(nulls last). Each row is a document of its own, so repeated ids rank repeatedly; rows of one item_id (or none) are one query of all their terms.
Long texts are cut between words into pieces, never shortened. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, kernels

TOP = 10
#: Bytes of text that one index holds, entries of a list taken in one round, and shares of the tasks' winners.
BLOCK_BYTES, STEP, SHARES = 8 << 20, 32, 64
QUERY_BYTES = common.BROADCAST_BYTES >> 4


def parts(data: np.ndarray, most: int = kernels.PIECE_BYTES) -> Iterator[np.ndarray]:
    """A text in parts of about `most` bytes, cut only where no word is; a longer word is a part of its own."""
    at, n = 0, len(data)
    while at < n:
        to = min(at + most, n)
        if to < n:
            gaps = np.flatnonzero(~kernels.ALNUM[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
            else:
                while to < n and kernels.ALNUM[data[to]]:
                    more = np.flatnonzero(~kernels.ALNUM[data[to : to + most]])
                    to = to + int(more[0]) if len(more) else min(to + most, n)
        yield data[at:to]
        at = to


def found_terms(data: np.ndarray, off: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows of texts: each row's number of terms, and (row, place in the sorted vocabulary, occurrences) of the terms it has of it."""
    whole = len(data) <= kernels.PIECE_BYTES or len(off) > 2
    sizes, keys, counts = np.zeros(len(off) - 1, np.int64), [], []
    for piece in [data] if whole else parts(data):
        start, end, first = kernels.words(piece, off if whole else np.asarray([0, len(piece)]), kernels.ALNUM)
        n = np.diff(first)
        sizes += n
        if not len(start) or not len(vocabulary):
            continue
        h = kernels.word_hashes(piece, start, end)
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        row = np.repeat(np.arange(len(n)), n)[known]
        k, c = np.unique(row * len(vocabulary) + at[known], return_counts=True)
        keys.append(k)
        counts.append(c)
    if not keys:
        none = np.zeros(0, np.int64)
        return sizes, none, none, none
    key, back = np.unique(np.concatenate(keys), return_inverse=True)
    tf = np.bincount(back, weights=np.concatenate(counts)).astype(np.int64)
    return sizes, key // max(1, len(vocabulary)), key % max(1, len(vocabulary)), tf


def statistics(docs: DataFrame, vocabulary) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, document frequency by vocabulary place); the sums by task are added up by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        documents, total, df = 0, 0, np.zeros(len(known), np.int64)
        for _, data, off in kernels.pieces(batches, "text"):
            sizes, _, term, _ = found_terms(data, off, known)
            documents += int((sizes > 0).sum())
            total += int(sizes.sum())
            df += np.bincount(term, minlength=len(known))
        kernels.trim()
        some = np.flatnonzero(df)
        place = np.concatenate([[-2, -1], some])
        yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.concatenate([[documents, total], df[some]]), pa.int64())], names=["place", "n"])

    sums = dict(docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n")).collect())
    df = np.zeros(len(vocabulary.value), np.int64)
    for place, n in sums.items():
        if place >= 0:
            df[place] = n
    return sums.get(-2, 0), sums.get(-1, 0), df


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    return np.asarray([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, sizes: np.ndarray, documents: int, total: int) -> np.ndarray:
    """w * ((10^9 tf) div (1000 tf + 8 m)) with m = 10 + (90 n N) div L."""
    if len(sizes) and 90 * int(sizes.max()) * documents >= 1 << 62:
        m = 10 + np.asarray([90 * int(n) * documents // total for n in sizes], np.int64)
    else:
        m = 10 + 90 * sizes * documents // max(1, total)
    return weight * (1_000_000_000 * tf // (1000 * tf + 8 * m))


class Block:
    """An index of some documents: impact-sorted lists by term, and impacts by document."""

    def __init__(self, row: np.ndarray, term: np.ndarray, impact: np.ndarray, rows: int, terms: int):
        self.docs = np.searchsorted(row, np.arange(rows + 1))  # (row, term) come sorted
        self.doc_terms, self.doc_impacts = term, impact
        order = np.lexsort((row, -impact, term))
        self.lists = np.searchsorted(term[order], np.arange(terms + 1))
        self.list_docs, self.list_impacts = row[order], impact[order]

    def scores(self, docs: np.ndarray, mine: np.ndarray) -> np.ndarray:
        """Whole scores by random access to the forward index; `mine` marks the query's terms."""
        a, n = self.docs[docs], self.docs[docs + 1] - self.docs[docs]
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) + np.repeat(a - first, n)
        return np.add.reduceat(self.doc_impacts[at] * mine[self.doc_terms[at]], first)  # each doc met has a term

    def search(self, terms: np.ndarray, mine: np.ndarray, k: int, floor: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold all documents whose score is among the k best here and at least `floor`."""
        begin, end = self.lists[terms], self.lists[terms + 1]
        begin, end = begin[begin < end], end[begin < end]
        met, found, score = np.zeros(len(self.docs) - 1, bool), [], []
        best = np.zeros(0, np.int64)
        while len(begin):
            at = (begin[:, None] + np.arange(step)).ravel()
            docs = np.unique(self.list_docs[at[at < np.repeat(end, step)]])
            docs = docs[~met[docs]]
            met[docs] = True
            if len(docs):
                s = self.scores(docs, mine)
                found.append(docs)
                score.append(s)
                best = np.concatenate([best, s])
                if len(best) > k:
                    best = np.partition(best, len(best) - k)[-k:]
            begin = begin + step
            more = begin < end
            threshold = int(self.list_impacts[begin[more] - 1].sum())  # an exhausted list gives nothing more
            least = max(floor, int(best.min())) if len(best) == k else floor
            if threshold < least:
                break
            begin, end = begin[more], end[more]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none
        docs, score = np.concatenate(found), np.concatenate(score)
        least = max(floor, int(best.min()), 1) if len(best) == k else max(floor, 1)
        return docs[score >= least], score[score >= least]


def _groups(items: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """Queries in groups of at most `most` bytes of text (one at least); an item's rows stay together."""
    group, size, last = [], 0, object()
    for row in items.select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len((row[1] or "").encode()) + 64
        if group and size + n > most and row[0] != last:
            yield group
            group, size = [], 0
        group.append((row[0], row[1] or ""))
        size, last = size + n, row[0]
    if group:
        yield group


def _searcher(queries, stats, k: int, block_bytes: int):
    """One task: blocks of documents one after another, and the k best of each query over them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, asked = queries.value
        documents, total, weight = stats.value
        best: list[list[tuple[int, object]]] = [[] for _ in asked]
        order = lambda e: (-e[0], e[1] is None, e[1])
        marks = []
        for terms in asked:
            mine = np.zeros(len(vocabulary), np.int64)
            mine[terms] = 1
            marks.append(mine)
        held: list[tuple] = []

        def settle() -> None:
            ids = [i for h in held for i in h[0]]
            base = np.cumsum([0, *(len(h[0]) for h in held)])
            sizes = np.concatenate([h[1] for h in held])
            row = np.concatenate([h[2] + b for h, b in zip(held, base[:-1], strict=True)])
            term, tf = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
            block = Block(row, term, impacts(weight[term], tf, sizes[row], documents, total), len(ids), len(vocabulary))
            for q, terms in enumerate(asked):
                floor = best[q][-1][0] if len(best[q]) == k else 1
                docs, score = block.search(terms, marks[q], k, floor)
                if len(docs):
                    best[q] = sorted([*best[q], *((int(s), ids[d]) for d, s in zip(docs, score, strict=True))], key=order)[:k]
            held.clear()

        size = 0
        for batch, data, off in kernels.pieces(batches, "text"):
            sizes, row, term, tf = found_terms(data, off, vocabulary)
            held.append((batch.column(0).to_pylist(), sizes, row, term, tf))
            size += len(data) + 64 * len(sizes)
            if size >= block_bytes:
                settle()
                size = 0
        if held:
            settle()
        kernels.trim()
        rows = [(q, s, d) for q, b in enumerate(best) for s, d in b]
        q, s, d = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.int64()), pa.array(d, pa.int64())], names=["q", "score", "doc_id"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most: int = QUERY_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = items.schema["item_id"].dataType
    scratch, out = common.Scratch(spark, "search"), None
    for group in _groups(items, most):
        by: dict[object, list[np.ndarray]] = defaultdict(list)
        for item, text in group:
            data = np.frombuffer(text.encode(), np.uint8)
            start, end, _ = kernels.words(data, np.asarray([0, len(data)]), kernels.ALNUM)
            by[item].append(kernels.word_hashes(data, start, end) if len(start) else np.zeros(0, np.uint64))
        vocabulary = np.unique(np.concatenate([h for hs in by.values() for h in hs]))
        asked = [np.searchsorted(vocabulary, np.unique(np.concatenate(hs))) for hs in by.values()]
        documents, total, df = statistics(docs, spark.sparkContext.broadcast(vocabulary))
        stats = spark.sparkContext.broadcast((documents, total, weights(df, documents)))
        queries = spark.sparkContext.broadcast((vocabulary, asked))
        won = docs.mapInArrow(_searcher(queries, stats, k, block_bytes), "q int, score long, doc_id long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        share = F.pmod(F.spark_partition_id(), F.lit(SHARES))
        won = won.withColumn("_share", share).withColumn("_r", F.row_number().over(W.partitionBy("q", "_share").orderBy(*order))).where(F.col("_r") <= k)
        won = won.withColumn("rank", F.row_number().over(W.partitionBy("q").orderBy(*order))).where(F.col("rank") <= k)
        names = spark.createDataFrame(list(enumerate(by)), f"q int, item_id {kind.simpleString()}")
        one = won.join(F.broadcast(names), "q").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = scratch.table(one) if out is None else out.unionByName(scratch.table(one))
    if out is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return out


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH dw AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
counted AS (SELECT doc_id, term, count(*) AS tf FROM dw GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM counted GROUP BY doc_id),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM sizes),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
df AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
weighed AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, total),
long AS (SELECT doc_id, 10 + (90 * n * docs) // terms AS m FROM sizes, total),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN long USING (doc_id) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10"""
