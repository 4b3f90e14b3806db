"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of `window` consecutive words of the benchmark items (an item of fewer words is one window).
Windows of one length form a matcher: a shift table over hashed blocks of words says how far the search may jump, a block
at which a window may end has shift 0 and leads to the bucket of the windows with that suffix; each of these is compared
with the text's own words, byte for byte, before it counts. Windows shorter than `window` have matchers of their own, so
that they do not shorten the jumps of the others.

The items are broadcast in blocks of at most `common.BROADCAST_BYTES` of text; each block is one map over the documents,
so a larger benchmark means more passes, never a larger broadcast. Nothing is shuffled.

Null and empty texts have no words and no hits. Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased. Texts
are searched whole. Equal item_ids (ties) count once; items without an item_id are one, named by the empty text. Repeated documents are judged alike, an empty benchmark marks
nothing, other columns pass through (columns with the result's names are replaced).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

WINDOW = 10
_BITS = 20


class Matcher:
    """The Wu-Manber tables of windows of one length, in words."""

    def __init__(self, length: int, windows: dict[bytes, tuple[np.ndarray, set]]):
        self.length, self.block = length, min(3, length)
        self.skip = length - self.block + 1
        self.shift = np.full(1 << _BITS, self.skip, np.uint8 if self.skip < 256 else np.int64)
        self.buckets: dict[int, list[tuple[bytes, set]]] = defaultdict(list)
        for text, (hashes, items) in windows.items():
            blocks = self.blocks(hashes)
            for j, b in enumerate(blocks & np.uint64((1 << _BITS) - 1)):
                self.shift[b] = min(self.shift[b], self.skip - 1 - j)
            self.buckets[int(blocks[-1])].append((text, items))

    def blocks(self, h: np.ndarray) -> np.ndarray:
        """Hashes of all runs of `block` words."""
        n = len(h) - self.block + 1
        out = h[:n].copy()
        for k in range(1, self.block):
            out = kernels.mix(out + h[k : n + k] * np.uint64(2 * k + 1), k)
        return out

    def search(self, h: np.ndarray, word: "callable") -> Iterator[tuple[int, set]]:
        """(first word, items) of every occurrence; word(i, j) is the text of the words from i up to j, joined by spaces."""
        if len(h) < self.length:
            return
        blocks = self.blocks(h)
        shifts = self.shift[blocks & np.uint64((1 << _BITS) - 1)].tolist()
        at, n, first = self.length - self.block, len(shifts), self.length - self.block
        while at < n:
            step = shifts[at]
            if step:
                at += step
                continue
            bucket = self.buckets.get(int(blocks[at]))
            if bucket:
                here = word(at - first, at + self.block)
                for text, items in bucket:
                    if text == here:
                        yield at - first, items
            at += 1


def matchers(items: Iterable[tuple[object, str | None]], window: int = WINDOW) -> list[Matcher]:
    by: dict[int, dict[bytes, tuple[np.ndarray, set]]] = defaultdict(dict)
    for item, text in items:
        data = np.frombuffer((text or "").encode(), np.uint8)
        start, end, _ = kernels.words(data, np.asarray([0, len(data)]), kernels.ALNUM)
        if not len(start):
            continue
        h = kernels.word_hashes(data, start, end)
        low = kernels.LOWER[data].tobytes()
        said = [low[s:e] for s, e in zip(start, end, strict=True)]
        n = min(window, len(said))
        for i in range(len(said) - n + 1):
            by[n].setdefault(b" ".join(said[i : i + n]), (h[i : i + n], set()))[1].add(item)
    return [Matcher(n, w) for n, w in sorted(by.items())]


def _blocks(benchmark: DataFrame, most: int) -> Iterator[list[tuple[object, str]]]:
    """Items in lists of at most `most` bytes of text (one item at least), read partition by partition."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        n = len((row[1] or "").encode()) + 64
        if block and size + n > most:
            yield block
            block, size = [], 0
        block.append(tuple(row))
        size += n
    if block:
        yield block


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most: int = common.BROADCAST_BYTES >> 3) -> DataFrame:
    """Adds n_words, hit_spans (array of (first word, number of words), disjoint, sorted) and hit_items (sorted array)."""
    spark = docs.sparkSession
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    kept = [F.col(f"`{c}`") for c in docs.columns]
    out = docs.select(*kept, F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<first:bigint,words:bigint>>)").alias("hit_spans"), F.expr("cast(array() as array<string>)").alias("hit_items"))
    scratch = common.Scratch(spark, "decontaminate")
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in out.schema.fields])
    k = -1
    for k, block in enumerate(_blocks(benchmark, most)):
        tables = spark.sparkContext.broadcast(matchers(block, window))
        out = out.mapInArrow(_searcher(tables), schema)
        if k % 4 == 3:
            out = scratch.table(out)
    if k < 0:
        out = out.mapInArrow(_searcher(spark.sparkContext.broadcast([])), schema)  # an empty benchmark: words are still counted
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a benchmark passage; the same columns, whatever their names."""
    added, prefix = ("n_words", "hit_spans", "hit_items"), "_own_"
    while any(f"{prefix}{n}" in docs.columns for n in added):
        prefix = "_" + prefix
    inside = {c: prefix + c if c in added else c for c in docs.columns}
    marked = mark(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inside.items()]), benchmark)
    return marked.where(F.size("hit_spans") == 0).select(*[F.col(f"`{n}`").alias(c) for c, n in inside.items()])


def _searcher(tables):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = tables.value
        for batch, data, off in kernels.pieces(batches, "text"):
            start, end, first = kernels.words(data, off, kernels.ALNUM)
            h = kernels.word_hashes(data, start, end)
            low = None
            names = batch.schema.names
            old_spans, old_items = batch.column(names.index("hit_spans")).to_pylist(), batch.column(names.index("hit_items")).to_pylist()
            spans, items = [], []
            for i in range(batch.num_rows):
                a, b = int(first[i]), int(first[i + 1])
                hits: list[tuple[int, int]] = [(s["first"], s["first"] + s["words"]) for s in old_spans[i]]
                got: set = set(old_items[i])
                for m in found:
                    if b - a < m.length:
                        continue
                    if low is None:
                        low = kernels.LOWER[data].tobytes()
                    said = lambda x, y, a=a: b" ".join([low[s:e] for s, e in zip(start[a + x : a + y], end[a + x : a + y], strict=True)])
                    for at, which in m.search(h[a:b], said):
                        hits.append((at, at + m.length))
                        got.update("" if w is None else str(w) for w in which)
                merged: list[list[int]] = []
                for x, y in sorted(hits):
                    if merged and x <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], y)
                    else:
                        merged.append([x, y])
                spans.append([{"first": x, "words": y - x} for x, y in merged])
                items.append(sorted(got))
            columns = {n: batch.column(k) for k, n in enumerate(names)} | {
                "n_words": pa.array(np.diff(first), pa.int64()),
                "hit_spans": pa.array(spans, batch.schema.field("hit_spans").type),
                "hit_items": pa.array(items, batch.schema.field("hit_items").type),
            }
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], schema=pa.schema([batch.schema.field(n).with_nullable(True) for n in names]))
        kernels.trim()

    return run


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = mark(docs, common.read(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("hit_items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH low AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
dw AS (
  SELECT doc_id, coalesce(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM low),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
runs AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, runs.n, i, item_id FROM runs JOIN windows USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT doc_id, coalesce(item_id::VARCHAR, '') AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
