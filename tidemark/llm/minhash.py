"""MinHash near-duplicates with tensored banding.

A document's set is its distinct shingles of `size` words (a shorter text: all its words as one). From two small
collections of `groups` minhash groups, A and B, `rows` hashes each, every pair (A[i], B[j]) forms the key of one table: groups**2
tables from 2 * groups * rows hashes, about the square root of what independent tables would compute.

Documents of equal sets are first reduced to their least doc_id. In the first round every document is compared, on its full set, with the
least document of each of its keys; in later rounds, at keys whose documents are still in different components, with a few pivots
drawn by hash. Verified links are merged into components by distributed min-label propagation. Keys whose documents are all in one
component drop out, as a further link there would change nothing. Pivot rounds only save work: they end when few
of their pairs are links.
Then all documents of keys that still hold several components are settled exactly (`unsettled`): each set is ordered by one global order, rare
shingles first by their exact counts, and two sets that reach the threshold share a shingle within their first n - ceil(percent * n / 100) + 1; all
pairs of other components that do, and whose sizes and places allow the threshold, are compared. So no pair that shares a key is left out. The full sets are
made anew from the texts of the documents that share a key (a filter of bounded size picks them at the scan), so no other set is stored or moved.

A link needs 100 * intersection >= percent * union, confirmed on the 64-bit hashes of all shingles. Null texts, and texts without words, are
empty sets, linked with nothing: they are their own components, equal or not. Repeated rows of one doc_id are one document
in the components, with each of its sets if they differ. Every input row gets a row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

GROUPS, ROWS = 6, 2


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(2024)
    return rng.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def distinct(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row."""
    rows = [np.unique(h[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return (np.concatenate(rows) if rows else h[:0]), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def table_keys(h: np.ndarray, first: np.ndarray, groups: int = GROUPS, rows: int = ROWS) -> np.ndarray:
    """Keys of the groups**2 tables for each row with a set; rows of zeros for empty ones."""
    full = np.flatnonzero(np.diff(first) > 0)
    out = np.zeros((len(first) - 1, groups * groups), np.uint64)
    if not len(full):
        return out
    a, b = _hashes(2 * groups * rows)
    at = first[full]
    parts = []
    for g in range(2 * groups):
        x = np.zeros(len(full), np.uint64)
        for k in range(g * rows, (g + 1) * rows):
            v = h * a[k] + b[k]
            v ^= v >> np.uint64(32)
            v *= np.uint64(0xD6E8FEB86659FD93)
            x = kernels.mix(x * np.uint64(31) + np.minimum.reduceat(v, at), k)
        parts.append(x)
    for i in range(groups):
        for j in range(groups):
            out[full, i * groups + j] = kernels.mix(parts[i] + parts[groups + j] * np.uint64(0x9E3779B97F4A7C15), 100 + i * groups + j)
    return out


KEY_SCHEMA = "doc_id long, n_shingles long, sig_a long, sig_b long, keys array<long>"
SET_SCHEMA = "doc_id long, shingles binary"
#: Bits of the filter that says which documents' full sets are fetched; a fixed bound, so more documents only make it less sharp: of the other
#: documents it lets through 0.4 % at a million candidates, 21 % at five and 58 % at ten million; their sets are written, and meet no pair.
FILTER_BITS = 1 << 24
#: The documents of a shingle that meet in one block of its pairs.
BLOCK = 1000


def _sets(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch, data, off in kernels.pieces(batches, "text"):
        start, end, word = kernels.words(data, off, kernels.SPACED)
        yield batch, *distinct(*kernels.shingle_hashes(kernels.word_hashes(data, start, end), word, size))
    kernels.trim()


def set_keys(size: int, groups: int = GROUPS, rows: int = ROWS):
    """mapInArrow body: (doc_id, text) to KEY_SCHEMA: the set's size, its signature and its table keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, first in _sets(batches, size):
            n = np.diff(first)
            sig = np.zeros((2, len(n)), np.uint64)
            full = np.flatnonzero(n > 0)
            if len(full):
                for k in (0, 1):
                    sig[k, full] = np.add.reduceat(kernels.mix(h, 50 + k), first[full])
            keys = table_keys(h, first, groups, rows).view(np.int64)
            width = keys.shape[1]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * width, pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(sig[0].view(np.int64)), pa.array(sig[1].view(np.int64)), lists], names=["doc_id", "n_shingles", "sig_a", "sig_b", "keys"]
            )

    return run


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    return np.stack([kernels.mix(ids.astype(np.uint64), 70 + k) % np.uint64(bits) for k in range(3)])


def id_filter(ids: DataFrame) -> tuple[int, np.ndarray]:
    """A Bloom filter of ids, of at most FILTER_BITS bits, or-ed together by the executors."""
    bits = FILTER_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for b in batches:
            at = _places(np.asarray(b.column(0), np.int64), bits).ravel()
            np.bitwise_or.at(held, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))
        words = held.view(np.int64)
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used])], names=["word", "value"])

    rows = ids.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toPandas()
    held = np.zeros(bits // 64, np.int64)
    held[rows["word"].to_numpy(np.int64)] = rows["value"].to_numpy(np.int64)
    return bits, held.view(np.uint8)


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles) of the documents that may be among ids: all of these, and few others. Nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, held = sent.value
        for b in batches:
            ids = b.column(0).fill_null(0)
            at = _places(np.asarray(ids, np.int64), bits)
            hit = np.all(held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1, axis=0)
            part = b.filter(pa.array(hit & b.column(0).is_valid().to_numpy(zero_copy_only=False)))
            for batch, h, first in _sets([part], size):
                raw = h.astype("<u8").tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([raw[8 * i : 8 * j] for i, j in zip(first[:-1], first[1:], strict=True)], pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, SET_SCHEMA)


def confirm(percent: int):
    """mapInArrow body: (a, b, sa, sb) to the pairs that are linked on their full sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    one = pairs.join(full.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    two = one.join(full.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b").select("a", "b", "sa", "sb")
    return two.mapInArrow(confirm(percent), "a long, b long")


def components(scratch: common.Scratch, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(id, comp): the least id reachable over undirected edges (a, b); nothing but counts reaches the driver.

    Labels spread to neighbours, each the least of what it hears; from the third step on they also jump to their label's label, so
    long chains take a logarithmic number of steps. `known` are labels that hold for a part of the edges already.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    start = both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp"))
    if known is not None:
        start = start.unionByName(known).groupBy("id").agg(F.min("comp").alias("comp"))
    labels, step = scratch.table(start), 0
    while True:
        step += 1
        heard = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").select(F.col("a").alias("id"), "comp", F.lit(None).cast("long").alias("own"))
        found = heard.unionByName(labels.select("id", "comp", F.col("comp").alias("own"))).groupBy("id").agg(F.min("comp").alias("comp"), F.min("own").alias("own"))
        if step > 2:
            jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_far"))
            found = found.join(jump, "comp", "left").select("id", F.least("comp", F.coalesce("_far", "comp")).alias("comp"), "own")
        found = scratch.table(found)
        scratch.drop(labels)
        changed = found.where("comp < own").limit(1).count()
        labels = found.select("id", "comp")
        labels._scratch = found._scratch
        if not changed:
            return labels


def held(batch: pa.RecordBatch, bits: int, held: np.ndarray) -> pa.RecordBatch:
    at = _places(np.asarray(batch.column(0), np.int64), bits)
    return batch.filter(pa.array(np.all(held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1, axis=0)))


def left_sets(full: DataFrame, sent) -> DataFrame:
    """(id, n, shingles) of the filter's sets."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = held(batch, *sent.value)
            size = np.asarray([len(v) // 8 for v in part.column(1).to_pylist()], np.int64)
            flat = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), lists], names=["id", "n", "shingles"])

    return full.mapInArrow(run, "id long, n long, shingles array<long>")


def unsettled(scratch: common.Scratch, full: DataFrame, now: DataFrame, percent: int) -> DataFrame | None:
    """All pairs (a, b) that can still be linked among the documents of now(key, id, comp) whose keys hold several components; None without any.

    Shingles of one component only come first in the global order, as they link nothing new; the others follow by their number of documents.
    A pair's first shared shingle bounds what they share by what follows it in both. A shingle of many documents is worked off in blocks.
    The two joins by shingle read written tables, so that a frequent shingle's rows can be split over tasks (AQE).
    """
    apart = scratch.table(now.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key"))
    left = scratch.table(now.join(apart, "key", "left_semi").select("id", "comp").distinct())
    if not left.limit(1).count():
        return None
    sent = full.sparkSession.sparkContext.broadcast(id_filter(left.select("id")))
    sets = scratch.table(left_sets(full, sent).join(left, "id"), compression="zstd")
    rows = sets.select("id", "comp", "n", F.explode("shingles").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count("*").alias("docs"), F.min("comp").alias("c0"), F.max("comp").alias("c1"))
    shared = scratch.table(shared.where("c0 < c1").select("shingle", "docs"), compression="zstd")
    # a set's shared shingles in the global order; of n it needs ceil(percent * n / 100) of them at least, and the first of those that may be missed
    own = rows.join(shared, "shingle").groupBy("id", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("docs", "shingle"))).alias("s"))
    own = own.withColumn("first", F.size("s") - F.ceil(F.col("n") * percent / 100) + 1).where("first > 0")
    prefix = own.select("id", "comp", "n", F.size("s").alias("m"), F.posexplode(F.slice("s", F.lit(1), F.col("first").cast("int"))).alias("at", "s"))
    prefix = prefix.select("id", "comp", "n", (F.col("m") - F.col("at")).alias("rest"), F.col("s.shingle").alias("shingle"), F.ceil(F.col("s.docs") / BLOCK).cast("int").alias("blocks"))
    prefix = scratch.table(prefix.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), compression="zstd")
    common.free(full.sparkSession)
    value = lambda s: F.struct("id", "comp", "n", "rest").alias(s)
    one = prefix.select("shingle", F.col("own").alias("i"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("j"), value("x"))
    two = prefix.select("shingle", F.explode(F.sequence(F.lit(0), "own")).alias("i"), F.col("own").alias("j"), value("y"))
    fits = F.expr(f"x.comp <> y.comp AND (i < j OR x.id < y.id) AND {100 + percent} * least(x.rest, y.rest) >= {percent} * (x.n + y.n)")
    return one.join(two, ["shingle", "i", "j"]).where(fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, groups: int = GROUPS, rows: int = ROWS, pivots: int = 3, scratch: common.Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of (doc_id, text)."""
    spark = docs.sparkSession
    scratch = scratch or common.Scratch(spark, "minhash")
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    sets = scratch.table(docs.mapInArrow(set_keys(size, groups, rows), KEY_SCHEMA), compression="zstd")
    same = sets.where("n_shingles > 0").groupBy("sig_a", "sig_b", "n_shingles").agg(F.min("doc_id").alias("rep"))
    reps = scratch.table(same.where("rep is not null"))
    chosen = sets.where("n_shingles > 0").join(reps.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig_a", "sig_b", "n_shingles"], "left_semi")
    keyed = chosen.select(F.col("doc_id").alias("id"), F.posexplode("keys").alias("t", "key")).select("id", F.xxhash64("t", "key").alias("key"), (F.col("t") % (groups + 1) == 0).alias("first"))
    shared = keyed.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("key")
    members = scratch.table(keyed.join(shared, "key", "left_semi"))
    common.free(spark)
    full = scratch.table(full_sets(docs, members.select("id"), size))
    labels, links, tried, turn, goes_on = None, None, None, 0, True
    while goes_on:
        rows_now = members.where("first") if turn == 0 else members
        if labels is None:
            now = rows_now.select("key", "id", F.col("id").alias("comp"))
        else:
            now = rows_now.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
        # the first turn uses the tables (A[i], B[i]) only, the second all, both with each key's least document; later ones compare with
        # several others, where components still differ
        orders = [F.col("id")] if turn < 2 else [F.xxhash64("id", F.lit(turn * pivots + i)) for i in range(pivots)]
        pivot = now.groupBy("key").agg(*[F.min_by(F.struct("id", "comp"), o).alias(f"p{i}") for i, o in enumerate(orders)], F.min("comp").alias("c0"), F.max("comp").alias("c1"))
        # as a written table: the join below has nothing else in its stage, so that a popular key's rows can be split over tasks (AQE)
        pivot = scratch.table(pivot.where("c0 < c1").select("key", F.array_distinct(F.array(*[f"p{i}" for i in range(len(orders))])).alias("p")))
        # only keys whose documents are still apart go on: components never part again
        apart = scratch.table(now.join(pivot, "key"))
        if turn:
            members = apart.select("key", "id")
        pairs = apart.select("id", F.explode(F.filter("p", lambda x: x["comp"] != F.col("comp"))).alias("p")).select(F.least("id", "p.id").alias("a"), F.greatest("id", "p.id").alias("b")).distinct()
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs)
        fresh = scratch.table(confirmed(pairs, full, percent))
        tried = pairs if tried is None else tried.union(pairs)
        if found := fresh.count():
            links = fresh if links is None else links.union(fresh)
            labels = components(scratch, links, labels)
            common.free(spark)
        # a turn that costs more than it brings is the last one: the exact join below takes over
        goes_on = turn == 0 or found > 0 and 8 * found >= pairs.count()
        turn += 1
    common.free(spark)
    now = members.select("key", "id", F.col("id").alias("comp")) if labels is None else members.join(labels, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    pairs = unsettled(scratch, full, now, percent)
    if pairs is not None:
        pairs = scratch.table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))
        fresh = scratch.table(confirmed(pairs, full, percent))
        if fresh.limit(1).count():
            labels = components(scratch, fresh if links is None else links.union(fresh), labels)
        common.free(spark)
    if labels is None:
        labels = spark.range(0).select("id", F.col("id").alias("comp"))
    scratch.keep(sets, reps, *([labels] if hasattr(labels, "_scratch") else []))
    least = reps.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("sig_a", "sig_b", "n_shingles", F.coalesce("comp", "rep").alias("comp"))
    out = sets.select("doc_id", "n_shingles", "sig_a", "sig_b").join(least, ["sig_a", "sig_b", "n_shingles"], "left")
    component = F.coalesce("comp", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, **parameters: int) -> DataFrame:
    """The documents that stay: one row of each component, the one of the least doc_id; the same columns. Rows without a doc_id stay.

    The ids that go are broadcast if there are few; else documents and ids are joined by id.
    """
    scratch = common.Scratch(docs.sparkSession, "kept")
    found = near_duplicates(docs, scratch=scratch, **parameters).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("_n"), F.bool_or("kept").alias("_kept"))
    found = scratch.table(found)
    scratch.keep(found)
    common.free(docs.sparkSession)
    gone = found.where("not _kept").select("doc_id")
    if gone.limit(common.BROADCAST_BYTES // 64 + 1).count() <= common.BROADCAST_BYTES // 64:
        gone = F.broadcast(gone)
    kept = docs.join(gone, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    # only where ids repeat are rows compared by id once more
    repeated = found.where("_n > 1 and _kept").select("doc_id")
    if not repeated.limit(1).count():
        return kept
    twice = kept.join(repeated, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    return kept.join(repeated, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns]).unionByName(twice.dropDuplicates(["doc_id"]))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.read(spark, sf_dir, "documents").select("doc_id", "text"), size=3, percent=85)


def components_sql(size: int, percent: int, table: str = "documents") -> str:
    """Common table expressions ending in near(doc_id, n_shingles, component_id), for any key column doc_id."""
    return rf"""
dupe_words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM {table}),
dupe_sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS s FROM dupe_words),
dupe_reps AS (SELECT min(doc_id) AS rep, s FROM (SELECT doc_id, list_sort(s) AS s FROM dupe_sets WHERE len(s) > 0) GROUP BY s),
dupe_items AS (SELECT rep, len(s) AS n, hash(unnest(s)) AS g FROM dupe_reps),
dupe_pairs AS (
  SELECT a.rep AS a, b.rep AS b FROM dupe_items a JOIN dupe_items b ON a.g = b.g AND a.rep < b.rep AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
dupe_edges AS MATERIALIZED (SELECT a, b FROM dupe_pairs UNION SELECT b, a FROM dupe_pairs),
dupe_reach(id, other) AS (SELECT a, a FROM dupe_edges UNION SELECT r.id, e.b FROM dupe_reach r JOIN dupe_edges e ON e.a = r.other),
dupe_least AS (SELECT id, min(other) AS comp FROM dupe_reach GROUP BY id),
near AS (
  SELECT d.doc_id, len(d.s)::BIGINT AS n_shingles, coalesce(l.comp, r.rep, d.doc_id) AS component_id
  FROM dupe_sets d LEFT JOIN dupe_reps r ON len(d.s) > 0 AND r.s = list_sort(d.s) LEFT JOIN dupe_least l ON l.id = r.rep)"""


OP8_SQL = f"WITH RECURSIVE {components_sql(3, 85)} SELECT *, doc_id = component_id AS kept FROM near"
