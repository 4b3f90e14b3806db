"""Document fingerprints from prefix polynomial hashes.

For each text, modular prefix arrays P[i] = sum of c[j] * B**j over j < i (two prime moduli near 2**31) give the hash of any span in
constant time, so two spans are equal if their shifted differences are, and the longest common extension of two positions
is found by binary search over span lengths. The fingerprint is the hash of the whole text, its length, and the `SKETCH` least
hashes of its spans of `GRAM` code points (a bottom-k sketch). Likeness is 1 for equal fingerprints, else the share of common
spans the sketches estimate (0 if either has none).

Null texts are read as empty; a text shorter than `GRAM` has one span, itself; the empty text has none. The next document
is the one with the next smaller doc_id (rows of the same doc_id: by descending hash of the text, then by text, at every size and setting); after the last
comes the first. A table of one row is its own next. A null doc_id comes after all others. Texts are exchanged once, by ranges of doc_id
and, within a hot id, of its texts' hashes; only rows equal in both must meet. Repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

MODULI = (2147483647, 2147483629)
BASES = (1103515245 % 2147483647, 1812433253 % 2147483629)
GRAM = 12
SKETCH = 64
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(k: int, n: int) -> np.ndarray:
    """B**j modulo the k-th prime for j < n, doubled as needed."""
    p, m = _powers[k], np.uint64(MODULI[k])
    while len(p) < n:
        p = np.concatenate([p, p * np.uint64(pow(BASES[k], len(p), MODULI[k])) % m])
    _powers[k] = p
    return p[:n]


class PrefixHash:
    """Prefix arrays of one sequence of code points."""

    def __init__(self, points: np.ndarray):
        self.n, self.prefix = len(points), []
        for k in (0, 1):
            p = np.zeros(self.n + 1, np.uint64)
            m = np.uint64(MODULI[k])
            p[1:] = np.cumsum((points.astype(np.uint64) + np.uint64(1)) * _power(k, self.n) % m) % m
            self.prefix.append(p)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """The hash of the span [i, j), the same wherever it stands."""
        return tuple((int(self.prefix[k][j]) - int(self.prefix[k][i])) * pow(BASES[k], -i, MODULI[k]) % MODULI[k] for k in (0, 1))

    def equal(self, i: int, other: PrefixHash, j: int, size: int) -> bool:
        return self.span(i, i + size) == other.span(j, j + size)

    def extension(self, i: int, other: PrefixHash, j: int) -> int:
        """Length of the longest common extension from position i here and j there, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.equal(i, other, j, mid):
                low = mid
            else:
                high = mid - 1
        return low

    def spans(self, size: int) -> np.ndarray:
        """Hashes of all spans of a size, as uint64."""
        n = self.n - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for k in (0, 1):
            m = np.uint64(MODULI[k])
            top = _power(k, self.n)[::-1][:n]  # B**(n-1-i): every span is shifted to the same power
            lift = top * np.uint64(pow(BASES[k], -(self.n - 1), MODULI[k])) % m
            d = (self.prefix[k][size:] + m - self.prefix[k][:n]) % m
            out = out << np.uint64(32) | d * lift % m
        return out


def sketch(points: np.ndarray, hashes: PrefixHash | None = None) -> tuple[int, int, np.ndarray]:
    """(whole hash, length, least span hashes, sorted and distinct)."""
    h = hashes or PrefixHash(points)
    n = h.n
    a, b = h.span(0, n)
    if not n:
        return 0, 0, np.zeros(0, np.uint32)
    x = (kernels.mix(h.spans(min(GRAM, n)), 9) >> np.uint64(32)).astype(np.uint32)
    if len(x) > 16 * SKETCH:  # the least few; more of them only while repeats leave too few
        least, most = x[:0], 4 * SKETCH
        while len(least) < SKETCH and most < len(x):
            least, most = np.unique(np.partition(x, most)[:most]), most * 4
        x = least if len(least) >= SKETCH else np.unique(x)
    else:
        x = np.unique(x)
    return a << 32 | b, n, x[:SKETCH]


def render(s: tuple[int, int, np.ndarray]) -> str:
    return f"{s[0]:016x}{s[1]:x}:" + s[2].astype(">u4").tobytes().hex()


def likeness(a: tuple[int, int, np.ndarray], b: tuple[int, int, np.ndarray]) -> float:
    if a[:2] == b[:2]:
        return 1.0
    if not len(a[2]) or not len(b[2]):
        return 0.0
    both = np.unique(np.concatenate([a[2], b[2]]))[:SKETCH]
    shared = np.isin(both, a[2], assume_unique=True) & np.isin(both, b[2], assume_unique=True)
    overlap = shared.sum() / len(both)
    return float(2 * overlap / (1 + overlap))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(_part, doc_id, text, _ghost), sorted, where each part ends with a copy of the row that follows it (a ghost).

    Parts are ranges of doc_id between quantiles. An id that fills several ranges (or null, by its share of the rows) has as many
    parts of its own, by ranges of a hash of the text, so a hot id meets in no one task. Only the ids' quantiles, the counts and each
    part's first row reach the driver.
    """
    spark = docs.sparkSession
    parts = parts or 4 * common.bucket_count(spark)
    total, named = docs.agg(F.count("*"), F.count("doc_id")).first()
    if not total:
        return docs.select("doc_id", "text", F.lit(0).alias("_part"), F.lit(False).alias("_ghost"))
    cuts = [int(c) for c in sorted(docs.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))] if parts > 1 and named else []
    nulls = max(1, round(parts * (total - named) / total))
    array = lambda values: F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<bigint>)")
    cut, own = array(cuts), array([cuts.count(c) for c in cuts])
    # the number of cuts below doc_id, by binary search
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))] or [F.lit(1)])
    below = F.aggregate(steps, F.lit(0), lambda at, n: F.when(F.get(cut, at + n - 1) < F.col("doc_id"), at + n).otherwise(at))
    rows = docs.select("doc_id", "text", F.when(F.col("doc_id").isNotNull(), below).alias("_below"))
    share = F.when(F.col("doc_id").isNull(), nulls).when(F.get(cut, F.col("_below")) == F.col("doc_id"), F.get(own, F.col("_below"))).otherwise(1).cast("long")
    rows = rows.withColumn("_share", share)
    # the order within an id, whatever its parts: by hash, then by text
    rows = rows.withColumn("_h", F.pmod(F.xxhash64("text"), F.lit(1 << 31)))
    part = (F.coalesce("_below", F.lit(-nulls)) + F.floor(F.col("_h") * F.col("_share") / (1 << 31))).cast("int")
    rows = rows.select("doc_id", "text", "_h", part.alias("_part"))
    place = F.struct("doc_id", "_h")  # nulls are least
    heads = sorted(((r[0], *r[1]) for r in rows.groupBy("_part").agg(F.max(place)).collect()), key=lambda r: r[0])
    size = nulls + max(p for p, _, _ in heads) + 1
    tops, hashes, goes = [None] * size, [None] * size, [None] * size
    for k, (p, top, h) in enumerate(heads):
        # descending ids: the part above comes before
        tops[p + nulls], hashes[p + nulls], goes[p + nulls] = top, h, heads[(k + 1) % len(heads)][0]
    at = lambda values, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("_part") + nulls)
    first = F.when(at(tops, "long").eqNullSafe(F.col("doc_id")) & (at(hashes, "long") == F.col("_h")), at(goes, "int"))
    both = F.when(first.isNull(), F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("g")))).otherwise(
        F.array(F.struct(F.col("_part").alias("p"), F.lit(False).alias("g")), F.struct(first.alias("p"), F.lit(True).alias("g")))
    )
    rows = rows.select("doc_id", "text", "_h", F.explode(both).alias("_to")).select("doc_id", "text", "_h", F.col("_to.p").alias("_part"), F.col("_to.g").alias("_ghost"))
    rows = rows.repartition("_part").sortWithinPartitions("_part", "_ghost", F.desc_nulls_last("doc_id"), F.desc("_h"), F.asc_nulls_first("text"))
    return rows.select("doc_id", "text", "_part", "_ghost")


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            yield from zip(*[c.to_pylist() for c in b.slice(i, 256).columns], strict=True)


def fingerprint_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row of with_next(): the digest columns of the row, its edited text and its next document."""
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
    out: list[tuple] = []
    held = None  # the row that waits for its next one
    for doc_id, text, part, ghost in _rows(batches):
        points = _points(text or "")
        h = PrefixHash(points)
        now = (doc_id, points, h, sketch(points, h), part, ghost)
        if held is not None and held[4] == part and not held[5]:
            _, before, bh, bs, _, _ = held
            keep = len(before) - len(before) // 2
            edited = np.concatenate([before[:keep], points[: len(before) // 2]])
            eh = PrefixHash(edited)
            es = sketch(edited, eh)
            said = edited.astype("<u4").tobytes().decode("utf-32-le")
            out.append((held[0], len(before), hashlib.sha256(said.encode()).hexdigest(), render(bs), render(es), likeness(bs, es), likeness(bs, now[3]), bh.extension(0, eh, 0)))
            if len(out) >= 512:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        held = now
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def fingerprints(docs: DataFrame) -> DataFrame:
    return with_next(docs.select("doc_id", "text")).select("doc_id", "text", "_part", "_ghost").mapInArrow(fingerprint_rows, SCHEMA)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(common.read(spark, sf_dir, "documents"))
