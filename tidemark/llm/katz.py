"""Katz backoff language model: Good-Turing discounted bigram counts over Good-Turing discounted unigrams.

P(w|h) = d(c) c(h w) / c(h) if the bigram was seen in training, else bow(h) P(w); P(w) = d(c) c(w) / N, and what the discounts of
unigrams free is the probability of the one unknown word. bow(h) = (1 - sum of P(w|h)) / (1 - sum of P(w)) over the words seen
after h, so every history's distribution sums to one exactly. A history whose bigrams are all too frequent for a
discount gets one more in its denominator, so that bow(h) is never zero. Discounts d(1..5) are Katz's, of each order's own counts of counts N(r), smoothed as
Good and Turing's estimate needs: a line through log r and log Z(r) (N(r) over its distance to the counts beside it), fitted to r up to `FIT`. At a slope of
b, (r + 1) N(r + 1) / N(r) / r is (1 + 1/r)^(b + 1), so for b below -1 (enforced) every discount lies in (0, 1) and grows with r, at every size of corpus.

Tokens are hashed to 64 bits. Rows are read once into chunks of about `CHUNK` tokens (documents are never cut), stored in the shared folder. A chunk's distinct words
and bigrams, with its training counts, go to key buckets; a bucket sums them over all chunks and answers each chunk in the
order it asked. So a frequent word or bigram costs one key a chunk, not one row a use, and no key is hot. The tables of counts and of history
sums are written to the shared folder as the exchange by kind and bucket deals them, so that each of their files holds whole buckets; each bigram's share of its
history's sums is added up by the one chunk that the bucket names its owner. What moves grows with the distinct bigrams of the chunks.

Nulls are empty texts: one end token. Empty tables give no rows. Without training rows all tokens are unknown. Repeated rows are
scored each; a repeated training row counts each time. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, kernels

CHUNK = 800_000
TOP = 5  # counts beyond are not discounted
FIT = 50  # counts of counts up to this one are smoothed
END, BEGIN = np.uint64(0xE4D), np.uint64(0xB05)  # reserved keys: the end token, and the history of a first word
STATE = "chunk long, n_docs long, n_tokens long, docs binary, lengths binary, train binary, words binary, tokens binary"
ASKED = "kind int, bucket int, chunk long, keys binary, values binary"
ANSWER = "kind int, bucket int, chunk long, payload binary, stats array<long>"


def _zip(a: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    raw = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b""
    return len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def _unzip(b: bytes, kind: np.dtype | type) -> np.ndarray:
    size, kind = int.from_bytes(b[:8], "little"), np.dtype(kind)
    if not size:
        return np.zeros(0, kind)
    raw = np.frombuffer(pa.decompress(b[8:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _zip_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences, whose high bytes are mostly zero."""
    return _zip(np.diff(keys, prepend=np.uint64(0)))


def _unzip_keys(b: bytes) -> np.ndarray:
    return np.cumsum(_unzip(b, np.uint64), dtype=np.uint64)


def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, train) rows to STATE rows."""
    held: list[tuple] = []
    size, made = 0, 0
    base = TaskContext.get().partitionId() << 32 if TaskContext.get() else 0
    schema = pa.schema([("chunk", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), *[(n, pa.binary()) for n in ("docs", "lengths", "train", "words", "tokens")]])

    def emit() -> pa.RecordBatch:
        docs, lengths, train, h = (np.concatenate([x[i] for x in held]) for i in range(4))
        words, tokens, count = np.unique(h, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words first: small numbers
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        row = [base + made, len(docs), len(h), docs.tobytes(), _zip(lengths.astype(np.int32)), _zip(train.astype(np.uint8)), words[order].tobytes(), _zip(place[tokens])]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    for batch, data, off in kernels.pieces(batches, "text"):
        start, end, first = kernels.words(data, off, kernels.SPACED)
        h = kernels.word_hashes(data, start, end)
        h = np.insert(h, first[1:], END)
        lengths = np.diff(first) + 1
        ids = batch.column(0)
        held.append((np.asarray(ids.fill_null(-(2**63)), np.int64), lengths, np.asarray(batch.column(2).to_pylist(), bool), h))
        size += len(h)
        if size >= CHUNK:
            yield emit()
            held, size, made = [], 0, made + 1
            kernels.trim()
    if held:
        yield emit()


class Chunk:
    """A chunk's tokens and its distinct words and bigrams, in the order of their keys."""

    def __init__(self, row: dict):
        self.id = row["chunk"]
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.lengths = _unzip(row["lengths"], np.int32).astype(np.int64)
        self.train = _unzip(row["train"], np.uint8).astype(bool)
        words = np.concatenate([np.frombuffer(row["words"], np.uint64), [BEGIN]])
        tokens = _unzip(row["tokens"], np.int32).astype(np.int64)
        order = np.argsort(words)
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.words, self.tokens = words[order], place[tokens]
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])[:-1]
        history = np.empty_like(self.tokens)
        history[1:] = self.tokens[:-1]
        history[self.first] = place[-1]
        self.history = history
        self.learns = np.repeat(self.train, self.lengths)
        pairs, inverse = np.unique(history * len(words) + self.tokens, return_inverse=True)
        self.h, self.w = pairs // len(words), pairs % len(words)
        key = kernels.mix(self.words[self.h] * np.uint64(0x9E3779B97F4A7C15) + kernels.mix(self.words[self.w], 3), 5)
        order = np.argsort(key)
        place2 = np.empty(len(pairs), np.int64)
        place2[order] = np.arange(len(pairs))
        self.keys, self.h, self.w, self.pairs = key[order], self.h[order], self.w[order], place2[inverse]

    def word_counts(self) -> np.ndarray:
        n = np.bincount(self.tokens[self.learns], minlength=len(self.words))
        n[np.searchsorted(self.words, BEGIN)] = self.train.sum()
        return n

    def pair_counts(self) -> np.ndarray:
        return np.bincount(self.pairs[self.learns], minlength=len(self.keys))


def _edges(buckets: int) -> np.ndarray:
    return np.asarray([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def _cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    return np.concatenate([[0], np.searchsorted(keys, _edges(buckets)), [len(keys)]])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_ASKED = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_ANSWER = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("payload", pa.binary()), ("stats", pa.list_(pa.int64()))])


def ask_counts(buckets: int):
    """STATE rows to ASKED rows: kind 0 words, kind 1 bigrams, with their training counts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                c = Chunk(row)
                for kind, keys, counts in ((0, c.words, c.word_counts()), (1, c.keys, c.pair_counts())):
                    cut = _cuts(keys, buckets)
                    rows = [(kind, b, c.id, _zip_keys(keys[i:j]), _zip(counts[i:j].astype(np.uint32))) for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j]
                    for k in range(0, len(rows), 64):
                        yield _batch(rows[k : k + 64], _ASKED)
                    del rows, keys, counts
                del c, row
                kernels.trim()

    return run


def sum_counts(table: pa.Table) -> pa.Table:
    """All ASKED rows of one kind and bucket to the answers: total counts, and whether the chunk owns the key."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    order = np.argsort(np.asarray(table.column("chunk")), kind="stable")
    table = table.take(pa.array(order))
    keys = [_unzip_keys(b.as_py()) for b in table.column("keys")]
    counts = np.concatenate([_unzip(b.as_py(), np.uint32) for b in table.column("values")]).astype(np.int64)
    unique, owner, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    total = np.zeros(len(unique), np.int64)
    np.add.at(total, inverse, counts)
    own = np.zeros(len(inverse), np.uint8)
    own[owner] = 1
    word = total[unique != BEGIN] if kind == 0 else total
    stats = [int((word > 0).sum()), int(word.sum()), *np.bincount(word[(word > 0) & (word <= FIT)], minlength=FIT + 1)[1:].tolist()]
    rows, at = [], 0
    for chunk, k in zip(table.column("chunk").to_pylist(), keys, strict=True):
        part = slice(at, at + len(k))
        answer = total[inverse[part]].astype(np.uint64)
        packed = (answer << np.uint64(1) | own[part]).astype(np.uint32 if answer.max(initial=0) < 2**31 else np.uint64)
        rows.append((kind, bucket, chunk, bytes([packed.dtype.itemsize]) + _zip(packed), None))
        at += len(k)
    rows.append((kind, bucket, -1, None, stats))
    kernels.trim()
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


def slope(counts_of_counts: list[int]) -> float:
    """The slope of the line through (log r, log Z(r)) of all N(r) > 0; -2 where fewer than two are."""
    n = np.asarray([0, *counts_of_counts], float)
    r = np.flatnonzero(n)
    if len(r) < 2:
        return -2.0
    below = np.concatenate([[0], r[:-1]])
    above = np.concatenate([r[1:], [2 * r[-1] - below[-1]]])
    x, y = np.log(r), np.log(2 * n[r] / (above - below))
    x -= x.mean()
    return float(x @ y / (x @ x))


def discounts(counts_of_counts: list[int]) -> np.ndarray:
    """d(r) for r = 0..TOP + 1; the last stands for all larger counts."""
    d = np.ones(TOP + 2)
    if any(counts_of_counts):
        b = min(slope(counts_of_counts) + 1, -1e-3)
        rest = np.expm1(b * np.log(TOP + 1))  # (TOP + 1) N(TOP + 1) / N(1), less 1
        d[1:-1] = (np.expm1(b * np.log1p(1 / np.arange(1, TOP + 1))) - rest) / -rest
    return d


class Model:
    """What all chunks share: totals, discounts, and the unknown word's probability."""

    def __init__(self, words: list[int], pairs: list[int]):
        self.distinct, self.tokens = words[0], words[1]
        self.d1, self.d2 = discounts(words[2:]), discounts(pairs[2:])
        freed = sum(n * r * (1 - self.d1[r]) for r, n in enumerate(words[2 : TOP + 2], 1))
        self.n = self.tokens + (freed <= 0)
        self.unknown = 1.0 if not self.tokens else (freed if freed > 0 else 1.0) / self.n

    def unigram(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.d1[np.minimum(c, TOP + 1)] * c / max(self.n, 1), self.unknown)

    def discounted(self, c: np.ndarray) -> np.ndarray:
        return self.d2[np.minimum(c, TOP + 1)] * c


def _answers(parts: list[dict]) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for p in sorted(parts, key=lambda p: (p["kind"], p["bucket"])):
        out.setdefault(p["kind"], []).append(p["payload"])
    return out


def _counts(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    packed = np.concatenate([_unzip(p[1:], np.uint32 if p[0] == 4 else np.uint64).astype(np.int64) for p in parts])
    return packed >> 1, (packed & 1).astype(bool)


def ask_sums(buckets: int, model: Model):
    """STATE rows with answers to ASKED rows of kind 2: each history's count, and the sums over the bigrams the chunk owns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                c, got = Chunk(row), _answers(row["parts"])
                (count, _), (pair, own) = _counts(got[0]), _counts(got[1])
                own &= pair > 0
                star = np.bincount(c.h[own], model.discounted(pair[own]), len(c.words))
                low = np.bincount(c.h[own], model.unigram(count[c.w[own]]), len(c.words))
                cut = _cuts(c.words, buckets)
                rows = [
                    (2, b, c.id, _zip_keys(c.words[i:j]), b"".join(len(z).to_bytes(8, "little") + z for z in (_zip(count[i:j]), _zip(star[i:j]), _zip(low[i:j]))))
                    for b, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if i < j
                ]
                for k in range(0, len(rows), 64):
                    yield _batch(rows[k : k + 64], _ASKED)

    return run


def _three(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    out = []
    for kind in (np.int64, np.float64, np.float64):
        size = int.from_bytes(b[:8], "little")
        out.append(_unzip(b[8 : 8 + size], kind))
        b = b[8 + size :]
    return tuple(out)


def backoff(count: np.ndarray, star: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 of bow(h), and each history's denominator."""
    more = (star > 0) & (count - star < 1e-6)
    below = np.maximum(count + more, 1).astype(float)
    bow = np.where(star > 0, (1 - star / below) / np.maximum(1 - low, 1e-300), 1.0)
    return np.log10(bow), below


def sum_histories(table: pa.Table) -> pa.Table:
    """All ASKED rows of kind 2 of one bucket to the answers: log10 bow and denominator of every history asked for."""
    bucket = table.column("bucket")[0].as_py()
    table = table.take(pa.array(np.argsort(np.asarray(table.column("chunk")), kind="stable")))
    keys = [_unzip_keys(b.as_py()) for b in table.column("keys")]
    parts = [_three(b.as_py()) for b in table.column("values")]
    unique, at, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    count = np.concatenate([p[0] for p in parts])[at]
    star, low = (np.bincount(inverse, np.concatenate([p[k] for p in parts]), len(unique)) for k in (1, 2))
    bow, below = backoff(count, star, low)
    extra = (below > np.maximum(count, 1)).astype(np.uint8)
    rows, i = [], 0
    for chunk, k in zip(table.column("chunk").to_pylist(), keys, strict=True):
        which = inverse[i : i + len(k)]
        z = _zip(bow[which].astype(np.float32))
        rows.append((2, bucket, chunk, len(z).to_bytes(8, "little") + z + _zip(extra[which]), None))
        i += len(k)
    kernels.trim()
    return pa.Table.from_batches([_batch(rows, _ANSWER)])


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, held_out boolean"


def evaluate(model: Model):
    """STATE rows with all answers to scores: per token the bigram if it was seen, else its history's weight and the unigram."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                c, got = Chunk(row), _answers(row["parts"])
                (count, _), (pair, _) = _counts(got[0]), _counts(got[1])
                bow, extra = [], []
                for p in got[2]:
                    size = int.from_bytes(p[:8], "little")
                    bow.append(_unzip(p[8 : 8 + size], np.float32))
                    extra.append(_unzip(p[8 + size :], np.uint8))
                bow, extra = np.concatenate(bow).astype(float), np.concatenate(extra)
                below = np.maximum(count, 1) + extra
                seen = np.log10(np.maximum(model.discounted(pair), 1e-300) / below[c.h])
                each = np.where(pair > 0, seen, bow[c.h] + np.log10(model.unigram(count[c.w])))
                word = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.distinct + 1)))
                ids = pa.array(c.docs, mask=c.docs == -(2**63))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(c.lengths), pa.array(np.add.reduceat((count > 0)[c.tokens].astype(np.int64), c.first)), pa.array(np.full(len(c.docs), model.tokens)),
                        pa.array(np.add.reduceat(word[c.tokens], c.first)), pa.array(np.add.reduceat(each[c.pairs], c.first)), pa.array(~c.train),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "held_out"],
                )

    return run


def score(docs: DataFrame) -> DataFrame:
    """Trains on the rows of (doc_id, text, train) whose train is true, and scores every row."""
    spark = docs.sparkSession
    scratch = common.Scratch(spark, "katz")
    state = scratch.table(docs.select(F.col("doc_id").cast("long"), "text", F.coalesce("train", F.lit(False)).alias("train")).mapInArrow(chunks, STATE), compression="zstd")
    total = state.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total:
        return spark.createDataFrame([], SCORES)
    buckets = max(64, -(-total // 1_000_000))
    answers = scratch.table(state.mapInArrow(ask_counts(buckets), ASKED).groupBy("kind", "bucket").applyInArrow(sum_counts, ANSWER), compression="none")
    common.free(spark)
    sums = answers.where("chunk = -1").groupBy("kind").agg(*[F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(FIT + 2)]).collect()
    by = {r["kind"]: [int(r[f"s{i}"]) for i in range(FIT + 2)] for r in sums}
    model = Model(by[0], by[1])
    parts = lambda a: a.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("kind", "bucket", "payload")).alias("parts"))
    asked = state.join(parts(answers), "chunk").mapInArrow(ask_sums(buckets, model), ASKED)
    histories = scratch.table(asked.groupBy("kind", "bucket").applyInArrow(sum_histories, ANSWER), compression="none")
    common.free(spark)
    return state.join(parts(answers.union(histories)), "chunk").mapInArrow(evaluate(model), SCORES)


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = score(docs.select("doc_id", "text", (common.crc_mod(F.col("doc_id"), 5) != 1).alias("train")))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
