"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language gets a codeword; one logistic classifier a bit predicts its sign from the text's byte 1- to 3-gram profile
(A-Z lower-cased, hashed to `DIMS` dimensions, square-rooted and length-normalised). Decoding sums the logistic loss of every bit's
margin against each codeword, weighted by the bit's accuracy on held-back training rows, and takes the language of the least loss; the score is that language's
share after a softmax of the negative losses. A row is flagged ambiguous if the runner-up's loss is closer than `AMBIGUOUS`.

All lang values are learnt. The training sample is bounded: each language has its equal part of `SAMPLE` labelled rows, one at least, and
gets that many rows, or all it has, by least hash of doc_id; whole texts. Scoring covers every row and every byte, map-side only.

Null texts, and texts without a letter, are "und" with score 0. With no labelled rows everything is "und"; with one
language every text with letters gets it, with score 1. Languages of equal loss: the first in order. Repeated rows are
judged alike. Other columns pass through (lang_pred, score and ambiguous are replaced).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

DIMS = 4096
SAMPLE = 3000
AMBIGUOUS = 0.05
_KEYS = np.random.default_rng(11).integers(1, 2**32, (3, 256), dtype=np.uint64)


def profiles(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Row-normalised square roots of hashed 1- to 3-gram counts."""
    rows, n = len(off) - 1, len(data)
    out = np.zeros(rows * DIMS, np.float32)
    low = kernels.LOWER[data]
    at = np.repeat(np.arange(rows, dtype=np.int64) * DIMS, np.diff(off))
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)
    key = np.zeros(n, np.uint64)
    for k in range(3):
        size = n - k
        if size <= 0:
            break
        key = key[:size] * np.uint64(0x9E3779B1) + _KEYS[k][low[k:]]
        where = at[:size] + ((key ^ (key >> np.uint64(29))) % np.uint64(DIMS)).astype(np.int64)
        out += np.bincount(where[left[:size] > k], minlength=rows * DIMS).astype(np.float32)
    out = np.sqrt(out.reshape(rows, DIMS))
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """Rows of +1 and -1: all bipartitions for up to 5 languages, else random words, kept for their least distance."""
    if languages < 2:
        return np.ones((languages, 1), np.float32)
    if languages <= 5:
        bits = [[1] + [1 if b >> j & 1 else -1 for j in range(languages - 1)] for b in range(2 ** (languages - 1) - 1)]
        return np.asarray(bits, np.float32).T.copy()
    rng, best, most = np.random.default_rng(seed), None, -1
    size = int(np.ceil(10 * np.log2(languages)))
    for _ in range(200):
        c = rng.choice(np.asarray([-1, 1], np.float32), (languages, size))
        d = (size - c @ c.T) / 2
        np.fill_diagonal(d, size)
        if d.min() > most and not np.any(np.abs(c.sum(0)) == languages):
            best, most = c, d.min()
    return best


def fit(texts: list[str], labels: list[str], rounds: int = 250) -> dict:
    """Codewords, weights and bit weights; deterministic in its input's order."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    if len(languages) < 2:
        return {"languages": languages, "code": code, "w": np.zeros((DIMS + 1, 1), np.float32), "bit": np.ones(1, np.float32)}
    data, off = kernels.buffers(pa.array(texts, pa.large_string()))
    x = np.concatenate([profiles(data[off[i] : off[j]], off[i : j + 1] - off[i]) for i, j in ((i, min(i + 200, len(texts))) for i in range(0, len(texts), 200))])
    x = np.concatenate([x * 8, np.ones((len(x), 1), np.float32)], 1)
    which = np.asarray([languages.index(v) for v in labels])
    y = code[which]
    held = np.arange(len(x)) % 5 == 0
    held[np.unique(which, return_index=True)[1]] = False  # each language trains on a row at least
    tx, ty = x[~held], y[~held]
    balance = (1.0 / np.bincount(which, minlength=len(languages)))[which][~held, None].astype(np.float32)
    balance /= balance.mean()
    w, step = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros((x.shape[1], y.shape[1]), np.float32)
    for _ in range(rounds):
        grad = -tx.T @ (balance * ty / (1 + np.exp(np.clip(ty * (tx @ w), -30, 30)))) / len(tx) + 1e-5 * w
        step = 0.9 * step - 0.3 * grad
        w += step
    right = ((x[held] @ w) * y[held] > 0).mean(0) if held.any() else np.ones(y.shape[1])
    right = np.clip(right, 0.51, 0.999)
    bit = np.log(right / (1 - right)).astype(np.float32)
    return {"languages": languages, "code": code, "w": w, "bit": bit / bit.sum()}


def decode(model: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language index, score and ambiguity of each profile."""
    margin = np.concatenate([x * 8, np.ones((len(x), 1), np.float32)], 1) @ model["w"]
    loss = np.stack([(np.logaddexp(0, -margin * c) * model["bit"]).sum(1) for c in model["code"]], 1)
    best = loss.argmin(1)
    share = np.exp(-4 * (loss - loss.min(1, keepdims=True)))
    score = 1 / share.sum(1)
    if loss.shape[1] < 2:
        return best, score, np.zeros(len(x), bool)
    two = np.partition(loss, 1, axis=1)
    return best, score, two[:, 1] - two[:, 0] < AMBIGUOUS


def train(docs: DataFrame, learn: Column, sample: int = SAMPLE) -> dict:
    """Fits on `sample` labelled rows, the same number of each language (one at least, and no more than it has), those of least hash."""
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [])
    each, top = max(1, sample // len(counts)), 1 << 30
    rows = rows.select("text", "lang", "doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(top)).alias("p"))

    def below(cuts: dict[str, int]) -> DataFrame:
        table = docs.sparkSession.createDataFrame(list(cuts.items()), "lang string, cut long")
        small = sum(len(k) + 64 for k in cuts) <= common.BROADCAST_BYTES  # beyond that, rows and cuts are joined by lang
        return rows.join(F.broadcast(table) if small else table, "lang").where("p < cut")

    # few more rows than needed come by hash; a language that falls short all the same (its rows repeat) gives all its rows
    cuts = {k: min(top, top * (2 * each + 64) // n) for k, n in counts.items()}
    found = {r["lang"]: r["n"] for r in below(cuts).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    cuts = {k: c if found.get(k, 0) >= min(each, counts[k]) else top for k, c in cuts.items()}
    place = F.row_number().over(W.partitionBy("lang").orderBy("p", "doc_id", "text"))
    picked = below(cuts).withColumn("place", place).where(F.col("place") <= each).select("text", "lang", "p", "doc_id").orderBy("p", "doc_id", "lang", "text").collect()
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(docs: DataFrame, model: dict, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """Adds lang_pred, score and ambiguous (or other names) from the text alone."""
    docs, added = docs.drop(*names), names
    schema = T.StructType([*docs.schema.fields, *[T.StructField(n, t()) for n, t in zip(added, (T.StringType, T.DoubleType, T.BooleanType), strict=True)]])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.asarray([*m["languages"], "und"], object)
        for batch, data, off in kernels.pieces(_short(batches), "text", 1 << 20):
            column = batch.column(batch.schema.get_field_index("text"))
            letters = np.asarray([v is not None and any(map(str.isalpha, v)) for v in column.to_pylist()], bool)
            if m["languages"]:
                best, score, close = decode(m, profiles(data, off))
            else:
                best, score, close = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
                letters[:] = False
            best = np.where(letters, best, len(m["languages"]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names[best], pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64()), pa.array(close & letters)],
                names=[*batch.schema.names, *added],
            )
        kernels.trim()

    return docs.mapInArrow(run, schema)


def _short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most 512 rows a batch: profiles are dense."""
    for b in batches:
        for i in range(0, b.num_rows, 512):
            yield b.slice(i, 512)


def accept(docs: DataFrame, model: dict) -> DataFrame:
    """The rows whose text has a language: neither "und" nor ambiguous; the same columns."""
    names = ["lang_pred", "score", "ambiguous"]
    while set(names) & set(docs.columns):
        names = [f"_{n}" for n in names]
    marked = identify(docs, model, tuple(names))
    return marked.where((F.col(names[0]) != "und") & ~F.col(names[2])).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs, ~held)
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")
