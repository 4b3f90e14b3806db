"""Token counts of whole texts, huge ones by overlapping chunks that are resynchronised.

A text of at most `chunk` code points is encoded as it is. A longer one is cut into slices that start every `chunk` code points and run
`overlap` beyond the next start, each encoded with offsets. Two neighbours are spliced at the first proven boundary of their overlap:
- both slices start a pre-token (a word of the tokenizer's splitting pattern) there. The left slice is in step with the whole text from its own
  splice on, as splitting scans from left to right; so from the common start on, the right slice scans what the whole text's scan does;
- it lies at least `margin` code points before the end of both slices, more than a special string or the pattern's look-ahead reaches;
- normalisation can't cross it: its character, or the one before, is ASCII, or it is a starter that composes with nothing before it.
Tokens of the left slice count up to the boundary, those of the right one from it on. Where an overlap holds no such boundary (say a
word longer than the overlap), it is doubled and the left slice encoded again, up to the text's end, so the count is always that of the whole
text. One slice is held at a time. This holds for tokenizers that split by a left-to-right pattern without look-behind before they merge, as
the byte-level and word-end vocabularies do; the tokenizer's file is read by the driver and broadcast (refused above `common.BROADCAST_BYTES`).

Where the tokenizer's file proves that every blank and line end is such a boundary (`words_apart`), a text of at most one chunk is the sum of
the pieces between them, and a worker has each distinct piece encoded once while it holds it (`Pieces`, of bounded size); else such texts are encoded whole.

Null and empty texts have 0 tokens and bytes. Repeated rows and ids are counted each for itself; nothing is grouped or shuffled. Very long texts
take time in proportion to their length (one word of any length is encoded whole, as the library does) and memory of a few copies of the text. An
empty table gives an empty result. Other columns pass through; columns with the result's names are replaced. Names with dots are not
taken, as in Spark's `mapInArrow`.
"""

from __future__ import annotations

import bisect
import json
import os
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

CHUNK, OVERLAP = 16_384, 256
LIMIT = 2048
#: Code points encoded by one call.
_CALL = 1 << 18
#: Characters of pieces (and 8 for each) after which a worker's held counts age; twice as many are held at most, besides those of one call.
_HELD = 1 << 23
#: A splitting pattern that takes no white space into a word and looks at nothing around it.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


@cache
def _joins_backwards() -> frozenset[str]:
    """Characters that canonical composition may join to the one before."""
    found = {chr(c) for lo, hi in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(lo, hi)}  # Hangul vowels and finals
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<":
            found.update(chr(int(p, 16)) for p in parts.split()[1:])
    return frozenset(found)


def stable(text: str, at: int) -> bool:
    """Whether normalisation of the text from `at` on does not depend on what is before it."""
    if text[at].isascii() or (at and text[at - 1].isascii() and not unicodedata.combining(text[at])):
        return True
    first = unicodedata.normalize("NFD", text[at])[0]
    return not unicodedata.combining(first) and first not in _joins_backwards() and text[at] not in _joins_backwards()


def _starts(encoding, base: int) -> tuple[list[int], list[int]]:
    """Places in the text where pre-tokens start, and how many tokens come before each."""
    places, before, last = [], [], None
    for i, (word, (start, _)) in enumerate(zip(encoding.word_ids, encoding.offsets, strict=True)):
        if word != last:
            places.append(base + start)
            before.append(i)
            last = word
    return places, before


def margin(tokenizer) -> int:
    return max([16, *(len(t.content) for t in tokenizer.get_added_tokens_decoder().values())]) + 1


def spliced(tokenizer, text: str, chunk: int = CHUNK, overlap: int = OVERLAP, rim: int | None = None) -> Iterator[list[int]]:
    """The ids of the text's tokens, slice by slice; joined they are those of the whole text."""
    rim, size = margin(tokenizer) if rim is None else rim, len(text)

    def slice_at(start: int, end: int):
        e = tokenizer.encode(text[start:end], add_special_tokens=False)
        return e, *_starts(e, start)

    start, end, skip = 0, min(chunk + overlap, size), 0
    here = slice_at(start, end)
    while end < size:
        following, to = start + chunk, min(max(start + chunk + overlap, end) + chunk, size)  # beyond the left slice's end in any case
        after, wide = slice_at(following, to), overlap
        while True:
            encoding, places, before = here
            inside = set(after[1])
            lo, hi = bisect.bisect_left(places, following), bisect.bisect_right(places, end - rim)
            place = next((k for k in range(lo, hi) if before[k] >= skip and places[k] in inside and stable(text, places[k])), None)
            if place is not None:
                break
            wide *= 2  # no proven boundary: widen the overlap, and the right slice with it
            end = min(following + wide, size)
            here = slice_at(start, end)
            if end == size:
                break
            to = min(end + chunk, size)
            after = slice_at(following, to)
        if place is None:
            break  # the left slice reaches the end of the text
        yield encoding.ids[skip : before[place]]
        start, end, here, skip = following, to, after, after[2][after[1].index(places[place])]
    yield here[0].ids[skip:]


def words_apart(model: str) -> bool:
    """Whether a tokenizer's file lets the tokens of a text be counted piece by piece between blanks and line ends.

    Special strings hold no white space and take none beside them; normalisation composes nothing with a blank or line end and works character by
    character; words are split by a pattern that never meets white space and are merged each for itself.
    """
    d = json.loads(model)
    steps = lambda part, name: [] if not part else part[name] if part["type"] == "Sequence" else [part]
    blanks = lambda n: n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
    plain = all(n["type"] in ("NFC", "Lowercase") or blanks(n) for n in steps(d.get("normalizer"), "normalizers"))
    special = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(c.isspace() for c in t["content"]) for t in d.get("added_tokens", []))
    pre = steps(d.get("pre_tokenizer"), "pretokenizers")
    split = bool(pre) and pre[0]["type"] == "Split" and pre[0]["pattern"] == {"Regex": _APART} and (pre[0]["behavior"], pre[0]["invert"]) == ("Removed", True)
    rest = all(p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"] for p in pre[1:])
    return plain and special and split and rest and d["model"]["type"] == "BPE" and not d["model"].get("dropout")


class Pieces:
    """Token counts of texts, with those of the pieces met lately: a piece that is not met while as many others come as are held goes."""

    def __init__(self, tokenizer, apart: bool):
        self.tokenizer, self.apart, self.new, self.old, self.held = tokenizer, apart, {}, {}, 0

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.apart:
            return self._encoded(texts)
        if self.held > _HELD:
            self.old, self.new, self.held = self.new, {}, 0
        split = [t.replace("\n", " ").split(" ") for t in texts]
        fresh = [p for p in set().union(*split) if p not in self.new]
        known = {p: self.old[p] for p in fresh if p in self.old}
        unknown = [p for p in fresh if p not in known]
        self.new.update(known)
        self.new.update(zip(unknown, self._encoded(unknown), strict=True))
        self.held += sum(map(len, fresh)) + 8 * len(fresh)
        return [sum(map(self.new.__getitem__, pieces)) for pieces in split]


@lru_cache(maxsize=2)
def _loaded(model: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark shares the cores out
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer, Pieces(tokenizer, words_apart(model))


def count_tokens(docs: DataFrame, path: str, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (more than `limit` tokens) by the tokenizer of a JSON file."""
    if chunk < 1 or overlap < 1:
        raise ValueError("chunk and overlap are at least 1")
    spark = docs.sparkSession
    with open(path, encoding="utf-8") as f:
        model = f.read()
    if len(model.encode()) > common.BROADCAST_BYTES:
        raise ValueError("the tokenizer's file is too large to broadcast")
    model = spark.sparkContext.broadcast(model)
    docs = docs.drop("n_bytes", "n_tokens", "over_limit")
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pieces = _loaded(model.value)
        rim = margin(tokenizer)
        for batch, _, _ in kernels.pieces(batches, "text"):
            counts, waiting, held = [0] * batch.num_rows, [], 0

            def settle():
                for (i, _), n in zip(waiting, pieces.count([t for _, t in waiting]), strict=True):
                    counts[i] = n  # noqa: B023
                waiting.clear()  # noqa: B023

            for i, value in enumerate(batch.column(names.index("text"))):
                text = value.as_py() or ""
                if len(text) > chunk + overlap:
                    counts[i] = sum(map(len, spliced(tokenizer, text, chunk, overlap, rim)))
                    continue
                waiting.append((i, text))
                held += len(text)
                if held > _CALL:
                    settle()
                    held = 0
            settle()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], names=[*names, "n_tokens"])
        kernels.trim()

    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], T.StructField("n_tokens", T.LongType())])
    counted = docs.mapInArrow(run, schema)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return counted.select(*[F.col(f"`{c}`") for c in names], size.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")
