"""Fill-in-the-middle transformation by a sparse event scan.

One Aho-Corasick automaton holds the ASCII characters at which the class of the text changes (the line feed for lines, ASCII white space for
words, none for characters) and the sentinels; a scan of a text gives only these events. The units of the gaps between events are counted
by arithmetic: a line ends after each line feed, and a gap after the last one is one more; a word ends where white space does; a gap of k
characters is k units. So the place after any number of units is looked up among the events, without marking every character.

A text of n units is cut after two ranks that a hash of its id gives (the smaller and the larger), and written in one of two orders:
psm: <P>prefix<S>suffix<M>middle; spm: <S>suffix<P>prefix<M>middle; else plain, as it is. A text that is empty or holds a sentinel stays plain, so
`restore` rebuilds every text from output and form alone. Sentinels must not overlap one another, which is checked.

Null texts are empty: n is 0, form plain, the cuts null. A null doc_id hashes as the empty text. Repeated rows and ids are each transformed for
themselves. Texts of any length are scanned whole, in time and memory in proportion to the text. An empty table gives an empty
result. Other columns pass through; columns with the result's names are replaced. Names with dots are not taken, as in Spark's `mapInArrow`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common, kernels

SEED = 7
SENTINELS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are transformed, and of these in the order spm.
RATE, SPM = 100, 50
#: The ASCII characters that change a text's class, by unit.
CHANGES = {"lines": "\n", "words": " \t\n\v\f\r", "chars": ""}
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Refuses sentinels that could occur across a border: one is empty, holds another, or ends as one begins."""
    for i, a in enumerate(sentinels):
        for j, b in enumerate(sentinels):
            if not a or (i != j and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (i != j))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


class Events:
    """The automaton, and what its events say about a text."""

    def __init__(self, unit: str, sentinels: tuple[str, str, str]):
        self.unit = unit
        self.automaton = ahocorasick.Automaton()
        for c in CHANGES[unit]:
            self.automaton.add_word(c, 0)
        for s in sentinels:
            self.automaton.add_word(s, 1)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[np.ndarray, bool]:
        """The places after class-changing characters, and whether there is a sentinel."""
        found = np.fromiter((2 * end + kind for end, kind in self.automaton.iter(text)), np.int64)
        return (found[found % 2 == 0] >> 1) + 1, bool((found % 2).any())

    def ends(self, places: np.ndarray, size: int) -> np.ndarray | range:
        """Where units end, ascending; the last is the text's end."""
        if self.unit == "chars":
            return range(1, size + 1)
        if self.unit == "words" and len(places):
            places = places[np.append(np.diff(places) > 1, True)]  # white space belongs to the word before it
        return np.append(places, size) if size and not (len(places) and places[-1] == size) else places


def cut(events: Events, text: str, h: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None]:
    """(units, form, end of the prefix, end of the middle)."""
    places, held = events.scan(text)
    ends = events.ends(places, len(text))
    n = len(ends)
    if not text or held or h[2] % 100 >= rate:
        return n, "plain", None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    place = lambda k: int(ends[k - 1]) if k else 0
    return n, "spm" if h[3] % 100 < spm else "psm", place(a), place(b)


def transform(docs: DataFrame, unit: str = "lines", seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """Adds n (units), form, prefix_chars, middle_chars (code points; null if plain) and output."""
    check_sentinels(sentinels)
    docs = docs.drop(*ADDED)
    names = docs.columns
    digest, own = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), "_h"
    while own in names:
        own += "_"
    hashed = docs.withColumn(own, F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]))
    first, second, third = sentinels

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        events = Events(unit, sentinels)
        for batch, _, _ in kernels.pieces(batches, "text"):
            rows, outputs = [], []
            for value, h in zip(batch.column(names.index("text")), batch.column(len(names)).to_pylist(), strict=True):
                text = value.as_py() or ""
                n, form, a, b = cut(events, text, h, rate, spm)
                if form == "psm":
                    outputs.append("".join((first, text[:a], second, text[b:], third, text[a:b])))
                elif form == "spm":
                    outputs.append("".join((second, text[b:], first, text[:a], third, text[a:b])))
                else:
                    outputs.append(text)
                rows.append((n, form, a, None if a is None else b - a))
            n, form, a, m = zip(*rows, strict=True)
            made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(m, pa.int64()), pa.array(outputs, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *made], names=[*names, *ADDED])
        kernels.trim()

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    return hashed.mapInArrow(run, T.StructType([*[T.StructField(f.name, f.dataType, True) for f in docs.schema.fields], *[T.StructField(n, k) for n, k in zip(ADDED, kinds, strict=True)]]))


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The exact text of an output and its form, by Spark expressions."""
    first, second, third = sentinels

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        body = F.substr(output, F.lit(len(one) + 1))
        left = F.substring_index(body, two, 1)
        body = F.substr(body, F.length(left) + len(two) + 1)
        right = F.substring_index(body, third, 1)
        return left, right, F.substr(body, F.length(right) + len(third) + 1)

    prefix, suffix, middle = parts(first, second)
    tail, head, centre = parts(second, first)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(head, centre, tail)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256")
    )


OP13_SQL = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x0A]*\x0A|[^\x0A]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, units, len(units)::BIGINT AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM hashed),
formed AS (
  SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m, array_to_string(units[b + 1:n], '') AS s FROM formed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""
