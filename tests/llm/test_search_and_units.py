"""Ranked search, token counts and fill-in-the-middle against plain Python, and on the edge cases their docstrings define."""

import collections
import hashlib
import math
import json
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, fill_middle, queries, ranked_search, token_count

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


# ranked search


def brute_search(docs, items, k=10):
    terms = {i: collections.Counter(TERM.findall((t or "").translate(LOW))) for i, (_, t) in enumerate(docs)}
    n = {i: sum(c.values()) for i, c in terms.items()}
    count, total = sum(x > 0 for x in n.values()), sum(n.values())
    df = collections.Counter(t for c in terms.values() for t in c)
    asked = collections.defaultdict(set)
    for item, text in items:
        asked[item] |= set(TERM.findall((text or "").translate(LOW)))
    out = []
    for item, wanted in asked.items():
        scores = []
        for i, c in terms.items():
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n[i] * count // total))) for t in wanted if c[t])
            if s > 0:
                scores.append((-s, docs[i][0] is None, docs[i][0] or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("block_bytes, most", [(1, 1 << 20), (3000, 200), (8 << 20, 1 << 20)])
def test_search_against_brute_force(spark, block_bytes, most):
    r = random.Random(block_bytes)
    word = lambda: f"w{int(60 * r.random() ** 3)}"
    docs = [(i, " ".join(word() for _ in range(r.randint(0, 60)))) for i in range(300)]
    docs += [(1000 + i, docs[7][1]) for i in range(30)]  # ties at the border of the list
    docs += [(5000, None), (5001, ""), (5002, "... --"), (None, "w3 w3 w9"), (7, docs[7][1]), (-4, "W1, Été w1!w2")]
    items = [(f"i{i}", " ".join(word() for _ in range(r.randint(1, 25)))) for i in range(20)] + [("none", None), ("no", "!?"), ("unknown", "zebra"), ("same", docs[7][1]), ("same", "été"), (None, "w5")]
    df = spark.createDataFrame([(d, t, 1.0) for d, t in docs], "doc_id long, text string, score double").repartition(3)
    got = ranked_search.search(df, spark.createDataFrame(items, "item_id string, text string"), most=most, block_bytes=block_bytes)
    assert found(got) == brute_search(docs, items)


def test_search_of_empty_tables_and_one_very_long_text(spark, monkeypatch):
    items = spark.createDataFrame([(1, "b a"), (2, "zz")], "item_id long, text string")
    assert ranked_search.search(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    docs = [(1, "a b " * 50_000 + "zz"), (2, "a"), (3, "x" * 300_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert ranked_search.search(df, items.limit(0)).count() == 0
    assert found(ranked_search.search(df, items)) == brute_search(docs, [(1, "b a"), (2, "zz")])
    data = np.frombuffer(("ab " * 9 + "x" * 70 + " é é").encode(), np.uint8)
    cut = [bytes(p).decode() for p in ranked_search.parts(data, 8)]
    assert "".join(cut) == "ab " * 9 + "x" * 70 + " é é" and sum(len(TERM.findall(c)) for c in cut) == 12


def test_search_stops_early_and_strictly_below_the_kth_score():
    """One list of 10,000 equal impacts and a rare term: ties need all of the equal ones, a better score stops the rounds."""
    rows, terms = np.arange(10_000), np.zeros(10_000, np.int64)
    block = ranked_search.Block(rows, terms, np.full(10_000, 5), 10_000, 1)
    docs, _ = block.search(np.asarray([0]), np.asarray([1]), 10, 1)
    assert len(docs) == 10_000
    block = ranked_search.Block(rows, terms, 20_000 - rows, 10_000, 1)
    seen = []
    block.scores = lambda docs, mine, f=block.scores: (seen.append(len(docs)), f(docs, mine))[1]
    docs, score = block.search(np.asarray([0]), np.asarray([1]), 10, 1)
    assert sum(seen) <= 2 * ranked_search.STEP and sorted(score)[-10:] == list(range(19_991, 20_001))
    assert len(block.search(np.asarray([0]), np.asarray([1]), 10, 30_000)[0]) == 0


def test_search_factor_beyond_64_bits():
    big = 10**11
    got = ranked_search.impacts(np.asarray([3]), np.asarray([2]), np.asarray([10**8]), big, 10**15)
    assert got.tolist() == [3 * (2 * 10**9 // (2000 + 8 * (10 + 90 * 10**8 * big // 10**15)))]


# token counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module", params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def tokenizer(request):
    t = Tokenizer.from_file(public_tokenizers.path(request.param))
    t.no_truncation()
    t.no_padding()
    return t


def hard_texts():
    r = random.Random(4)
    alphabet = ["a", "B", "don't", "'ll", "é", "́", "  ", "\n", " ", "12", "!?", "...", "中文", "，", "é", "ß", "ΣΑΣ", "각", "각", "<|endoftext|>", "<|endof", "|>", "🙂", "‍", "Ünï", "x" * 90, "\t"]
    for n in (1, 5, 40, 300, 900):
        yield "".join(r.choice(alphabet) for _ in range(n))
        yield " ".join(r.choice(alphabet) for _ in range(n))
    yield "q" * 700
    yield "é" * 500 + " " + "́" * 300
    yield "<|endoftext|>" * 60
    yield "中文，" * 200
    yield "a " * 400
    yield " " * 800


@pytest.mark.parametrize("chunk, overlap", [(1, 1), (7, 3), (50, 20), (200, 30), (64, 256)])
def test_spliced_ids_are_those_of_the_whole_text(tokenizer, chunk, overlap):
    for text in hard_texts():
        if chunk < 50 and len(text) > 400:
            text = text[:400]
        got = [i for ids in token_count.spliced(tokenizer, text, chunk, overlap) for i in ids]
        assert got == tokenizer.encode(text, add_special_tokens=False).ids, text[:60]


def test_chunks_are_spliced_not_widened_where_words_are_short(tokenizer):
    asked = []

    class Counting:
        def encode(self, text, **options):
            asked.append(len(text))
            return tokenizer.encode(text, **options)

    text = "some words of a long text, cut anywhere; " * 500
    got = sum(map(len, token_count.spliced(Counting(), text, 1000, 100, token_count.margin(tokenizer))))
    assert got == len(tokenizer.encode(text, add_special_tokens=False).ids) and max(asked) <= 1100 and sum(asked) <= 1.2 * len(text)


def test_token_counts_of_a_table(spark):
    whole = Tokenizer.from_file(PATH)
    texts = [None, "", "a", "<|endoftext|> <|startoftext|>", "Word " * 2048, "word " * 2049, "w" * 40_000, "é, 中文 " * 20_000, "a"]
    df = spark.createDataFrame([(i % 8, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string").repartition(2)
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_count.count_tokens(df, PATH).collect())
    counts = [len(whole.encode(t or "", add_special_tokens=False)) for t in texts]
    assert got == sorted((len((t or "").encode()), n, n > 2048) for t, n in zip(texts, counts, strict=True)) and {2048, 2049} <= set(counts)
    assert token_count.count_tokens(df.limit(0), PATH).count() == 0
    with pytest.raises(ValueError):
        token_count.count_tokens(df, PATH, overlap=0)


def test_distinct_pieces_are_encoded_once(monkeypatch):
    """Counts by pieces are the library's, on odd texts and while held pieces age; only what is not held is encoded."""
    tokenizer, asked = Tokenizer.from_file(PATH), []

    class Counting:
        def encode_batch_fast(self, texts, **options):
            asked.extend(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    with open(PATH, encoding="utf-8") as f:
        model = f.read()
    assert token_count.words_apart(model)
    changes = [("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}), ("normalizer", {"type": "NFKC"}), ("added_tokens", [json.loads(model)["added_tokens"][0] | {"lstrip": True}])]
    assert not any(token_count.words_apart(json.dumps(json.loads(model) | {key: value})) for key, value in changes)
    r = random.Random(8)
    bits = ["a", "B", "Don't", "'", "s", "é", "\u0301", "\u0338", "=", "<", " ", "\n", "\t", "\x1c", "\x85", "\u00a0", "\u2028", "\u3000", "1", "Σ", "İ", "ß", "<|endoftext|>", "<|end", "oftext|>", "\u1100", "\u1161", "가", "🙂", "\u200d", "\x00", "\u0f71\u0f72"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + list(hard_texts())
    want = [len(tokenizer.encode(t, add_special_tokens=False)) for t in texts]
    pieces = token_count.Pieces(Counting(), True)
    assert pieces.count(texts) == want and len(asked) == len(set(asked))
    n = len(asked)
    assert pieces.count(texts) == want and len(asked) == n
    monkeypatch.setattr(token_count, "_HELD", 200)
    pieces = token_count.Pieces(Counting(), True)
    assert [c for i in range(0, len(texts), 50) for c in pieces.count(texts[i : i + 50])] == want
    assert sum(map(len, pieces.new)) + sum(map(len, pieces.old)) <= 4 * max(len("".join(texts[i : i + 50])) for i in range(0, len(texts), 50))
    assert token_count.Pieces(tokenizer, False).count(texts) == want


def test_token_query_against_whole_texts(spark, tables):
    whole = Tokenizer.from_file(PATH)
    texts = {r["doc_id"]: r["text"] or "" for r in common.read(spark, tables, "documents").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op12_token_count"](spark, tables).collect():
        assert r["n_tokens"] == len(whole.encode(texts[r["doc_id"]], add_special_tokens=False)) and r["n_bytes"] == len(texts[r["doc_id"]].encode())


# fill in the middle

UNITS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+", "chars": r"(?s:.)"}


@pytest.mark.parametrize("unit", list(UNITS))
@pytest.mark.parametrize("rate, spm", [(100, 50), (60, 0), (100, 100)])
def test_fill_middle_against_brute_force(spark, unit, rate, spm):
    r = random.Random(6)
    pieces = ["a", "bb ", "\n", "\n\n", " ", "\t", "é中🙂", "<", "P>", "<S", ">", "\r\n", "\x00", "x y", "<P"]
    texts = [None, "", "\n", "no end", "has <S> inside", "<M>"] + ["".join(r.choice(pieces) for _ in range(r.randint(1, 40))) for _ in range(150)]
    rows = [(i if i % 50 else None, t, "clash") for i, t in enumerate(texts)] + [(3, "no end", "")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    made = fill_middle.transform(df, unit, rate=rate, spm=spm).withColumn("again", fill_middle.restore(F.col("output"), F.col("form")))
    got = sorted((tuple(x) for x in made.select("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "again").collect()), key=str)
    want = []
    for i, t, _ in rows:
        text = t or ""
        units = re.findall(UNITS[unit], text)
        digest = hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
            want.append((i, t, len(units), "plain", None, None, text, text))
        elif h[3] % 100 < spm:
            want.append((i, t, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            want.append((i, t, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    assert got == sorted(want, key=str)


def test_fill_middle_of_empty_tables_and_long_texts(spark):
    df = spark.createDataFrame([(1, "line\n" * 400_000), (2, "x" * 1_000_000)], "doc_id long, text string")
    assert fill_middle.transform(df.limit(0)).count() == 0
    made = fill_middle.transform(df).withColumn("again", fill_middle.restore(F.col("output"), F.col("form")))
    assert made.where("again = text and length(output) = length(text) + 9 and form <> 'plain'").count() == 2
    assert [r["n"] for r in made.orderBy("doc_id").collect()] == [400_000, 1]


def test_sentinels_that_overlap_are_refused():
    for bad in (("", "<S>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("<P>", "x<P>y", "<M>"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fill_middle.check_sentinels(bad)
    fill_middle.check_sentinels(("<fim_prefix>", "<fim_suffix>", "<fim_middle>"))
