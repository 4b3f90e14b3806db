"""Language identification against plain Python: profiles, loss-weighted decoding, and the distances of codewords."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language


def plain_profile(text):
    """Square roots of the counts of hashed byte runs of one to three bytes, as a vector of length one; ASCII letters in lower case."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())
    counts = {}
    for size in (1, 2, 3):
        for i in range(len(data) - size + 1):
            key = 0
            for k in range(size):
                key = (key * 0x9E3779B1 + int(language._KEYS[k][data[i + k]])) % 2**64
            at = (key ^ key >> 29) % language.DIMS
            counts[at] = counts.get(at, 0) + 1
    norm = math.sqrt(sum(counts.values())) or 1.0
    return {at: math.sqrt(n) / norm for at, n in counts.items()}


def plain_decode(model, text):
    """(language, score, difference of the two least losses)."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0, None
    profile, bits = plain_profile(text), len(model["bit"])
    margins = [sum(8 * v * float(model["w"][at, b]) for at, v in profile.items()) + float(model["w"][language.DIMS, b]) for b in range(bits)]
    losses = [sum(math.log1p(math.exp(-m * float(c))) * float(model["bit"][b]) for b, (m, c) in enumerate(zip(margins, word, strict=True))) for word in model["code"]]
    ordered = sorted(losses)
    score = 1 / sum(math.exp(-4 * (v - ordered[0])) for v in losses)
    return model["languages"][losses.index(ordered[0])], score, ordered[1] - ordered[0]


@pytest.mark.parametrize("languages", [2, 4, 8])
def test_decoding_against_plain_python(spark, languages):
    rng = random.Random(languages)
    words = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéßжди") for _ in range(rng.randrange(2, 8))) for _ in range(12)] for _ in range(languages)]
    text = lambda i, n: " ".join(rng.choice(words[i]) for _ in range(n))
    rows = [(i, text(i % languages, rng.randrange(4, 30)), f"l{i % languages}") for i in range(60 * languages)]
    rows += [(-1, None, None), (-2, "", None), (-3, "12 34 !", None), (-4, "a", None), (-5, "Ä", None), (-6, text(0, 5) + " " + text(1, 5), None), (-7, text(1, 9000), None)]
    rows += [rows[0], rows[0]]  # repeated rows
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.col("doc_id") % 5 != 2)
    assert model["languages"] == sorted(f"l{i}" for i in range(languages))
    got = language.identify(df, model).collect()
    assert len(got) == len(rows)
    for r in got:
        name, score, gap = plain_decode(model, r["text"])
        assert r["score"] == pytest.approx(score, abs=2e-3), r["text"][:40]
        if gap is None:
            assert r["lang_pred"] == "und" and not r["ambiguous"]
        elif abs(gap) > 1e-3:  # single against double precision
            assert r["lang_pred"] == name
            if abs(gap - language.AMBIGUOUS) > 1e-3:
                assert r["ambiguous"] == (gap < language.AMBIGUOUS)
    held = [r for r in got if r["doc_id"] >= 0 and r["doc_id"] % 5 == 2]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95


@pytest.mark.parametrize("languages", [2, 3, 4, 5, 6, 17, 60])
def test_codewords_correct_wrong_bits(languages):
    code = language.codewords(languages)
    apart = min(int((a != b).sum()) for i, a in enumerate(code) for b in code[:i])
    assert apart >= 1 and not np.any(np.abs(code.sum(0)) == languages)  # no bit is the same for all
    rng, bits = random.Random(1), code.shape[1]
    # classifiers that are sure of a word, but wrong in as many bits as half the distance corrects
    plain = {"languages": list(range(languages)), "code": code, "bit": np.full(bits, 1 / bits, np.float32)}
    for i, word in enumerate(code):
        seen = word.copy()
        for b in rng.sample(range(bits), (apart - 1) // 2):
            seen[b] *= -1
        weights = np.zeros((language.DIMS + 1, bits), np.float32)
        weights[language.DIMS] = 3 * seen
        best, score, _ = language.decode(plain | {"w": weights}, np.zeros((1, language.DIMS), np.float32))
        assert best[0] == i and 0 < score[0] <= 1


def test_equal_losses_take_the_first_language_and_are_ambiguous():
    model = {"languages": ["a", "b"], "code": language.codewords(2), "bit": np.ones(1, np.float32), "w": np.zeros((language.DIMS + 1, 1), np.float32)}
    best, score, close = language.decode(model, np.zeros((1, language.DIMS), np.float32))
    assert best[0] == 0 and score[0] == pytest.approx(0.5) and close[0]


def test_rows_that_share_an_id_are_learnt_from(spark):
    rows = [(1, f"aaa bbb abab {i}", "x") for i in range(40)] + [(2, f"zyz yyy zzzy {i}", "y") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df, F.lit(True), sample=10)
    assert {r["lang_pred"] for r in language.identify(df.where("lang = 'y'"), model).collect()} == {"y"}
