"""The registered queries: SQL where there is any, else plain Python; and the pipeline, stage by stage."""

import os
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from tidemark.llm import common, decontaminate, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, tables, name):
    con = duckdb.connect()
    for f in os.listdir(tables):
        con.sql(f"create view {f.split('.')[0]} as select * from '{tables}/{f}'")
    got, want = queries.QUERIES[name](spark, tables).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(map(str, r)) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


def test_language_is_told_on_held_out_rows(spark, tables):
    got = queries.QUERIES["op7_language"](spark, tables).toPandas().merge(common.read(spark, tables, "documents").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all() and (held.lang_pred == held.lang).mean() > 0.95


def test_held_out_texts_are_likelier_than_by_the_base(spark, tables):
    got = queries.QUERIES["op3_katz"](spark, tables).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.n_known <= got.n_tokens).all()


def test_pipeline(spark, tables):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "decontamination", "pii", "packing"]
    docs = common.read(spark, tables, "documents")
    scratch, columns = common.Scratch(spark, "test"), docs.columns
    before = docs.count()
    ids = None
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.table(stage(spark, docs, tables))
        n = out.count()
        assert n <= before and n == out.select("doc_id").distinct().count()
        if name in ("pii", "packing"):
            assert n == before
        if name != "packing":
            assert out.columns == columns
        docs, before = out, n
        ids = {r[0] for r in out.select("doc_id").collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, tables).select("doc_id").collect()} == ids


def test_pipeline_against_plain_python(spark, tmp_path):
    """Each stage's decisions on a fixture, made by plain loops over all documents, pairs and windows."""
    r = random.Random(21)
    syllables = {"a": ["the", "ing", "ow", "sh"], "b": ["eau", "ois", "qué", "ou"]}
    said = lambda k, n: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 4))) for _ in range(n))
    texts = [(said("ab"[i % 2], r.randint(20, 60)), "ab"[i % 2]) for i in range(80)]
    passage = said("a", 12)
    texts += [(None, "a"), ("12 34 !!", "b"), ("", None)]  # no letters: they go
    texts += [(texts[3][0], "b"), (texts[4][0].upper(), "a"), (texts[6][0] + " tail", "a")]  # copies: they go
    texts += [(f"{said('a', 15)} {passage.upper()} {said('a', 15)}", "a")]  # a benchmark passage: it goes
    texts += [(f"{said('a', 12)} me.you@site.example.org and 10.0.0.7 {said('a', 12)} +1 (555) 123-4567 {said('a', 3)}", "a")]
    docs = pd.DataFrame([(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(texts)], columns=["doc_id", "text", "lang", "source", "n_chars"])
    docs.astype({"n_chars": "Int64"}).to_parquet(tmp_path / "documents.parquet")
    pd.DataFrame([(1, passage), (2, said("b", 25)), (3, None)], columns=["item_id", "text"]).to_parquet(tmp_path / "benchmark.parquet")

    left = {i: t for i, (t, _) in enumerate(texts) if t and any(map(str.isalpha, t))}
    low = lambda t: t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, low(t).split()) for i, t in left.items())}
    group = {i: i for i in left}
    for i in left:
        for j in left:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if v == old else v for k, v in group.items()}
    left = {i: t for i, t in left.items() if group[i] == i}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    windows = {tuple(w[k : k + 10]) for w in map(words, (passage,)) for k in range(len(w) - 9)}
    left = {i: t for i, t in left.items() if not any(tuple(w[k : k + 10]) in windows for w in [words(t)] for k in range(len(w)))}
    clean = {i: t.replace("me.you@site.example.org", "[EMAIL]").replace("10.0.0.7", "[IP]").replace("+1 (555) 123-4567", "[PHONE]") for i, t in left.items()}
    assert set(range(80)) <= set(clean) | {i for i in range(80) if group.get(i) != i} and len(clean) == 81

    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert dict(zip(got.doc_id, got.text, strict=True)) == clean
    assert all(n == len(clean[i].split()) and c == len(clean[i]) for i, n, c in zip(got.doc_id, got.n_tokens, got.n_chars, strict=True))
    counts = sorted(len(t.split()) for t in clean.values())
    tops = sorted(set(counts))
    if len(tops) <= 16:
        assert (got.padded_to == got.n_tokens).all()
    assert (got.padded_to >= got.n_tokens).all() and not got.duplicated(["bucket", "batch", "slot"]).any()


CLASHING = "hit_spans string, n_words long, lang_pred string, score double, ambiguous boolean, _row string, _f string, spans string, kept boolean, component_id long"


def test_stages_on_empty_null_repeated_and_clashing_rows(spark, tables):
    """All but the last stage return the columns they get, with the values of the rows that stay; no stage stops on such rows."""
    more = ("h", 7, "xx", 0.5, True, "r", "f", "s", False, 9)
    said = "the quick brown fox jumps over the lazy dog while a small grey cat sleeps on the warm stone wall " * 2
    rows = [
        (1, said, "en", "s", len(said), *more),
        (1, said, "en", "s", len(said), *more),
        (2, "", "en", None, 0, *more),
        (None, None, None, None, None, *[None] * len(more)),
        (None, "ask me.you@site.example.org " + "z" * 40, None, None, None, *more),
        (3, "Das ist ein ganz anderer Text über Wiesen, Felder und Wälder im Norden des Landes", "de", "t", 9, *more),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, tables)
        if name != "packing":
            assert got.columns == docs.columns
        found = got.collect()
        plain = [tuple(r[c] for c in docs.columns if c not in ("text", "n_chars")) for r in found]
        want = [tuple(r[i] for i, c in enumerate(docs.columns) if c not in ("text", "n_chars")) for r in rows]
        assert all(p in want for p in plain), name
        if name in ("decontamination", "pii", "packing"):
            assert len(found) == len(rows)
        if name == "near_duplicates":
            assert sorted(str(r["doc_id"]) for r in found) == ["1", "2", "3", "None", "None"]
        if name == "pii":
            assert sum("[EMAIL]" in (r["text"] or "") for r in found) == 1
        none = stage(spark, docs.limit(0), tables)
        assert none.count() == 0, name


def test_decontamination_of_repeated_rows_and_null_items(spark):
    passage = " ".join(f"word{i}" for i in range(12))
    docs = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (None, passage.upper())], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, passage), (5, passage), (6, None), (7, "")], "item_id long, text string")
    got = decontaminate.mark(docs, items).collect()
    assert len(got) == 5
    for r in got:
        hit = r["text"] not in (None, "")
        assert r["hit_items"] == (["", "5"] if hit else []) and [tuple(s) for s in r["hit_spans"]] == ([(0, 12)] if hit else [])
