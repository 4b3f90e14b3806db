"""Each operator against a plain-Python version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import html as entities
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat_format, common, decontaminate, fingerprint, html, katz, kernels, language, minhash, packing, pii, queries, url_filter

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, texts, **more):
    return spark.createDataFrame([(i, t, *more.values()) for i, t in enumerate(texts)], ", ".join(["doc_id long", "text string", *(f"{k} string" for k in more)]))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def prose(r, n, vocabulary=400):
    return " ".join(f"w{int(vocabulary * r.random() ** 2)}" for _ in range(n))


# url filter


def test_url_rules(spark):
    urls = [
        "http://a.net/x", "https://Example.NET/en/1?q", "http://example.net/fr/", "http://m.example.com/de/5#t", "http://org/fr/", "http://x.org/fr", "http://notexample.com/de/", "http://y.net", "no scheme", None, "", "http://a.b.example.net/en/x/y", "x://u.net?p=/",
    ]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert got == {
        0: ("a.net", "/x", "net/", "block"), 1: ("example.net", "/en/1", "example.net/en/", "allow"), 2: ("example.net", "/fr/", "net/", "block"), 3: ("m.example.com", "/de/5", "example.com/de/", "block"),
        4: ("org", "/fr/", "org/fr/", "allow"), 5: ("x.org", "/fr", None, "allow"), 6: ("notexample.com", "/de/", None, "allow"), 7: ("y.net", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("", "", None, "allow"), 10: ("", "", None, "allow"), 11: ("a.b.example.net", "/en/x/y", "example.net/en/", "allow"), 12: ("u.net", "", None, "allow"),
    }
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0


def test_url_trie_and_join_against_brute_force(spark, monkeypatch):
    r = random.Random(2)
    label, part = lambda: r.choice("abc"), lambda: r.choice(["x", "y", "xy", ""])
    rules = [(".".join(label() for _ in range(r.randint(1, 3))), "/" + "/".join(part() for _ in range(r.randint(0, 3))), r.choice(["allow", "block"])) for _ in range(60)]
    hosts = [(".".join(label() for _ in range(r.randint(1, 4))), "/" + "/".join(part() for _ in range(r.randint(0, 4)))) for _ in range(300)]

    def brute(host, path):
        fits = [(h.count("."), len(p), h + p, a) for h, p, a in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        if not fits:
            return None, "allow"
        best = max(f[:2] for f in fits)
        own = [f for f in fits if f[:2] == best]
        return own[0][2], "block" if any(f[3] == "block" for f in own) else "allow"

    df = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in enumerate(hosts)], "page_id long, url string")
    want = {i: brute(h, p) for i, (h, p) in enumerate(hosts)}
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, action string")
    for got in (url_filter.judge(df, rules), url_filter.judge_table(df, table), url_filter.by_join(df, table)):
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == want
    # keys of many rows are spread; rules with nulls are none; repeated, null and very long urls
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    long = "http://a.b/" + "x/" * 2000
    more = [(1000, None), (1001, long), *[(2000 + i, f"http://{hosts[0][0]}{hosts[0][1]}") for i in range(40)]]
    df = df.union(spark.createDataFrame(more, "page_id long, url string"))
    want |= {1000: (None, "allow"), 1001: brute("a.b", "/" + "x/" * 2000)} | {2000 + i: want[0] for i in range(40)}
    table = table.union(spark.createDataFrame([(None, "/", "block"), ("a", None, "block"), ("a", "/", None)], table.schema))
    for got in (url_filter.judge(df, [tuple(x) for x in table.collect()]), url_filter.judge_table(df, table), url_filter.by_join(df, table)):
        assert {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()} == want and got.count() == df.count()


# decontamination


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    items = [(i, prose(r, r.choice([1, 3, 10, 25]), 30)) for i in range(12)] + [(12, None), (13, " .,! "), (0, "same item again " * 4), (None, prose(r, 12, 30))]
    texts = [prose(r, 60, 30) for _ in range(40)] + [None, "", "...", items[3][1].upper(), prose(r, 3000, 30)]
    for i in range(10):
        texts[i] += " , " + items[i][1].replace(" ", "--") + "!"
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    find = lambda t: pattern.findall((t or "").translate(LOW))
    df = docs_of(spark, texts, hit_items="clash")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (1 << 20, 200):  # one block, and many
        got = {x["doc_id"]: x for x in decontaminate.mark(df, bench, most=most).collect()}
        for i, t in enumerate(texts):
            w, hit, own = find(t), set(), set()
            for item, said in items:
                v = find(said)
                n = min(10, len(v))
                for k in range(len(v) - n + 1 if v else 0):
                    for at in range(len(w) - n + 1):
                        if w[at : at + n] == v[k : k + n]:
                            hit.update(range(at, at + n))
                            own.add("" if item is None else str(item))
            assert got[i]["n_words"] == len(w) and got[i]["hit_items"] == sorted(own)
            assert sum(s["words"] for s in got[i]["hit_spans"]) == len(hit)
    empty = decontaminate.mark(df, bench.limit(0)).where(F.col("doc_id") == 0).first()
    assert empty["hit_spans"] == [] and empty["n_words"] == len(find(texts[0]))
    assert decontaminate.mark(df.limit(0), bench).count() == 0


# katz


def _good_turing(counts):
    """Katz's discounts of counts 1 to 5, of counts of counts on a fitted line; 1 beyond."""
    n = collections.Counter(v for v in counts.values() if v <= 50)
    seen = sorted(n)
    z = []
    for i, v in enumerate(seen):
        low = seen[i - 1] if i else 0
        high = seen[i + 1] if i + 1 < len(seen) else 2 * v - low
        z.append(n[v] / (0.5 * (high - low)))
    b = min(np.polyfit(np.log(seen), np.log(z), 1)[0], -1.001) if len(seen) > 1 else -2.0
    line = lambda v: v**b
    tail = 6 * line(6) / line(1)
    return lambda v: 1.0 if v > 5 else ((v + 1) * line(v + 1) / (v * line(v)) - tail) / (1 - tail)


def _katz(texts, train):
    """The model from its formulas alone: tokens, counts, and the probability of a word after another."""
    toks = {i: [*words(t), "</s>"] for i, t in enumerate(texts)}
    c, b, hc = collections.Counter(), collections.Counter(), collections.Counter()
    for i, w in toks.items():
        if train[i]:
            c.update(w)
            b.update(zip(["<s>", *w[:-1]], w, strict=True))
            hc.update(["<s>", *w[:-1]])
    n, d1, d2 = sum(c.values()), _good_turing(c), _good_turing(b)
    freed = sum(k * (1 - d1(k)) for k in c.values())
    total = n if freed > 0 else n + 1
    p1 = {w: d1(k) * k / total for w, k in c.items()}
    unknown = (freed or 1) / total
    after = collections.defaultdict(dict)
    for (h, w), k in b.items():
        after[h][w] = d2(k) * k
    below = {h: hc[h] + (hc[h] - sum(v.values()) < 1e-6) for h, v in after.items()}

    def p(w, h):
        if w in after.get(h, ()):
            return after[h][w] / below[h]
        lower = p1.get(w, unknown)
        if h not in after:
            return lower
        return (1 - sum(after[h].values()) / below[h]) / (1 - sum(p1[v] for v in after[h])) * lower

    return toks, c, n, p, after


def test_katz_against_brute_force(spark):
    r = random.Random(4)
    texts = [prose(r, r.randint(1, 80), 60) for _ in range(60)] + [None, "", "Only ONCE", "Only ONCE", prose(r, 2000, 60)]
    train = [zlib.crc32(str(i).encode()) % 5 != 1 for i in range(len(texts))]
    toks, c, n, p, back = _katz(texts, train)
    df = docs_of(spark, texts).withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 5 != 1).repartition(3)
    rows = {x["doc_id"]: x for x in katz.score(df).collect()}
    assert len(rows) == len(texts)
    for i, w in toks.items():
        x = rows[i]
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (len(w), sum(t in c for t in w), n, not train[i])
        assert x["base_score"] == pytest.approx(sum(math.log10((c.get(t, 0) + 0.5) / (n + 0.5 * (len(c) + 1))) for t in w))
        assert x["score"] == pytest.approx(sum(math.log10(p(t, h)) for h, t in zip(["<s>", *w[:-1]], w, strict=True)), rel=1e-5)
    for h in [*list(back)[:20], "never seen"]:  # every history's distribution sums to one
        assert sum(p(t, h) for t in c) + p("no such word", h) == pytest.approx(1.0)


def test_discounts_are_good_turing_at_every_size():
    # counts of counts of words and of pairs in corpora of two sizes: the raw estimate of d(4) is above 1 in all of them
    for n in ([47282, 12115, 4986, 2403, 2211, 1010], [184604, 23148, 5982, 1955, 2263, 607], [196853, 56582, 23638, 13634, 12848, 6779], [1480242, 227968, 47069, 19756, 17459, 7018]):
        d = katz.discounts(n)[1:-1]
        want = [_good_turing(dict(enumerate(r for r, k in enumerate(n, 1) for _ in range(k))))(r) for r in range(1, 6)] if sum(n) < 100_000 else d
        assert d == pytest.approx(want) and (d > 0).all() and (d < 1).all() and (np.diff(d) > 0).all()
    for n in ([5], [0, 0, 3], [1, 5, 50, 500], [7, 7, 7, 7, 7]):  # no line, or one that does not fall
        d = katz.discounts(n)[1:-1]
        assert (d > 0).all() and (d < 1).all()


def test_katz_edges(spark):
    df = docs_of(spark, ["a b", "a b"]).withColumn("train", F.lit(False))
    assert {(x["n_known"], x["score"], x["base_score"]) for x in katz.score(df).collect()} == {(0, 0.0, 0.0)}
    assert katz.score(df.limit(0)).count() == 0
    clash = docs_of(spark, ["a b", "a b", None]).withColumns({"train": F.lit(True), "score": F.lit("x"), "bucket": F.lit(1), "n_tokens": F.lit("t")})
    assert sorted(x["n_tokens"] for x in katz.score(clash).collect()) == [1, 3, 3]
    one = katz.score(docs_of(spark, ["a a a a a a a a"]).withColumn("train", F.lit(True))).first()
    assert -100 < one["score"] < 0


# packing


def test_padding_is_least_over_all_counts(spark):
    sizes = [1026] * 5 + [1030, 1031] + [1040] * 2 + [3000, 3001, 3002]
    got = packing.pack(docs_of(spark, ["x " * n for n in sizes]), 4, 8192).collect()
    counts = sorted(set(sizes))
    least = min(sum(min(e for e in (*c, 3002) if e >= n) - n for n in sizes) for c in itertools.combinations(counts[:-1], 3))
    assert sum(x["padded_to"] - x["n_tokens"] for x in got) == least


def test_boundaries_are_optimal():
    r = random.Random(5)
    for buckets in (1, 2, 3):
        lengths = sorted(r.randint(1, 30) for _ in range(25))
        bins = [(v, n, v * n) for v, n in sorted(collections.Counter(lengths).items())]
        cost = lambda edges: sum(min(e for e in edges if e >= v) - v for v in lengths)
        import itertools

        tops = [b[0] for b in bins]
        best = min(cost([*c, tops[-1]]) for k in range(buckets) for c in itertools.combinations(tops[:-1], k))
        got = packing.boundaries(bins, buckets)
        assert len(got) <= buckets and got[-1] == tops[-1] and cost(got) == best


def test_packing(spark):
    r = random.Random(6)
    texts = [prose(r, r.choice([0, 1, 5, 40, 300])) for _ in range(200)] + [None, "", "x " * 20000, "x", "x"]
    got = packing.pack(docs_of(spark, texts, batch="clash").repartition(4), 4, 512).collect()
    assert len(got) == len(texts) and all(x["n_tokens"] == len(words(texts[x["doc_id"]])) for x in got)
    seen, by = set(), collections.Counter()
    for x in got:
        assert x["n_tokens"] <= x["padded_to"]
        key = (x["bucket"], x["batch"], x["slot"])
        assert key not in seen
        seen.add(key)
        by[key[:2]] += 1
    room = {x["bucket"]: max(1, 512 // x["padded_to"]) for x in got}
    for b in room:
        sizes = [n for (k, _), n in sorted(by.items()) if k == b]
        assert all(n == room[b] for n in sizes[:-1]) and sizes[-1] <= room[b]
    assert packing.pack(docs_of(spark, ["x"]).limit(0)).count() == 0


# fingerprints


def test_prefix_hash_spans():
    r = random.Random(7)
    a, b = ([r.randint(1, 3) for _ in range(60)] for _ in range(2))
    b[10:40] = a[20:50]
    x, y = fingerprint.PrefixHash(np.array(a, np.uint32)), fingerprint.PrefixHash(np.array(b, np.uint32))
    for _ in range(400):
        i, j = r.randint(0, 59), r.randint(0, 59)
        n = r.randint(0, 60 - max(i, j))
        assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < 60 and j + k < 60 and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    spans = x.spans(5)
    assert all((spans[i] == spans[j]) == (a[i : i + 5] == a[j : j + 5]) for i in range(56) for j in range(56))


def test_fingerprints(spark):
    r = random.Random(8)
    texts = [prose(r, r.randint(30, 200)) for _ in range(40)] + [None, "", "a", "é😀ß" * 9, "same text here and there", "same text here and there", prose(r, 30000)]
    df = spark.createDataFrame([(3 * i - 10, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {(x["doc_id"] + 10) // 3: x for x in fingerprint.fingerprints(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        t, nxt = t or "", texts[i - 1] or ""  # descending doc_id; after the least comes the largest
        edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i]["near_next"] <= 1 and 0 <= got[i]["near_edited"] <= 1
        if 400 < len(t) < 2000 and len(nxt) > len(t) // 2:
            assert got[i]["near_edited"] > 0.25 > got[i]["near_next"]
    assert got[44]["fingerprint"] == got[45]["fingerprint"] and got[45]["near_next"] == 1.0
    assert got[40]["fingerprint"] == got[41]["fingerprint"] and len({x["fingerprint"] for x in got.values()}) == len(texts) - 2
    alone = fingerprint.fingerprints(docs_of(spark, ["one row only"])).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0
    assert fingerprint.fingerprints(df.limit(0)).count() == 0
    repeated = spark.createDataFrame([(1, "b" * 50), (1, "a" * 50), (None, "c")], "doc_id long, text string")
    assert fingerprint.fingerprints(repeated).count() == 3


def test_fingerprints_of_repeated_ids_do_not_depend_on_settings(spark):
    rows = [(i, f"text {i} " * 9) for i in range(300)] + [(7, f"other {k} " * 7) for k in range(40)] + [(None, "n " * 20), (None, None), (7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = []
    for n in ("1", "3", "40"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got.append(sorted(map(str, fingerprint.fingerprints(df).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] == got[2] and len(got[0]) == len(rows)


@pytest.mark.parametrize("hot", [7, None])
def test_a_hot_id_is_spread(spark, hot):
    """Half of the rows have one id: they fill several parts, and the chain of next documents holds all rows once."""
    rows = [(i, f"text {i} " + "z" * (i % 7)) for i in range(200)] + [(hot, f"hot {i}") for i in range(200)] + [(hot, "hot 3")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(5)
    placed = fingerprint.with_next(df, 16).collect()
    own = [r for r in placed if not r["_ghost"]]
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"]) for r in own) == sorted((i is None, i or 0, t) for i, t in rows)
    sizes = collections.Counter(r["_part"] for r in own)
    assert max(sizes.values()) < 80 and len({r["_part"] for r in own if r["doc_id"] == hot}) > 4
    chain = [(r["doc_id"], r["text"]) for p in sorted(sizes, reverse=True) for r in placed if r["_part"] == p and not r["_ghost"]]
    assert [i for i, _ in chain] == sorted((i for i, _ in rows), key=lambda i: (i is None, -(i or 0)))
    got = fingerprint.fingerprints(df.coalesce(1)).collect()
    assert len(got) == len(rows) and collections.Counter(r["n_chars"] for r in got) == collections.Counter(len(t) for _, t in rows)
    at = {p: k for k, p in enumerate(sorted(sizes, reverse=True))}
    for p, k in at.items():  # each part ends with the row that follows it
        follows = [q for q, j in at.items() if j == (k + 1) % len(at)][0]
        assert next(r["text"] for r in placed if r["_part"] == p and r["_ghost"]) == next(r["text"] for r in placed if r["_part"] == follows and not r["_ghost"])


# chat formatting


def test_chat_round_trip(spark):
    said = ["", "plain", "[/ROLE][NEXT]</s>", "\\o[\\]<\\b", "line\nline", "x" * 30000, "</s>[INST] ok [/INST]", "\\", "ünï😀"]
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", "a]b", None]), r.choice([*said, None])) for c in range(30) for t in range(r.randint(1, 9))]
    rows += [(0, 0, "user", "again"), (None, 0, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    back = {x["conv_id"]: x for x in chat_format.read_back(chat_format.format_chats(df)).collect()}
    chats = collections.defaultdict(list)
    for c, t, role, text in rows:
        chats[c].append((t, role or "", text or ""))
    assert set(back) == set(chats)
    for c, turns in chats.items():
        turns = sorted(turns)
        assert [(x["role"], x["text"]) for x in back[c]["turns"]] == [t[1:] for t in turns]
        f = back[c]["formatted"]
        loss = [f[s["start"] : s["start"] + s["length"]] for s in back[c]["loss_spans"]]
        plain = lambda x: x.replace("\\l", "<").replace("\\c", "]").replace("\\o", "[").replace("\\b", "\\")
        assert [plain(x) for x in loss] == [t[2] for t in turns if t[1] == "assistant"]
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_a_chat_of_many_turns(spark):
    """20,000 turns in proportionate time; other columns are ignored, whatever their names."""
    roles = ["user", "assistant", "assistant", "user", "user", "tool"]
    rows = [(1, t, roles[t % 6], f"[{t}]", "x", "y") for t in range(20000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, loss_spans string")
    began = time.time()
    got = chat_format.read_back(chat_format.format_chats(df)).first()
    assert time.time() - began < 60
    assert [(x["role"], x["text"]) for x in got["turns"]] == [(x[2], x[3]) for x in rows]
    assert [got["formatted"][s["start"] : s["start"] + s["length"]] for s in got["loss_spans"]] == [f"\\o{t}\\c" for t in range(20000) if t % 6 in (1, 2)]


# language


def test_language(spark):
    r = random.Random(10)
    syllables = {"a": ["the", "ing", "ow"], "b": ["eau", "ois", "qué"], "c": ["sch", "ein", "ung"]}
    said = lambda k, n: " ".join("".join(r.choice(syllables[k]) for _ in range(r.randint(1, 3))) for _ in range(n))
    rows = [(i, said("abc"[i % 3], r.randint(5, 60)), "abc"[i % 3]) for i in range(300)] + [(900, None, "a"), (901, "", "a"), (902, "12 34 !!", "b"), (903, said("a", 20), None), (904, said("b", 30000), "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    model = language.train(df, ~held)
    got = {x["doc_id"]: x for x in language.identify(df, model).collect()}
    tested = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == "abc"[i % 3] for i in tested) / len(tested) > 0.95
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 904)] == ["und", "und", "und", "b"]
    assert all(0 <= x["score"] <= 1 for x in got.values())
    kept = language.accept(df, model)
    assert kept.columns == df.columns and {900, 901, 902}.isdisjoint(x["doc_id"] for x in kept.collect())
    nothing = language.train(df.limit(0), F.lit(True))
    assert {x["lang_pred"] for x in language.identify(df, nothing).collect()} == {"und"}
    single = language.train(df.where("lang = 'a'"), F.lit(True))
    assert {x["lang_pred"] for x in language.identify(df.where("doc_id < 300"), single).collect()} == {"a"}


def test_all_languages_are_learnt(spark):
    # 300 languages, the last with one row; and one row of a language beside very many of another
    texts = [f"q{k}z q{k}z{i}" for k in range(299) for i in (0, 1)] + ["ooo"]
    rows = [(i, t, f"l{i // 2:03d}") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert language.train(df, F.lit(True))["languages"] == sorted({x[2] for x in rows})
    two = spark.createDataFrame([(i, "x", "rare" if i < 3 else "common") for i in range(400)], "doc_id long, text string, lang string")
    assert language.train(two, F.lit(True), 6)["languages"] == ["common", "rare"]


def test_codewords_are_apart():
    for n in (2, 3, 4, 5, 6, 12):
        c = language.codewords(n)
        assert len({tuple(r) for r in c}) == n
        if n >= 4:
            assert min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= 3


# near-duplicates


def _components(texts, size, percent):
    sets = []
    for t in texts:
        w = words(t)
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < size else frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)))
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], [len(s) for s in sets]


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_near_duplicates_against_brute_force(spark, size, percent):
    r = random.Random(11)
    texts = [prose(r, r.choice([4, 60, 200])) for _ in range(40)]
    for _ in range(60):
        w = r.choice(texts[:50]).split()
        for _ in range(r.randint(0, max(1, len(w) // 60))):
            w[r.randrange(len(w))] = "changed" + str(r.randint(0, 9))
        texts.append(" ".join(w).upper() if r.random() < 0.3 else " ".join(w))
    texts += [None, None, "", " \t ", "two words", "Two  Words", "word", texts[0], texts[0], prose(r, 20000)]
    want, sizes = _components(texts, size, percent)
    df = docs_of(spark, texts, kept="clash").repartition(4)
    got = {x["doc_id"]: x for x in minhash.near_duplicates(df, size, percent).collect()}
    assert [got[i]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i]["component_id"] for i in range(len(texts))] == want
    assert all(x["kept"] == (i == want[i]) for i, x in got.items())
    kept = minhash.keep_one(df, size=size, percent=percent)
    assert kept.columns == df.columns and sorted(x["doc_id"] for x in kept.collect()) == sorted(set(want))
    assert minhash.near_duplicates(df.limit(0), size, percent).count() == 0


def test_chains_of_links(spark):
    """A long chain: neighbours are linked, ends are far apart."""
    base = [f"t{i}" for i in range(400)]
    texts = [" ".join(base[10 * k : 10 * k + 250]) for k in range(14)]
    want, _ = _components(texts, 3, 85)
    got = sorted((x["doc_id"], x["component_id"]) for x in minhash.near_duplicates(docs_of(spark, texts), 3, 85).collect())
    assert [c for _, c in got] == want == [0] * 14


def test_pairs_of_a_crowded_key_are_all_found(spark):
    # a shared template just below the threshold (172 of 200 words: 0.754); the last twenty are pairs just above it (180 of 200: 0.818)
    pair = [i // 2 * 2 if i >= 280 else i for i in range(300)]
    texts = [" ".join([f"t{k}" for k in range(172)] + [f"p{pair[i]}x{k}" for k in range(8)] + [f"u{i}x{k}" for k in range(20)]) for i in range(300)]
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_duplicates(docs_of(spark, texts), 1, 80).collect()}
    assert got == dict(enumerate(pair))


def test_repeated_rows_are_one_document(spark):
    df = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((x["doc_id"] or 0) for x in minhash.keep_one(df, size=3, percent=85).collect()) == [0, 5]


# personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(d):
    return sum((2 * int(c) - 9 * (2 * int(c) > 9)) if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 12 <= len(d) <= 19 and _luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return [f"{list(BASE)[k]}:{a}:{b}" for a, k, b in sorted(out)]


def test_base_spans_against_regular_expressions(spark):
    r = random.Random(12)
    bits = ["a.b@c.d", "@", "x@y", "1.2.3.4", "300.1.1.1", "1.2.3.4.5.6", "4111 1111-1111 1111", "4111111111111111", "1" * 30, "0000000000000", "+1 (555) 123-4567", "+12", "+1 2 3 4 5 6 7 8 9", "😀", "é", " ", "\n", "-", "++4912345678-", "001.002.003.004", "a@b-.c_d@e.f", "12", "7 7"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", ","]) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, "", "9" * 20000, "x" * 50000, "1 " * 5000, "a." * 3000 + "@" + "b." * 3000, "+" + "1" * 9000]
    got = {x["doc_id"]: x for x in pii.find(docs_of(spark, texts)).withColumn("told", pii.told("base_spans")).collect()}
    for i, t in enumerate(texts):
        assert [x for x in got[i]["told"].split(",") if x] == _base(t), (i, (t or "")[:200])
        base = [tuple(s) for s in got[i]["base_spans"]]
        assert all(s in [tuple(x) for x in got[i]["spans"]] for s in base)


def test_query_counts_each_kind(spark, tmp_path):
    """The query's columns, where the kinds of the spans differ in number and order."""
    texts = ["1.2.3.4 5.6.7.8 9.9.9.9", "a@b.c +1 (555) 123-4567 d@e.f", "4111 1111 1111 1111, 4111111111111111 2.2.2.2", "+49 30 1234567 x@y.z 300.1.1.1", None, "", "no"]
    docs_of(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x["doc_id"]: x for x in pii.op9_pii(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = _base(t)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(b.startswith(f"{k}:") for b in base) for k in BASE], (t, got[i])
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()


def test_added_spans_and_redaction(spark):
    texts = ["write joe [at] host [dot] com now", "call (555) 234-9876 today", "order 123-456-7890-12 shipped", "look (at) this. Thing", "host 10[.]0[.]0[.]7 down", None, "", "me a@b.co and a@b.co"]
    df = docs_of(spark, texts, spans="clash").withColumn("n_chars", F.length("text").cast("long"))
    done = pii.redact(df)
    assert done.columns == df.columns
    got = {x["doc_id"]: x for x in done.collect()}
    assert [got[i]["text"] for i in range(8)] == ["write [EMAIL] now", "call [PHONE] today", texts[2], texts[3], "host [IP] down", None, "", "me [EMAIL] and [EMAIL]"]
    assert got[7]["n_chars"] == len("me [EMAIL] and [EMAIL]") and got[0]["spans"] == "clash"
    assert pii.redact(df.limit(0)).count() == 0


# html


def test_blocks():
    page = """<!DOCTYPE html><html><head><title>t &lt; u</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
    <header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="ad">Buy</div>
    <main><article><header><h1>A &amp; B</h1></header><p>One  <b>bold</b>ly<br>two<p title="a>b">three &amp;amp; four<!-- <p>no</p> --><div id="cookie-notice">Cookies</div>
    <aside>More</aside><ul><li>i<li>j</ul><form>x<input>y</form>tail</article></main><section class="comments"><article>Nice</article></section><footer>f</footer></body></html>"""
    assert [t for z, t in html.blocks(page) if z == "article"] == ["A & B", "One boldly two", "three &amp; four", "i", "j", "tail"]
    assert html.blocks("") == [] and html.blocks("plain <b") == [("rest", "plain")]


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout with-sidebar"><article>A <b>c</b></article><div class="sidebar">s</div></div>',
        '<article class="post category-social"><p>A c</p></article>',
        "<form id=x><nav>n</nav><main>A c</main><footer>f</footer></form>",
        '<div id="page" class="menu-open"><div class="nav-menu">n</div><article>A c</article></div>',
        '<article id="share-prices-rise">A c<div class="share-buttons">b</div></article>',
        '<main><form action="/"><article>A c</article></form></main><div class="related-posts"><article>teaser, and a long one</article></div>',
        '<div class="has-comments"><main><article>A c</article></main><ol class="comment depth-1"><article>a comment longer than the page</article></ol></div>',
        '<div class="shop social-wall"><main>A c</main></div><section class="new"><article>t</article></section>',
        '<div class="social-wall news"><article>less</article></div><main><section><article>A c</article></section></main><div class="ad">x</div>'.replace("less", "l"),
    ],
)
def test_furniture_words_on_wrappers_and_articles_lose_no_article(page):
    found = html.blocks(page)
    assert [t for z, t in found if z == html.main_part(found)] == ["A c"]


def host_pages():
    """Pages of three hosts, open ones and some with a main part, of words that hosts share; blocks by page, marked as furniture or not."""
    r = random.Random(12)
    word = lambda: f"w{r.randrange(40)}"
    runs = [[word() for _ in range(r.randint(6, 14))] for _ in range(9)]
    pages = []
    for i in range(45):
        blocks = []
        for _ in range(r.randint(1, 5)):
            said = [w for _ in range(r.randint(1, 3)) for w in (r.choice(runs) if r.random() < 0.5 else [word() for _ in range(r.randint(1, 12))])]
            blocks.append((r.random() < 0.2, " ".join(said)))
        pages.append((i, f"http://h{i % 3}.org/{i}", blocks, i % 9 == 0))
    return pages + [(100, *pages[4][1:]), (101, None, pages[5][2], False)]


def brute_hosts(pages, run):
    """The texts of open pages by comparing every window of every page with those of the host's other pages."""
    host = lambda url: url.split("/")[2] if url else ""
    streams = {i: [w for _, t in blocks for w in t.split()] for i, _, blocks, _ in pages}
    windows = {i: {tuple(s[k : k + run]) for k in range(len(s) - run + 1)} for i, s in streams.items()}
    out = {}
    for i, url, blocks, main in pages:
        if main:
            out[i] = "the article"
            continue
        others = set().union(*(windows[j] for j, u, _, _ in pages if host(u) == host(url) and streams[j] != streams[i]))
        s, gone = streams[i], set()
        for k in range(len(s) - run + 1):
            if tuple(s[k : k + run]) in others:
                gone |= set(range(k, k + run))
        at, kept = 0, []
        for furniture, text in blocks:
            left = [w for k, w in enumerate(text.split(), at) if k not in gone]
            at += len(text.split())
            if left and not furniture:
                kept.append(" ".join(left))
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("share, tokens", [(250, 400_000), (4, 400_000), (250, 60)])
def test_repeated_runs_of_hosts_against_brute_force(spark, monkeypatch, share, tokens):
    monkeypatch.setattr(html, "TOKENS", tokens)
    pages = host_pages()
    page = lambda blocks, main: "".join(f"<nav>{t}</nav>" if f else f"<p>{t}</p>" for f, t in blocks) + ("<article>the article</article>" if main else "")
    df = spark.createDataFrame([(i, u, page(b, m)) for i, u, b, m in pages], "page_id long, url string, html string").repartition(3)
    want = brute_hosts(pages, html.RUN)
    assert {x["page_id"]: x["text"] for x in html.extract(df, share).collect()} == want
    assert sum(len(want[i].split()) < sum(len(t.split()) for f, t in b if not f) for i, _, b, m in pages if not m) > 20


def test_the_suffix_array_decides_on_hosts_of_one_run(monkeypatch):
    """Without it, nothing of a host's pages is covered: the runs that pages share would stay."""
    pages = [p for p in host_pages() if p[1] and "h1.org" in p[1]]
    rows = [(i, u, "h1.org", 0, [("1" if f else "0") + t for f, t in b], None, not m) for i, u, b, m in pages]
    texts = lambda: html._finish(rows).column(2).to_pylist()
    want = brute_hosts(pages, html.RUN)
    assert texts() == [want[i] for i, _, _, m in pages if not m]
    monkeypatch.setattr(html, "covered", lambda streams, run=8: [[np.zeros(len(t.split()), bool) for t in s] for s in streams])
    assert texts() != [want[i] for i, _, _, m in pages if not m]


def article_pages():
    """Pages of two hosts, all with an article of blocks of kinds p (content) and div (doubtful), after a menu; some are copies under another menu, some without doubtful blocks."""
    r = random.Random(21)
    word = lambda: f"w{r.randrange(400)}"
    boxes = [" ".join(word() for _ in range(r.randint(8, 12))) for _ in range(4)]
    passages = [" ".join(word() for _ in range(r.randint(8, 14))) for _ in range(6)]
    pages = []
    for i in range(60):
        said = [("p", " ".join(word() for _ in range(r.randint(2, 30)))), ("p", r.choice(passages)), ("p", " ".join(word() for _ in range(20)))]
        if i % 5:
            said.insert(r.randint(0, 3), ("div", r.choice(boxes) if r.random() < 0.7 else " ".join(word() for _ in range(9))))
        pages.append((i, f"http://a{i % 2}.org/{i}", [("nav", f"menu {i % 3} of the site"), *said]))
    pages += [(100 + i, pages[i][1], [("nav", f"another menu {i}"), *pages[i][2][1:]]) for i in range(1, 20, 3)]
    pages += [(200 + i, "http://a0.org/x", [("nav", f"menu {i}"), ("p", "short"), ("div", boxes[i % 2]), ("div", f"own {i}")]) for i in range(4)]
    return pages


def article_html(blocks):
    tag = {"p": "<p>{}</p>", "div": '<div class="newsletter-teaser"><b>{}</b></div>'}
    return f"<nav>{blocks[0][1]}</nav><article>" + "".join(tag[k].format(t) for k, t in blocks[1:]) + "</article>"


def brute_articles(pages, run):
    """The texts of articles: doubtful blocks go if covered from end to end by windows of other pages, save in copies and where they are not the lesser part."""
    host = lambda url: url.split("/")[2]
    streams = {i: [w for _, t in blocks for w in t.split()] for i, _, blocks in pages}
    windows = {i: {tuple(s[k : k + run]) for k in range(len(s) - run + 1)} for i, s in streams.items()}
    out = {}
    for i, url, blocks in pages:
        others = set().union(*(windows[j] for j, u, _ in pages if host(u) == host(url) and streams[j] != streams[i]))
        hit = set()
        for k in range(len(streams[i]) - run + 1):
            if tuple(streams[i][k : k + run]) in others:
                hit |= set(range(k, k + run))
        at, found = 0, []
        for kind, text in blocks:
            n = len(text.split())
            found.append((kind, text, [k in hit for k in range(at, at + n)]))
            at += n
        firm = [x for kind, _, m in found if kind == "p" for x in m]
        lesser = sum(len(m) for kind, _, m in found if kind == "div") < len(firm) and 2 * sum(firm) < len(firm)
        out[i] = "\n".join(t for kind, t, m in found if kind == "p" or kind == "div" and not (lesser and all(m)))
    return out


@pytest.mark.parametrize("share, tokens", [(250, 400_000), (4, 400_000), (250, 120)])
def test_articles_against_brute_force(spark, monkeypatch, share, tokens):
    monkeypatch.setattr(html, "TOKENS", tokens)
    pages = article_pages()
    df = spark.createDataFrame([(i, u, article_html(b)) for i, u, b in pages], "page_id long, url string, html string").repartition(3)
    want = brute_articles(pages, html.RUN)
    whole = {i: "\n".join(t for k, t in b[1:]) for i, _, b in pages}
    assert {x["page_id"]: x["text"] for x in html.extract(df, share).collect()} == want
    boxed = [i for i, _, b in pages if any(k == "div" for k, _ in b)]
    assert 15 < sum(want[i] != whole[i] for i in boxed) < len(boxed) - 15


def test_the_suffix_array_decides_in_articles(monkeypatch):
    """Whole articles run through it: without it, no doubtful block of them would go."""
    pages = [p for p in article_pages() if "a1.org" in p[1]]
    rows = [(i, u, "a1.org", 0, html.judged(article_html(b)), None, True) for i, u, b in pages]
    texts = lambda: html._finish(rows).column(2).to_pylist()
    want = brute_articles(pages, html.RUN)
    assert [" ".join(x[1:] for x in r[4]).split() for r in rows] == [" ".join(t for _, t in b).split() for _, _, b in pages]
    assert texts() == [want[i] for i, _, _ in pages]
    monkeypatch.setattr(html, "covered", lambda streams, run=8: [[np.zeros(len(t.split()), bool) for t in s] for s in streams])
    assert texts() == ["\n".join(t for _, t in b[1:]) for _, _, b in pages] != [want[i] for i, _, _ in pages]


def test_sure_furniture_holds_no_main_part():
    for page in ('<div class="sidebar"><article>t</article></div>', "<aside><main>t</main></aside>", '<div class="comments"><article>t</article></div>', '<article class="ad">t</article>', "<form>t</form>", '<div class="with-sidebar">t</div>'):
        assert html.main_part(html.blocks(page)) is None and html.blocks(page) == [("furniture", "t")]



def _extracted(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    return {x["page_id"]: (x["text"], x["n_chars"]) for x in html.extract(df.repartition(3), share=4).collect()}


def test_repeated_runs_go_where_structure_is_silent(spark):
    r = random.Random(13)
    menu = "<div>home news sport weather travel money help about us contact</div>"
    own = [f"{prose(r, 12, 10**6)} unique{i}" for i in range(30)]
    rows = [(i, f"http://h/{i}", f"<body>{menu}<div>{t}</div></body>") for i, t in enumerate(own)]
    rows += [(100, "http://lonely/1", f"<body>{menu}<p>alone</p></body>"), (101, None, None), (102, "http://h/x", ""), (103, "http://h/a", "<article><p>kept</p></article><p>" + menu), (104, "http://h/a", "<article><p>kept</p></article><p>" + menu)]
    got = _extracted(spark, rows)
    assert all(got[i] == (t, len(t)) for i, t in enumerate(own))
    assert got[100][0].startswith("home news") and got[101] == got[102] == ("", 0) and got[103] == got[104] == ("kept", 4)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_a_host_is_searched_as_a_whole(spark, monkeypatch):
    # each notice is on two pages of one host of forty, which is dealt over ten shares; alone, its second page would keep it
    notice = lambda k: " ".join(f"n{k}x{i}" for i in range(10))
    rows = [(i, "http://h.com/%d" % i, f"<p>own {i} words{i}</p><div>{notice(i % 20)}</div>") for i in range(40)]
    want = {i: (f"own {i} words{i}", len(f"own {i} words{i}")) for i in range(40)}
    assert _extracted(spark, rows) == want
    monkeypatch.setattr(html, "TOKENS", 30)
    assert _extracted(spark, rows) == want


def test_covered_against_brute_force():
    r = random.Random(14)
    streams = [[" ".join(r.choice("abcd") for _ in range(r.randint(1, 12))) for _ in range(3)] for _ in range(8)]
    streams.append(streams[0])
    got = html.covered(streams, 4)
    flat = [" ".join(s).split(" ") for s in streams]
    for i, toks in enumerate(flat):
        hit = [False] * len(toks)
        for at in range(len(toks) - 3):
            if any(other != toks and toks[at : at + 4] in [other[k : k + 4] for k in range(len(other) - 3)] for other in flat):
                hit[at : at + 4] = [True] * 4
        assert [bool(x) for b in got[i] for x in b] == hit


def test_decoding_matches_the_library(spark):
    said = "&lt;b&gt; &amp;amp; &#65;&#x42; &copy; &nbsp;x &unknown; a&ampb"
    got = _extracted(spark, [(1, "http://a/", f"<article><p>{said}</p></article>")])
    assert got[1][0] == " ".join(entities.unescape(said).split())


# kernels


def test_kernels_against_plain_python():
    import pyarrow as pa

    r = random.Random(15)
    texts = ["", None, " a B ", "é\tü\x0bx", "no", "x" * 300] + ["".join(r.choice("aB1 \n.é") for _ in range(r.randint(0, 40))) for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])
    seen = []
    for part, data, off in kernels.pieces([batch], "text", 100):
        for kind, pattern in ((kernels.SPACED, r"[^\x20\x09-\x0D]+"), (kernels.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
            start, end, first = kernels.words(data, off, kernels.SPACED if kind is kernels.SPACED else kernels.ALNUM)
            raw = kernels.LOWER[data].tobytes()
            got = [[raw[s:e].decode() for s, e in zip(start[a:b], end[a:b], strict=True)] for a, b in zip(first[:-1], first[1:], strict=True)]
            assert got == [re.findall(pattern, (t or "").translate(LOW)) for t in part.column(0).to_pylist()]
            if kind is kernels.SPACED:
                h = kernels.word_hashes(data, start, end)
                seen += [(w, int(x)) for ws, x in zip([w for g in got for w in g], h, strict=True) for w in [ws]]
    by = collections.defaultdict(set)
    for w, x in seen:
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len({x for _, x in seen}) == len(by)


def test_all_queries_are_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)] and set(queries.SQL) <= set(queries.QUERIES)


def test_tokenizer_states():
    said = lambda page: [t for z, t in html.blocks(page) if z != "furniture"]
    assert said("<p class=it's>Hello</p><p>don't stop</p>") == ["Hello", "don't stop"]
    assert said("<script src=x/>code()</script>t<object>fallback</object>") == ["tfallback"]
    assert said("a < b <1 </ c> <//x> e <svg/>f <p title=\"x>y\">z<a href=u/v>w</a>") == ["a < b <1 e f", "zw"]
    assert said('<article><p class="share-price">a</p><div class="related-work">b</div><div class="share-buttons">c</div><p class="notice">d') == ["a", "b"]
    assert said('<div class="share-price">a</div>b<select><option>c</select>') == ["b"]


@pytest.mark.parametrize("page", ["<svg " * 80000, "<p>" + "</b>" * 60000, "<b><p>" + "<i>" * 5000 + "</b>" * 50000, "<script>" * 50000, "<" * 300000, "<a b='" * 50000])
def test_hostile_pages_take_linear_time(page):
    began = time.perf_counter()
    html.blocks(page)
    assert time.perf_counter() - began < 5


def test_long_runs_of_one_text_take_linear_time(spark):
    m = 1_000_000
    texts = ["x" * m + " a@b.co", "@" + "1" * m + " 1.2.3.4", "1." * (m // 2), "+1" * (m // 2), "abcd:" * (m // 5)]
    began = time.perf_counter()
    got = {x["doc_id"]: x["n"] for x in pii.find(docs_of(spark, texts)).select("doc_id", F.size("base_spans").alias("n")).collect()}
    assert time.perf_counter() - began < 60 and got == {0: 1, 1: 1, 2: m // 8, 3: 0, 4: 0}


def test_many_spans_are_redacted(spark):
    text = "".join(f"x a{i}@b.co é " for i in range(1000)) + "end"
    df = docs_of(spark, [text]).withColumn("n_chars", F.lit(0).cast("long"))
    assert pii.redact(df).first()["text"] == "x [EMAIL] é " * 1000 + "end"


def test_packing_of_a_hot_id(spark):
    """Rows without an id, and rows of one id, are more than the bound: every slot is taken once, batches are full."""
    rows = [(None, "x")] * 300 + [(7, "x y")] * 200 + [(i, "x " * (i % 5)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = packing.pack(df, 2, 16, hot=50).collect()
    assert len(got) == len(rows) and len({(x["bucket"], x["batch"], x["slot"]) for x in got}) == len(rows)
    for b in {x["bucket"] for x in got}:
        own = [x for x in got if x["bucket"] == b]
        room = 16 // own[0]["padded_to"]
        assert sorted(x["batch"] * room + x["slot"] for x in own) == list(range(len(own)))
