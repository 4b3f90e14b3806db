"""Personal data by candidate gradient boosting, in Spark expressions only.

Base spans are what four fixed patterns find, leftmost and without overlap per kind, if a check passes (parts of an
address, Luhn, number of digits). Around them, high-recall generators propose further, overlapping spans (written-out or bracketed
e-mail addresses, telephone numbers without a plus, cards with other separators, defanged and long addresses); boosted trees over format and context
features score each, and a threshold per kind, calibrated on held-back examples to a precision of `PRECISION`, selects those that are
added. Base spans always stay; an added span never overlaps one, nor another added one that starts before it.

The trees are fitted on the driver from a fixed synthetic set of labelled snippets (`examples`, bounded), whose features the same expressions
compute, and are turned into CASE expressions. Nothing of the documents' rows goes through Python.

Positions are code points, ends exclusive. Patterns never repeat a group with backtracking, so long texts cannot exhaust the
regex stack. Null and empty texts have no spans. Repeated rows are treated alike; other columns pass through.
"""

from __future__ import annotations

import functools
import json
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
PART = 128
#: Base patterns. A run of name characters or digits decides as a whole what may follow, so a search begins only where a run does, or where the
#: last match ended (\\G), and never gives characters back: linear in the text. A card of fewer than 12 digits never passes, so it never matches.
BASE = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(_t, '@')"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"rlike(_t, '[0-9]\\.[0-9]')"),
    "card": (r"[0-9](?:[ -]?[0-9]){11,}+", r"rlike(_t, '[0-9][ -]?[0-9]')"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", "contains(_t, '+')"),
}
WIDE = {
    "email": (r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(] ?at ?[\])] ?[a-z0-9-]{1,63}(?: ?(?:[\[(] ?dot ?[\])]|\.) ?[a-z0-9-]{1,63}){1,6}", r"rlike(_t, '(?i)[\\[(] ?at ?[\\])]')"),
    "ip": (r"[0-9]{1,3}(?:[\[(](?:\.|dot)[\])][0-9]{1,3}){3}|(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}", r"rlike(_t, '[0-9][\\[(][.d]|:[0-9A-Fa-f]{1,4}:')"),
    "card": (r"[0-9]{4}(?:[ ./_-]{1,2}[0-9]{4}){2}[ ./_-]{1,2}[0-9]{1,7}", r"rlike(_t, '[0-9]{4}[ ./_-]{1,2}[0-9]{4}')"),
    "phone": (r"\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}", r"rlike(_t, '[0-9]{3}[ .-][0-9]{4}')"),
}
SPAN = "array<struct<kind:int,start:bigint,end:bigint,value:string,before:string,after:string>>"
CONTEXT = 24  # characters before a candidate; no more than since the start of the match before it
FEATURES = ("digits", "luhn", "length", "marks", "first", "brackets", "left_open", "right_open", "hint", "denial", "kind", "repeats")


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(v: Column) -> Column:
    d = F.reverse(_digits(v))
    at = lambda i: F.substring(d, i, F.lit(1)).try_cast("int")
    twice = lambda x: F.when(x > 4, 2 * x - 9).otherwise(2 * x)
    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), F.lit(0), lambda s, i: s + F.coalesce(F.when(i % 2 == 0, twice(at(i))).otherwise(at(i)), F.lit(1)))
    return F.when(F.length(d).between(1, 19), total % 10 == 0).otherwise(False)


def _part(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(short.try_cast("int"), F.lit(0)) <= 255)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), _part),
    "card": lambda v: (F.length(_digits(v)) <= 19) & _luhn(v),
    "phone": lambda v: F.length(_digits(v)).between(9, 15),
}


def _parts(values: Column) -> Column:
    """An array cut into arrays of PART, so that work which grows with the square of an array's size stays small."""
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / PART).cast("int")), lambda i: F.slice(v, i * PART + 1, F.lit(PART)))
    return F.get(F.transform(F.array(values), cut), F.lit(0))  # the array is made once, as a variable


def _find(df: DataFrame, patterns: dict[str, tuple[str, str]], out: str) -> DataFrame:
    """Adds an array column of all matches, by kind, with their positions: what lies between them gives the starts."""
    names = {k: f"{out}_{k}" for k in patterns}
    df = df.withColumns(
        {f"{n}_m": F.when(F.expr(gate), F.regexp_extract_all("_t", F.lit(p), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)")) for (p, gate), n in zip(patterns.values(), names.values(), strict=True)}
    )
    df = df.withColumns({f"{n}_g": F.when(F.size(f"{n}_m") > 0, F.split("_t", patterns[k][0], -1)) for k, n in names.items()})

    def spans(k: str, n: str) -> Column:
        gap, match = lambda i: F.get(f"{n}_g", i), lambda i: F.coalesce(F.get(f"{n}_m", i), F.lit(""))
        before = lambda i: F.substring(F.concat(match(i - 1), gap(i)), -CONTEXT, CONTEXT)
        after = lambda i: F.substring(F.concat(gap(i + 1), match(i + 1)), 1, 1)
        pairs = F.transform(f"{n}_m", lambda v, i: F.struct(v.alias("v"), F.length(gap(i)).cast("long").alias("g"), before(i).alias("b"), after(i).alias("a")))
        parts = F.transform(_parts(pairs), lambda p: F.struct(p.alias("p"), F.aggregate(p, F.lit(0).cast("long"), lambda s, x: s + x["g"] + F.length(x["v"])).alias("size")))
        none = F.expr(f"cast(array() as {SPAN})")

        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["g"]
            end = start + F.length(x["v"])
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(F.lit(KINDS.index(k)).alias("kind"), start.alias("start"), end.alias("end"), x["v"].alias("value"), x["b"].alias("before"), x["a"].alias("after")))).alias("out"))

        def placed(all_parts: Column) -> Column:
            begin = lambda i: F.aggregate(F.slice(all_parts, F.lit(1), i), F.lit(0).cast("long"), lambda s, q: s + q["size"])
            return F.flatten(F.transform(all_parts, lambda q, i: F.aggregate(q["p"], F.struct(begin(i).alias("at"), none.alias("out")), step)["out"]))

        # the parts are made once, as a variable
        return F.when(F.size(f"{n}_m") > 0, F.get(F.transform(F.array(parts), placed), F.lit(0))).otherwise(none)

    df = df.withColumns({n: spans(k, n) for k, n in names.items()})
    df = df.withColumn(out, F.concat(*names.values()))
    return df.drop(*names.values(), *(f"{n}_m" for n in names.values()), *(f"{n}_g" for n in names.values()))


def _valid(s: Column) -> Column:
    out = F.lit(False)
    for i, k in enumerate(KINDS):
        out = F.when(s["kind"] == i, VALID[k](s["value"])).otherwise(out)
    return out


def _order(spans: Column) -> Column:
    by = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(by)


def features(s: Column) -> list[Column]:
    """Format and context of a candidate span, as doubles, in the order of FEATURES."""
    before, after = F.lower(s["before"]), s["after"]
    d, v = _digits(s["value"]), s["value"]
    said = (
        F.length(d), _luhn(v), F.length(v), F.length(F.regexp_replace(v, "[A-Za-z0-9]", "")),
        F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)), F.length(F.regexp_replace(v, r"[^\[\](){}]", "")),
        F.coalesce(~before.rlike(r"[a-z0-9_.+-]$"), F.lit(True)), ~after.rlike(r"[A-Za-z0-9_-]"),
        before.rlike(r"(card|visa|pay|tel|phone|call|fax|mail|write|contact|reach|host|addr|server|login)[^a-z]*[a-z]{0,6}[^a-z]*$"),
        before.rlike(r"(order|invoice|ref|version|isbn|serial|part|model|case|key|sum|total)[^a-z]*[a-z]{0,6}[^a-z]*$"),
        s["kind"], F.size(F.array_distinct(F.split(d, ""))),
    )
    return [x.cast("double") for x in said]


def examples(seed: int = 7, each: int = 60) -> list[tuple[str, int]]:
    """Labelled snippets, each with one candidate: written forms of made-up data, and numbers and phrases that only look like it."""
    r = random.Random(seed)
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))

    def card(good: bool) -> str:
        d = r.choice("3456") + n(14)
        total = sum(int(c) if i % 2 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(d))
        d += str((-total + (0 if good else r.randint(1, 9))) % 10)
        s = r.choice([".", "/", "  ", "_"])
        return s.join((d[:4], d[4:8], d[8:12], d[12:]))

    good = {
        "email": lambda: f"{word()}{r.choice([' [at] ', '(at)', '[at]', ' (at) '])}{word()}{r.choice(['.com', ' [dot] org', '(dot)net', '.example.com'])}",
        "ip": lambda: r.choice(["[.]", "[dot]", "(.)"]).join(str(r.randint(1, 254)) for _ in range(4)) if r.random() < 0.6 else ":".join(f"{r.randrange(65536):x}" for _ in range(8)),
        "card": lambda: card(True),
        "phone": lambda: r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}"]).format(r.choice("23456789") + n(2), r.choice("23456789") + n(2), n(4)),
    }
    bad = {
        "email": lambda: r.choice([f"{word()} (at) {word()}. {word().title()}", f"{word()} [at] {word()}. {word()}"]),
        "ip": lambda: "[.]".join(str(r.randint(300, 999)) for _ in range(4)),
        "card": lambda: card(False),
        "phone": lambda: "{}-{}-{}".format(n(3), r.choice("01") + n(2), n(4)) + r.choice(["", "-" + n(2), "x"]),
    }
    hints, denials = ["call", "tel:", "mail", "contact", "pay by card", "host", "reach me"], ["order", "invoice no.", "ref", "part", "serial"]
    out = []
    for k in KINDS:
        for _ in range(each):
            lead = lambda own: f"{word()} {r.choice(own) if own and r.random() < 0.6 else word()} "
            out.append((lead(hints) + good[k]() + f" {word()}", 1))
            out.append((lead(denials) + bad[k]() + f" {word()}", 0))
        for _ in range(each // 3):
            out.append((f"{word()} {r.choice(denials)} " + (good[k]() if k == "phone" else bad[k]()) + f" {word()}", 0))
    r.shuffle(out)
    return out


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple | float:
    """A regression tree for one boosting step: (feature, threshold, low, high), or a leaf's value."""
    total = grad.sum() ** 2 / (hess.sum() + 1)
    best = (1e-6, None, None)
    if depth:
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            for t in (values[1:] + values[:-1])[:: max(1, len(values) // 32)] / 2:
                m = x[:, j] < t
                gain = grad[m].sum() ** 2 / (hess[m].sum() + 1) + grad[~m].sum() ** 2 / (hess[~m].sum() + 1) - total
                if gain > best[0]:
                    best = (gain, j, float(t))
    if best[1] is None:
        return float(0.3 * grad.sum() / (hess.sum() + 1))
    m = x[:, best[1]] < best[2]
    return (best[1], best[2], _tree(x[m], grad[m], hess[m], depth - 1), _tree(x[~m], grad[~m], hess[~m], depth - 1))


def _apply(tree: tuple | float, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, t, low, high = tree
    return np.where(x[:, j] < t, _apply(low, x), _apply(high, x))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3) -> list:
    trees, score = [], np.zeros(len(x))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, y - p, p * (1 - p), depth))
        score += _apply(trees[-1], x)
    return trees


@functools.lru_cache(maxsize=4)
def model(spark: SparkSession) -> tuple[list, dict[int, float]]:
    """Trees and calibrated thresholds by kind; features of the snippets come from the same expressions as the documents'."""
    said = examples()
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([s for s, _ in said])), "array<string>")).alias("_t"))
    found = _find(rows, WIDE, "_w").select("_t", F.explode("_w").alias("s")).select("_t", F.array(*features(F.col("s"))).alias("f")).limit(4 * len(said)).collect()
    label = dict(said)
    found = sorted(((r["_t"], r["f"]) for r in found), key=repr)
    x, y = np.asarray([f for _, f in found]), np.asarray([label[t] for t, _ in found], float)
    held = np.arange(len(x)) % 3 == 0
    trees = boost(x[~held], y[~held])
    score = sum(_apply(t, x) for t in trees)
    cut = {}
    for k in range(len(KINDS)):
        own = held & (x[:, FEATURES.index("kind")] == k)
        cut[k] = 1e9
        for t in sorted(score[own])[::-1]:
            chosen = own & (score >= t)
            if y[chosen].mean() >= PRECISION:
                cut[k] = float(t)
    return trees, cut


def _score(trees: list, f: list[Column]) -> Column:
    def column(t: tuple | float) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(f[t[0]] < t[1], column(t[2])).otherwise(column(t[3]))

    return functools.reduce(Column.__add__, map(column, trees))


def find(docs: DataFrame) -> DataFrame:
    """Adds base_spans and spans: sorted arrays of (start, kind, end, value), kind as its place in KINDS."""
    trees, cut = model(docs.sparkSession)
    df = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    df = _find(df, BASE, "_b")
    df = df.withColumn("base_spans", _order(F.filter("_b", _valid)))
    df = _find(df, WIDE, "_w")
    apart = lambda s: ~F.exists("base_spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    df = df.withColumn("_w", F.filter("_w", apart))
    threshold = lambda s: functools.reduce(lambda o, k: F.when(s["kind"] == k, F.lit(cut[k])).otherwise(o), cut, F.lit(1e9))
    # features are computed once a candidate, as an array beside it, and the trees read that array
    df = df.withColumn("_f", F.transform("_w", lambda s: F.struct(s.alias("s"), F.array(*features(s)).alias("f"))))
    chosen = F.transform(F.filter("_f", lambda c: _score(trees, [c["f"][i] for i in range(len(FEATURES))]) >= threshold(c["s"])), lambda c: c["s"])
    df = df.withColumn("_a", _order(chosen))
    first = F.aggregate(
        "_a",
        F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint,value:string>>)"),
        lambda acc, s: F.when((F.size(acc) == 0) | (F.try_element_at(acc, F.lit(-1))["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(acc),
    )
    return df.withColumn("spans", F.array_sort(F.concat("base_spans", F.when(F.size("_a") > 0, first).otherwise(F.col("_a"))))).drop("_t", "_b", "_w", "_f", "_a")


def told(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span of text replaced by its kind in brackets, and n_chars counted anew; the same columns."""
    columns = docs.columns
    found = find(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    zero = F.lit(0).cast("long")

    def part(p: Column, i: Column, parts: Column) -> Column:
        """The text from the end of what earlier parts cover to the end of what this part covers."""
        end = lambda spans: F.aggregate(spans, zero, lambda m, s: F.greatest(m, s["end"]))
        begin = F.aggregate(F.slice(parts, F.lit(1), i), zero, lambda m, q: F.greatest(m, end(q)))
        said = lambda at: F.substring(F.col("text"), (at + 1).cast("int"), F.greatest(end(p) - at, zero).cast("int"))

        def step(acc: Column, s: Column, x: Column) -> Column:
            gap = F.substring(x["said"], (acc["at"] - x["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], zero).cast("int"))
            mark = F.when(s["start"] >= acc["at"], F.get(names, s["kind"])).otherwise(F.lit(""))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, mark).alias("out"))

        one = F.transform(F.array(begin), lambda at: F.struct(at.alias("at"), said(at).alias("said")))
        done = F.transform(one, lambda x: F.aggregate(p, F.struct(x["at"].alias("at"), F.lit("").alias("out")), lambda acc, s: step(acc, s, x)))
        return F.get(done, F.lit(0))

    parts = F.get(F.transform(F.array(_parts(F.col("spans"))), lambda all_parts: F.transform(all_parts, lambda p, i: part(p, i, all_parts))), F.lit(0))
    clean = found.withColumn("_d", F.when(F.size("spans") > 0, parts))
    last = F.element_at("_d", -1)["at"]
    said = F.concat(F.array_join(F.transform("_d", lambda x: x["out"]), ""), F.col("text").substr(last.cast("int") + 1, F.length("text")))
    clean = clean.withColumn("text", F.when(F.col("_d").isNull(), F.col("text")).otherwise(said))
    counted = F.when(F.col("_d").isNull(), F.col("_row")["n_chars"] if "n_chars" in columns else F.lit(None)).otherwise(F.length("text").cast("long"))
    new = {"text": F.col("text"), "n_chars": counted}
    return clean.select(*[(new[c] if c in new else F.col("_row").getField(c)).alias(c) for c in columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(common.read(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda i: F.size(F.filter("base_spans", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(told("base_spans").cast("binary"), 256).alias("base_sha256"), told("spans").alias("spans"))
