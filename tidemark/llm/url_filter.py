"""URL filters: a trie over reversed host labels, then path segments; the longest matching rule decides.

A rule is (host, path, action). It fits the host itself and every subdomain, if the url's path starts with the rule's
path. Specificity is the number of host labels, then the length of the path; equal rules: block wins. The trie is
broadcast only after its size was measured; beyond the bound the same node keys are joined (`by_join`). A rule with a null is no rule.

Null urls, and those without "://", have an empty host and path and fit no rule. An empty url table gives an empty
result; repeated rows are judged alike; other columns pass through, columns named host, path, rule or verdict are
replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The fixed rules of the registered query.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("url")))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class Trie:
    """Nested dicts: host labels from the last to the first, then "/" and whole path segments.

    A node's "=" entry maps the rest of a rule's path after its last slash to (rule, action).
    """

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        self.root: dict = {}
        for host, path, action in rules:
            node = self.root
            for label in reversed(host.split(".")) if host else ():
                node = node.setdefault(label, {})
            *whole, rest = path.split("/")
            for segment in ("/", *whole):
                node = node.setdefault((segment,), {})
            ends = node.setdefault("=", {})
            if rest not in ends or action == "block":
                ends[rest] = (host + path, action)

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        found, node = None, self.root
        depths = [node]
        for label in reversed(host.split(".")):
            if (node := node.get(label)) is None:
                break
            depths.append(node)
        for node in reversed(depths):  # the longest host first
            node = node.get(("/",))
            at = 0
            while node is not None:
                ends = node.get("=")
                if ends:
                    rest = path[at:]
                    for k in sorted((k for k in ends if rest.startswith(k)), key=len)[-1:]:
                        found = ends[k]
                cut = path.find("/", at)
                if cut < 0:
                    break
                node, at = node.get((path[at:cut],)), cut + 1
            if found:
                return found
        return None


def judge(urls: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to a table with a url column; rules are a bounded list on the driver."""
    rules = [r for r in rules if None not in r]
    if sum(len(h) + len(p) + len(a) + 200 for h, p, a in rules) > common.BROADCAST_BYTES:
        return by_join(urls, urls.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, action string"), default)
    trie = urls.sparkSession.sparkContext.broadcast(Trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def decide(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        hits = [match(h, p) or (None, default) for h, p in zip(host, path, strict=True)]
        return pd.DataFrame({"rule": [h[0] for h in hits], "verdict": [h[1] for h in hits]})

    return _named(urls).withColumn("_d", decide("host", "path")).withColumns({"rule": F.col("_d.rule"), "verdict": F.col("_d.verdict")}).drop("_d")


def judge_table(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """As judge, with the rules in a table (rule_host, rule_path, action): its measured size picks the way."""
    rules = rules.where("rule_host is not null and rule_path is not null and action is not null")
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("rule_host") + F.length("rule_path") + 210), F.lit(0))).first()
    if size > common.BROADCAST_BYTES:
        return by_join(urls, rules, default)
    return judge(urls, [tuple(r) for r in rules.select("rule_host", "rule_path", "action").limit(n).collect()], default)


def _named(urls: DataFrame) -> DataFrame:
    urls = urls.drop("host", "path", "rule", "verdict")
    return urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


def by_join(urls: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same decision without a broadcast: trie node keys of distinct (host, path) pairs are joined with the rules'.

    Every url has the nodes of its top-level domain, so both joins spread the keys that hold many rows.
    """
    node = lambda host, path: F.concat_ws("\n", host, F.regexp_replace(path, r"[^/]*$", ""))
    rules = rules.where("rule_host is not null and rule_path is not null and action is not null")
    rules = rules.withColumns({"_node": node("rule_host", "rule_path"), "_rest": F.regexp_extract("rule_path", r"([^/]*)$", 1)})
    rules = rules.groupBy("_node", "_rest", "rule_host", "rule_path").agg(F.max("action").alias("action"))
    named = _named(urls)
    pairs = named.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    parts = F.split("path", "/")
    paths = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.lit("/"))))
    keys = pairs.withColumn("_h", F.explode(F.array_union(hosts, F.array(F.lit(""))))).withColumn("_p", F.explode(paths))
    keys = keys.withColumn("_node", F.concat_ws("\n", "_h", "_p")).withColumn("_left", F.expr("substr(path, length(_p) + 1)"))
    hits = common.spread_join(keys, rules, ["_node"]).where(F.expr("startswith(_left, _rest)"))
    order = F.struct(F.when(F.col("rule_host") == "", 0).otherwise(F.size(F.split("rule_host", r"\."))), F.length("rule_path"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("action").alias("verdict")), order).alias("_d"))
    out = common.spread_join(named, best, ["host", "path"], "left").withColumns({"rule": F.col("_d.rule"), "verdict": F.coalesce("_d.verdict", F.lit(default))}).drop("_d")
    return out.select(*named.columns, "rule", "verdict")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
n AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)
SELECT page_id, host, path,
       CASE WHEN fits_en THEN 'example.net/en/' WHEN fits_net THEN 'net/' WHEN fits_de THEN 'example.com/de/' WHEN fits_fr THEN 'org/fr/' END AS rule,
       CASE WHEN fits_en THEN 'allow' WHEN fits_net THEN 'block' WHEN fits_de THEN 'block' ELSE 'allow' END AS verdict
FROM (SELECT *, ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') AS fits_en,
             ends_with('.' || host, '.net') AND starts_with(path, '/') AS fits_net,
             ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') AS fits_de,
             ends_with('.' || host, '.org') AND starts_with(path, '/fr/') AS fits_fr FROM n)
"""
