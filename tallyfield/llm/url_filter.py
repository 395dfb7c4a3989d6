"""Allow and block lists for urls in one trie: reversed host labels, then path segments.

A rule is a host and the start of a path. It fits its host and all subdomains, if the url's path starts with
the rule's. The last segment of a rule's path may be a part of a segment; it is looked up by its length. Of the
rules that fit, the longest (host and path together) wins, whether it allows or blocks; between rules of one
length the one with the longer host.

The trie is broadcast, if its rules have at most ``bound`` characters, whether they come as tuples or as a table. Longer lists are joined: each url's
host suffixes meet the rules' hosts, paths are compared, and the longest is kept by a partial aggregate.

Cases: a null url, or one without ``://``, has an empty host and path and no rule. Repeated urls are judged
each by itself. A rule given twice counts once; given as allow and block, it blocks. No rule: ``default``. Rules
with an empty host fit all urls. A rule without host or path (null) has an empty one; a rule without verdict is left out. Other columns pass through; host, path, rule and verdict replace those names.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import table

#: Host, path, verdict: fixed values of the query.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
ADDED = ("host", "path", "rule", "verdict")


class Trie:
    """``labels`` leads to the node of the next host label to the left; ``segments`` to that of the next path segment;
    ``parts`` has, by length, the rules that end within the next segment."""

    __slots__ = ("labels", "segments", "parts")

    def __init__(self):
        self.labels, self.segments, self.parts = {}, {}, {}

    def add(self, host: str, path: str, verdict: str) -> None:
        node = self
        for label in reversed(host.split(".")) if host else ():
            node = node.labels.setdefault(label, Trie())
        *whole, part = path.split("/")
        for segment in whole:
            node = node.segments.setdefault(segment, Trie())
        known = node.parts.setdefault(len(part), {}).get(part)
        node.parts[len(part)][part] = (len(host) + len(path), len(host), host + path, "block" if known and "block" in (known[3], verdict) else verdict)

    def find(self, host: str, segments: list[str]) -> tuple | None:
        best, node = None, self
        labels = host.split(".")
        for depth in range(len(labels) + 1):
            at = node
            for segment in segments:
                for n, rules in at.parts.items():
                    if (rule := rules.get(segment[:n]) if len(segment) >= n else None) and (best is None or rule[:2] > best[:2]):
                        best = rule
                at = at.segments.get(segment)
                if at is None:
                    break
            node = node.labels.get(labels[-1 - depth]) if depth < len(labels) else None
            if node is None:
                break
        return best


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    rest = (url or "").partition("://")[2]
    cut = min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))
    rest = rest[:cut]
    slash = rest.find("/")
    host = rest if slash < 0 else rest[:slash]
    return host.translate(_LOWER), rest[len(host) :]


def judge(pages: DataFrame, rules, default: str = "allow", bound: int = 16_000_000, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict. ``rules``: (host, path, verdict) tuples, or a DataFrame of those columns."""
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame) and sum(len(h or "") + len(p or "") + 32 for h, p, _ in rules) > bound:
        rules = spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")
    if isinstance(rules, DataFrame):
        rules = rules.where("verdict is not null").select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("host", "path")), "verdict")
        size = rules.agg(F.sum(F.length("host") + F.length("path") + 32)).first()[0] or 0
        if size > bound:
            return _judge_by_join(pages, rules, default, url)
        rules = [tuple(r) for r in rules.collect()]
    trie = Trie()
    for host, path, verdict in sorted({(h or "", p or "", v) for h, p, v in rules if v is not None}):
        trie.add(host.translate(_LOWER), path, verdict)
    held = spark.sparkContext.broadcast(trie)
    rest = [f for f in pages.schema.fields if f.name.lower() not in ADDED]
    place, names = [f.name for f in rest].index(url), [*(f.name for f in rest), *ADDED]

    def run(batches):
        find = held.value.find
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [])
            for text in batch.column(place).to_pylist():
                host, path = split_url(text)
                rule = find(host, path.split("/")) if text and "://" in text else None
                for column, value in zip(columns, (host, path, rule and rule[2], rule[3] if rule else default)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, type=pa.string()) for c in columns)], names=names)

    return pages.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, T.StructType([*rest, *(T.StructField(c, T.StringType()) for c in ADDED)]))


def _judge_by_join(pages: DataFrame, rules: DataFrame, default: str, url: str) -> DataFrame:
    """For lists too long to broadcast. Distinct urls only are joined, so a url on many rows moves once."""
    rest = [f.name for f in pages.schema.fields if f.name.lower() not in ADDED]
    after = lambda c: f"substring_index(substring_index(substring({c}, instr({c}, '://') + 3), '?', 1), '#', 1)"
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    host, path = F.substring_index("_whole", "/", 1), F.expr("substring(_whole, length(substring_index(_whole, '/', 1)) + 1)")
    parts = pages.select(F.col(url).alias("_url")).distinct().where(F.instr("_url", "://") > 0)
    parts = parts.select("_url", F.expr(after("_url")).alias("_whole")).select("_url", lower(host).alias("_host"), path.alias("_path"))
    labels = F.split("_host", r"\.")
    suffix = F.concat(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")), F.array(F.lit("")))
    keys = parts.select("_url", "_path", F.explode(F.array_distinct(suffix)).alias("_at"))
    listed = rules.select(lower(F.col("host")).alias("_at"), F.col("path").alias("_start"), F.col("verdict").alias("_verdict")).distinct()
    met = keys.join(listed, "_at").where(F.expr("startswith(_path, _start)"))
    found = met.groupBy("_url").agg(F.max(F.struct((F.length("_at") + F.length("_start")).alias("n"), F.length("_at").alias("h"), (F.col("_verdict") == "block").alias("b"), F.concat("_at", "_start").alias("rule"), F.col("_verdict").alias("verdict"))).alias("_best"))
    out = pages.select(*(F.col(f"`{c}`") for c in rest)).join(found, F.col(url) == F.col("_url"), "left")
    out = out.withColumn("_whole", F.when(F.instr(url, "://") > 0, F.expr(after(f"`{url}`"))).otherwise(""))
    return out.select(*(F.col(f"`{c}`") for c in rest), lower(host).alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def op8_url_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op8_url_trie": op8_url_trie}
ORACLE = {
    "op8_url_trie": r"""
WITH rules(rh, rp, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                                 ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS r FROM pages),
s AS (SELECT page_id, translate(regexp_extract(r, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             substr(r, length(regexp_extract(r, '^[^/]*')) + 1) AS path FROM u),
m AS (SELECT s.*, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS k
      FROM s LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM m WHERE k = 1
"""
}
