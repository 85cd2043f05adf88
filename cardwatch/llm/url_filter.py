"""URL filters: a trie over reversed host labels, each node with a trie of path segments.

A rule is (host, path, verdict). It fits its host and all subdomains when the url's path
starts with the rule's path; of all rules that fit, the longest wins (more host labels,
then a longer path; a block entry wins a tie). An url no rule fits gets the default.

The trie is broadcast while the rules hold at most ``TRIE_RULES`` entries of at most
``TRIE_CHARS`` characters. Beyond that the same answer comes from a join: every url
carries its host suffixes to the rules of that host.

Defined cases: a null url, or one without ``://``, has an empty host and path, which only
a rule of an empty host could fit, and gets the default verdict. Repeated pages give
repeated rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardwatch.llm.base import lean

TRIE_RULES = 100_000
TRIE_CHARS = 8_000_000
DEFAULT = "allow"

# Host and path of an url, as DataFrame expressions.
_REST = "if(instr(url, '://') > 0, substring(url, instr(url, '://') + 3), '')"
HOST = f"translate(regexp_extract({_REST}, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = f"regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1)"


def build_trie(rules: Iterable[tuple[str, str, str]]) -> dict:
    """Nodes are {label: node}; under None a host's node has the trie of its paths.

    A path's whole segments lead to a node; its last, maybe unfinished, segment is kept
    there as a beginning that the url's segment must have.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *segments, last = path.split("/")
        for segment in segments:
            node = node.setdefault(segment, {})
        ends = node.setdefault(None, {})
        if ends.get(last, ("", "allow"))[1] == "allow":
            ends[last] = (host + path, verdict)
    return root


def _longest_path(paths: dict, path: str) -> tuple[str, str] | None:
    best, node = None, paths
    for segment in path.split("/"):
        for start in sorted(node.get(None, ()), key=len, reverse=True):
            if segment.startswith(start):
                best = node[None][start]
                break
        node = node.get(segment)
        if node is None:
            break
    return best


def longest_match(trie: dict, host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest fitting rule."""
    best, node = None, trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        if None in node:
            best = _longest_path(node[None], path) or best
    return best


def _judge(trie, default):
    def run(batches):
        for batch in batches:
            hosts, paths = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            found = [longest_match(trie.value, h, p) or (None, default) for h, p in zip(hosts, paths, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([x[k] for x in found], pa.string()) for k in (0, 1))],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    return lean(run)


def judge_urls(
    pages: DataFrame, rules: DataFrame, default: str = DEFAULT, trie_rules: int = TRIE_RULES, trie_chars: int = TRIE_CHARS
) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict of every page.

    rules: host, path, verdict ('allow' or 'block').
    """
    spark = pages.sparkSession
    parts = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).selectExpr(
        "page_id", f"coalesce({HOST}, '') as host", f"coalesce({PATH}, '') as path"
    )
    rules = rules.selectExpr("lower(coalesce(host, '')) as host", "coalesce(path, '') as path", "verdict")
    count, chars = rules.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("host") + F.length("path")), F.lit(0))).first()
    if count <= trie_rules and chars <= trie_chars:
        trie = spark.sparkContext.broadcast(build_trie(map(tuple, rules.collect())))
        return parts.mapInArrow(_judge(trie, default), "page_id long, host string, path string, rule string, verdict string")
    labels = "split(host, '[.]')"
    suffixes = parts.select("host", "path").distinct().select(
        "host", "path",
        F.explode(F.expr(f"transform(sequence(1, size({labels})), k -> array_join(slice({labels}, -k, k), '.'))")).alias("of_host"),
    )
    r = rules.select(F.col("host").alias("of_host"), F.col("path").alias("rule_path"), "verdict")
    fitting = suffixes.join(r, "of_host").where("startswith(path, rule_path)")
    rank = F.struct(
        F.size(F.split("of_host", "[.]")), F.length("rule_path"), F.col("verdict") == "block",
        F.concat("of_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict"),
    )
    best = fitting.groupBy("host", "path").agg(F.max(rank).alias("best"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
