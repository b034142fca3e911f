"""URL filter: allow and block rules in a trie of reversed host labels and path segments.

The library's item records hold no addresses, so this operator is general: it takes any frame with an
id and a `url` column.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from itemnorm.llm.common import id_type, map_batches

MAX_RULES = 1_000_000
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    """verdict 'allow' or 'block'; the host with all its subdomains; the start of the path."""

    verdict: str
    host: str
    path: str


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' without '://'."""
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to '?', '#' or the end; '' without '://'."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


@dataclass
class _PathNode:
    children: dict[str, "_PathNode"] = field(default_factory=dict)
    #: Starts of one more segment at which a rule ends.
    ends: dict[str, UrlRule] = field(default_factory=dict)


@dataclass
class _HostNode:
    children: dict[str, "_HostNode"] = field(default_factory=dict)
    paths: _PathNode | None = None


class UrlTrie:
    """Longest host and path first; of an allow and a block entry for the same place, block holds."""

    def __init__(self, rules: Sequence[UrlRule]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"the trie is broadcast, so it takes {MAX_RULES} rules at most")
        self.root = _HostNode()
        for rule in rules:
            node = self.root
            for label in reversed(rule.host.split(".")) if rule.host else ():
                node = node.children.setdefault(label, _HostNode())
            node.paths = place = node.paths or _PathNode()
            *whole, last = rule.path.split("/")
            for segment in whole:
                place = place.children.setdefault(segment, _PathNode())
            held = place.ends.get(last)
            if held is None or rule.verdict == "block":
                place.ends[last] = rule

    def match(self, host: str, path: str) -> UrlRule | None:
        best, length = None, (-1, -1)
        node, labels = self.root, reversed(host.split("."))
        while node is not None:
            if node.paths is not None and (rule := self._longest_path(node.paths, path)) is not None:
                size = (len(rule.host) + len(rule.path), len(rule.host))
                if size > length:
                    best, length = rule, size
            label = next(labels, None)
            node = None if label is None else node.children.get(label)
        return best

    @staticmethod
    def _longest_path(node: _PathNode, path: str) -> UrlRule | None:
        best = None
        for segment in path.split("/"):
            if node.ends:
                for cut in range(len(segment), -1, -1):
                    if (rule := node.ends.get(segment[:cut])) is not None:
                        best = rule
                        break
            node = node.children.get(segment)
            if node is None:
                break
        return best


def filter_urls(pages: DataFrame, rules: Sequence[UrlRule], default: str = "allow", id_column: str = "page_id") -> DataFrame:
    """id, host, path, rule, verdict of every page; `default` where no rule fits.

    pages(page_id, url, ...): only these two columns are read. A null url, or one without '://', has an
    empty host and path and so fits a rule only if that has both empty. Repeated rows give repeated
    results, an empty table an empty result. The trie travels in the task closure; its size is the
    caller's rule list, at most MAX_RULES.
    """
    trie = UrlTrie(rules)
    ids = pages.select(F.col(id_column), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    schema = f"`{id_column}` {id_type(pages, id_column)}, host string, path string, rule string, verdict string"

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [trie.match(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        rule = pa.array([None if r is None else r.host + r.path for r in found], pa.string())
        verdict = pa.array([default if r is None else r.verdict for r in found], pa.string())
        return pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*batch.schema.names, "rule", "verdict"])

    return map_batches(ids, judge, schema)
