"""The two table sets every operator takes and returns.

Lists that can grow with the data (the aliases and members behind one row, the
aliases of one memory point) are tables of their own, one line per element with a
position, never arrays inside a row: one row may stand for a third of the input.
Only things bounded by the width of a header (attribute names, values per
attribute, merge policies) are arrays and maps.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from itemnorm.session import cut_lineage

VALUES = "map<string,string>"

CLUSTERS = (
    "cluster_id bigint, name string, attributes array<string>, enriched_name_template string, "
    "attribute_merge map<string,string>, attribute_merge_separators map<string,string>, "
    "source string, memory_cluster_name string"
)
ROWS = (
    "cluster_id bigint, row_pos bigint, item string, enriched_name string, "
    "values map<string,string>, source string, deleted boolean"
)
ALIASES = "cluster_id bigint, row_pos bigint, alias_pos bigint, alias string"
MEMBERS = (
    "cluster_id bigint, row_pos bigint, member_pos bigint, item string, "
    "values map<string,string>, source string"
)
ITEMS = "cluster_id bigint, item_pos bigint, item string"
POINTS = (
    "item_id string, text string, attributes map<string,string>, cluster_name string, "
    "attribute_merge map<string,string>, attribute_merge_separators map<string,string>, "
    "vec_local array<double>, vec_alt array<double>"
)
POINT_ALIASES = "item_id string, alias_pos bigint, alias string, values map<string,string>"


@dataclass(frozen=True)
class Catalogue:
    """Working set of clusters: header lines, rows, and what is behind each row."""

    clusters: DataFrame
    rows: DataFrame
    aliases: DataFrame
    members: DataFrame
    items: DataFrame

    def with_(self, **parts: DataFrame) -> "Catalogue":
        return replace(self, **parts)

    def stored(self, *parts: str) -> "Catalogue":
        """The named tables written out once, so that what follows plans from files."""
        return replace(self, **{p: cut_lineage(getattr(self, p)) for p in parts})


@dataclass(frozen=True)
class Memory:
    """Known items: one line per point, and the aliases (original items) of each point."""

    points: DataFrame
    aliases: DataFrame

    def with_(self, **parts: DataFrame) -> "Memory":
        return replace(self, **parts)

    def stored(self) -> "Memory":
        """Both tables written out once, so that what reads them several times does not make them again."""
        return Memory(cut_lineage(self.points), cut_lineage(self.aliases))
