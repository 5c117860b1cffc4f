"""Ordered constraints over nested records of any shape, declared once and read as Columns.

A record is a VARIANT, so a field may be absent, null or of another type than
it should be. A rule that is null or false fails. ``first_failing`` gives the
first in order, as a validator that stops there does, ``failing`` all of them.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    holds: Column


def first_failing(rules: Sequence[Rule]) -> Column:
    out = F
    for r in rules:
        out = out.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name))
    return out.otherwise(F.lit(None).cast("string"))


def failing(rules: Sequence[Rule]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(r.holds, F.lit(False)), F.lit(r.name)) for r in rules]))


class Record:
    """Typed access to the fields of a VARIANT column."""

    def __init__(self, column: str) -> None:
        self.column = column

    def get(self, path: str, kind: str) -> Column:
        return F.expr(f"try_variant_get({self.column}, '$.{path}', '{kind}')")

    def kind(self, path: str) -> Column:
        """The type of what a field holds, null if it is absent."""
        return F.expr(f"schema_of_variant(try_variant_get({self.column}, '$.{path}', 'variant'))")

    def has(self, *paths: str) -> Column:
        out = F.lit(True)
        for p in paths:
            out = out & self.kind(p).isNotNull()
        return out

    def text(self, path: str) -> Column:
        """A string that is not blank."""
        return (self.kind(path) == "STRING") & self.get(path, "string").rlike(r"\S")

    def whole(self, path: str, least: int) -> Column:
        """An integer of at least ``least``."""
        return (self.kind(path) == "BIGINT") & (self.get(path, "bigint") >= least)


# The fields of a chunk record, and the order of its checks.
TOP = ("chunk_id", "content", "embedding", "metadata", "embedding_model", "embedding_dim")
META = ("parent_id", "source", "task", "sequence", "total_chunks", "content_type", "related_chunks", "chunk_length", "created_timestamp")


def chunk_rules(column: str, default_dim: int = 768) -> list[Rule]:
    """What a chunk must be before it is stored, eighteen checks in their order."""
    r = Record(column)
    m = lambda f: f"metadata.{f}"
    vector = r.get("embedding", "array<double>")
    numbers = r.kind("embedding").rlike(r"^ARRAY<(DOUBLE|FLOAT|DECIMAL\(\d+,\d+\)|VOID)>$")
    related = r.kind(m("related_chunks")).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(r.get(m("related_chunks"), "array<string>"), lambda x: x.isNull())
    stamp = r.kind(m("created_timestamp"))
    return [
        Rule("top_fields", r.has(*TOP)),
        Rule("chunk_id", r.text("chunk_id")),
        Rule("content", r.text("content")),
        Rule("embedding_size", r.kind("embedding").startswith("ARRAY") & (F.size(r.get("embedding", "array<variant>")) == F.coalesce(r.get("embedding_dim", "int"), F.lit(default_dim)))),
        Rule("embedding_values", numbers & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))),
        Rule("metadata", r.kind("metadata").startswith("OBJECT")),
        Rule("embedding_model", r.kind("embedding_model") == "STRING"),
        Rule("embedding_dim", r.whole("embedding_dim", 1)),
        Rule("metadata_fields", r.has(*map(m, META))),
        Rule("parent_id", r.text(m("parent_id"))),
        Rule("source", r.text(m("source"))),
        Rule("task", r.text(m("task"))),
        Rule("sequence", r.whole(m("sequence"), 1)),
        Rule("total_chunks", r.whole(m("total_chunks"), 1)),
        Rule("content_type", r.text(m("content_type"))),
        Rule("related_chunks", related),
        Rule("chunk_length", r.whole(m("chunk_length"), 1)),
        Rule("created_timestamp", stamp.startswith("TIMESTAMP") | (stamp == "STRING") & r.get(m("created_timestamp"), "timestamp").isNotNull()),
    ]
