"""File changes named by a patch envelope."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from actiontrail.functions.scalars import let, trim_space

_DIRECTIVE = r"\A\*\*\* (Add File|Update File|Delete File|Move to):\s*(.*\S)\s*\z"


def patch_changes(patch: Column) -> Column:
    """`array<struct<path, delete>>` in source order; a move deletes its source."""
    lines = F.transform(F.split(patch, "\n"), lambda l, i: F.struct(
        i.alias("at"), l.alias("raw"), trim_space(l).alias("text")))
    outside_hunks = lambda l: ~l["raw"].rlike(r"\A(?:[+\- ]|@@)")

    def directives(ls: Column) -> Column:
        framed = F.exists(ls, lambda l: l["text"] == "*** Begin Patch")
        live = F.filter(ls, outside_hunks)
        marks = F.filter(live, lambda l: l["text"].isin("*** Begin Patch", "*** End Patch"))

        def inside(l: Column) -> Column:
            last = F.try_element_at(F.filter(marks, lambda m: m["at"] < l["at"]), F.lit(-1))
            return ~framed | F.coalesce(last["text"] == "*** Begin Patch", F.lit(False))

        named = F.filter(live, lambda l: l["text"].rlike(_DIRECTIVE) & inside(l))
        return F.transform(named, lambda l: F.struct(
            F.regexp_extract(l["text"], _DIRECTIVE, 1).alias("kind"),
            F.regexp_extract(l["text"], _DIRECTIVE, 2).alias("path")))

    def changes(ds: Column) -> Column:
        return F.transform(ds, lambda d, i: F.struct(
            d["path"].alias("path"),
            ((d["kind"] == "Delete File") | ((d["kind"] == "Update File") & F.coalesce(
                F.get(ds, i + 1)["kind"] == "Move to", F.lit(False)))).alias("delete")))

    return let(lines, lambda ls: let(directives(ls), changes))
