"""Tags: maps of strings written as [k#v,k#v], and tests on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_tags(text: Column) -> Column:
    """Map of the tags; empty for [] and null."""
    inner = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s*\[|\]\s*$", "")
    pairs = F.filter(F.split(inner, ","), lambda p: F.instr(p, "#") > 0)
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "#", 1).alias("key"), F.substr(p, F.instr(p, "#") + 1).alias("value")))
    return F.map_from_entries(_last_of_each_key(entries))


def _last_of_each_key(entries: Column) -> Column:
    return F.filter(entries, lambda e, i: F.size(F.filter(entries, lambda o, j: (o["key"] == e["key"]) & (j > i))) == 0)


def format_tags(tags: Column) -> Column:
    pairs = F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("#"), e["value"]))
    return F.concat(F.lit("["), F.coalesce(F.concat_ws(",", pairs), F.lit("")), F.lit("]"))


def clean_tag(text: Column) -> Column:
    """White space as a space; quotes, # and commas as _."""
    return F.regexp_replace(F.regexp_replace(text, r"\s", " "), r"[\"'#,]", "_")


def has_tag(tags: Column, keys: list[str], values: list[str] | None = None, substring: bool = False) -> Column:
    """Whether one of the keys is there, with one of the values if given. ``substring``: a key need only be part of the comma-joined list."""
    if substring:
        joined = F.lit(",".join(keys))
        ok = lambda k, v: (F.instr(joined, k) > 0) if values is None else (F.instr(joined, k) > 0) & (F.instr(F.lit(",".join(values)), v) > 0)
    else:
        ok = lambda k, v: k.isin(keys) if values is None else k.isin(keys) & v.isin(values)
    return F.exists(F.map_entries(tags), lambda e: ok(e["key"], e["value"]))


def tags_to_pairs(tags: Column) -> Column:
    """{"k"="v"}{"k"="v"}..., the notation of the road-network extracts."""
    return F.concat_ws("", F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.format_string('{"%s"="%s"}', e["key"], e["value"])))
