"""Label sets (maps of strings) as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import METRIC_LABEL


def entries(m: Column) -> Column:
    """The canonical form: an array of structs (key, value) in order of name and value."""
    return F.array_sort(F.map_entries(m))


def add_label(m: Column, name: str, value: str | Column) -> Column:
    """With one more label; a label that is there stays as it is."""
    v = value if isinstance(value, Column) else F.lit(value)
    return F.when(F.map_contains_key(m, name), m).otherwise(F.map_concat(m, F.create_map(F.lit(name), v)))


def del_label(m: Column, name: str) -> Column:
    return F.map_filter(m, lambda k, _: k != name)


def labels_string(m: Column) -> Column:
    """``{a=1,b=2}``, in canonical order."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), F.lit("}"))


def metric_of(m: Column) -> Column:
    """The metric's name, empty if there is none."""
    return F.coalesce(m[METRIC_LABEL], F.lit(""))


def source_group(m: Column) -> Column:
    """All labels but the metric's name, as ``{a+1b+2}``; for display, as different sets can read alike."""
    rest = F.filter(entries(m), lambda e: e["key"] != METRIC_LABEL)
    return F.concat(F.lit("{"), F.array_join(F.transform(rest, lambda e: F.concat(e["key"], F.lit("+"), e["value"])), ""), F.lit("}"))


def labels_from_pairs(*parts: str) -> Column:
    """A label set of names and values in turn; an odd number of parts gives an empty one."""
    if len(parts) % 2:
        parts = ()
    if not parts:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*map(F.lit, parts))


def keep_labels(m: Column, names: list[str]) -> Column:
    """Grouping key of an aggregation ``by`` some labels."""
    return F.map_filter(m, lambda k, _: k.isin(names))


def drop_labels(m: Column, names: list[str]) -> Column:
    """Grouping key of an aggregation ``without`` some labels, and without the metric's name."""
    return F.map_filter(m, lambda k, _: ~k.isin([*names, METRIC_LABEL]))


def labels_hash(m: Column) -> Column:
    return F.xxhash64(F.to_json(entries(m)))


def by_hash(m: Column, names: list[str]) -> Column:
    return labels_hash(keep_labels(m, names))


def without_hash(m: Column, names: list[str]) -> Column:
    return labels_hash(drop_labels(m, names))


def name_hashes(m: Column) -> Column:
    return F.transform(entries(m), lambda e: F.xxhash64(e["key"]))


def value_hashes(m: Column) -> Column:
    return F.transform(entries(m), lambda e: F.xxhash64(e["value"]))


def metric_hash(m: Column) -> Column:
    return F.xxhash64(metric_of(m))


def source_hash(m: Column) -> Column:
    return labels_hash(del_label(m, METRIC_LABEL))


def compare_labels(a: Column, b: Column) -> Column:
    """-1, 0 or 1: label sets by their entries in turn, then by length."""
    x, y = entries(a), entries(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
