"""Column builders over tag lists, relations and names; all stay inside JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: The forms of a tag, with and without a sign.
TAG = r"^(-?)(\w+)\((.+)\)$"
UNSIGNED_TAG = r"^(\w+)\((.+)\)$"


def parsed(tags: Column, pattern: str = TAG) -> Column:
    """array<struct<ord,key,value>> of the tags that match, in order; a sign stays in front of its value."""
    signed = pattern == TAG
    key, value = (2, 3) if signed else (1, 2)
    entries = F.transform(
        tags,
        lambda t, i: F.struct(
            i.alias("ord"),
            F.regexp_extract(F.trim(t), pattern, key).alias("key"),
            F.concat(F.regexp_extract(F.trim(t), pattern, 1) if signed else F.lit(""), F.regexp_extract(F.trim(t), pattern, value)).alias("value"),
            F.trim(t).rlike(pattern).alias("ok"),
        ),
    )
    return F.filter(entries, lambda e: e["ok"])


def values(entries: Column, key: str) -> Column:
    """Values of one key, in order; an empty array where there are none."""
    return F.coalesce(F.transform(F.filter(entries, lambda e: e["key"] == key), lambda e: e["value"]), F.array().cast("array<string>"))


def semantics(tags: Column) -> Column:
    return values(parsed(tags), "Semantics")


def _in(x: Column, words) -> Column:
    return x.isin(*words)


def first_of(sem: Column, words) -> Column:
    """The first semantic tag of a vocabulary, else null."""
    return F.get(F.filter(sem, lambda x: _in(x, words)), F.lit(0))


def first_not_of(sem: Column, words, default: str | None = None) -> Column:
    found = F.get(F.filter(sem, lambda x: ~_in(x, words)), F.lit(0))
    return found if default is None else F.coalesce(found, F.lit(default))


def any_of(sem: Column, words) -> Column:
    return F.exists(sem, lambda x: _in(x, words))


def state_type(sem: Column) -> Column:
    """The first registered kind that the semantics name; base by default."""
    kind = F.when(F.array_contains(sem, "base"), "base")
    for name in vocab.MESH_TYPES:
        kind = kind.when(F.array_contains(sem, name), name)
    return kind.otherwise("base")


def prim_name(obj: Column) -> Column:
    return F.translate(F.regexp_replace(obj, r"\.meshed$", ""), "-/.()", "_____")


def prim_base(obj: Column) -> Column:
    """The older rule: brackets stay."""
    return F.translate(F.regexp_replace(obj, r"\.meshed$", ""), "-/.", "___")


def prim_name_object(obj: Column) -> Column:
    return F.translate(obj, ".()", "___")


def door_label(sem: Column) -> Column:
    return F.when(F.array_contains(sem, "entrance"), "entrance").otherwise("door")


def translation(matrix: Column, row: int) -> Column:
    """Element (row, 3) of a translation matrix; null where it is missing."""
    return F.get(F.get(matrix, F.lit(row)), F.lit(3))


def truthy(text: Column) -> Column:
    """JSON truth as a scripting language sees it: absent, false, zero and empty values are false."""
    return F.coalesce(~F.lower(text).isin("false", "0", "0.0", "", "null", "[]", "{}"), F.lit(False))
