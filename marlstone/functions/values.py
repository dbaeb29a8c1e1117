"""Strict reading of JSON rule values: wrong types read as absent, never as errors; and values with a name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$"


def _raw(json: Column, key: str) -> Column:
    return F.get_json_object(json, f"$.{key}")


def number_field(json: Column, key: str) -> Column:
    """A finite JSON number (not a numeric string) under the key."""
    v = F.try_parse_json(json)
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant"))
    return F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL)"), F.try_variant_get(v, f"$.{key}", "double"))


def bounds(json: Column) -> Column:
    """struct(min, max); null when neither is a number."""
    low, high = number_field(json, "min"), number_field(json, "max")
    return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("min"), high.alias("max")))


def string_list(json: Column, path: str = "$") -> Column:
    """An array whose elements are all strings; null for everything else. Empty is valid."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), v).try_cast("array<variant>")
    return F.when(F.forall(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), F.transform(items, lambda x: x.cast("string")))


def strings_only(json: Column, path: str = "$") -> Column:
    """The string elements of an array; empty for everything else."""
    v = F.try_variant_get(F.try_parse_json(json), path, "variant")
    items = F.when(F.schema_of_variant(v).startswith("ARRAY"), v).try_cast("array<variant>")
    kept = F.transform(F.filter(items, lambda x: F.coalesce(F.schema_of_variant(x) == "STRING", F.lit(False))), lambda x: x.cast("string"))
    return F.coalesce(kept, F.array().cast("array<string>"))


def is_true(json: Column) -> Column:
    return F.coalesce(F.trim(json) == "true", F.lit(False))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is looked at, within lambdas too."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
