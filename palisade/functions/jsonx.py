"""JSON: canonical hashing, path reads, right-biased merge, reference URLs."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct_sha256(**fields: Column) -> Column:
    """SHA-256 of a compact JSON object with its keys in order; nulls are written as ``null``."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def _refuse(token: str):
    raise ValueError(token)


def _canonical_sha(text):
    if text is None:
        return None
    try:
        value = json.loads(text, parse_constant=_refuse)
    except ValueError:
        return None
    encoded = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(encoded.encode()).hexdigest()


@F.pandas_udf(T.StringType())
def escaped_sha256(values: pd.Series) -> pd.Series:
    """Hash of canonical JSON in which non-ASCII characters are written as lower-case escapes."""

    def digest(text):
        if text is None:
            return None
        body = json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))
        return hashlib.sha256(body.encode()).hexdigest()

    return values.map(digest, na_action="ignore")


@F.pandas_udf(T.StringType())
def payload_sha256(values: pd.Series) -> pd.Series:
    """Hash of an arbitrary JSON payload in canonical form; null if it is not finite JSON.

    Number text has to follow one printer, so arbitrary payloads are re-printed by Python's
    ``json`` in Arrow batches. Payloads of a known shape use ``struct_sha256`` in the JVM.
    """
    return values.map(_canonical_sha, na_action="ignore")


def strict_json(col: Column) -> Column:
    """VARIANT of a text that is one whole JSON value, else null.

    Spark's parser stops after the first value and ignores what follows. So the text is parsed as
    the first item of an array whose second item is the text's own hash, which the text cannot
    contain: only if the parser reaches that item was everything before it one value.
    """
    mark = F.sha2(col, 256)
    pair = F.try_parse_json(F.concat(F.lit("["), col, F.lit(',"'), mark, F.lit('"]')))
    whole = F.try_variant_get(pair, "$[1]", "string") == mark
    return F.when(whole, F.try_variant_get(pair, "$[0]", "variant"))


def variant_kind(col: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN or VOID, without the inner types."""
    return F.regexp_extract(F.schema_of_variant(col), r"^([A-Z]+)", 1)


def fields(col: Column) -> Column:
    """Top-level members of a VARIANT object as a map, null for anything that is not an object."""
    return F.try_variant_get(col, "$", "map<string,variant>")


def kinds(members: Column) -> Column:
    """Kind of every member; a JSON null counts as VOID."""
    return F.transform_values(members, lambda _, v: F.coalesce(variant_kind(v), F.lit("VOID")))


class Members:
    """Typed reads of named members, given the member map and its kind map.

    Both maps belong in a projection of their own, so that each object is taken apart once.
    """

    def __init__(self, members: Column, member_kinds: Column):
        self.members, self.member_kinds = members, member_kinds

    def item(self, name: str) -> Column:
        return F.try_element_at(self.members, F.lit(name))

    def kind(self, name: str) -> Column:
        """Empty text for an absent member."""
        return F.coalesce(F.try_element_at(self.member_kinds, F.lit(name)), F.lit(""))

    def text(self, name: str) -> Column:
        return F.when(self.kind(name) == "STRING", self.read(name, "string"))

    def read(self, name: str, kind: str) -> Column:
        return F.try_variant_get(self.item(name), "$", kind)


def merge_right(left: Column, right: Column) -> Column:
    """Union of two maps where the right one wins on a shared key."""
    kept = F.map_filter(left, lambda k, _: ~F.array_contains(F.map_keys(right), k))
    return F.map_concat(kept, right)


def safe_url(col: Column) -> Column:
    """The URL itself if it is http(s) with a host, else null."""
    return F.when(col.rlike(r"^[hH][tT][tT][pP][sS]?://[^/?#]+"), col)


def clean_strings(col: Column) -> Column:
    """Sorted distinct texts with ends trimmed; blanks and nulls removed."""
    trimmed = F.transform(col, lambda x: F.trim(x))  # alone, trim would take the index for its second argument
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda x: x.isNotNull() & (x != ""))))


def first_match(items: Column, predicate, field: str) -> Column:
    """Field of the first array element that satisfies the predicate, null if none does."""
    return F.try_element_at(F.filter(items, predicate), F.lit(1)).getField(field)
