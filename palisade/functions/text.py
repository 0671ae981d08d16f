"""Text rules: whitespace, control characters, names, file names, keys and media types."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -------------------------------------------------------------------------
# Runs treated as white space by name and query cleaning (Unicode spaces plus FS, GS, RS, US).
WHITESPACE = r"(?U)[\s\x1c-\x1f]+"
# Any C0 control or DEL.
CONTROL = r"[\x00-\x1f\x7f]"
# The same, with tab, line feed and carriage return allowed.
CONTROL_EXCEPT_LINE_BREAKS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
ASCII_ONLY = r"^[\x00-\x7f]*$"
MEDIA_TYPE = r"^[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*/[A-Za-z0-9][A-Za-z0-9!#$&^_.+-]*$"
KEY_SEGMENT = r"^[A-Za-z0-9][A-Za-z0-9._-]*$"
SLUG = r"^[a-z0-9]+(-[a-z0-9]+)*$"
TECHNIQUE_ID = r"^T[0-9]{4}([.][0-9]{3})?$"
SHA256_HEX = r"^[0-9a-f]{64}$"
DEVICE_NAME = r"(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])([.]|$)"
MAX_NAME = 255
MAX_REASON = 2000
MIN_QUERY, MAX_QUERY = 2, 200
# ------------------------------------------------------------------------------------------


def collapse(col: Column) -> Column:
    """White-space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(col, WHITESPACE, " "))


def has_control(col: Column, allow_line_breaks: bool = False) -> Column:
    return col.rlike(CONTROL_EXCEPT_LINE_BREAKS if allow_line_breaks else CONTROL)


def strip(col: Column) -> Column:
    """Remove white space of any kind at both ends, keeping the inside as written."""
    return F.regexp_replace(
        F.regexp_replace(col, r"(?U)^[\s\x1c-\x1f]+", ""), r"(?U)[\s\x1c-\x1f]+$", ""
    )


@F.pandas_udf(T.StringType())
def compat_fold(values: pd.Series) -> pd.Series:
    """NFKC then case folding. Spark has neither, so non-ASCII text takes this path."""
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v).casefold(),
        na_action="ignore",
    )


@F.pandas_udf(T.StringType())
def _plain_fold(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else v.casefold(), na_action="ignore")


def casefold(col: Column) -> Column:
    """Case folding without compatibility forms; ASCII rows stay in the JVM."""
    ascii_only = col.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(col)).otherwise(_plain_fold(F.when(~ascii_only, col)))


@F.pandas_udf(T.StringType())
def compat_form(values: pd.Series) -> pd.Series:
    """NFKC only."""
    return values.map(
        lambda v: None if v is None else unicodedata.normalize("NFKC", v), na_action="ignore"
    )


def fold(col: Column) -> Column:
    """NFKC + casefold; ASCII rows stay in the JVM (the UDF only sees null for them)."""
    ascii_only = col.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(col)).otherwise(compat_fold(F.when(~ascii_only, col)))


def normalize_name(col: Column) -> Column:
    """Comparison key of an actor or alias name; null where the name is not acceptable."""
    folded = collapse(fold(col))
    bad = (folded == "") | has_control(folded) | (F.length(folded) > MAX_NAME)
    return F.when(~bad, folded)


def clean_query(col: Column) -> Column:
    """Display form of a search query; null if too short, too long or holding control characters."""
    cleaned = collapse(col)
    return F.when(
        F.length(cleaned).between(MIN_QUERY, MAX_QUERY) & ~has_control(col), cleaned
    )


def bounded_reason(col: Column, default: str) -> Column:
    cleaned = collapse(col)
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit(default)), 1, MAX_REASON)


def sanitize_filename(col: Column) -> Column:
    """Last path part with unsafe runs replaced, device names prefixed, at most 255 characters."""
    ascii_only = col.rlike(ASCII_ONLY)
    compat = F.when(ascii_only, col).otherwise(compat_form(F.when(~ascii_only, col)))
    base = F.regexp_extract(compat, r"([^/\\]*)$", 1)
    safe = F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "-")
    bare = F.regexp_replace(F.regexp_replace(safe, r"^[ ._-]+", ""), r"[ ._-]+$", "")
    named = F.when(bare == "", F.lit("evidence")).otherwise(bare)
    guarded = F.when(named.rlike(DEVICE_NAME), F.concat(F.lit("_"), named)).otherwise(named)
    return F.substring(guarded, 1, 255)


def media_type(col: Column) -> Column:
    """Lower-case media type, null if it carries parameters or is malformed."""
    cleaned = F.lower(F.trim(col))
    return F.when(cleaned.rlike(MEDIA_TYPE) & F.length(cleaned).between(3, 255), cleaned)


def object_key_ok(col: Column) -> Column:
    """Relative, forward slashes only, every segment safe (so no dot segments either)."""
    segments = F.split(F.regexp_replace(F.regexp_replace(col, "/+", "/"), "/$", ""), "/")
    return (
        ~F.contains(col, F.lit("\\"))
        & ~F.startswith(col, F.lit("/"))
        & F.forall(F.filter(segments, lambda s: s != "."), lambda s: s.rlike(KEY_SEGMENT))
        & (F.size(F.filter(segments, lambda s: s != ".")) > 0)
    )


def token_estimate(col: Column) -> Column:
    """One token per four characters, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(col) / F.lit(4))).cast("int")


# --- fixed values: question intents, tried in this order ----------------------------------
CHANGE_TERMS = ("changed", "change", "evolution", "over time")
SUPPORT_TERMS = ("evidence", "support", "source", "citation")
# ------------------------------------------------------------------------------------------


def classify_intent(col: Column) -> Column:
    lowered = fold(col)

    def mentions(terms):
        found = F.lit(False)
        for term in terms:
            found = found | F.contains(lowered, F.lit(term))
        return found

    return (
        F.when(mentions(CHANGE_TERMS), F.lit("behavior_change"))
        .when(mentions(SUPPORT_TERMS), F.lit("evidence_support"))
        .otherwise(F.lit("actor_overview"))
    )
