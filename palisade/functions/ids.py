"""Hashes, name-based UUIDs and content-addressed keys, all as native expressions."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: file suffix per media type, anything else is ".bin" ----------------------
MEDIA_SUFFIX = {
    "application/json": ".json",
    "application/pdf": ".pdf",
    "application/xml": ".xml",
    "text/csv": ".csv",
    "text/html": ".html",
    "text/plain": ".txt",
}
# ------------------------------------------------------------------------------------------


def content_sha256(col: Column) -> Column:
    return F.sha2(col, 256)


def uuid5(namespace: UUID, name: Column) -> Column:
    """RFC 9562 version-5 UUID of a column of names (equal to Python's ``uuid.uuid5``)."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(
        F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab"
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def object_key(source: Column, digest: Column, media: Column) -> Column:
    """``raw/<source>/<first two hex>/<sha256><suffix>``"""
    suffixes = F.create_map(*[F.lit(x) for pair in MEDIA_SUFFIX.items() for x in pair])
    suffix = F.coalesce(F.try_element_at(suffixes, media), F.lit(".bin"))
    return F.concat(
        F.lit("raw/"), source, F.lit("/"), F.substring(digest, 1, 2), F.lit("/"), digest, suffix
    )
