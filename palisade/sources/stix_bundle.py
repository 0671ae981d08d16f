"""STIX bundles: scan files, check the envelope, split into one row per object.

A bundle is one JSON document and here one input row (``bundle_ranges`` reads larger ones in many tasks); the objects are spread
over the cluster right after the split. Object payloads keep their exact text, which the payload hash needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.jsonx import variant_kind

# --- fixed values: identifier shapes and messages -------------------------------------------
BUNDLE_ID = r"^bundle--[0-9a-fA-F-]{36}$"
OBJECT_ID = r"^[a-z][a-z0-9-]{0,99}--[0-9a-fA-F-]{36}$"
NOT_JSON = "Payload is not valid UTF-8 JSON"
NOT_BUNDLE = "Payload must be a STIX bundle object"
BAD_BUNDLE_ID = "Bundle has an invalid STIX identifier"
NO_OBJECTS = "Bundle objects must be an array"
# ------------------------------------------------------------------------------------------


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """(raw_path, content) of every file below the path."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("raw_path"), F.col("value").alias("content"))
    )


def check_envelope(bundles: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``bundle_id``, ``bundle_error`` (null if usable) and the parsed ``_kinds``/``_texts``."""
    body = F.col(content)
    mark = F.sha2(body, 256)
    # the mark behind the body is reached only if the whole body is one JSON value
    wrapped = F.concat(F.lit('{"v":'), body, F.lit(',"end":"'), mark, F.lit('"}'))
    kinds = F.from_json(
        wrapped, "v struct<type:variant,id:variant,objects:array<variant>>, end string"
    )
    texts = F.from_json(body, "type string, id string, objects array<string>")
    parsed = bundles.withColumn("_w", kinds).withColumns({"_k": F.col("_w.v"), "_t": texts})
    is_json = F.coalesce(F.col("_w.end") == mark, F.lit(False))
    is_bundle = (variant_kind(F.col("_k.type")) == "STRING") & (F.col("_t.type") == "bundle")
    good_id = (variant_kind(F.col("_k.id")) == "STRING") & F.col("_t.id").rlike(BUNDLE_ID)
    error = (
        F.when(~is_json, F.lit(NOT_JSON))
        .when(~F.coalesce(is_bundle, F.lit(False)), F.lit(NOT_BUNDLE))
        .when(~F.coalesce(good_id, F.lit(False)), F.lit(BAD_BUNDLE_ID))
        .when(F.col("_k.objects").isNull(), F.lit(NO_OBJECTS))
    )
    checked = parsed.withColumn("bundle_error", error).drop("_w")
    return checked.withColumn("bundle_id", F.when(F.col("bundle_error").isNull(), F.col("_t.id")))


def split_objects(checked: DataFrame, keep: list[str]) -> DataFrame:
    """One row per object of every usable bundle: index, id, type, exact payload text, error."""
    usable = checked.filter(F.col("bundle_error").isNull())
    items = F.transform(
        F.col("_t.objects"),
        lambda x, i: F.struct(
            x.alias("payload"), variant_kind(F.get(F.col("_k.objects"), i)).alias("kind")
        ),
    )
    exploded = usable.select(*keep, "bundle_id", F.posexplode(items).alias("object_index", "item"))
    rows = exploded.select(
        *keep, "bundle_id", "object_index", F.col("item.kind").alias("kind"),
        F.col("item.payload").alias("payload"),
    )
    return check_objects(rows)


def check_objects(rows: DataFrame) -> DataFrame:
    """Adds object_id, object_type and object_error to rows of object_index, kind (dropped) and payload."""
    payload = F.when(F.col("kind") == "OBJECT", F.col("payload"))
    head = F.from_json(payload, "id variant, type variant")
    rows = rows.withColumn("_h", head)
    as_text = {
        name: F.when(
            variant_kind(F.col(f"_h.{name}")) == "STRING",
            F.variant_get(F.col(f"_h.{name}"), "$", "string"),
        )
        for name in ("id", "type")
    }
    rows = rows.withColumns({"object_id": as_text["id"], "object_type": as_text["type"]})
    label = F.concat(F.lit("Object "), F.col("object_index").cast("string"))
    good_id = F.col("object_id").rlike(OBJECT_ID)
    same_type = F.startswith(F.col("object_id"), F.concat(F.col("object_type"), F.lit("--")))
    error = (
        F.when(F.coalesce(F.col("kind"), F.lit("VOID")) != "OBJECT",
               F.concat(label, F.lit(" must be a JSON object")))
        .when(~F.coalesce(good_id, F.lit(False)),
              F.concat(label, F.lit(" has an invalid STIX identifier")))
        .when(~F.coalesce(same_type, F.lit(False)),
              F.concat(label, F.lit(" type does not match its identifier")))
    )
    return rows.withColumn("object_error", error).drop("_h", "kind")
