"""Deterministic generated inputs of any size: bundles for load runs, and a synthetic graph."""

from __future__ import annotations

from uuid import UUID

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.ids import uuid5
from palisade.functions.text import normalize_name
from palisade.schemas import Graph

SPACE = UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def _id(kind: str, number) -> object:
    return uuid5(SPACE, F.concat(F.lit(f"{kind}:"), number.cast("string")))


def intrusion_set_bundles(spark: SparkSession, bundles: int, objects: int) -> DataFrame:
    """(raw_evidence_id, content): one JSON bundle per row with ``objects`` intrusion sets."""
    number = F.col("id") * objects + F.col("k")
    rows = spark.range(bundles).select("id", F.explode(F.sequence(F.lit(0), F.lit(objects - 1))).alias("k"))
    item = F.struct(
        F.lit("intrusion-set").alias("type"),
        F.lit("2.1").alias("spec_version"),
        F.concat(F.lit("intrusion-set--"), _id("set", number)).alias("id"),
        F.lit("2026-08-01T00:00:00Z").alias("created"),
        F.lit("2026-08-02T00:00:00Z").alias("modified"),
        F.concat(F.lit("Generated Group "), number.cast("string")).alias("name"),
        F.concat(F.lit("Generated description "), number.cast("string")).alias("description"),
    )
    packed = rows.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", item.alias("o")))),
                    lambda x: x.getField("o")).alias("objects")
    )
    return packed.select(
        _id("raw", F.col("id")).alias("raw_evidence_id"),
        F.to_json(
            F.struct(
                F.lit("bundle").alias("type"),
                F.concat(F.lit("bundle--"), _id("bundle", F.col("id"))).alias("id"),
                "objects",
            )
        ).alias("content"),
    )


def graph(spark: SparkSession, actors: int, observations_per_actor: int = 1, sources: int = 2) -> Graph:
    """Published graph: each actor with one alias and a run of observations."""
    stamp = F.timestamp_seconds(F.lit(1767225600))

    def stamped(df):
        return df.withColumns(
            {"publication_state": F.lit("published"), "created_at": stamp, "updated_at": stamp}
        )

    src = stamped(
        spark.range(sources).select(
            _id("source", F.col("id")).alias("id"),
            F.concat(F.lit("Generated Source "), F.col("id").cast("string")).alias("name"),
            F.lit("dataset").alias("kind"),
        )
    )
    act = spark.range(actors)
    title = F.concat(F.lit("Generated Actor "), F.col("id").cast("string"))
    actor_rows = stamped(
        act.select(_id("actor", F.col("id")).alias("id"), title.alias("canonical_name"),
                   normalize_name(title).alias("normalized_name"), F.lit(None).cast("string").alias("description"))
    )
    alias_name = F.concat(F.lit("Generated Alias "), F.col("id").cast("string"))
    alias_rows = stamped(
        act.select(
            _id("alias", F.col("id")).alias("id"),
            _id("source", F.col("id") % sources).alias("source_id"),
            _id("actor", F.col("id")).alias("actor_id"),
            alias_name.alias("name"), normalize_name(alias_name).alias("normalized_name"),
            F.lit(None).cast("string").alias("source_native_id"), F.lit(90).alias("confidence"),
        )
    )
    obs = act.select(
        F.col("id").alias("a"),
        F.explode(F.sequence(F.lit(0), F.lit(observations_per_actor - 1))).alias("k"),
    ).withColumn("n", F.col("a") * observations_per_actor + F.col("k"))
    obs_rows = stamped(
        obs.select(
            _id("observation", F.col("n")).alias("id"),
            _id("source", F.col("n") % sources).alias("source_id"),
            F.concat(F.lit("native-"), F.col("n").cast("string")).alias("source_native_id"),
            F.concat(F.lit("Generated activity "), F.col("n").cast("string")).alias("title"),
            F.lit("Generated summary of credential activity").alias("summary"),
            F.timestamp_seconds(F.lit(1767225600) + F.col("n") * 60).alias("observed_at"),
            F.lit(None).cast("timestamp").alias("first_seen"),
            F.lit(None).cast("timestamp").alias("last_seen"),
            F.lit(None).cast("int").alias("confidence"),
            F.lit("observed").alias("intelligence_type"), F.lit("imported").alias("origin"),
            F.lit(None).cast("string").alias("raw_evidence_id"),
        )
    )
    links = obs.select(_id("actor", F.col("a")).alias("actor_id"),
                       _id("observation", F.col("n")).alias("observation_id"))
    return Graph(spark, {"sources": src, "actors": actor_rows, "aliases": alias_rows,
                         "observations": obs_rows, "actor_observations": links})
