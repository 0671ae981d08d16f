"""Structured Streaming jobs over the batch operators.

Every job is a function of a streaming DataFrame, or a ``foreachBatch`` step whose state is a stored
table, so a restart resumes from the checkpoint and a replayed micro-batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.functions.ids import content_sha256
from palisade.operators import intake, normalize
from palisade.sources.changes import ChangeTable


def event_time(df: DataFrame, column: str) -> DataFrame:
    """Watermarks need TIMESTAMP; Parquet often carries TIMESTAMP_NTZ."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available and stop; the sink is Parquet with exactly-once file commits."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()


def run_batches(stream: DataFrame, step, checkpoint: str) -> None:
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


def bounded_dedup(stream: DataFrame, keys: list[str], at: str, horizon: str) -> DataFrame:
    """First arrival per key; a key is forgotten after the horizon."""
    return event_time(stream, at).withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def windowed_queue(stream: DataFrame, at: str, width: str, lateness: str, states: dict[str, str]) -> DataFrame:
    """Events per state in tumbling windows; a window is emitted once the watermark passes it."""
    counted = (
        event_time(stream, at)
        .withWatermark(at, lateness)
        .groupBy(F.window(at, width).alias("w"))
        .agg(*[F.count_if(F.col("event_type") == value).alias(name) for name, value in states.items()],
             F.count(F.lit(1)).alias("total"))
    )
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                          *states, "total")


class LateRows:
    """``foreachBatch`` step: rows that ``windowed_queue`` drops because their window had closed, counted per window.

    For streams that run over what is available and stop: a run ends by closing the windows that its rows made due, so the watermark
    of the next is the newest event time so far, less the lateness, and a row is late if its window ends at or before it. (Within a
    run of several batches Spark drops rows by the watermark of one batch earlier; use one batch a run.) A batch stores its counts and its newest time, so a replay finds the watermark it had
    and replaces its own counts. Reading the watermark touches one key of one row per batch. Rows without a time have no window and
    are not counted.
    """

    COUNTS = "batch_id bigint, window_start timestamp, late bigint"
    MARKS = "name string, newest timestamp"

    def __init__(self, spark: SparkSession, root: str, at: str, width: str, lateness: str):
        self.at, self.width, self.lateness = at, width, lateness
        self.counts = ChangeTable(spark, f"{root}/late_rows", self.COUNTS, ["batch_id", "window_start"])
        self.marks = ChangeTable(spark, f"{root}/marks", self.MARKS, ["name"], buckets=1)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.marks.done(batch_id):
            return
        held = self.marks.rows(batch_id).first()
        newest = held["newest"] if held else None
        times = event_time(batch.select(self.at), self.at).filter(F.col(self.at).isNotNull())
        closed = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {self.lateness}")
        late = times.select(F.window(self.at, self.width).alias("w")).filter(F.col("w.end") <= closed)
        self.counts.write(late.groupBy(F.col("w.start").alias("window_start")).agg(F.count(F.lit(1)).alias("late"))
                          .withColumn("batch_id", F.lit(batch_id).cast("bigint")), batch_id)
        seen = times.agg(F.max(self.at).alias("newest")).select(
            F.lit("newest").alias("name"), F.greatest("newest", F.lit(newest).cast("timestamp")).alias("newest"))
        self.marks.write(seen, batch_id)

    def total(self) -> DataFrame:
        """window_start, late over all batches."""
        return self.counts.rows().groupBy("window_start").agg(F.sum("late").alias("late"))


def activity_sessions(stream: DataFrame, key: str, at: str, gap: str, lateness: str) -> DataFrame:
    """First and last event of each run of activity with no pause of ``gap`` or more."""
    merged = (
        event_time(stream, at)
        .withWatermark(at, lateness)
        .groupBy(key, F.session_window(at, gap).alias("w"))
        .agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.count(F.lit(1)).alias("events"))
    )
    return merged.select(key, "first_seen", "last_seen", "events")


def update_feed(stream: DataFrame, after_sequence: int = 0) -> DataFrame:
    """Append feed of updates; progress is the checkpoint, ``after_sequence`` only sets the start."""
    return stream.filter(F.col("sequence") > after_sequence)


def exact_dedup(stream: DataFrame, keys: list[str]) -> DataFrame:
    """First arrival per key for all time: keys live in the state store, a batch costs its own size."""
    return stream.dropDuplicates(keys)


class EvidenceIntake:
    """``foreachBatch`` step: exact deduplication against a stored key table that other jobs can read.

    A batch looks its own keys up and appends the new ones; ``exact_dedup`` keeps the keys in the state store instead.
    """

    KEYS = ("source_id", "content_sha256")
    SCHEMA = (
        "source_id string, content_sha256 string, content_size_bytes bigint, mime_type string, "
        "storage_key string, submission_id bigint"
    )

    def __init__(self, spark: SparkSession, root: str, max_bytes: int = 50 * 1024 * 1024):
        self.keys, self.max_bytes = ChangeTable(spark, f"{root}/raw_keys", self.SCHEMA, self.KEYS), max_bytes

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.keys.done(batch_id):
            return
        asked = batch.select("source_id", content_sha256(F.col("content")).alias("content_sha256"))
        marked = intake.raw_evidence(batch, self.keys.rows(batch_id, asked), max_bytes=self.max_bytes)
        self.keys.write(intake.new_rows(marked), batch_id)

    def known(self, before: int | None = None) -> DataFrame:
        return self.keys.rows(before)


class StreamingNormalization:
    """``foreachBatch`` step over split bundle objects.

    The stored observations are the state of the fold, which is associative over batches. Observations and ledger are kept
    as changes and are read as of the batch before, for the keys of the batch, so a replay after a crash between the two
    writes gives the same rows, and a finished batch is skipped.
    """

    OBSERVATION = (
        "source_id string, source_native_id string, raw_evidence_id string, title string, summary string, "
        "observed_at timestamp, first_seen timestamp, last_seen timestamp, confidence int, metadata string, "
        "fingerprint string"
    )
    LEDGER = (
        "raw_evidence_id string, object_index int, source_id string, source_native_id string, "
        "object_type string, payload_sha256 string, status string, stage string, reason string, attempts int, "
        "identity_conflict boolean"
    )

    def __init__(self, spark: SparkSession, root: str, raw_evidence: DataFrame):
        self.raw_evidence = raw_evidence
        self.observations = ChangeTable(spark, f"{root}/observations", self.OBSERVATION, ["source_id", "source_native_id"])
        self.ledger = ChangeTable(spark, f"{root}/ledger", self.LEDGER, ["raw_evidence_id", "object_index"])

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        if self.ledger.done(batch_id):
            return
        named = batch.select("source_id", F.col("object_id").alias("source_native_id"))
        stored, previous = self.observations.rows(batch_id, named), self.ledger.rows(batch_id, batch)
        result = normalize.normalize_batch(batch, self.raw_evidence, stored, previous)
        self.observations.write(result.changed, batch_id)
        self.ledger.write(result.ledger, batch_id)


__all__ = [
    "EvidenceIntake", "LateRows", "StreamingNormalization", "activity_sessions", "bounded_dedup", "event_time",
    "run_batches", "run_to_table", "update_feed", "windowed_queue",
]
