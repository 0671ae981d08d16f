"""Content-addressed blobs read through the binary file source."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.session import materialize


def scan_blobs(spark: SparkSession, root: str, prefix: str = "raw") -> DataFrame:
    """(storage_key, length, content) of every file below ``root/prefix``.

    Column pruning decides the cost: without ``content`` only the listing is read.
    """
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(f"{base}/{prefix}")
    )
    marker = f"/{prefix}/"
    tail = F.element_at(F.split(F.col("path"), marker, 2), 2)
    return files.select(
        F.concat(F.lit(f"{prefix}/"), tail).alias("storage_key"), "length", "content"
    )


def write_blobs(rows: DataFrame, root: str) -> DataFrame:
    """Store (storage_key, content) as files below ``root`` and return the keys with their sizes.

    Every file is written under another name and then renamed, so a retried task leaves whole files only. ``root`` is any
    folder that the executors mount; the rows stay where Spark has them.
    """
    base = root.rstrip("/").removeprefix("file:")

    def store(batches):
        import uuid

        for frame in batches:
            sizes = []
            for key, content in zip(frame["storage_key"], frame["content"]):
                path = os.path.join(base, key)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                made = os.path.join(base, f".{uuid.uuid4().hex}.part")
                with open(made, "wb") as handle:
                    handle.write(content)
                os.replace(made, path)
                sizes.append(len(content))
            yield pd.DataFrame({"storage_key": frame["storage_key"], "blob_size": sizes})

    return rows.select("storage_key", "content").mapInPandas(store, "storage_key string, blob_size bigint")


def _hidden(name: str) -> bool:
    """Names that Spark's file sources pass over."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def list_blobs(spark: SparkSession, root: str, prefix: str = "raw") -> DataFrame:
    """(storage_key) of every file with content below ``root/prefix``.

    Folders are listed in tasks, level by level, and names stay there: the driver learns only whether there is another level.
    """
    base = root.rstrip("/").removeprefix("file:")

    def names(batches):
        for frame in batches:
            for folder in frame["storage_key"]:
                found = []
                with os.scandir(os.path.join(base, folder)) as entries:
                    for entry in entries:
                        nested = entry.is_dir()
                        if not _hidden(entry.name) and (nested or entry.stat().st_size):
                            found.append((f"{folder}/{entry.name}", nested))
                        if len(found) == 10_000:
                            yield pd.DataFrame(found, columns=["storage_key", "folder"])
                            found = []
                yield pd.DataFrame(found, columns=["storage_key", "folder"]).astype({"storage_key": object, "folder": bool})

    folders, files = spark.range(1).select(F.lit(prefix).alias("storage_key")), None
    while files is None or not folders.isEmpty():
        listed = materialize(folders.repartition("storage_key").mapInPandas(names, "storage_key string, folder boolean"), "blob-names")
        found = listed.filter("not folder").select("storage_key")
        files = found if files is None else files.unionByName(found)
        folders = listed.filter("folder").select("storage_key")
    return files


def write_lines(rows: DataFrame, root: str) -> None:
    """Text files below ``root`` from (file, place, line) rows, each file's lines by place.

    A file may be larger than a task: sorted parts of it are stored, a running sum over the sizes of the parts gives each its start, and
    every part is written there. A part that is written again has the same bytes. ``root`` is any folder that the executors mount.
    """
    base = root.rstrip("/").removeprefix("file:")
    parts = materialize(rows.select("file", "place", "line").repartitionByRange("file", "place").withColumn("part", F.spark_partition_id()), "line-parts")
    sizes = parts.groupBy("file", "part").agg(F.sum(F.octet_length("line") + F.lit(1).cast("bigint")).alias("size"))
    before = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))

    def put(batches):
        key, handle = None, None
        for frame in batches:
            for file, part, start, line in zip(frame["file"], frame["part"], frame["start"], frame["line"]):
                if (file, part) != key:
                    if handle:
                        handle.close()
                    path = os.path.join(base, file)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    key, handle = (file, part), os.fdopen(os.open(path, os.O_WRONLY | os.O_CREAT, 0o644), "wb")
                    handle.seek(start)
                handle.write(line.encode() + b"\n")
            yield pd.DataFrame({"lines": [len(frame)]})
        if handle:
            handle.close()

    placed = parts.join(F.broadcast(starts), ["file", "part"]).repartition("file", "part").sortWithinPartitions("file", "part", "place")
    placed.select("file", "part", "start", "line").mapInPandas(put, "lines long").agg(F.sum("lines")).first()


def streamed_hashes(spark: SparkSession, root: str, prefix: str = "raw", references: DataFrame | None = None) -> DataFrame:
    """(storage_key, blob_sha256, blob_size, blob_status) of every listed file and every key of ``references``.

    Each file is read in streams of 1 MiB, so that one may be larger than a row. Empty files are not listed: an empty blob is found by
    its reference only, a stray one is not reported.
    """
    keys = list_blobs(spark, root, prefix)
    if references is not None:
        keys = keys.unionByName(references.filter(F.col("storage_key").isNotNull()).select("storage_key"))
    return read_listed_blobs(keys, root)


def hash_blobs(blobs: DataFrame) -> DataFrame:
    """(storage_key, blob_sha256, blob_size); the bytes do not travel past the scan."""
    return blobs.select(
        "storage_key",
        F.sha2("content", 256).alias("blob_sha256"),
        F.col("length").alias("blob_size"),
    )


def read_listed_blobs(references: DataFrame, root: str) -> DataFrame:
    """Hash every referenced key by opening it, classing what cannot be opened.

    The file source fails its task on an unreadable file, so a reconcile that has to report
    ``missing`` and ``storage_error`` apart opens keys one by one inside the tasks, in streams of
    1 MiB; the key list stays partitioned by Spark. ``root`` is any folder the executors mount.
    """
    base = root.rstrip("/").removeprefix("file:")

    def check(batches):
        import hashlib

        for frame in batches:
            out = []
            for key in frame["storage_key"]:
                digest, size, status = hashlib.sha256(), 0, "read"
                try:
                    with open(os.path.join(base, key), "rb") as handle:
                        while chunk := handle.read(1 << 20):
                            digest.update(chunk)
                            size += len(chunk)
                except FileNotFoundError:
                    status = "missing"
                except OSError:
                    status = "storage_error"
                read = status == "read"
                out.append((key, digest.hexdigest() if read else None, size if read else None, status))
            yield pd.DataFrame(out, columns=["storage_key", "blob_sha256", "blob_size", "blob_status"])

    schema = "storage_key string, blob_sha256 string, blob_size bigint, blob_status string"
    return references.select("storage_key").distinct().mapInPandas(check, schema)


def key_collisions(blobs: DataFrame, key: str = "storage_key", digest: str = "sha256") -> DataFrame:
    """Keys claimed by more than one content."""
    return (
        blobs.groupBy(key)
        .agg(F.min(digest).alias("first_sha256"), F.max(digest).alias("last_sha256"),
             F.count(F.lit(1)).alias("claims"))
        .filter(F.col("first_sha256") != F.col("last_sha256"))
    )
