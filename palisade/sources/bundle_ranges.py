"""Bundle files of any size, read in many tasks.

A bundle is one JSON document, mostly one long array. Spark's text reader cuts a file at every ``}`` and thereby gives its byte ranges
to many tasks, however long the lines are. What a cut means depends on all that came before: whether it stands in a string, and how
deep. So the reading is a scan: each chunk says what it does to either state (in a string or not) and how often it opens a level,
relative to an unknown depth; the chunks of a file are a narrow table, whose running sum gives each chunk its own start; then every
chunk is read again for itself. Objects that lie across chunks are put together from their pieces.

Defined results, as of the whole reader: a file that isn't one JSON value, no bundle or without an array of objects has
``bundle_error`` and no objects. Unlike there, elements of ``objects`` that aren't JSON objects make the whole file unusable, a file
without bytes has no row, and payloads keep their white space.
"""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialize
from palisade.sources.stix_bundle import BAD_BUNDLE_ID, BUNDLE_ID, NO_OBJECTS, NOT_BUNDLE, NOT_JSON, check_objects

CHUNK = 1 << 20
#: What can change the state: a string's end or an escaped character inside, a bracket or a string's begin outside.
_INSIDE, _OUTSIDE = re.compile(rb'\\.|"', re.S), re.compile(rb'["{}\[\]]')

_COMMA = re.compile(rb"\s*,?")


def _steps(body: bytes, in_string: bool):
    """(position, byte) of the brackets outside strings; at last (-1, whether a string is open)."""
    at = 0
    while True:
        found = (_INSIDE if in_string else _OUTSIDE).search(body, at)
        if found is None:
            yield -1, in_string
            return
        at, byte = found.end(), found[0]
        if byte == b'"':
            in_string = not in_string
        elif not in_string:
            yield found.start(), byte


def _effect(body: bytes, in_string: bool) -> tuple[int, int, list[int]]:
    """End state, change of depth, and for each level, from the start: level, objects opened there, arrays or objects, whether the last is an array."""
    depth, opened = 0, {}
    for place, byte in _steps(body, in_string):
        if place < 0:
            return int(byte), depth, [x for level, counts in sorted(opened.items()) for x in (level, *counts)]
        if byte in b"{[":
            counts = opened.setdefault(depth, [0, 0, 0])
            counts[0] += byte == b"{"
            counts[1] += 1
            counts[2] = int(byte == b"[")
            depth += 1
        else:
            depth -= 1
    raise AssertionError


_CHUNK = ("path string, block long, number int, body binary, file_size long, end0 int, depth0 int, opened0 array<int>, "
          "end1 int, depth1 int, opened1 array<int>")


def _chunks(batches):
    """Fragments between two ``}`` of one range, joined to chunks of about CHUNK bytes, with their effects on both states."""
    names = [c.split()[0] for c in _CHUNK.split(", ")]
    held, key, number, size = [], None, 0, 0

    def made():
        body = b"".join(held)
        row = [*key[:2], number, body, key[2], *_effect(body, False), *_effect(body, True)]
        types = [pa.string(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), *[pa.int32(), pa.int32(), pa.list_(pa.int32())] * 2]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

    for batch in batches:
        for path, block, file_size, value in zip(*(c.to_pylist() for c in batch.columns)):
            if held and ((path, block, file_size) != key or size >= CHUNK):
                yield made()
                number = number + 1 if (path, block, file_size) == key else 0
                held, size = [], 0
            key = (path, block, file_size)
            held += [value, b"}"]
            size += len(value) + 1
    if held:
        yield made()


_START = "path string, block long, number int, place long, in_string int, depth int, objects long, members long, in_array int, in_object int, cut int"


def _starts(rows: pa.Table) -> pa.Table:
    """The state at the begin of each chunk of a file; ``cut``: bytes to take from its end (the reader's last ``}`` may not be there)."""
    rows = rows.sort_by([("block", "ascending"), ("number", "ascending")]).to_pylist()
    out, state, depth, objects, members, in_array, in_object = [], 0, 0, 0, 0, 0, 0
    spare = sum(r["size"] for r in rows) - rows[0]["file_size"]
    for place, r in enumerate(rows):
        out.append((r["path"], r["block"], r["number"], place, state, depth, objects, members, in_array, in_object, spare if place == len(rows) - 1 else 0))
        end, change, opened = (r[f"{c}{state}"] for c in ("end", "depth", "opened"))
        for level, n_objects, n_all, last in zip(*(opened[k::4] for k in range(4))):
            if depth + level == 2:
                objects, in_object = objects + n_objects, 1 - last
            if depth + level == 1:
                members, in_array = members + n_all, last
        state, depth = end, depth + change
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(),
                                                                pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()])],
                    names=[c.split()[0] for c in _START.split(", ")])


_PIECE = "path string, place long, object long, member long, text binary"


def _pieces(batches):
    """Pieces of objects at depth 3, numbered over the file, with the number of the member that they stand in; object -1: what is left."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            body, depth, object_, member = r["body"], r["depth"], r["objects"] - 1, r["members"] - 1
            body = body[: len(body) - r["cut"]]
            in_array = bool(r["in_array"])
            # a chunk ends with "}": at this depth with that of an object, whose comma follows
            rest, at = [], len(_COMMA.match(body)[0]) if depth == 2 and r["place"] and in_array else 0
            in_object = depth >= 3 and bool(r["in_object"])
            for place, byte in _steps(body, bool(r["in_string"])):
                if place < 0:
                    break
                if byte in b"{[":
                    if depth == 1:
                        member, in_array = member + 1, byte == b"["
                    if depth == 2 and byte == b"{":
                        object_ += 1
                        rest.append(body[at:place])
                        if not in_array:
                            rest.append(b"null")
                        at, in_object = place, True
                    depth += 1
                else:
                    depth -= 1
                    if depth == 2 and in_object and byte == b"}":
                        out.append((r["path"], r["place"], object_, member, body[at : place + 1]))
                        at, in_object = place + 1, False
                        if in_array:
                            at += len(_COMMA.match(body, at)[0])
            (out.append((r["path"], r["place"], object_, member, body[at:])) if in_object else rest.append(body[at:]))
            out.append((r["path"], r["place"], -1, -1, b"".join(rest)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()])],
                                             [c.split()[0] for c in _PIECE.split(", ")])


def _envelope(rows: pa.Table) -> pa.Table:
    """From what is left of a file without its objects: identifier, error and the member that holds the objects."""
    text = b"".join(r["text"] for r in rows.sort_by("place").to_pylist())
    name, member, error = None, -1, None
    try:
        found = json.loads(text.decode(), object_pairs_hook=lambda pairs: ("{", pairs))
    except ValueError:
        found, error = None, NOT_JSON
    if error is None:
        pairs = found[1] if isinstance(found, tuple) else []
        last, nested = {}, 0
        for key, value in pairs:
            last[key] = (value, nested)
            nested += isinstance(value, (list, tuple))
        get = lambda key: last.get(key, (None, -1))
        name = get("id")[0]
        if get("type")[0] != "bundle":
            error = NOT_BUNDLE
        elif not isinstance(name, str) or not re.match(BUNDLE_ID, name):
            error = BAD_BUNDLE_ID
        elif get("objects")[0] != []:
            error = NO_OBJECTS
        else:
            member = get("objects")[1]
    return pa.table({"path": rows.column("path").slice(0, 1).combine_chunks(), "bundle_id": pa.array([None if error else name], pa.string()),
                     "bundle_error": pa.array([error], pa.string()), "member": pa.array([member], pa.int64())})


def _whole(objects: DataFrame) -> DataFrame:
    """(path, object, member, payload): objects in one piece as they are, the others put together."""
    pieces = objects.groupBy("path", "object").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    parted = objects.join(pieces, ["path", "object"], "left_semi").groupBy("path", "object").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda p: p.text.cast("string")), "").alias("payload"),
        F.max("member").alias("member"))
    single = objects.join(pieces, ["path", "object"], "left_anti").select("path", "object", F.col("text").cast("string").alias("payload"), "member")
    return single.unionByName(parted)


def read_split_bundles(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Envelopes (raw_path, bundle_id, bundle_error) of all files below the path, and the objects of the usable ones: raw_path, bundle_id,
    object_index, payload, object_id, object_type, object_error."""
    text = spark.read.option("recursiveFileLookup", "true").option("lineSep", "}").text(path)
    meta = lambda name: F.col(f"_metadata.{name}")
    fragments = text.select(meta("file_path").alias("path"), meta("file_block_start").alias("block"), meta("file_size").alias("file_size"),
                            F.col("value").cast("binary").alias("value"))
    # written once: another scan may cut the files into other ranges
    chunks = materialize(fragments.mapInArrow(_chunks, _CHUNK), "bundle-chunks")
    narrow = chunks.withColumn("size", F.octet_length("body").cast("bigint")).drop("body")
    starts = narrow.groupBy("path").applyInArrow(_starts, _START)
    pieces = materialize(chunks.select("path", "block", "number", "body").join(starts, ["path", "block", "number"])
                         .mapInArrow(_pieces, _PIECE), "bundle-pieces")
    heads = pieces.filter("object = -1").select("path", "place", "text").groupBy("path").applyInArrow(
        _envelope, "path string, bundle_id string, bundle_error string, member long")
    objects = materialize(_whole(pieces.filter("object >= 0")).withColumn("ok", F.try_parse_json("payload").isNotNull()), "bundle-objects")
    broken = objects.groupBy("path").agg(F.min(F.struct("ok")).alias("all")).filter("not all.ok").select("path")
    heads = materialize(heads.join(broken.withColumn("broken", F.lit(True)), "path", "left").withColumn(
        "bundle_error", F.when(F.col("broken"), F.lit(NOT_JSON)).otherwise(F.col("bundle_error"))).drop("broken"), "bundle-heads")
    usable = heads.filter("bundle_error is null")
    first = objects.join(usable.select("path", "member"), ["path", "member"]).groupBy("path").agg(F.min("object").alias("first"))
    found = (objects.join(usable.select("path", "bundle_id", "member"), ["path", "member"]).join(first, "path")
             .select(F.col("path").alias("raw_path"), "bundle_id", (F.col("object") - F.col("first")).cast("int").alias("object_index"),
                     F.lit("OBJECT").alias("kind"), "payload"))
    envelopes = heads.select(F.col("path").alias("raw_path"), F.when(F.col("bundle_error").isNull(), F.col("bundle_id")).alias("bundle_id"), "bundle_error")
    return envelopes, check_objects(found)
