"""Stored inverted index: postings written once as Parquet, read by the buckets of the words asked for.

One row per (word, document) with its positions, in folders by the hash of the word. Rows are placed by bucket and hash of the document
while they are written, so a word that stands in a third of all documents is spread over many files, and every file is sorted:
a lookup opens the folders of its words only, and Parquet's own statistics skip the rest of a file. Exact names are
stored beside the words under a mark that no word begins with, so that one lookup serves both.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.session import materialize, scratch_root

BUCKETS = 64
#: Places of a bucket: the rows of one word go to so many tasks and files.
SPREAD = 32
#: Rows whose positions are gathered at a time before they are moved.
FOLDED = 200_000
#: Words asked for that are pushed into the scan by name; with more of them, their folders alone are.
PUSHED = 64
EXACT = "="
_LIST_TABLES = "spark.sql.execution.useObjectHashAggregateExec"
_SCHEMA = "term string, entity_type string, id string, list array<int>, bucket int"


def bucket_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


class PostingsIndex:
    """A written index below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def rows(self) -> DataFrame:
        """(term, entity_type, id, list) of all words; a position is packed as ``pos * 4`` and the number of its weight."""
        return self.spark.read.schema(_SCHEMA).parquet(self.path).filter(~F.startswith("term", F.lit(EXACT)))

    def _asked(self, terms: DataFrame) -> DataFrame:
        """The rows of ``terms`` (term, repeats allowed). Their folders come from a small job: at most BUCKETS numbers; the words
        themselves only while they are few."""
        words = terms.select("term").distinct()
        stored = self.spark.read.schema(_SCHEMA).parquet(self.path)
        found = words.agg(F.collect_set(bucket_of(F.col("term"))).alias("buckets"), F.count(F.lit(1)).alias("n")).first()
        stored = stored.filter(F.col("bucket").isin(found["buckets"]))
        if 0 < found["n"] <= PUSHED:
            return stored.filter(F.col("term").isin([r["term"] for r in words.collect()]))
        return stored.join(words, "term", "left_semi")

    def lists(self, terms: DataFrame) -> DataFrame:
        """(entity_type, id, term, list) of the words asked for."""
        return self._asked(terms).select("entity_type", "id", "term", "list")

    def exact(self, keys: DataFrame) -> DataFrame:
        """(entity_type, id, _key) of the exact names asked for in ``keys`` (_key)."""
        asked = keys.select(F.concat(F.lit(EXACT), F.col("_key")).alias("term"))
        return self._asked(asked).select("entity_type", "id", F.substring("term", len(EXACT) + 1, 1 << 30).alias("_key"))


def _folded(batches):
    """Rows (term, entity_type, id, at) as (term, entity_type, id, list): one for each word of a document within a run of rows."""
    def made(run):
        rows = pa.Table.from_batches(run).group_by(["term", "entity_type", "id"], use_threads=False).aggregate([("at", "list")])
        return rows.select(["term", "entity_type", "id", "at_list"]).rename_columns(["term", "entity_type", "id", "list"]).to_batches()

    run, n = [], 0
    for batch in batches:
        run.append(batch)
        n += batch.num_rows
        if n >= FOLDED:
            yield from made(run)
            run, n = [], 0
    if n:
        yield from made(run)


def _listed(docs: pa.RecordBatch, weights: list[str]) -> pa.RecordBatch:
    """Rows (term, entity_type, id, list) of documents (entity_type, id, fields) whose fields have words, null if dropped, and a weight."""
    fields = docs.column("fields")
    inside = fields.flatten()
    words = inside.field("words")
    n_words = np.diff(words.offsets.to_numpy())
    n_fields = np.diff(fields.offsets.to_numpy())
    of_field = np.repeat(np.repeat(np.arange(len(docs)), n_fields), n_words)
    kind = pc.index_in(inside.field("weight"), value_set=pa.array(weights)).to_numpy(zero_copy_only=False)
    first = np.cumsum(np.r_[0, np.bincount(of_field, minlength=len(docs))])[:-1]
    at = (np.arange(len(of_field)) - first[of_field] + 1) * 4 + np.repeat(kind, n_words)
    coded = words.flatten().dictionary_encode()
    kept = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))
    codes = coded.indices.take(pa.array(kept)).to_numpy().astype(np.int64)
    key = of_field[kept].astype(np.int64) * max(1, len(coded.dictionary)) + codes
    order = np.argsort(key, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0]) if len(order) else np.zeros(0, np.int64)
    edges = pa.array(np.r_[starts, len(order)].astype(np.int32))
    heads = order[starts]
    row = pa.array(of_field[kept][heads])
    lists = pa.ListArray.from_arrays(edges, pa.array(at[kept][order].astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [coded.dictionary.take(pa.array(codes[heads])), docs.column("entity_type").take(row), docs.column("id").take(row), lists],
        ["term", "entity_type", "id", "list"])


def listed(weights: list[str]):
    """``_listed`` for runs of at most about ``FOLDED`` words, or one document."""
    def run(batches):
        for batch in batches:
            fields = batch.column("fields")
            upto = fields.flatten().field("words").offsets.to_numpy()[fields.offsets.to_numpy() - fields.offsets[0].as_py()]
            begin = 0
            while begin < len(batch):
                end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + FOLDED, side="right")) - 1)
                yield _listed(batch.slice(begin, end - begin), weights)
                begin = end

    return run


def write_lists(lists: DataFrame, path: str, again: DataFrame, exact: DataFrame | None = None) -> None:
    """``write_postings`` of rows (term, entity_type, id, list), one for each word of a document row.

    ``again`` (entity_type, id) has the documents of several rows: only their lists are put together, so that all others are
    sorted and written as they come.
    """
    again = materialize(again.select(F.struct("entity_type", "id").alias("_again")), "postings-again")
    order = ["bucket", "term", "entity_type", "id"]
    rows = lists.select("term", "entity_type", "id", "list")
    if again.first() is not None:
        known = F.struct("entity_type", "id") == F.col("_again")
        twice = rows.join(again, known, "left_semi").groupBy("term", "entity_type", "id").agg(F.array_sort(F.flatten(F.collect_list("list"))).alias("list"))
        rows = rows.join(again, known, "left_anti").unionByName(twice)
    if exact is not None:
        rows = rows.unionByName(_exact_names(exact).distinct())
    place = F.pmod(F.xxhash64("entity_type", "id"), F.lit(SPREAD)).cast("int")
    placed = rows.withColumns({"bucket": bucket_of(F.col("term")), "place": place}).repartition("bucket", "place").drop("place")
    placed.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)


def _exact_names(exact: DataFrame) -> DataFrame:
    names = exact.select(F.explode("exact_keys").alias("key"), "entity_type", "id").filter("key is not null")
    return names.select(F.concat(F.lit(EXACT), F.col("key")).alias("term"), "entity_type", "id", F.array().cast("array<int>").alias("list"))


def write_postings(posted: DataFrame, path: str, exact: DataFrame | None = None) -> None:
    """Write postings (entity_type, id, term, pos, weight) and, if given, exact names (entity_type, id, exact_keys).

    Positions are gathered where the rows are read, so that a word of a document is moved once however often it stands
    there, and rows go by hash to ``SPREAD`` places a bucket: the texts are gone through once, without a pass that samples them.
    """
    from palisade.operators.postings import packed

    rows = posted.select("term", "entity_type", "id", packed().alias("at")).mapInArrow(
        _folded, "term string, entity_type string, id string, list array<int>")
    if exact is not None:
        rows = rows.unionByName(_exact_names(exact))
    order = ["bucket", "term", "entity_type", "id"]
    place = F.pmod(F.xxhash64("entity_type", "id"), F.lit(SPREAD)).cast("int")
    placed = rows.withColumns({"bucket": bucket_of(F.col("term")), "place": place}).repartition("bucket", "place")
    # a place holds all of a key, so positions are gathered without a second shuffle; by sorting, as there are too many keys
    # for a table of lists, and the rows are to be written in that order anyway
    spark = posted.sparkSession
    tables = spark.conf.get(_LIST_TABLES)
    spark.conf.set(_LIST_TABLES, "false")
    try:
        lists = placed.groupBy(*order, "place").agg(F.array_sort(F.flatten(F.collect_list("list"))).alias("list")).drop("place")
        lists.sortWithinPartitions(*order).write.partitionBy("bucket").parquet(path)
    finally:
        spark.conf.set(_LIST_TABLES, tables)


def _hadoop(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def stamp_of(spark: SparkSession, paths: Sequence[str]) -> str:
    """Names, sizes and times of the input files: another stamp means that an index is out of date."""
    seen = hashlib.sha256()
    for path in paths:
        folder, fs = _hadoop(spark, path)
        for status in sorted((str(s.getPath()), s.getLen(), s.getModificationTime()) for s in fs.listStatus(folder)):
            seen.update(repr(status).encode())
    return seen.hexdigest()[:32]


def stored_postings(spark: SparkSession, label: str, inputs: Sequence[str],
                    build: Callable[[], tuple]) -> PostingsIndex:
    """The index of these input files below the session's shared folder; ``build`` is only called if it isn't there yet. It
    returns what ``write_postings`` takes, or what ``write_lists`` does: postings and exact names, or lists, exact names and ``again``.

    It is written beside its place and then renamed, so a job that dies leaves no half index, and of two that build it at
    once one is kept.
    """
    root = scratch_root(spark)
    path = f"{root}/postings-{label}-{stamp_of(spark, inputs)}"
    final, fs = _hadoop(spark, path)
    if not fs.exists(final):
        made = f"{root}/postings-{label}-{uuid.uuid4().hex}"
        posted, exact, *again = build()
        if again:
            write_lists(posted, made, again[0], exact)
        else:
            write_postings(posted, made, exact)
        if not fs.rename(_hadoop(spark, made)[0], final) and not fs.exists(final):
            raise OSError(f"{made} can't be renamed to {path}")
    return PostingsIndex(spark, path)
