"""Packing of token sequences: repeat counts of length combinations by non-negative least squares.

Every document becomes its token ids and one end id. Whole windows are cut off the front. What is left of each
document (1 to window - 1 ids) is packed: shallow combinations of two or three lengths that fill a window exactly are
enumerated, non-negative least squares finds how often each is to be used so that the histogram of lengths is met, the
counts are rounded down, and the pieces that then remain are laid one after the other, cut where a window ends.

Only the histogram (window - 1 numbers) and the used combinations (at most as many again) pass through the driver.

Defined results: null and empty texts give one piece with the end id alone; repeated rows and repeated ids are packed
as rows of their own; an empty table gives no pieces; further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import kept_in_worker, slices, stage

#: The characters with Unicode's White_Space property.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units are cut where a pre-token always ends: before white space that follows black, after a run of letters (these are
#: all letters; none may follow), after a line feed alone. They are encoded on their own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_UNIT = re.compile(f" ?[{_LETTERS}]++(?![^\\W\\d_])|\n(?=[^{_WS}])|[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Fixed value: the pattern that splits text before the merges.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_KEEP = 100_000
_PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"


class Encoder:
    """Little-endian ids of whole texts, by the units that were met before.

    New units are encoded many at a time, joined by line feeds: one between black characters, or before a single space,
    is a pre-token of its own, so its id separates the units' ids. Units met are kept in two generations of bounded size.
    ``ranks``: the same vocabulary as a file of ranks; its library gives the same ids at a quarter of the time.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.tokenizer = self.ranked = None
        if not ranks:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.encode_special_tokens = True
        else:
            import tiktoken

            with open(ranks, "rb") as file:
                merges = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PRE_TOKEN, mergeable_ranks=merges, special_tokens={})
        self.feed = self._ids("\n")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, text: str) -> list[int]:
        if self.ranked:
            return self.ranked.encode_ordinary(text)
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _learn(self, units: set[str]) -> None:
        known = self.known
        for unit in units & self.before.keys():
            known[unit] = self.before[unit]
        new = units - known.keys()
        plain = [u for u in new if not (u[1:2] if u[0] == " " else u[0]).isspace() and u != " " and "\n" not in u]
        for at in range(0, len(plain), 5000):
            some = plain[at : at + 5000]
            ids = np.asarray(self._ids("\n".join(some)), "<u4")
            parts = np.flatnonzero(ids == self.feed[0]) if len(self.feed) == 1 else ids[:0]
            if len(parts) == len(some) - 1:
                ends, data = [*(4 * parts).tolist(), 4 * len(ids)], ids.tobytes()
                begin = 0
                for unit, end in zip(some, ends):
                    known[unit] = data[begin:end]
                    begin = end + 4
        for unit in new - known.keys():
            known[unit] = np.asarray(self._ids(unit), "<u4").tobytes()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [_UNIT.findall(text) for text in texts]
        if len(self.known) > _KEEP:
            self.before, self.known = self.known, {}
        new = set().union(*split) - self.known.keys()
        if new:
            self._learn(new)
        of = self.known.__getitem__
        return [b"".join(map(of, units)) for units in split]


def encoder(path: str, ranks: str | None) -> Encoder:
    """The worker's encoder; what it has met stays known for later tasks."""
    return kept_in_worker(("encoder", path, ranks), lambda: Encoder(path, ranks))


def _cut(tokenizer_path: str, ranks_path: str | None, window: int, end_id: int):
    def run(batches):
        encode, end, full = encoder(tokenizer_path, ranks_path), np.asarray([end_id], "<u4").tobytes(), 4 * window
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()),
                            ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in (part for whole in batches for part in slices(whole, "text")):
            docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for doc, ids in zip(docs, encode([text or "" for text in texts])):
                ids += end
                n = len(ids) // 4
                whole = len(ids) - len(ids) % full
                rows += [(doc, at // 4, window, zlib.crc32(ids[at : at + full]), n, None) for at in range(0, whole, full)]
                if whole < len(ids):
                    rest = ids[whole:]
                    rows.append((doc, whole // 4, len(rest) // 4, zlib.crc32(rest), n, rest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def combinations(window: int) -> list[tuple[int, ...]]:
    """All pairs that fill the window, and the triples on a grid of a 64th of it."""
    step = max(1, window // 64)
    pairs = [(a, window - a) for a in range(1, window // 2 + 1)]
    triples = [(a, b, window - a - b) for a in range(step, window // 3 + 1, step)
               for b in range(a, (window - a) // 2 + 1, step)]
    return pairs + triples


def repeat_counts(histogram: np.ndarray, used: list[tuple[int, ...]], rounds: int = 200) -> np.ndarray:
    """Non-negative least squares by an active set: x >= 0 with the smallest |A x - histogram|."""
    a = np.zeros((len(histogram), len(used)))
    for p, lengths in enumerate(used):
        for length in lengths:
            a[length, p] += 1
    gram, want = a.T @ a, a.T @ histogram
    x = np.zeros(len(used))
    passive = np.zeros(len(used), bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(want).max(initial=0)))
    for _ in range(rounds):
        slope = np.where(passive, -np.inf, want - gram @ x)
        best = np.argsort(-slope)[: 8 if passive.any() else len(used) // 2]
        best = best[slope[best] > tolerance]
        if not len(best):
            break
        passive[best] = True
        while True:
            at = np.flatnonzero(passive)
            z = np.linalg.solve(gram[np.ix_(at, at)] + 1e-9 * np.eye(len(at)), want[at])
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            low = z <= 0
            old = x[at]
            ratio = np.min(np.where(low, old / np.maximum(old - z, 1e-300), np.inf))
            x[at] = np.maximum(old + min(ratio, 1.0) * (z - old), 0)
            out = at[low & (x[at] <= tolerance)]
            passive[out if len(out) else at[low]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def rounded(x: np.ndarray, histogram: np.ndarray, used: list[tuple[int, ...]]) -> np.ndarray:
    """Whole counts that never ask for more pieces of a length than there are."""
    left, counts = histogram.astype(np.int64).copy(), np.zeros(len(used), np.int64)
    for p in np.argsort(-x, kind="stable"):
        need: dict[int, int] = {}
        for length in used[p]:
            need[length] = need.get(length, 0) + 1
        counts[p] = min(int(x[p] + 1e-6), *(int(left[k]) // n for k, n in need.items()))
        for k, n in need.items():
            left[k] -= n * counts[p]
    return counts


def _slots(spark, counts: np.ndarray, used: list[tuple[int, ...]], window: int) -> DataFrame:
    """For each length the ranks [low, high) that go to one place of one combination."""
    taken, rows, base = np.zeros(window + 1, np.int64), [], 0
    for p in np.flatnonzero(counts):
        offset, n = 0, int(counts[p])
        for length in used[p]:
            low = int(taken[length])
            rows.append((length, low, low + n, base, offset))
            taken[length] += n
            offset += length
        base += n
    return spark.createDataFrame(rows, "slot_length int, low long, high long, base long, slot_offset int")


def _lay_out(window: int):
    """Cut each remaining piece where a window ends and give place and checksum of its parts."""
    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence", pa.int64()),
                            ("offset", pa.int64())])
        for batch in batches:
            rows = []
            for doc, start, total, before, ids in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = 0, len(ids) // 4
                while at < n:
                    room = window - (before + at) % window
                    part = ids[4 * at : 4 * min(n, at + room)]
                    rows.append((doc, start + at, len(part) // 4, zlib.crc32(part), total, (before + at) // window,
                                 (before + at) % window))
                    at += room
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, ranks_path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences hold ``window`` ids but for the last of the remaining pieces, which is padded. Kinds of sequence keep
    apart by the remainder of sequence_id by 3: whole windows, combinations, remaining pieces.
    """
    spark = docs.sparkSession
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = pieces.mapInArrow(_cut(tokenizer_path, ranks_path, window, end_id), _PIECES).withColumn("row", F.monotonically_increasing_id())
    # written with their numbers: these would be others in a scan that packs the files into other partitions
    pieces = stage(pieces.withColumn("part", F.shiftright("row", 33)), "pack-pieces")
    out = ["doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens"]

    whole = pieces.filter("ids is null").select(*out, (F.col("row") * 3).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = pieces.filter("ids is not null")

    # ranks within a length: a part's own numbering, after the counts of the parts before it
    counted = rest.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(window + 1)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[row["length"]] = row["n"]
    used = combinations(window)
    counts = rounded(repeat_counts(histogram, used), histogram, used)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part", "length").orderBy("row")
    ranked = (rest.drop("ids").withColumn("own", F.row_number().over(own) - 1)
              .join(starts, ["length", "part"]).withColumn("rank", F.col("first") + F.col("own")).drop("first", "own"))
    slots = F.broadcast(_slots(spark, counts, used, window))
    placed = stage(ranked.join(slots, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("low"))
                               & (F.col("rank") < F.col("high")), "left")
                   .withColumn("sequence", F.col("base") + F.col("rank") - F.col("low"))
                   .select("row", "part", *out, "sequence", F.col("slot_offset").cast("long").alias("offset")), "pack-placed")
    fitted = placed.filter("sequence is not null").select(*out, (F.col("sequence") * 3 + 1).alias("sequence_id"), "offset")

    left = placed.filter("sequence is null").select("row", "part", "length")
    sums = left.groupBy("part").agg(F.sum("length").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("part").orderBy(F.desc("length"), "row").rowsBetween(Window.unboundedPreceding, -1)
    left = (left.withColumn("own", F.coalesce(F.sum("length").over(own), F.lit(0))).join(sums, "part")
            .select("row", (F.col("first") + F.col("own")).alias("before")))
    laid = (rest.join(left, "row").select("doc_id", "start", "doc_tokens", "before", "ids")
            .mapInArrow(_lay_out(window), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
                        "sequence long, offset long"))
    laid = laid.select(*out, (F.col("sequence") * 3 + 2).alias("sequence_id"), "offset")
    return whole.unionByName(fitted).unionByName(laid)
