"""Importance resampling towards a target: array-scored weights, then a distributed LSD radix sort.

Texts are lower-cased (A-Z). Words are runs of a-z, 0-9 and all characters beyond ASCII; features are the runs of 1 to ``grams``
words joined by one space, repeats counted; the bucket of a feature is the crc32 of its UTF-8 bytes modulo ``buckets``. Each
task counts its buckets in one array, and the arrays' entries are added up by bucket, so that no more than ``buckets`` numbers come to
the driver and none goes out but their gains. A document's weight is the sum of its features' gains.

The score is the weight and Gumbel noise of the document's id: the highest scores are a sample without replacement. They are found by
sorting: the key (score descending, doc_id ascending) is cut into digits of ``DIGIT`` bits, and each pass from the least significant
digit on is a stable counting sort. A pass counts the rows of each digit in each part, adds the counts of smaller digits and of
the same digit in earlier parts to the row's place among its equals in its part, and so knows the row's destination. Parts
are runs of destinations of equal size, whatever the keys: no key is hot. Digits that all rows share are left out.
Each pass is written before the next one reads it, so that a part that is lost is made again with the same places.

Defined results: a null text has no words; a null doc_id counts as the empty string in the noise and stands before all others among
equal scores; rows of equal score and doc_id are drawn in the order of the input's parts; rows without features weigh 0;
an empty table gives an empty one, and an empty target counts nothing; further columns are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.llm.common import discard, other_columns, slices, stage, texts_of

#: Bits of a digit, most rows of a part, longest word whose checksum is worked out by position beside others.
DIGIT, MOST, LONG = 11, 1 << 20, 40

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Outside words lie \x00-\x2F, \x3A-\x60 and \x7B-\x7F, looked up after lower-casing.
_INSIDE = np.ones(256, bool)
_INSIDE[0x00:0x30] = _INSIDE[0x3A:0x61] = _INSIDE[0x7B:0x80] = False
_U = np.uint32
#: The table of the reflected polynomial 0xEDB88320.
_CRC = np.arange(256, dtype=_U)
for _ in range(8):
    _CRC = np.where(_CRC & _U(1), (_CRC >> _U(1)) ^ _U(0xEDB88320), _CRC >> _U(1))


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; begin, end and text of each word."""
    data, offsets = texts_of(column)
    data = _LOWER[data]
    inside = _INSIDE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return data, begin, end, np.searchsorted(offsets[1:], begin, side="right")


def _fed(state: np.ndarray, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Running checksums (inverted, as between bytes) after the bytes of one word each."""
    state, length = state.copy(), end - begin
    order = np.argsort(-length, kind="stable")
    for k in order[: np.searchsorted(-length[order], -LONG, side="left")].tolist():
        state[k] = ~_U(zlib.crc32(data[begin[k] : end[k]].tobytes(), int(~state[k])))
    order = order[np.searchsorted(-length[order], -LONG, side="left") :]
    length = length[order]
    for step in range(int(length[0]) if len(length) else 0):
        now = order[: np.searchsorted(-length, -step, side="left")]
        held = state[now]
        state[now] = _CRC[(held ^ data[begin[now] + step]) & _U(255)] ^ (held >> _U(8))
    return state


def feature_buckets(column: pa.Array, grams: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each feature, and the number of words of each text."""
    data, begin, end, text = _words(column)
    found, owners = [], []
    state, first = np.full(len(begin), 0xFFFFFFFF, _U), np.arange(len(begin))
    for n in range(grams):
        if n:
            first = first[first + n < len(begin)]
            first = first[text[first + n] == text[first]]
            held = state[first]
            state[first] = _CRC[(held ^ _U(32)) & _U(255)] ^ (held >> _U(8))
        state[first] = _fed(state[first], data, begin[first + n], end[first + n])
        found.append((~state[first] % _U(buckets)).astype(np.int64))
        owners.append(text[first])
    return np.concatenate(found), np.concatenate(owners), np.bincount(text, minlength=len(column))


def _counted(grams: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            total += np.bincount(feature_buckets(batch.column(0), grams, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, grams: int = 1, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts lie in each bucket."""
    rows = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sums = rows.mapInArrow(_counted(grams, buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in sums.toLocalIterator():
        counts[row["bucket"]] = row["n"]
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's and the source's share of each bucket, both smoothed by one."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_s + n) / ((s + 1.0) * (all_t + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(gains: np.ndarray, grams: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            at = batch.schema.get_field_index("text")
            found, owner, n_words = feature_buckets(batch.column(at), grams, len(gains))
            weight = np.zeros(batch.num_rows, np.int64)
            np.add.at(weight, owner, gains[found])
            n_features = np.bincount(owner, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(weight)],
                [*batch.schema.names, "n_words", "n_features", "weight"])

    return run


def _noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _digits(rows: DataFrame, keys: list[str]) -> list[Column]:
    """The digits that differ anywhere, least significant first, of keys most significant first, read as unsigned."""
    found = rows.agg(*[f(k).alias(f"{name}_{k}") for k in keys for name, f in (("all", F.bit_and), ("any", F.bit_or))]).first()
    digits = []
    for k in reversed(keys):
        differ = ((found[f"all_{k}"] or 0) ^ (found[f"any_{k}"] or 0)) & ((1 << 64) - 1)
        for shift in range(0, 64, DIGIT):
            if differ >> shift & ((1 << DIGIT) - 1):
                digits.append(F.shiftrightunsigned(F.col(k), shift).bitwiseAND((1 << DIGIT) - 1).cast("int"))
    return digits


def radix_ranks(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """rank (1, 2, 3, ...) of each row by its keys (longs, read as unsigned), and the number of rows.

    ``rows`` is a staged table of ``part`` (int), ``place`` (long, orders the rows of a part) and the keys; ties keep this order.
    """
    spark = rows.sparkSession
    columns = [c for c in rows.columns if c not in ("part", "place")]
    n = rows.count()
    wanted = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    size = max(1, min(MOST, -(-n // wanted)))
    digits = _digits(rows, keys) or [F.lit(0)]
    for k, digit in enumerate(digits):
        dealt = rows.withColumn("digit", digit)
        counts = dealt.groupBy("digit", "part").agg(F.count(F.lit(1)).alias("n"))
        # at most 2 ** DIGIT sums come to the driver
        sums = sorted((r["digit"], r["n"]) for r in counts.groupBy("digit").agg(F.sum("n").alias("n")).collect())
        before = np.cumsum([0, *[x for _, x in sums]]).tolist()
        bases = spark.createDataFrame([(d, b) for (d, _), b in zip(sums, before)], "digit int, base long")
        earlier = Window.partitionBy("digit").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        first = (counts.withColumn("upto", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(F.broadcast(bases), "digit")
                 .select("digit", "part", (F.col("base") + F.col("upto")).alias("first")))
        equals = Window.partitionBy("digit", "part").orderBy("place")
        placed = (dealt.withColumn("own", F.row_number().over(equals) - 1).join(first, ["digit", "part"])
                  .select(*columns, (F.col("first") + F.col("own")).alias("place")))
        made = stage(placed.select(*columns, F.expr(f"int(place div {size})").alias("part"), "place"), "radix-pass")
        if k:
            discard(rows)
        rows = made
    return rows.select(*columns, (F.col("place") + 1).alias("rank")), n


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, grams: int = 1, buckets: int = 10_000,
             seed: int = 2024, keep_text: bool = False) -> DataFrame:
    """Every document as row (its columns but the text), n_words, n_features, weight, score, rank.

    ``rank`` is that of the drawn documents, null for the others: of the n documents with at least ``min_words`` words the
    floor(percent * n / 100) highest scores. With ``keep_text`` the text is kept too.
    """
    if not 0 <= percent <= 100 or grams < 1 or buckets < 1:
        raise ValueError("percent lies from 0 to 100; grams and buckets are positive")
    gains = bucket_gains(bucket_counts(docs, grams, buckets), bucket_counts(target, grams, buckets))
    rows = docs.select(F.struct(*other_columns(docs)).alias("row"), F.col("text").cast("string").alias("text"))
    made = T.StructType([*rows.schema, *[T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]])
    scored = rows.mapInArrow(_weighed(gains, grams), made)
    doc_id = F.col("row.doc_id")
    scored = scored.withColumn("score", F.col("weight") + _noise(doc_id, seed))
    # numbered before it is written: a later scan may pack the files into other partitions
    scored = stage((scored if keep_text else scored.drop("text")).withColumn("at", F.monotonically_increasing_id()), "resample-scored")

    able = scored.filter(F.col("n_words") >= min_words)
    most = able.agg(F.max("score").alias("most")).first()["most"] or 0
    narrow = able.select(
        "at", (F.lit(most) - F.col("score")).alias("below"), doc_id.isNotNull().cast("long").alias("has_id"),
        F.coalesce(doc_id.cast("long"), F.lit(0)).bitwiseXOR(F.lit(-(1 << 63))).alias("id"),
        F.shiftright("at", 33).cast("int").alias("part"), F.col("at").alias("place"))
    ranks, n = radix_ranks(stage(narrow, "resample-keys"), ["below", "has_id", "id"])
    drawn = ranks.filter(F.col("rank") <= percent * n // 100).select("at", "rank")
    return scored.join(drawn, "at", "left").drop("at")


def draw(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents with all their columns, and their rank as ``draw_rank``."""
    found = resample(docs, target, keep_text=True, **options).filter("rank is not null")
    columns = [F.col("text") if c == "text" else F.col("row").getField(c) for c in docs.columns]
    return found.select(*[c.alias(name) for c, name in zip(columns, docs.columns)], F.col("rank").alias("draw_rank"))
