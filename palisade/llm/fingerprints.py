"""SimHash fingerprints of texts and search within a Hamming radius, in DataFrame functions only.

A text's terms are its pairs of neighbouring words (the last word is paired with nothing). Each term is hashed to 128 bits; every
bit votes for or against with the term's weight, which is the number of times the term occurs. A fingerprint bit is set if the
votes for it exceed those against.

Votes are counted without a column per bit: the hash bits 0, 16, 32 and 48 places above each other are added as four 16-bit
fields of one number, over stretches of at most 2**15 terms, and the stretches' sums are then added in 32-bit fields.

``neighbours`` places documents in descending order of doc_id: the table is dealt into ranges of doc_id (bounds from
quantiles), the first document of each range is copied into the range before, and a window over each range looks one row
ahead. Texts are shuffled once, by range; votes are added up within it.

``within_radius``: fingerprints are cut into radius + 2 blocks. Two within the radius agree in two blocks at least, so each
pair of blocks gives a table keyed by them, and equal keys give candidates that are then compared in full.

Defined results: null texts count as empty; an empty text has one (empty) term; a null doc_id comes last in the
order; rows of equal doc_id are ordered by the hash of their texts, equal rows after each other; an empty table gives an empty
one; further columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import stage

BITS = 128
STRETCH = 15
#: The lowest bit of each 16-bit and each 32-bit field of a number.
_QUARTERS, _HALVES = 0x0001000100010001, 0x0000FFFF0000FFFF
_LOWEST = -(1 << 63)
_SPACE = "\\x20\\x09-\\x0D"


def terms(text: Column) -> Column:
    """Array of (a, b): each word and the one after it."""
    words = F.split(F.regexp_replace(text, f"^[{_SPACE}]+|[{_SPACE}]+$", ""), f"[{_SPACE}]+")
    return F.arrays_zip(words.alias("a"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(1))).alias("b"))


def _packed() -> list[Column]:
    """For each of the two hashes, 16 sums that hold the votes for four bits each."""
    return [F.sum(F.shiftright(h, j).bitwiseAND(F.lit(_QUARTERS))).alias(f"{h}{j}") for h in ("g", "h") for j in range(16)]


def _votes() -> list[Column]:
    found = []
    for h in ("g", "h"):
        for j in range(16):
            four = F.col(f"{h}{j}")
            found.append(F.sum(four.bitwiseAND(F.lit(_HALVES))).alias(f"{h}{j}low"))
            found.append(F.sum(F.shiftrightunsigned(four, 16).bitwiseAND(F.lit(_HALVES))).alias(f"{h}{j}high"))
    return found


def _number(h: str) -> Column:
    """The 64 fingerprint bits of one hash: set where twice the votes for exceed all votes."""
    bits = []
    for j in range(16):
        for part, lift in (("low", 0), ("high", 16)):
            two = F.col(f"{h}{j}{part}")
            for value, place in ((two.bitwiseAND(F.lit(0xFFFFFFFF)), 0), (F.shiftrightunsigned(two, 32), 32)):
                place += j + lift
                one = (1 << place) - (1 << 64 if place == 63 else 0)
                bits.append(F.when(value * 2 > F.col("total"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2])]
    return bits[0]


def simhash(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, high and low: the two halves of each text's fingerprint. Keys tell rows apart."""
    exploded = (rows.select(*keys, F.posexplode(terms(F.col(text))).alias("at", "t"))
                .select(*keys, F.shiftright("at", STRETCH).alias("stretch"), F.xxhash64("t.a", "t.b").alias("g"),
                        F.xxhash64(F.lit(1), "t.b", "t.a").alias("h")))
    packed = exploded.groupBy(*keys, "stretch").agg(F.count(F.lit(1)).alias("total"), *_packed())
    votes = packed.groupBy(*keys).agg(F.sum("total").alias("total"), *_votes())
    return votes.select(*keys, _number("g").alias("high"), _number("h").alias("low"))


def hexed(high: Column, low: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def likeness(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Share of equal bits."""
    apart = F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))
    return 1 - apart / F.lit(float(BITS))


def _range_of(order: Column, bounds: list[int]) -> Column:
    """Number of bounds above the value, found in two steps (bounds descend)."""
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + width] for k in range(0, len(bounds), width)]
    heads = F.array(*[F.lit(g[0]).cast("long") for g in groups])
    above = F.size(F.filter(heads, lambda b: b > order))
    within = F.array(*[F.array(*[F.lit(b).cast("long") for b in g]) for g in groups])
    return F.when(above == 0, 0).otherwise(
        (above - 1) * width + F.size(F.filter(F.element_at(within, F.greatest(above, F.lit(1))), lambda b: b > order)))


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text and the text that follows in descending doc_id; part and place order the rows, copies are marked."""
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("order"))
    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = ids.agg(F.percentile_approx("order", [k / parts for k in range(1, parts)], 10 * parts)).first()[0] or [0]
    part = _range_of(F.col("order"), sorted(set(at), reverse=True))
    firsts = sorted((r["part"], r["first"]) for r in ids.groupBy(part.alias("part")).agg(F.max("order").alias("first")).collect())
    # the first document of a range also ends the range before; that of the first range ends the last
    ends = [F.struct(F.lit(first).cast("long").alias("order"), F.lit(firsts[k - 1][0]).cast("int").alias("part"))
            for k, (_, first) in enumerate(firsts)]
    ends = spark.range(1 if ends else 0).select(F.inline(F.array(*ends or [F.struct(F.lit(0).cast("long").alias("order"), F.lit(0).alias("part"))])))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("order", F.coalesce("doc_id", F.lit(_LOWEST))).withColumn("tie", F.xxhash64("text"))
    copies = (rows.join(F.broadcast(ends), "order").groupBy("order", "part")
              .agg(F.min(F.struct("tie", "text", "doc_id")).alias("r")).select("r.*", "order", "part").withColumn("copy", F.lit(True)))
    rows = rows.withColumn("part", part).withColumn("copy", F.lit(False)).unionByName(copies.select(*rows.columns, "part", "copy"))
    order = Window.partitionBy("part").orderBy("copy", F.desc("order"), "tie")
    return rows.withColumn("place", F.row_number().over(order)).withColumn("following", F.lead("text").over(order))


def edited(text: Column, n_chars: Column, following: Column) -> Column:
    """The text with its last third replaced by the first as many code points of the following one."""
    third = F.floor(n_chars / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), (n_chars - third).cast("int")), F.substring(following, F.lit(1), third))


def within_radius(queries: DataFrame, fingerprints: DataFrame, radius: int = 3) -> DataFrame:
    """For each distinct fingerprint (high, low) of the queries: n, the summed ``times`` of fingerprints within the radius.

    ``fingerprints``: high, low, times, each fingerprint once.
    """
    n_blocks = radius + 2
    edges = [BITS * k // n_blocks for k in range(n_blocks + 1)]

    def block(k: int) -> Column:
        whole = [(F.col("low"), 0), (F.col("high"), 64)]
        parts = []
        for number, base in whole:
            low, high = max(edges[k], base), min(edges[k + 1], base + 64)
            if low < high:
                mask = (1 << (high - low)) - 1
                parts.append(F.shiftrightunsigned(number, low - base).bitwiseAND(F.lit(mask if high - low < 64 else -1)))
        return F.concat_ws("-", *[F.hex(p) for p in parts])

    def tables(rows: DataFrame) -> DataFrame:
        keys = [F.xxhash64(F.lit(a), block(a), F.lit(b), block(b)) for a, b in combinations(range(n_blocks), 2)]
        return rows.withColumn("key", F.explode(F.array(*keys)))

    asked = tables(queries.select("high", "low").distinct()).select("key", F.col("high").alias("q_high"), F.col("low").alias("q_low"))
    apart = F.bit_count(F.col("high").bitwiseXOR(F.col("q_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("q_low")))
    pairs = asked.join(tables(fingerprints), "key").filter(apart <= radius).select("q_high", "q_low", "high", "low", "times").distinct()
    return pairs.groupBy(F.col("q_high").alias("high"), F.col("q_low").alias("low")).agg(F.sum("times").alias("n"))


def fingerprint_documents(docs: DataFrame, radius: int = 3, every: int = 100) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, their likeness, and for query rows (ids divisible
    by ``every``) the number of other documents whose fingerprints lie within the radius."""
    rows = neighbours(docs).withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("n_chars"), F.coalesce("following", F.lit(""))))
    keys = ["part", "place", "copy", "doc_id", "n_chars"]
    texts = rows.select(*keys, F.posexplode(F.array("text", "edited")).alias("which", "text"))
    texts = texts.withColumn("digest", F.when(F.col("which") == 1, F.sha2("text", 256)).otherwise(F.lit("")))
    made = stage(simhash(texts, [*keys, "which", "digest"]), "fingerprints")

    own = made.filter("which = 0").drop("which", "digest")
    new = made.filter("which = 1").select("part", "place", F.col("digest").alias("edited_sha256"), F.col("high").alias("e_high"),
                                          F.col("low").alias("e_low"))
    order = Window.partitionBy("part").orderBy("place")
    both = (own.withColumn("n_high", F.lead("high").over(order)).withColumn("n_low", F.lead("low").over(order))
            .filter(~F.col("copy")).join(new, ["part", "place"]))
    single = own.filter(~F.col("copy"))
    times = single.groupBy("high", "low").agg(F.count(F.lit(1)).alias("times"))
    asked = single.filter(F.col("doc_id") % every == 0)
    found = within_radius(asked, times, radius)
    mine = (F.col("high"), F.col("low"))
    return (both.join(found, ["high", "low"], "left")
            .select("doc_id", "n_chars", "edited_sha256", hexed(*mine).alias("fingerprint"),
                    hexed(F.col("e_high"), F.col("e_low")).alias("edited_fingerprint"),
                    likeness(mine, (F.col("e_high"), F.col("e_low"))).alias("near_edited"),
                    likeness(mine, (F.col("n_high"), F.col("n_low"))).alias("near_next"),
                    F.when(F.col("doc_id") % every == 0, F.col("n") - 1).alias("n_within")))
