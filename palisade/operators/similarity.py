"""Lossless similarity join of short names: ratio of matched characters at or above a threshold.

The ratio is ``2 * M / (len(a) + len(b))`` where M counts the characters in matching blocks, which
form a common subsequence. A ratio of at least t therefore bounds the deletions and insertions that
turn one name into the other, and each of those can destroy only two (deletion) or one (insertion)
of a name's bigrams. A name's bigrams, rarest first, up to that bound plus one, must share an entry
with the same list of any partner: the prefix-filter principle. So the join is an equi join on
rare bigrams; no pair outside it can reach the threshold. Below ``BIGRAM_FLOOR`` the bound can use
up all bigrams of a short name, and single characters are used in the same way.

Names of one language share so many bigrams that such a join makes every pair several times over. Then
all names of like length are compared in blocks instead: a product of 0/1 matrices counts the bigrams
that the pairs of two blocks share, and pairs that lack more than the bound go no further. Both ways are
lossless and give the same pairs; the numbers of pairs that they would make decide between them.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.session import materialize

BIGRAM_FLOOR = 0.82
COMMON_TOKENS = 20_000  # size bound of the broadcast frequency table
BITMAP_WORDS = 8  # of 64 bits
PAIRS_PER_TASK = 20_000_000  # a token whose two sides make more pairs is dealt to several tasks
FEW_PAIRS = 1_000_000  # up to so many, names are always joined on tokens
JOINED_PAIR_COST = 8  # of a pair joined on a token, in pairs compared by a product of matrices
BLOCK_NAMES = 4096  # names in a block, about; twice as many of names under SHORT
SHORT = 128
BAND = 1.1  # names of a band differ in length by this factor
MOST_TASKS = 4096
_WORD, _CHARS = 64, 256  # bits of a word; columns of characters


@lru_cache(maxsize=4096)
def _places(name: str) -> dict[str, int]:
    """For each character the bits of its places."""
    found: dict[str, int] = {}
    for k, char in enumerate(name):
        found[char] = found.get(char, 0) | 1 << k
    return found


def _longest_common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one step of bits per character."""
    places, every = _places(a), (1 << len(a)) - 1
    open_ = every
    for char in b:
        met = open_ & places.get(char, 0)
        open_ = (open_ + met | open_ - met) & every
    return len(a) - open_.bit_count()


def _ratio(a: str, b: str, floor: float):
    """Matcher ratio, or None below the floor; the cheap upper bounds are tried first."""
    total = len(a) + len(b)
    if total and (2 * min(len(a), len(b)) / total < floor or 2 * _longest_common(a, b) / total < floor):
        return None
    ratio = SequenceMatcher(None, a, b).ratio()
    return ratio if ratio >= floor else None


def sequence_ratio(left: Column, right: Column, floor: float = 0.0) -> Column:
    """Standard-library matcher ratio in Arrow batches; the order of the arguments matters to it."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratio(x, y, floor) for x, y in zip(a, b)], dtype="float64")

    return ratio(left, right)


def _numbered(tokens: Column) -> Column:
    """Make repeats distinct: each token carries its occurrence number within the name."""
    ordered = F.array_sort(tokens)
    return F.transform(
        ordered,
        lambda x, i: F.concat(
            x, F.lit("\x1f"), (i + 2 - F.array_position(ordered, x)).cast("string")
        ),
    )


def _grams(name: Column, width: int) -> Column:
    return F.transform(
        F.sequence(F.lit(1), F.length(name) - (width - 1)),
        lambda i: F.substr(name, i, F.lit(width)),
    )


def _prefix_length(length: Column, threshold: float, width: int) -> Column:
    """How many leading tokens must be compared so that no partner at the threshold is missed."""
    if width == 1:
        least = F.greatest(F.lit(1), F.ceil(length * (threshold / (2 - threshold)) - 1e-9))
        return (length - least + 1).cast("int")
    # deletions d and insertions i of a partner of length m: d + i <= (1 - t)(n + m), d - i = n - m;
    # bigrams lost 2d + i. Its maximum over n*t/(2-t) <= m <= n*(2-t)/t lies at the shortest or the
    # longest partner, because it is linear in m.
    def lost(m: Column) -> Column:
        return 1.5 * (1 - threshold) * (length + m) + 0.5 * (length - m)

    ends = F.greatest(
        lost(length * (threshold / (2 - threshold))), lost(length * ((2 - threshold) / threshold))
    )
    return (F.floor(ends + 1e-9) + 1).cast("int")


def _tokens(names: DataFrame, name: str, width: int) -> DataFrame:
    """(name, token); a name shorter than a gram is its own token."""
    grams = F.when(F.length(name) >= width, _grams(F.col(name), width)).otherwise(F.array(name))
    return names.select(name, F.explode(_numbered(grams)).alias("_token"))


def _lost(n: Column, m: Column, threshold: float, width: int) -> Column:
    """Most tokens of a name of length n that a partner of length m at the threshold can lack."""
    both, apart = (1 - threshold) * (n + m), n - m
    if width == 1:
        return F.floor(0.5 * both + 0.5 * apart + 1e-9)
    return F.floor(1.5 * both + 0.5 * apart + 1e-9)


def _bitmap(hashes: Column) -> list[Column]:
    """Token set as a fixed bitmap: two names differ in no more bits than in tokens."""
    one = F.lit(1).cast("bigint")

    def word(number: int) -> Column:
        def add(acc, h):
            bit = F.call_function("shiftleft", one, F.pmod(h, F.lit(64)).cast("int"))
            mine = F.pmod(F.shiftright(h, 6), F.lit(BITMAP_WORDS)) == number
            return F.when(mine, acc.bitwiseOR(bit)).otherwise(acc)

        return F.aggregate(hashes, F.lit(0).cast("bigint"), add)

    return [word(number) for number in range(BITMAP_WORDS)]


def _bits_only_left(left: str, right: str) -> Column:
    total = F.lit(0)
    for i in range(BITMAP_WORDS):
        total = total + F.bit_count(F.col(f"{left}{i}").bitwiseAND(F.bitwise_not(F.col(f"{right}{i}"))))
    return total


def _signatures(names: DataFrame, name: str, common: DataFrame, threshold: float, width: int) -> DataFrame:
    """(name, prefix array of token hashes in the global order rare -> common, token bitmap)."""
    ranked = _tokens(names, name, width).join(F.broadcast(common), "_token", "left")
    key = F.struct(
        F.coalesce("_df", F.lit(0)).alias("df"), F.xxhash64("_token").alias("h")
    )
    packed = ranked.groupBy(name).agg(F.array_sort(F.collect_list(key)).alias("_all"))
    take = _prefix_length(F.length(F.col(name)), threshold, width)
    hashes = F.transform("_all", lambda x: x.getField("h"))
    bits = [expr.alias(f"{name}_bits{i}") for i, expr in enumerate(_bitmap(hashes))]
    return packed.select(
        name,
        F.transform(F.slice("_all", F.lit(1), take), lambda x: x.getField("h")).alias("_prefix"),
        *bits,
    )


def _marks(names: list[str], width: int, columns: int, vocabulary: dict) -> np.ndarray:
    """0/1 rows of the names' numbered tokens, dealt to so many columns."""
    out = np.zeros((len(names), columns), bool)
    for row, name in enumerate(names):
        seen: dict = {}
        for gram in [name[k : k + width] for k in range(len(name) - width + 1)] or [name]:
            seen[gram] = number = seen.get(gram, 0) + 1
            out[row, vocabulary.setdefault((gram, number), len(vocabulary)) % columns] = True
    return out


def _lacks(n: np.ndarray, m: np.ndarray, threshold: float, width: int) -> np.ndarray:
    """``_lost`` for arrays."""
    return (0.5 if width == 1 else 1.5) * (1 - threshold) * (n + m) + 0.5 * (n - m) + 1e-6


def _coded_chars(names: list[str]) -> np.ndarray:
    """Characters of the names as columns of ``_placed_chars``; the last one is none, and all that a name of more than 64 has."""
    out = np.full((len(names), _WORD), _CHARS, np.int64)
    for row, name in enumerate(names):
        if len(name) <= _WORD:
            out[row, : len(name)] = [ord(x) % _CHARS for x in name]
    return out


def _placed_chars(names: list[str]) -> np.ndarray:
    """For each name and character the bits of its places; no bits in names of more than 64."""
    out = np.zeros((len(names), _CHARS + 1), np.uint64)
    for row, name in enumerate(names):
        for k, x in enumerate(name if len(name) <= _WORD else ""):
            out[row, ord(x) % _CHARS] |= np.uint64(1 << k)
    return out


def _common_bound(p: np.ndarray, q: np.ndarray, places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """At least the length of the longest common subsequence of each pair, for all pairs at a time; infinite for a name of more than 64.

    Characters that share a column make it longer, never shorter.
    """
    long = ~places.any(axis=1)[p] | (codes[:, 0] == _CHARS)[q]
    open_ = np.full(len(p), ~np.uint64(0))
    for column in codes.T:
        met = open_ & places[p, column[q]]
        open_ = (open_ + met) | (open_ - met)
    return np.where(long, np.inf, _WORD - np.bitwise_count(open_).astype(np.float64))


def _share_tokens(a: list[str], b: list[str], threshold: float, width: int, most: int = 1 << 22):
    """Index arrays of the pairs whose lengths, shared tokens and shared characters allow a ratio at the threshold.

    A shared column makes pairs look more alike, never less, so no pair is lost.
    """
    columns = 1 << min(12, max(8, (6 * max(map(len, a + b))).bit_length()))
    n, m = (np.array([len(x) for x in names], np.float64) for names in (a, b))

    def both(width: int) -> list[np.ndarray]:
        vocabulary: dict = {}
        return [_marks(names, width, columns, vocabulary) for names in (a, b)]

    left, right = (x.astype(np.float32) for x in both(width))
    held_a, held_b = left.sum(axis=1), right.sum(axis=1)
    bits_a, bits_b = (np.packbits(x, axis=1).view(np.uint64) for x in both(1))
    # tokens held less those that may lack, as sums of a part of either name; slack is for single precision and lets pass only
    lose, keep = (float(_lacks(x, y, threshold, width)) for x, y in ((0.0, 1.0), (1.0, 0.0)))
    slack = 0.01 + 1e-6 * max(n.max(), m.max())
    own, other = ((held - keep * size - slack).astype(np.float32) for held, size in ((held_a, n), (held_b, m)))
    past_a, past_b = ((lose * size).astype(np.float32) for size in (n, m))
    chars_a, chars_b = (np.bitwise_count(x).sum(axis=1, dtype=np.int64) for x in (bits_a, bits_b))
    places, codes = _placed_chars(a), _coded_chars(b)
    step = max(1, most // len(b))
    for first in range(0, len(a), step):
        part = slice(first, first + step)
        common = left[part] @ right.T
        i, j = np.nonzero((common - own[part, None] >= -past_b) & (common + past_a[part, None] >= other))
        i += first
        i, j = (x[2 * np.minimum(n[i], m[j]) >= threshold * (n[i] + m[j]) - 1e-9] for x in (i, j))
        for some in range(0, len(i), 1 << 16):
            p, q = i[some : some + (1 << 16)], j[some : some + (1 << 16)]
            common = np.bitwise_count(bits_a[p] & bits_b[q]).sum(axis=1, dtype=np.int64)
            near = (chars_a[p] - common <= _lacks(n[p], m[q], threshold, 1)) & (chars_b[q] - common <= _lacks(m[q], n[p], threshold, 1))
            p, q = p[near], q[near]
            near = _common_bound(p, q, places, codes) * 2 >= threshold * (n[p] + m[q]) - 1e-6
            yield p[near], q[near]


def _compared(threshold: float, width: int):
    """Pairs of the names of two blocks that can reach the threshold."""
    def run(rows: pa.Table) -> pa.Table:
        left, names = (x.to_pylist() for x in (rows.column("_left"), rows.column("_name")))
        a, b = ([x for x, mine in zip(names, left) if mine is side] for side in (True, False))
        found = list(_share_tokens(a, b, threshold, width)) if a and b else []
        take = lambda side, k: [side[x] for part in found for x in part[k].tolist()]
        return pa.table({"_a": pa.array(take(a, 0), pa.string()), "_b": pa.array(take(b, 1), pa.string())})

    return run


def _reach(threshold: float) -> int:
    """How many bands apart two names at the threshold can be."""
    return math.ceil(math.log((2 - threshold) / threshold) / math.log(BAND)) + 1


def _band(name: str) -> Column:
    return F.floor(F.log(F.length(name).cast("double")) / math.log(BAND)).cast("int")


def _block_pairs(left: DataFrame, right: DataFrame, threshold: float, width: int, tasks: int) -> DataFrame:
    """(_a, _b) of all pairs that can reach the threshold, from pairs of blocks of bounded size."""
    def sized(names: DataFrame, name: str, band: str, blocks: str) -> DataFrame:
        held = F.when(F.max(F.length(name)) < SHORT, F.lit(2 * BLOCK_NAMES)).otherwise(F.lit(BLOCK_NAMES))
        return names.groupBy(_band(name).alias(band)).agg(F.ceil(F.count(F.lit(1)) / held).cast("int").alias(blocks))

    reach = _reach(threshold)
    met = sized(left, "_a", "_band_a", "_na").withColumn(
        "_band_b", F.explode(F.sequence(F.col("_band_a") - reach, F.col("_band_a") + reach))
    ).join(sized(right, "_b", "_band_b", "_nb"), "_band_b")

    def dealt(names: DataFrame, name: str, band: str, own: str, other: str) -> DataFrame:
        rows = names.withColumn(band, _band(name)).join(met, band)
        block, others = F.pmod(F.xxhash64(name), F.col(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        return rows.withColumn(own, block).withColumn(other, others).select(
            "_band_a", "_band_b", "_na", "_nb", F.lit(name == "_a").alias("_left"), F.col(name).alias("_name"))

    keys = ["_band_a", "_band_b", "_na", "_nb"]
    rows = dealt(left, "_a", "_band_a", "_na", "_nb").unionByName(dealt(right, "_b", "_band_b", "_nb", "_na"))
    # a fixed number: sizes in bytes say nothing about the pairs that a block makes
    pairs = rows.repartition(tasks, *keys).groupBy(*keys).applyInArrow(_compared(threshold, width), "_a string, _b string")
    return pairs.repartition(tasks, "_a", "_b")


def similar_pairs(
    labels: DataFrame, names: DataFrame, threshold: float = 0.84, label: str = "label", name: str = "name"
) -> DataFrame:
    """(label, name, similarity) of all distinct pairs whose ratio reaches the threshold.

    Both sides are reduced to distinct texts first, so copies cost nothing. Work is dealt out by the number
    of pairs: a token that is frequent on both sides goes to as many tasks as its pairs ask for, or names are
    compared in blocks.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    width = 2 if threshold >= BIGRAM_FLOOR else 1
    left, right = _distinct_names(labels, label, "_a"), _distinct_names(names, name, "_b")
    prefixes = _prefixes(left, right, threshold, width)
    compared = _compared_pairs(left, right, threshold)
    if compared <= FEW_PAIRS or JOINED_PAIR_COST * _joined_pairs(*prefixes) < compared:
        pairs = _prefix_pairs(*prefixes, threshold, width)
    else:
        pairs = _block_pairs(left, right, threshold, width, min(MOST_TASKS, math.ceil(2 * compared / PAIRS_PER_TASK)))
    scored = pairs.withColumn(
        "similarity", sequence_ratio(F.col("_a"), F.col("_b"), threshold)
    )
    return scored.filter(F.col("similarity").isNotNull()).select(
        F.col("_a").alias(label), F.col("_b").alias(name), "similarity"
    )


def _distinct_names(rows: DataFrame, name: str, as_: str) -> DataFrame:
    """Distinct texts that are not empty, stored in as many files as a shuffle has parts: few bytes can be much work."""
    texts = rows.select(F.col(name).alias(as_)).filter(F.length(as_) > 0).distinct()
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(texts.repartition(parts), "similar-names")


def _compared_pairs(left: DataFrame, right: DataFrame, threshold: float) -> int:
    """Number of pairs whose bands of length can meet."""
    reach = _reach(threshold)
    a = left.groupBy(_band("_a").alias("_i")).agg(F.count(F.lit(1)).alias("_na"))
    b = right.groupBy(_band("_b").alias("_i")).agg(F.count(F.lit(1)).alias("_nb"))
    near = a.withColumn("_i", F.explode(F.sequence(F.col("_i") - reach, F.col("_i") + reach))).join(b, "_i")
    return int(near.agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0)


def _prefixes(left: DataFrame, right: DataFrame, threshold: float, width: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of both sides, stored once."""
    frequency = _tokens(right, "_b", width).groupBy("_token").agg(F.count(F.lit(1)).alias("_df"))
    # Bounded by construction; tokens left out all count as equally rare, which any order allows.
    common = materialize(frequency.orderBy(F.desc("_df"), "_token").limit(COMMON_TOKENS), "similar-tokens")
    return (materialize(_signatures(left, "_a", common, threshold, width), "similar-prefixes"),
            materialize(_signatures(right, "_b", common, threshold, width), "similar-prefixes"))


def _token_counts(sig_a: DataFrame, sig_b: DataFrame) -> DataFrame:
    """(_h, _na, _nb) of the tokens in prefixes of both sides."""
    counts = [sig.select(F.explode("_prefix").alias("_h")).groupBy("_h").agg(F.count(F.lit(1)).alias(n))
              for sig, n in ((sig_a, "_na"), (sig_b, "_nb"))]
    return counts[0].join(counts[1], "_h")


def _joined_pairs(sig_a: DataFrame, sig_b: DataFrame) -> float:
    """Number of pairs that a join on the prefixes would make."""
    return _token_counts(sig_a, sig_b).agg(F.sum(F.col("_na").cast("double") * F.col("_nb"))).first()[0] or 0.0


def _prefix_pairs(sig_a: DataFrame, sig_b: DataFrame, threshold: float, width: int) -> DataFrame:
    """(_a, _b) of all pairs that can reach the threshold, by an equi join on the tokens of their prefixes."""
    bits_a = [f"_a_bits{i}" for i in range(BITMAP_WORDS)]
    bits_b = [f"_b_bits{i}" for i in range(BITMAP_WORDS)]
    exploded_a = sig_a.select("_a", *bits_a, F.col("_prefix").alias("_pa"), F.explode("_prefix").alias("_h"))
    exploded_b = sig_b.select("_b", *bits_b, F.col("_prefix").alias("_pb"), F.explode("_prefix").alias("_h"))
    parts = F.ceil(F.col("_na") * F.col("_nb") / F.lit(PAIRS_PER_TASK)).cast("int")
    hot = _token_counts(sig_a, sig_b).select("_h", parts.alias("_parts")).filter(F.col("_parts") > 1)
    dealt = F.coalesce("_parts", F.lit(1))
    salted_a = exploded_a.join(hot, "_h", "left").withColumn("_salt", F.pmod(F.xxhash64("_a"), dealt).cast("int"))
    salted_b = exploded_b.join(hot, "_h", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), dealt - 1)))
    la, lb = F.length("_a"), F.length("_b")
    return (
        salted_a.drop("_parts")
        .join(salted_b.drop("_parts"), ["_h", "_salt"])
        .filter(2 * F.least(la, lb) >= F.lit(threshold) * (la + lb) - 1e-9)
        .filter(_bits_only_left("_a_bits", "_b_bits") <= _lost(la, lb, threshold, width))
        .filter(_bits_only_left("_b_bits", "_a_bits") <= _lost(lb, la, threshold, width))
        # each pair survives at one of its shared tokens only
        .filter(F.element_at(F.array_intersect("_pa", "_pb"), 1) == F.col("_h"))
        .select("_a", "_b")
    )
