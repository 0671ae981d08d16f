"""Jaccard join of sets of word n-grams by rare-first prefixes.

Words are lower-cased (A-Z). A text's set holds its distinct runs of three words; with fewer words, all of them as one run. Two
texts link when ``100 * intersection >= percent * union``. Texts of equal sets are one content from the start.

Every content's n-grams stand in one order, rare ones first: by an estimate of their frequency, then by hash. The estimate adds up, in
2 ** 20 bins, what each task has met more than once; any estimate gives right results, a good one gives short lists. Two sets
that link share an n-gram of both prefixes, that is of their first ``n - ceil(percent * n / 100) + 1`` n-grams. So the lists of the
prefix n-grams hold all pairs. An n-gram whose estimate is more than a partition's share is salted while its list is counted. Lists
of equal members are one bucket, that of their rarest n-gram.

A pair belongs to its rarest common bucket. Buckets of up to ``SMALL`` contents give pairs as rows, which must pass

* the length filter: ``100 * min(n) >= percent * max(n)``;
* the positional filter: what stands after the common n-gram suffices for the overlap that is needed (in the rarest common
  bucket, where nothing common stands before it; so no pair is lost in all its buckets);
* the suffix filter: counted by ranges of the hash, the sets differ in no more n-grams than a link allows;

and are verified once. A larger bucket is dealt into blocks of about ``BLOCK`` contents or ``BLOCK_WORDS`` words, and every two
blocks meet in one task, twice: first without texts, which leaves the contents that have a partner by the length and the suffix filter
and no earlier large bucket in common with it (small buckets leave out pairs with any large one); then these contents come with
their texts, and a matrix product gives the sizes of all intersections. A task writes a row for each content, not for each pair:
its number of links, and one link to hold linked parts together.

Runs are told apart by 64 bits, which is checked nowhere else: in one set or pair a mistake needs two runs of equal hash and a
similarity at the very limit. Contents are told apart by 128 bits of two independent hashes.

Defined results: a null, empty or blank text has an empty set, is linked with nothing and is a component of its own; a null doc_id is
never the smallest, and a component of null ids only has none; repeated rows link; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisade.llm.common import Words, mix, slices, stage, texts_of
from palisade.llm.graph import components

N, BINS, RANGES = 3, 1 << 18, 64
SMALL, BLOCK, BLOCK_WORDS, COLUMNS = 16, 1000, 1_000_000, 4096
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = mix(np.arange(1, 2 * N + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
_OTHER = mix(np.arange(256, dtype=_U) + _U(0x51ED270B0A1F39C1))


def _runs(values: np.ndarray, first: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of each run of N words (of all words, if a text has fewer); ``first``: where the texts begin."""
    size = np.diff(first)
    count = np.where(size > 0, np.maximum(size - N + 1, 1), 0)
    owner = np.repeat(np.arange(len(size)), count)
    begin = first[:-1][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    room = size[owner]
    key = np.zeros(len(owner), _U)
    padded = np.append(values, np.zeros(N, _U))
    for k in range(N):
        key += np.where(k < room, padded[np.minimum(begin + k, len(values))] * steps[k], _U(k + 1))
    return mix(key), owner


def _sets(key: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the distinct runs of each text stand, ordered by text and hash: index, hash, text."""
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return order[new], key[new], owner[new]


def _second(words: Words) -> np.ndarray:
    """A hash of each word that doesn't depend on ``words.hashes``."""
    if not len(words.start):
        return np.zeros(0, _U)
    length = words.end - words.start
    at = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(at, length)
    place = np.repeat(words.start, length) + within
    return mix(np.add.reduceat(mix(_OTHER[words.data[place]] + within.astype(_U)), at) + length.astype(_U))


class _Texts:
    """The distinct runs of a slice of texts."""

    def __init__(self, column: pa.Array):
        data, offsets = texts_of(column)
        self.words = Words(_LOWER[data], offsets)
        self.index, self.key, self.owner = _sets(*_runs(self.words.hashes, self.words.first, _STEPS[:N]))
        self.n = np.bincount(self.owner, minlength=len(column))
        self.first = np.append(0, np.cumsum(self.n))

    def sets(self) -> list[np.ndarray]:
        return [self.key[a:b] for a, b in zip(self.first.tolist(), self.first[1:].tolist())]

    def summed(self, values: np.ndarray) -> np.ndarray:
        sums = np.append(_U(0), np.cumsum(values, dtype=_U))
        return sums[self.first[1:]] - sums[self.first[:-1]]

    def contents(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits for each set, whatever the order of its runs."""
        other, _ = _runs(_second(self.words), self.words.first, _STEPS[N:])
        size = self.n.astype(_U)
        return (mix(self.summed(mix(self.key ^ _STEPS[0])) + size).view(np.int64),
                mix(self.summed(mix(other[self.index] ^ _STEPS[1])) + size).view(np.int64))

    def fresh(self, seen: set) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The identities, and which texts hold a set that the task hasn't met."""
        one, two = self.contents()
        new = []
        for k, pair in enumerate(zip(one.tolist(), two.tolist())):
            if self.n[k] and pair not in seen:
                seen.add(pair)
                new.append(k)
        return one, two, np.array(new, np.int64)


def _known(batches):
    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts = _Texts(batch.column(1))
        one, two = texts.contents()
        cell = texts.owner * RANGES + (texts.key >> _U(64 - RANGES.bit_length() + 1)).astype(np.int64)
        ranges = np.bincount(cell, minlength=RANGES * batch.num_rows).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(one), pa.array(two), pa.array(texts.n, pa.int64()), pa.array(np.diff(texts.words.first), pa.int64()),
             pa.FixedSizeListArray.from_arrays(pa.array(ranges), RANGES).cast(pa.list_(pa.int32()))],
            ["doc_id", "one", "two", "n", "n_words", "ranges"])


def _counted(batches):
    """How often each bin's n-grams stand in several contents of the task."""
    bins, seen = np.zeros(BINS, np.int64), set()
    held = []

    def add():
        if held:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            np.add.at(bins, (keys[counts > 1] % _U(BINS)).astype(np.int64), counts[counts > 1])

    waiting = 0
    for batch in (part for whole in batches for part in slices(whole, "text")):
        texts = _Texts(batch.column(0))
        _, _, new = texts.fresh(seen)
        keep = np.zeros(len(texts.n), bool)
        keep[new] = True
        held.append(texts.key[keep[texts.owner]])
        waiting += len(held[-1])
        if waiting > 4_000_000:
            add()
            waiting = 0
    add()
    some = np.flatnonzero(bins)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(bins[some])], ["bin", "n"])


def _prefixes(percent: int, bins: np.ndarray, share: int):
    def run(batches):
        seen: set = set()
        for batch in (part for whole in batches for part in slices(whole, "text")):
            texts = _Texts(batch.column(0))
            one, _, new = texts.fresh(seen)
            keep = np.zeros(len(texts.n), bool)
            keep[new] = True
            some = keep[texts.owner]
            key, owner = texts.key[some], texts.owner[some]
            often = bins[(key % _U(BINS)).astype(np.int64)]
            order = np.lexsort((key.view(np.int64), often, owner))  # as Spark compares them
            key, owner, often = key[order], owner[order], often[order]
            n = texts.n[owner]
            first = np.zeros(len(texts.n), np.int64)
            first[new] = np.cumsum(texts.n[new]) - texts.n[new]
            place = np.arange(len(key)) - first[owner]
            short = place < n - -(-percent * n // 100) + 1
            key, owner, often, place = key[short], owner[short], often[short], place[short]
            member = one[owner]
            salts = 1 + often // share
            salt = (mix(member.view(_U)) % salts.astype(_U)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(salt * (salts > 1) + (salts > 1), pa.int32()), pa.array(member),
                 pa.array(often, pa.int64()), pa.array(place, pa.int64())], ["token", "salt", "one", "often", "place"])

    return run


def _firsts(batches):
    """One text of each content that the task holds."""
    seen: set = set()
    for batch in (part for whole in batches for part in slices(whole, "text")):
        one, two, new = _Texts(batch.column(0)).fresh(seen)
        yield pa.RecordBatch.from_arrays([pa.array(one[new]), pa.array(two[new]), batch.column(0).take(pa.array(new))], ["one", "two", "text"])


def _verified(percent: int):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text_x")):
            left, right = (_Texts(batch.column(batch.schema.get_field_index(c))).sets() for c in ("text_x", "text_y"))
            found = []
            for own, other, a, b, copies_a, copies_b in zip(left, right, *(c.to_pylist() for c in batch.columns[:4])):
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= percent * (len(own) + len(other) - both):
                    found += [(a, b, copies_b), (b, a, copies_a)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b", "n"])

    return run


def _incidence(sets: list[np.ndarray], columns: np.ndarray) -> np.ndarray:
    made = np.zeros((len(sets), len(columns)), np.float32)
    if len(columns):
        for k, s in enumerate(sets):
            at = np.minimum(np.searchsorted(columns, s), len(columns) - 1)
            made[k, at[columns[at] == s]] = 1
    return made


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two blocks of sets."""
    total = np.zeros((len(left), len(right)))
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for k in range(0, len(common), COLUMNS):
        some = common[k : k + COLUMNS]
        total += _incidence(left, some) @ _incidence(right, some).T
    return total


def _earlier(lists: list[list], current: tuple) -> np.ndarray:
    """A bit for each large bucket before the current one that a content of the group lies in."""
    names = sorted({(x["often"], x["token"]) for held in lists for x in held if (x["often"], x["token"]) < current})
    bit = {name: k for k, name in enumerate(names)}
    masks = np.zeros((len(lists), max(1, -(-len(names) // 64))), _U)
    for k, held in enumerate(lists):
        for x in held:
            b = bit.get((x["often"], x["token"]))
            if b is not None:
                masks[k, b // 64] |= _U(1) << _U(b % 64)
    return masks


def _halves(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows are of the lower and of the higher block; which pairs of them have no earlier large bucket in common."""
    part, (low, high) = rows.column("part").to_numpy(), (rows.column(c)[0].as_py() for c in ("low", "high"))
    masks = _earlier(rows.column("large").to_pylist(), (rows.column("often")[0].as_py(), rows.column("token")[0].as_py()))
    one, two = np.flatnonzero(part == low), np.flatnonzero(part == high)
    first = np.ones((len(one), len(two)), bool)
    for w in range(masks.shape[1]):
        first &= (masks[one, w][:, None] & masks[two, w][None, :]) == 0
    if low == high:
        np.fill_diagonal(first, False)
    return one, two, first


def _survivors(percent: int):
    """The rows of two blocks (or of one) that have a partner by the length and the suffix filter."""
    def run(rows: pa.Table) -> pa.Table:
        one, two, first = _halves(rows)
        n = rows.column("n").to_numpy().astype(np.float64)
        ranges = np.array(rows.column("ranges").to_pylist(), np.float32)
        n_x, n_y = n[one][:, None], n[two][None, :]
        first &= 100 * np.minimum(n_x, n_y) >= percent * np.maximum(n_x, n_y)
        room = n_x + n_y - 2 * np.ceil((n_x + n_y) * percent / (100.0 + percent) - 1e-9)
        for k, row in enumerate(one):
            some = np.flatnonzero(first[k])
            first[k, some] = np.abs(ranges[two[some]] - ranges[row]).sum(axis=1, dtype=np.float64) <= room[k, some]
        alive = np.zeros(rows.num_rows, bool)
        alive[one[first.any(axis=1)]] = alive[two[first.any(axis=0)]] = True
        return rows.select(["token", "often", "cid", "copies", "part", "low", "high"]).filter(pa.array(alive))

    return run


def _blocks(percent: int):
    """All pairs of two blocks of a bucket (or of one): for each linked content a, weighted number of links n, and a link b."""
    def run(rows: pa.Table) -> pa.Table:
        cid, copies = (rows.column(c).to_numpy() for c in ("cid", "copies"))
        low, high, first = _halves(rows)
        if not first.any():
            return pa.table({c: pa.array([], pa.int64()) for c in ("a", "b", "n")})
        sets = _Texts(rows.column("text")).sets()
        size = np.array([len(s) for s in sets], np.float64)
        both = _overlaps([sets[k] for k in low], [sets[k] for k in high])
        linked = first & (100 * both >= percent * (size[low][:, None] + size[high][None, :] - both))
        degree = np.zeros(len(cid), np.int64)
        degree[low] += linked @ copies[high]
        if rows.column("low")[0] != rows.column("high")[0]:
            degree[high] += linked.T @ copies[low]
        group = np.arange(len(cid))
        while True:  # the smallest index among all that are linked, directly or not
            near = group.copy()
            np.minimum.at(near, low, np.where(linked, group[high][None, :], len(cid)).min(axis=1, initial=len(cid)))
            np.minimum.at(near, high, np.where(linked, group[low][:, None], len(cid)).min(axis=0, initial=len(cid)))
            near = near[near]
            if (near == group).all():
                break
            group = near
        some = np.flatnonzero(degree)
        return pa.table({"a": pa.array(cid[some]), "b": pa.array(cid[group[some]]), "n": pa.array(degree[some])})

    return run


def _bins(texts: DataFrame) -> np.ndarray:
    """The estimates: at most BINS numbers."""
    sums = texts.mapInArrow(_counted, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()
    bins = np.zeros(BINS, np.int64)
    bins[sums.column("bin").to_numpy()] = sums.column("n").to_numpy()
    return bins


def _buckets(texts: DataFrame, contents: DataFrame, percent: int) -> DataFrame:
    """Members (token, often, size, cid, place, ...) of the lists of prefix n-grams, one bucket for lists of equal members."""
    spark = texts.sparkSession
    total = contents.agg(F.sum(F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).alias("n")).first()["n"] or 0
    share = max(1000, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    rows = texts.mapInArrow(_prefixes(percent, _bins(texts), share), "token long, salt int, one long, often long, place long")
    # salt 0: the whole list is here, and a list of one is done; salted lists are counted over all salts below
    rows = rows.repartition("token", "salt").dropDuplicates(["token", "salt", "one"])
    rows = rows.withColumn("here", F.count(F.lit(1)).over(Window.partitionBy("token", "salt"))).filter("salt > 0 or here > 1")
    lists = stage(rows.select("token", "one", "often", "place"), "jaccard-lists")
    mark = [F.bit_xor(F.xxhash64("one", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    sizes = lists.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.max("often").alias("often"), *mark).filter("size > 1")
    first = F.min(F.struct("often", "token")).alias("first")
    kept = sizes.groupBy("mark1", "mark2", "size").agg(first).select("first.token", "size")
    return stage(lists.join(kept, "token").join(contents, "one"), "jaccard-buckets")


def _needed(n_x, n_y, percent: int):
    """The smallest intersection of a link."""
    return F.ceil((n_x + n_y) * percent / (100.0 + percent) - 1e-9)


def links(texts: DataFrame, contents: DataFrame, percent: int = 90) -> DataFrame:
    """For each linked content a: links b that join all that are linked, directly or not, and n, parts of its number of linked rows.

    ``contents`` is a staged table of cid, one, two, n, n_words, ranges, copies with a row for each set that isn't empty.
    """
    members = _buckets(texts, contents, percent)
    is_large = F.col("size") > SMALL
    large = stage(members.filter(is_large).groupBy("cid", "one", "two")
                  .agg(F.array_sort(F.collect_list(F.struct("often", "token"))).alias("large")), "jaccard-large")

    side = lambda s: (members.filter(~is_large).join(large.select("cid", "large"), "cid", "left")
                      .select("token", *[F.col(c).alias(f"{c}_{s}") for c in ("cid", "one", "two", "n", "place", "ranges", "copies", "large")]))
    n_x, n_y = F.col("n_x"), F.col("n_y")
    needed = _needed(n_x, n_y, percent)
    apart = F.aggregate(F.zip_with("ranges_x", "ranges_y", lambda p, q: F.abs(p - q).cast("long")), F.lit(0).cast("long"), lambda s, d: s + d)
    pairs = (side("x").join(side("y"), "token").filter(F.col("cid_x") < F.col("cid_y"))
             .filter(100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y))
             .filter(F.least(n_x - F.col("place_x"), n_y - F.col("place_y")) >= needed)
             .filter(apart <= n_x + n_y - 2 * needed)
             .filter(~F.coalesce(F.arrays_overlap(F.transform("large_x", lambda t: t.token), F.transform("large_y", lambda t: t.token)), F.lit(False)))
             .select(*[f"{c}_{s}" for s in "xy" for c in ("cid", "one", "two", "copies")]).dropDuplicates(["cid_x", "cid_y"]))
    pairs = stage(pairs, "jaccard-pairs")

    # every two blocks of a large bucket meet once; a content goes to as many groups as its bucket has blocks
    words = members.filter(is_large).groupBy("token").agg(F.sum("n_words").alias("words"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    dealt = (members.filter(is_large).join(words, "token").withColumn("blocks", blocks)
             .withColumn("part", F.pmod(F.xxhash64("cid", F.lit(5)), F.col("blocks")).cast("int"))
             .select("token", "often", "cid", "copies", "n", "ranges", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
             .join(large.select("cid", "large"), "cid"))
    alive = stage(dealt.groupBy("token", "low", "high").applyInArrow(
        _survivors(percent), "token long, often long, cid long, copies long, part int, low int, high int"), "jaccard-alive")

    # texts of the contents that are left in a pair or in a large bucket, and of no others
    ends = [pairs.select(*[F.col(f"{c}_{s}").alias(c) for c in ("cid", "one", "two")]) for s in "xy"]
    ends.append(large.join(alive.select("cid").distinct(), "cid").select("cid", "one", "two"))
    wanted = ends[0].unionByName(ends[1]).unionByName(ends[2]).distinct().join(large.select("cid", "large"), "cid", "left")
    held = stage(texts.mapInArrow(_firsts, "one long, two long, text string").join(wanted, ["one", "two"])
                 .dropDuplicates(["cid"]).select("cid", "text", "large"), "jaccard-texts")
    text = lambda s: held.select(F.col("cid").alias(f"cid_{s}"), F.col("text").alias(f"text_{s}"))
    rows = pairs.join(text("y"), "cid_y").join(text("x"), "cid_x")
    few = (rows.select("cid_x", "cid_y", "copies_x", "copies_y", "text_x", "text_y")
           .mapInArrow(_verified(percent), "a long, b long, n long"))

    many = alive.join(held, "cid").groupBy("token", "low", "high").applyInArrow(_blocks(percent), "a long, b long, n long")
    return stage(few.unionByName(many), "jaccard-links")


def joined(docs: DataFrame, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of those linked, directly or not), n_links (rows linked directly) per row."""
    if not 0 < percent <= 100:
        raise ValueError("percent lies above 0 and at most at 100")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = stage(rows.mapInArrow(_known, "doc_id long, one long, two long, n long, n_words long, ranges array<int>"), "jaccard-known")
    some = known.filter("n > 0")
    contents = stage(some.groupBy("one", "two").agg(*[F.first(c).alias(c) for c in ("n", "ranges")], F.max("n_words").alias("n_words"),
                                                    F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"))
                     .withColumn("cid", F.monotonically_increasing_id()), "jaccard-contents")
    found = links(rows.select("text"), contents, percent)
    # a component's smallest id, over contents: a few numbers a content, and no row of a copy
    labels = components(found.filter("a != b").select("a", "b")).withColumnRenamed("node", "cid")
    degree = found.groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("n_others"))
    each = contents.join(labels, "cid", "left").join(degree, "cid", "left").select(
        "one", "two", F.coalesce("label", "cid").alias("label"), (F.coalesce("n_others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "least")
    each = stage(each, "jaccard-each")
    each = each.join(each.groupBy("label").agg(F.min("least").alias("component_id")), "label").drop("label", "least")
    linked = some.join(each, ["one", "two"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links")
    alone = known.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)
