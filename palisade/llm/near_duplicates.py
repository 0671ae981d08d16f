"""Near duplicates by order MinHash and banded alignment.

Words are lower-cased (A-Z); a text's k-mers are its runs of five words (all of its words, if fewer), each labelled with the
number of times it has occurred before. One sketch takes the two labelled k-mers with the smallest hashes and keeps them
in the order in which they stand, so that it agrees for texts that share content in the same order. Two sketches make
a band; texts that agree in one of 16 bands are candidates. At a similarity of 0.8 a pair is missed with a
probability of about 2 in 10,000.

A candidate pair is aligned: its equal labelled k-mers, within the diagonal band that a similarity of 0.8 leaves room for, are
chained in order. The similarity is aligned k-mers over all (n_a + n_b - aligned); 0.8 or more is a link.

Equal texts are one content from the start. Every bucket is compared in full. The pairs of one of at most ``SMALL`` contents are
rows; a larger one is dealt into blocks of about ``BLOCK`` contents or ``BLOCK_WORDS`` words, and every two of its blocks meet in
one group, which gives each content's number of links and as many links as hold its parts together, not a row for each pair. A
pair that shares several large buckets counts in that of its first band; one that also shares small ones counts in the large
one only. So the only links that can be missed are those of texts that share no band.

Classes are the connected components of the links. Defined results: texts without words (null, empty, blank) are equal to each
other; texts of fewer than five words match only equal ones; repeated rows fall into one class; a null doc_id is the
smallest; an empty table gives an empty one; further columns are kept by ``one_of_each`` and ignored otherwise.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import BASES, Rolling, Words, mix, rows_and_text, slices, stage, texts_of, with_row
from palisade.llm.graph import components

K, BANDS, ROWS = 5, 16, 2
SMALL, BLOCK, BLOCK_WORDS = 16, 1000, 1_000_000
_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=_U) * _U(0x632BE59BD9B4E019)) | _U(1)
_LAST = _U(0xFFFFFFFFFFFFFFFF)


def _lowered(column: pa.Array) -> Words:
    data, offsets = texts_of(column)
    return Words(_LOWER[data], offsets)


def _content(words: Words) -> np.ndarray:
    size = np.diff(words.first).astype(_U)
    return mix(Rolling(words.hashes, BASES[0])(words.first[:-1], words.first[1:]) ^ mix(size)).view(np.int64)


def labelled(key: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Each k-mer's hash with the number of its occurrence in its text."""
    whole = key if text is None else mix(key ^ mix(text.astype(_U)))
    order = np.argsort(whole, kind="stable")
    same = np.zeros(len(key), bool)
    same[1:] = whole[order][1:] == whole[order][:-1]
    if not same.any():
        return key
    place = np.arange(len(key))
    start = np.maximum.accumulate(np.where(same, 0, place))
    occurrence = np.zeros(len(key), _U)
    occurrence[order] = (place - start).astype(_U)
    return np.where(occurrence > 0, mix(key + occurrence * _U(0x2545F4914F6CDD1D)), key)


def sketches(words: Words) -> np.ndarray:
    """For each text its sketches: hashes of two labelled k-mers in the order in which they stand."""
    n, size = words.n_texts, np.diff(words.first)
    made = np.zeros((n, BANDS * ROWS), np.uint32)
    have = np.flatnonzero(size)
    if not len(have):
        return made
    count = np.maximum(size[have] - K + 1, 1)
    owner = np.repeat(np.arange(len(have)), count)
    first = np.cumsum(count) - count
    begin = words.first[have][owner] + np.arange(len(owner)) - first[owner]
    end = np.minimum(begin + K, words.first[1:][have][owner])
    key = labelled(Rolling(words.hashes, BASES[1])(begin, end), owner)
    at = np.arange(len(key))
    for t, seed in enumerate(_SEEDS):
        value = key * seed
        value ^= value >> _U(29)
        picks = []
        for _ in range(2):
            least = np.minimum.reduceat(value, first)
            hit = np.minimum.reduceat(np.where(value == least[owner], at, len(key)), first)
            hit = np.minimum(hit, len(key) - 1)
            picks.append(hit)
            value[hit] = _LAST
        one, two = np.minimum(*picks), np.maximum(*picks)
        made[have, t] = (mix(key[one] * _U(3) + mix(key[two])) >> _U(32)).astype(np.uint32)
    return made


def _contents(tokens: bool):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            words = _lowered(batch.column(batch.schema.get_field_index("text")))
            content, size = pa.array(_content(words)), pa.array(np.diff(words.first), pa.int32())
            if tokens:
                low = (words.hashes >> _U(32)).astype("<u4").tobytes()
                edges = (4 * words.first).tolist()
                yield pa.RecordBatch.from_arrays([content, pa.array([low[a:b] for a, b in zip(edges, edges[1:])], pa.binary())],
                                                 ["content", "tokens"])
            else:
                found = pa.FixedSizeListArray.from_arrays(pa.array(sketches(words).view(np.int32).ravel()), BANDS * ROWS)
                yield pa.RecordBatch.from_arrays([batch.column(0), content, size, found.cast(pa.list_(pa.int32()))],
                                                 ["doc_id", "content", "n_words", "sketch"])

    return run


def _keyed(batches):
    for batch in (part for whole in batches for part in slices(whole, "text")):
        words = _lowered(batch.column(1))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_content(words))], [*batch.schema.names, "content"])


def _kmers(tokens: bytes) -> np.ndarray:
    words = np.frombuffer(tokens, "<u4").astype(_U)
    if len(words) < K:
        words = np.append(words, np.zeros(K - len(words), _U))
    key = words[: len(words) - K + 1]
    for k in range(1, K):
        key = key * _U(0x9E3779B97F4A7C15) + words[k : len(words) - K + 1 + k]
    return labelled(mix(key))


def aligned(a: np.ndarray, b: np.ndarray, similarity: float) -> int:
    """Most k-mers of a and b that match in order within the band."""
    band = int((1 - similarity) / (1 + similarity) * (len(a) + len(b))) + 1
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    if len(j) < 2 or (np.diff(j) > 0).all():
        return len(j)
    tails: list[int] = []
    for x in j.tolist():
        k = bisect_left(tails, x)
        tails[k : k + 1] = [x]
    return len(tails)


def _matches(one: int, others: np.ndarray, ids: np.ndarray, first: np.ndarray, place: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the others are as similar to one: ``aligned`` for many texts at once; ``place`` is -1 throughout and left so."""
    own, sizes = ids[first[one] : first[one + 1]], first[others + 1] - first[others]
    n_own = len(own)
    place[own] = np.arange(n_own)
    owner = np.repeat(np.arange(len(others)), sizes)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    i = place[ids[np.repeat(first[others], sizes) + j]]
    place[own] = -1
    band = ((1 - similarity) / (1 + similarity) * (n_own + sizes)).astype(np.int64) + 1
    near = np.flatnonzero((i >= 0) & (np.abs(i - j) <= band[owner]))
    i, owner = i[near], owner[near]
    n = np.bincount(owner, minlength=len(others))
    crossed = np.zeros(len(others), bool)
    crossed[owner[1:][(owner[1:] == owner[:-1]) & (i[1:] < i[:-1])]] = True
    edges = np.append(0, np.cumsum(n))
    for k in np.flatnonzero(crossed & (n / (n_own + sizes - n) >= similarity)):
        tails: list[int] = []
        for x in i[edges[k] : edges[k + 1]].tolist():
            t = bisect_left(tails, x)
            tails[t : t + 1] = [x]
        n[k] = len(tails)
    return others[n / (n_own + sizes - n) >= similarity]


def _blocks(similarity: float):
    """All pairs of two blocks of a bucket (or of one): links that join their parts (a, b, 0) and numbers of links (a, null, n)."""
    def run(rows: pa.Table) -> pa.Table:
        content, part, band = (rows.column(c).to_numpy() for c in ("content", "part", "band"))
        keys = np.array(rows.column("large").to_pylist(), np.int64)[:, : band[0]]
        kmers = [_kmers(t) for t in rows.column("tokens").to_pylist()]
        first = np.append(0, np.cumsum([len(k) for k in kmers]))
        size = np.diff(first)
        seen, ids = np.unique(np.concatenate(kmers), return_inverse=True)
        place = np.full(len(seen), -1, np.int64)
        two = np.flatnonzero(part == rows.column("high")[0].as_py())
        within = rows.column("low")[0].as_py() == rows.column("high")[0].as_py()
        degree, group = np.zeros(len(content), np.int64), np.arange(len(content))
        a, b = [], []
        for one in range(len(content)) if within else np.flatnonzero(part == rows.column("low")[0].as_py()):
            rest = two[two > one] if within else two
            rest = rest[(size[rest] >= similarity * size[one]) & (size[one] >= similarity * size[rest])]
            rest = rest[~((keys[rest] == keys[one]) & (keys[one] != 0)).any(axis=1)]
            for at in range(0, len(rest), BLOCK):
                found = _matches(one, rest[at : at + BLOCK], ids, first, place, similarity)
                degree[one] += len(found)
                degree[found] += 1
                labels, where = np.unique(group[found], return_index=True)
                for label, k in zip(labels.tolist(), where.tolist()):
                    if label != group[one]:
                        a.append(content[one])
                        b.append(content[found[k]])
                        group[group == label] = group[one]
        some = np.flatnonzero(degree)
        return pa.table({"a": pa.array([*a, *content[some].tolist()], pa.int64()), "b": pa.array([*b, *[None] * len(some)], pa.int64()),
                         "n": pa.array([*[0] * len(a), *degree[some].tolist()], pa.int64())})

    return run


def _compared(similarity: float):
    def run(batches):
        for batch in batches:
            links, last, kmers = [], None, None
            for a, b, left, right in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if left is not last:
                    last, kmers = left, _kmers(left)
                other = _kmers(right)
                n = aligned(kmers, other, similarity)
                if n / (len(kmers) + len(other) - n) >= similarity:
                    links.append((a, b))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links]), pa.array([x[1] for x in links])], ["a", "b"])

    return run


def links(docs: DataFrame, known: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Links among the contents of ``known`` (content, n_words, sketch).

    First a, b: enough links to join all that are linked, directly or not; then node, n_links: the number of all links of a content.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity lies above 0 and at most at 1")
    distinct = known.filter("n_words > 0").dropDuplicates(["content"]).select("content", "n_words", "sketch")
    keys = [F.xxhash64(F.lit(b), *[F.col("sketch")[b * ROWS + r] for r in range(ROWS)]) for b in range(BANDS)]
    members = stage(distinct.select("content", "n_words", F.posexplode(F.array(*keys)).alias("band", "bucket")), "omh-members")
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words")).filter("n > 1")
    members = stage(members.join(sizes, "bucket"), "omh-buckets")
    is_large = F.col("n") > SMALL
    of_band = [F.coalesce(F.max(F.when(is_large & (F.col("band") == b), F.col("bucket"))), F.lit(0)) for b in range(BANDS)]
    wanted = members.groupBy("content").agg(F.array(*of_band).alias("large"))
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    tokens = stage(texts.mapInArrow(_contents(True), "content long, tokens binary").join(wanted, "content")
                   .dropDuplicates(["content"]), "omh-tokens")

    small = members.filter(~is_large).select("bucket", "content", "n_words")
    shingles = lambda c: F.greatest(F.col(c) - (K - 1), F.lit(1))
    fits = (shingles("n_x") >= similarity * shingles("n_y")) & (shingles("n_y") >= similarity * shingles("n_x"))
    pairs = (small.select("bucket", F.col("content").alias("x"), F.col("n_words").alias("n_x"))
             .join(small.select("bucket", F.col("content").alias("y"), F.col("n_words").alias("n_y")), "bucket")
             .filter((F.col("x") < F.col("y")) & fits).select("x", "y").distinct())
    side = lambda c, name, large: tokens.select(F.col("content").alias(c), F.col("tokens").alias(name), F.col("large").alias(large))
    elsewhere = F.exists(F.zip_with("large_x", "large_y", lambda p, q: (p == q) & (p != 0)), lambda same: same)
    rows = pairs.join(side("y", "right", "large_y"), "y").join(side("x", "left", "large_x"), "x").filter(~elsewhere)
    few = rows.select("x", "y", "left", "right").mapInArrow(_compared(similarity), "a long, b long").withColumn("n", F.lit(1).cast("long"))

    # every two blocks of a large bucket meet once; a content goes to as many groups as its bucket has blocks
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int")
    part = F.pmod(F.xxhash64("content", F.lit(5)), F.col("blocks")).cast("int")
    dealt = (members.filter(is_large).withColumn("blocks", blocks).withColumn("part", part)
             .select("bucket", "band", "content", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .withColumn("low", F.least("part", "other")).withColumn("high", F.greatest("part", "other")).drop("other")
             .join(tokens, "content"))
    many = dealt.groupBy("bucket", "low", "high").applyInArrow(_blocks(similarity), "a long, b long, n long")
    found = stage(few.unionByName(many), "omh-links")
    ends = F.when(F.col("b").isNull(), F.array("a")).otherwise(F.array("a", "b"))
    degree = found.filter("n > 0").select(F.explode(ends).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n_links"))
    return found.filter("b is not null").select("a", "b"), degree


def classes(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id, content, n_words, class_id (the smallest doc_id of the class) and n_links (links to other texts) per row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = stage(rows.mapInArrow(_contents(False), "doc_id long, content long, n_words int, sketch array<int>"), "omh-sketches")
    found, degree = links(docs, known, similarity)
    labels = components(found)
    labels = labels.join(degree, "node").withColumnRenamed("node", "content")
    each = (known.select("doc_id", "content", "n_words").join(labels, "content", "left")
            .select("doc_id", "content", "n_words", F.coalesce("label", "content").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    each = stage(each, "omh-rows")
    first = each.groupBy("label").agg(F.min(F.struct("doc_id", "content")).alias("first"))
    return each.join(first, "label").select("doc_id", "content", "n_words", F.col("first.doc_id").alias("class_id"),
                                            F.col("first.content").alias("class_content"), "n_links")


def one_of_each(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """row (the other columns) and text of one document per class: the one with the smallest doc_id."""
    firsts = stage(classes(docs, similarity).select("class_id", F.col("class_content").alias("content")).distinct(), "omh-firsts")
    rows = rows_and_text(docs)
    keyed = rows.mapInArrow(_keyed, with_row(rows, "text string, content long"))
    same = (F.coalesce(F.col("row.doc_id").cast("long"), F.lit(-(1 << 63))) == F.coalesce("class_id", F.lit(-(1 << 63))))
    kept = keyed.join(firsts, "content").filter(same)
    return kept.dropDuplicates(["content", "class_id"]).select("row", "text")
