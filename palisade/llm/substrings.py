"""Removal of repeated word sequences, found by recompression.

Every text is rewritten in rounds, each of which names things by a hash of what they consist of, so that the same words
get the same name in every task without a shared dictionary: first each run of one word becomes a block, then, in two
rounds, neighbours (a, b) become a pair where a's name falls into the left and b's into the right half of a partition
that changes with the round. Whether two symbols are joined depends on these two alone, so equal passages are cut
into equal symbols but for the last few words at either end: a window of 35 words is cut alike wherever it stands, but for
``MARGIN`` words at each end (2 of a run, 2 of the first, 4 of the second pairing).

* A window's anchor is the interior symbol with the smallest mark (the leftmost, if equal). The anchor's key is a hash of the
  symbol and of ``MARGIN`` words on either side, all of which lie in the window. A window that has no interior symbol, or
  begins or ends in a run of more than two equal words, is its own anchor. Equal windows thus have equal keys.
* Keys that occur once are dropped: their windows are unique.
* The neighbouring windows of one anchor form a span. Spans that occur twice are repeated as a whole. For keys with several
  different spans one of each is looked up in its text, and its windows are compared by 128-bit hashes.

No step holds all rows of a key: they are counted by aggregation and joined by inner joins that can be split.

Defined results: null, empty and short texts (under the window) lose nothing; repeated rows repeat each other and lose all
that a window covers; an empty table gives an empty one; all columns of the input are kept, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import BASES, Rolling, Words, mix, rows_and_text, slices, stage, texts_of, with_row

MARGIN = 8
LONGEST = 8
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)
_PLACE = _U((1 << 28) - 1)


def _named(a: np.ndarray, b: np.ndarray | int) -> np.ndarray:
    return mix(a * _U(0x9FB21C651E98DF25) + (b if isinstance(b, np.ndarray) else _U(b)) + _U(0x5851F42D4C957F2D))


def symbols(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length in words and name of each symbol after the rounds."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    new = np.ones(n, bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(new)
    length = np.diff(np.append(start, n))
    name = hashes[start]
    name = np.where(length > 1, _named(name, length.astype(_U)), name)
    for turn in (1, 2):
        side = (mix(name ^ _U(turn * 0x1234567)) & _U(1)).astype(bool)
        free = length <= 2 * turn
        joined = free[:-1] & free[1:] & ~side[:-1] & side[1:] & (text[start[1:]] == text[start[:-1]])
        at = np.flatnonzero(joined)
        name[at] = _named(name[at], name[at + 1])
        length[at] += length[at + 1]
        keep = np.ones(len(start), bool)
        keep[at + 1] = False
        start, length, name = start[keep], length[keep], name[keep]
    return start, length, name


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def anchors(words: Words, window: int) -> dict[str, np.ndarray]:
    """Runs of neighbouring windows with one anchor: text, low (first window's word), n (windows), key, span."""
    n = len(words.hashes)
    none = {k: np.zeros(0, t) for k, t in (("text", np.int64), ("low", np.int64), ("n", np.int64), ("key", _U), ("span", _U))}
    if n < window:
        return none
    p = np.arange(n - window + 1)
    p = p[p + window <= words.first[words.text[p] + 1]]
    if not len(p):
        return none
    start, length, name = symbols(words.hashes, words.text)
    long = np.zeros(n, np.int64)
    long[start] = length
    stretch = window - 2 * MARGIN
    best = np.full(n - window + 1, _NONE)
    mark = (mix(name ^ _U(0xABCDEF)) & ~_PLACE) | start.astype(_U)
    for size in range(1, min(LONGEST, stretch) + 1):
        own = length == size
        if own.any():
            value = np.full(n, _NONE)
            value[start[own]] = mark[own]
            best = np.minimum(best, _least(value, stretch - size + 1)[MARGIN : MARGIN + n - window + 1])
    run = np.ones(n, bool)
    run[1:] = (words.hashes[1:] != words.hashes[:-1]) | (words.text[1:] != words.text[:-1])
    at = np.flatnonzero(run)
    which = np.cumsum(run) - 1
    run_start, run_end = at[which], np.append(at[1:], n)[which]
    best = best[p]
    alone = (best == _NONE) | (run_end[p] - p > 2) | (p + window - run_start[p + window - 1] > 2)
    anchor = np.where(alone, -1 - p, (best & _PLACE).astype(np.int64))

    first = np.ones(len(p), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (p[1:] != p[:-1] + 1)
    at = np.flatnonzero(first)
    low, count, anchor = p[at], np.diff(np.append(at, len(p))), anchor[at]
    one, two = Rolling(words.hashes, BASES[0]), Rolling(words.hashes, BASES[1])
    alone = anchor < 0
    begin = np.where(alone, low, anchor - MARGIN)
    end = np.where(alone, low + window, anchor + long[np.maximum(anchor, 0)] + MARGIN)
    key = one(begin, end) ^ np.where(alone, _U(0x77777777), _U(0))
    span = two(low, low + count + window - 1) + mix(((begin - low) * 4096 + count).astype(_U))
    text = words.text[low]
    return {"text": text, "low": low - words.first[text], "n": count, "key": key, "span": span}


def _content(words: Words) -> np.ndarray:
    """A hash of the whole word sequence of each text."""
    return Rolling(words.hashes, BASES[0])(words.first[:-1], words.first[1:])


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _anchor_rows(window: int, whole: bool):
    def run(batches):
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            words = Words(*texts_of(batch.column(0)))
            found = anchors(words, window)
            if not len(found["key"]):
                continue
            if not whole:
                yield pa.RecordBatch.from_arrays([_signed(found["key"])], ["key"])
                continue
            content, size = _content(words), np.diff(words.first)
            yield pa.RecordBatch.from_arrays(
                [_signed(found["key"]), _signed(found["span"]), _signed(content[found["text"]]),
                 pa.array(size[found["text"]], pa.int32()), pa.array(found["low"], pa.int32()), pa.array(found["n"], pa.int32())],
                ["key", "span", "content", "n_words", "low", "n"])

    return run


def _keyed(batches):
    """Add hash and number of words to each text."""
    for batch in (part for all_ in batches for part in slices(all_, "text")):
        words = Words(*texts_of(batch.column(batch.schema.get_field_index("text"))))
        yield pa.RecordBatch.from_arrays([*batch.columns, _signed(_content(words)), pa.array(np.diff(words.first), pa.int32())],
                                         [*batch.schema.names, "content", "n_words"])


def _window_rows(window: int):
    """128-bit hashes of the windows of the listed spans."""
    def run(batches):
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            words = Words(*texts_of(batch.column(0)))
            one, two = Rolling(words.hashes, BASES[0]), Rolling(words.hashes, BASES[1])
            asked = batch.column(1)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(asked.offsets.to_numpy()))
            part = asked.flatten()
            low, n = part.field("low").to_numpy(), part.field("n").to_numpy()
            total = int(n.sum())
            if not total:
                continue
            which = np.repeat(np.arange(len(n)), n)
            offset = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
            at = words.first[owner[which]] + low[which] + offset
            yield pa.RecordBatch.from_arrays(
                [part.field("key").take(pa.array(which)), part.field("span").take(pa.array(which)), pa.array(offset, pa.int32()),
                 _signed(one(at, at + window)), _signed(two(at, at + window))], ["key", "span", "at", "one", "two"])

    return run


def _without(window: int):
    def run(batches):
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: E731, B023
            removed, digests, kept_texts = [], [], []
            for text, ranges in zip(column("text").to_pylist(), column("ranges").to_pylist()):
                kept = (text or "").encode().split()
                if ranges:
                    edge = np.zeros(len(kept) + 1, np.int64)
                    np.add.at(edge, [r["low"] for r in ranges], 1)
                    np.add.at(edge, [r["low"] + r["n"] + window - 1 for r in ranges], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    removed.append(int(len(kept) - stays.sum()))
                    kept = [kept[i] for i in np.flatnonzero(stays)]
                else:
                    removed.append(0)
                joined = b" ".join(kept)
                digests.append(hashlib.sha256(joined).hexdigest())
                kept_texts.append(joined if removed[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [column("row"), pa.array(column("text")), pa.array(column("n_words").cast(pa.int64())), pa.array(removed, pa.int64()),
                 pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary()).cast(pa.string())],
                ["row", "text", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_ranges(docs: DataFrame, window: int) -> DataFrame:
    """Per distinct word sequence (content, n_words) the ranges of repeated windows: array of (low, n)."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = texts.mapInArrow(_anchor_rows(window, False), "key long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).filter("times > 1").select("key")
    found = texts.mapInArrow(_anchor_rows(window, True), "key long, span long, content long, n_words int, low int, n int")
    found = stage(found.join(shared, "key"), "repeat-anchors")

    spans = stage(found.groupBy("key", "span").agg(F.count(F.lit(1)).alias("times"),
                                                   F.min(F.struct("content", "n_words", "low", "n")).alias("one")), "repeat-spans")
    whole = (found.join(spans.filter("times > 1").select("key", "span"), ["key", "span"])
             .select("content", "n_words", "low", "n"))

    several = spans.groupBy("key").agg(F.count(F.lit(1)).alias("spans")).filter("spans > 1").select("key")
    asked = (spans.join(several, "key").select("key", "span", "one.*").groupBy("content", "n_words")
             .agg(F.collect_list(F.struct("key", "span", "low", "n")).alias("asked")))
    one_text = texts.mapInArrow(_keyed, "text string, content long, n_words int")
    windows = stage(one_text.join(asked, ["content", "n_words"]).select("text", "asked", "content", "n_words")
                    .mapInArrow(_window_rows(window), "key long, span long, at int, one long, two long").distinct(), "repeat-windows")
    twice = (windows.groupBy("key", "one", "two").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
             .select("key", "one", "two"))
    single = (windows.join(twice, ["key", "one", "two"]).select("key", "span", "at")
              .join(found.join(spans.filter("times = 1").select("key", "span"), ["key", "span"]), ["key", "span"])
              .select("content", "n_words", (F.col("low") + F.col("at")).alias("low"), F.lit(1).alias("n")))
    return (whole.unionByName(single).distinct().groupBy("content", "n_words")
            .agg(F.collect_list(F.struct("low", "n")).alias("ranges")))


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """All rows with their columns in ``row`` (text apart), and n_words, n_removed, kept_sha256, kept_text.

    kept_text is null where nothing was removed.
    """
    if window <= 2 * MARGIN:
        raise ValueError(f"a window has more than {2 * MARGIN} words")
    ranges = stage(repeated_ranges(docs, window), "repeat-ranges")
    rows = rows_and_text(docs)
    keyed = rows.mapInArrow(_keyed, with_row(rows, "text string, content long, n_words int"))
    return (keyed.join(ranges, ["content", "n_words"], "left").select("row", "text", "n_words", "ranges")
            .mapInArrow(_without(window), with_row(rows, "text string, n_words long, n_removed long, kept_sha256 string, kept_text string")))
