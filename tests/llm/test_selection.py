"""Jaccard join, importance resampling and Merkle manifest against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from palisade.llm import jaccard, manifest, resampling
from palisade.llm.common import held_out, stage
from tests.llm.helpers import awkward_texts, frame, words

ODD = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                    T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("a-b c", T.StringType()),
                    T.StructField("x.`y", T.StringType()), T.StructField("weight", T.StringType()), T.StructField("part", T.StringType()),
                    T.StructField("hash", T.StringType()), T.StructField("tree", T.StringType()), T.StructField("one", T.StringType())])


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_frame(spark, rows, sources=("s1", None, "s0", "é")):
    return spark.createDataFrame([(i, t, sources[k % len(sources)], None if k % 7 == 3 else "en", None if t is None else len(t), *"abcdefg")
                                  for k, (i, t) in enumerate(rows)], ODD)


# --- Jaccard join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(w)} if 0 < len(w) < 3 else {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


def plain_join(rows, percent):
    sets = [shingles(t) for _, t in rows]
    near = [[j for j, b in enumerate(sets) if j != i and a and b and 100 * len(a & b) >= percent * len(a | b)] for i, a in enumerate(sets)]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids else None, len(near[i])))
    return out


def edited(rng, words_, n):
    out = list(words_)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"x{rng.randrange(10**6)}"
    return " ".join(out)


def shown(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("percent, small, block", [(90, 16, 1000), (90, 2, 5), (70, 3, 7), (100, 1, 4)])
def test_jaccard_join_equals_all_pairs(spark, monkeypatch, percent, small, block):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(percent + small)
    rows = [(i, t) for i, t in awkward_texts() if len(t or "") < 5000]
    base = words(rng, 120, 10**6).split()
    rows += [(1000 + k, edited(rng, base, rng.randrange(0, 9))) for k in range(40)]
    chain = list(base[:60])  # each links with its neighbours, the ends are far apart
    for k in range(25):
        chain[rng.randrange(60)] = f"c{k}"
        rows.append((2000 - k, " ".join(chain)))
    rows += [(3000 + k, " ".join(base[:50]) + " " + words(rng, 30, 10**6)) for k in range(20)]  # a common passage, not near
    rows += [(None, "only null ids here it is"), (None, "only null ids here it is"), (4000, "A b"), (4001, "a B"), (4002, "a b c")]
    got = [tuple(r) for r in jaccard.joined(frame(spark, rows), percent).select("doc_id", "n_shingles", "component_id", "n_links").collect()]
    assert shown(got) == shown(plain_join(rows, percent))


def test_jaccard_join_of_nothing(spark):
    assert jaccard.joined(frame(spark, [])).collect() == []
    got = jaccard.joined(odd_frame(spark, [(3, None), (None, "  \n"), (5, "a b c d")])).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(3, 0, 3, 0), (None, 0, None, 0), (5, 2, 5, 0)], key=repr)


def test_jaccard_join_has_no_row_for_each_pair_of_a_group(spark):
    rng = random.Random(8)
    base = words(rng, 200, 10**6).split()
    docs = frame(spark, [(k, edited(rng, base, 1)) for k in range(300)])
    rows = docs.select("doc_id", "text")
    known = rows.mapInArrow(jaccard._known, "doc_id long, one long, two long, n long, n_words long, ranges array<int>")
    contents = stage(known.selectExpr("one", "two", "n", "n_words", "ranges", "1L as copies", "monotonically_increasing_id() as cid"), "test")
    assert jaccard.links(rows.select("text"), contents).count() < 300 * 40
    assert {r.n_links for r in jaccard.joined(docs).collect()} == {299}


# --- importance resampling


def plain_resample(rows, target, grams, buckets, percent, min_words):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % buckets for n in range(1, grams + 1) for k in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    found = [features(text) for _, text in rows]
    for _, f in found:
        s.update(f)
    for text in target:
        t.update(features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (total_s + float(buckets)) / ((s[b] + 1.0) * (total_t + float(buckets)))))
    out, able = [], []
    for k, ((doc, _), (n_words, f)) in enumerate(zip(rows, found)):
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if n_words >= min_words:
            able.append((-out[k][3], doc is not None, doc or 0, k))
    for place, (*_, k) in enumerate(sorted(able)[: percent * len(able) // 100]):
        out[k][4] = place + 1
    return [tuple(r) for r in out]


@pytest.mark.parametrize("grams, percent", [(1, 10), (3, 60), (2, 100)])
def test_resampling_equals_plain_python(spark, grams, percent):
    rng = random.Random(grams)
    rows = [*awkward_texts(), (-5, words(rng, 40)), (-(1 << 62), words(rng, 40)), (1 << 62, "Ünï-çode w1 " * 30), (99, "word" * 30 + " " + "q" * 5000)]
    target = [words(rng, 50), None, "", "w1 w2 w3", "é q" + "q" * 4999]
    other = spark.createDataFrame([(t,) for t in target], "text string")
    got = resampling.resample(odd_frame(spark, rows), other, percent=percent, min_words=10, grams=grams, buckets=500)
    got = [(r.row.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got.collect()]
    want = plain_resample(rows, target, grams, 500, percent, 10)
    key = lambda r: repr(r[:4])  # noqa: E731 - rows of equal id and score may swap their ranks
    assert sorted(map(key, got)) == sorted(map(key, want))
    ranked = lambda rows_: sorted((r for r in rows_ if r[4]), key=lambda r: r[4])
    assert [r[:4:3] for r in ranked(got)] == [r[:4:3] for r in ranked(want)] and [r[4] for r in ranked(got)] == [r[4] for r in ranked(want)]


def test_radix_ranks_sort_any_keys(spark, monkeypatch):
    monkeypatch.setattr(resampling, "DIGIT", 5)
    rng = random.Random(1)
    keys = [(rng.choice([0, 3, 1 << 40]), rng.randrange(-(1 << 63), 1 << 63) if k % 3 else 7) for k in range(500)]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(keys)], "at long, a long, b long").repartition(3)
    rows = stage(rows.selectExpr("at", "a", "b", "spark_partition_id() as part", "monotonically_increasing_id() as place"), "test")
    held = {r.at: (r.part, r.place) for r in rows.collect()}
    ranks, n = resampling.radix_ranks(rows, ["a", "b"])
    got = [r.at for r in sorted(ranks.collect(), key=lambda r: r.rank)]
    assert n == 500 and got == sorted(range(500), key=lambda k: (keys[k][0], keys[k][1] % (1 << 64), *held[k]))


def test_drawn_documents_keep_their_columns(spark):
    rng = random.Random(2)
    docs = odd_frame(spark, [(k, words(rng, 30)) for k in range(50)])
    got = resampling.draw(docs, docs.limit(5), percent=20)
    assert got.columns == [*docs.columns, "draw_rank"] and sorted(r.draw_rank for r in got.collect()) == list(range(1, 11))
    assert got.drop("draw_rank").subtract(docs).count() == 0
    assert resampling.resample(docs.limit(0), docs).count() == 0
    assert {r.weight for r in resampling.resample(docs.limit(3), docs.limit(0)).collect()} <= {r for r in range(-10**6, 10**6)}


# --- manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = defaultdict(list)
    for r in rows:
        own = h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, r.text))))
        changed = h("".join(map(field, (r.doc_id, r.source, r.lang, r.n_chars, None if r.text is None else lowered(r.text)))))
        doc = "" if r.doc_id is None else str(r.doc_id)
        by[r.source].append((r.doc_id is not None, r.doc_id or 0, own, changed if zlib.crc32(doc.encode()) % 5 == 0 else own))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_levels([x[2] for x in sorted(by[s])]) for s in sources}
    top = plain_levels([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for k, (has, doc, own, changed) in enumerate(sorted(by[s])):
            proof, value = "", changed
            for levels, at in ((trees[s], k), (top, place)):
                for level in levels[:-1]:
                    run = level[at - at % 16 : at - at % 16 + 16]
                    left, right = "".join(run[: at % 16]), "".join(run[at % 16 + 1 :])
                    proof += left + right
                    value = h(left + value + right)
                    at //= 16
            out.append((doc if has else None, own, trees[s][-1][0], top[-1][0], h(proof), value, value == top[-1][0]))
    return out


@pytest.mark.parametrize("n, sources", [(0, ["a"]), (40, ["only"]), (700, ["hot"] * 9 + [None, "b", ""]), (120, [f"s{k}" for k in range(40)])])
@pytest.mark.parametrize("levels", [1, 3])
def test_manifest_equals_plain_trees(spark, monkeypatch, n, sources, levels):
    from pyspark.sql import functions as F

    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 16**levels)
    rng = random.Random(n)
    rows = [*awkward_texts(), (7, "AB"), (7, "AB")] if n == 40 else [(k, f"Text {rng.random()}" if k % 11 else None) for k in range(n)]
    docs = odd_frame(spark, rows, sources)
    got = manifest.manifest(docs, held_out(F.col("doc_id"), 5, 0))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = plain_manifest(docs.collect()) if rows else []
    assert shown(map(tuple, got.collect())) == shown(want)
    assert n < 100 or any(not r[-1] for r in want) and any(r[-1] for r in want)


def test_fold_hashes_right_siblings_only():
    nodes = [h(str(k)) for k in range(40)]
    block = manifest._Block(nodes, 40)
    whole = plain_levels(nodes)
    assert block.nodes[-1] == whole[-1]
    for k in (0, 15, 16, 39):
        siblings = block.siblings(k)
        assert block.fold(k, nodes[k], siblings[1::2]) == whole[-1][0] != block.fold(k, h("x"), siblings[1::2])
