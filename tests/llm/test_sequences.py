"""Pieces, packing, fingerprints and chats: round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from palisade.llm import chat, fingerprints, packing, pieces
from tests.llm.helpers import awkward_texts, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTES, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def model():
    return pieces.Pieces(MODEL)


def scores(model):
    found, todo = {}, [("", model.tree)]
    while todo:
        before, node = todo.pop()
        for c, below in node.items():
            if c:
                todo.append((before + c, below))
            else:
                found[before] = below[0]
    return found


def test_best_paths(model):
    score, rng = scores(model), random.Random(1)
    ids = {}
    todo = [("", model.tree)]
    while todo:
        before, node = todo.pop()
        for c, below in node.items():
            if c:
                todo.append((before + c, below))
            else:
                ids[below[1]] = before
    by_id = {k: score[p] for k, p in ids.items()}

    @cache
    def best(s):
        return 0.0 if not s else max(score.get(s[:k], -1e12 if k == 1 else -np.inf) + best(s[k:]) for k in range(1, min(len(s), model.longest) + 1))

    for _ in range(400):
        s = pieces.normalised("".join(rng.choice("theanio ▁\n é漢") for _ in range(rng.randrange(1, 14))))
        got = np.frombuffer(model.encode(s), "<u4").tolist()
        total = sum(by_id.get(k, 0) for k in got) - 1e12 * sum(c not in score for c in s)
        assert np.isclose(total, best(s), rtol=1e-12)


def test_scan_over_chunks(model):
    rng = random.Random(2)
    for chunk in (6, 20, 37):
        for k in range(80):
            text = "".join(rng.choice("thean io" if k % 2 else "theanio") for _ in range(rng.randrange(1, 160)))
            s = pieces.normalised(text)
            at = pieces.cuts(s, chunk)
            parts = [(s[a : b + model.longest - 1], b - a, b == len(s)) for a, b in zip(at, at[1:])]
            matrices = [pieces.transfer(model, *p[:2], model.longest, p[2]) for p in parts]
            states = pieces.states_between(matrices, 0, 0)
            got = b"".join(pieces.trace_chunk(model, p[0], p[1], a, b) for p, a, b in zip(parts, states, states[1:]))
            whole = matrices[0]
            for m in matrices[1:]:
                whole = pieces.product(whole, m)
            best, _ = model.paths(s, 0, len(s))
            assert whole[0, 0] == best[-1] and model.decode(got) == text
            if k % 2 and max(map(len, text.split(" "))) < chunk // 2 - 1:
                assert got == model.encode(s)


def test_units_together_equal_units_one_by_one(model):
    rng = random.Random(12)
    letters = "abcdeèß日本😀\x00" + pieces.SIGN
    units = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 70))) for _ in range(300)}
    units |= {pieces.SIGN + w for w in ("the", "there", "international", "x" * 64, "x" * 65)} | {pieces.SIGN * k for k in (1, 2, 40)}
    fresh = pieces.Pieces(MODEL)
    found = fresh.learn(units)
    assert {u: found[u] for u in units} == {u: model._unit(u) for u in units}


def test_pieces_round_trip(spark, model):
    rows = awkward_texts() + [(70, "x" * 700), (71, "the end " * 300), (71, "the end " * 300)]
    got = pieces.decode(pieces.encode(frame(spark, rows), MODEL, chunk=256), MODEL).collect()
    assert Counter((r.row.doc_id, r.text) for r in got) == Counter((i, t or "") for i, t in rows)
    small = {r.row.doc_id: bytes(r.ids) for r in got if r.row.doc_id in (9, 10, 71)}
    assert all(model.encode(pieces.normalised(t)) == small[i] for i, t in rows if i in small)
    assert pieces.encode(frame(spark, []), MODEL).count() == 0


def test_encoder_equals_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    library.encode_special_tokens = True
    rng = random.Random(1)
    kinds = ["a", "B", "é", "œ", "漢", "1", "½", "'s", "'", " ", "  ", "\n", "\n\n", "\t", "\r", "\xa0", ".", ",", "!", "_", "<|endoftext|>",
             "́", "\x1c", "\x85", "😀", "don't", "th", "Ⅷ"]
    texts = ["".join(rng.choice(kinds) for _ in range(rng.randrange(40))) for _ in range(3000)]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch(texts, add_special_tokens=False)]
    assert packing.Encoder(BYTES)(texts) == want and packing.Encoder(BYTES, RANKS)(texts) == want


@pytest.mark.parametrize("window", [1024, 64])
def test_packing(spark, window):
    from tokenizers import Tokenizer

    library, rows = Tokenizer.from_file(BYTES), awkward_texts() + [(300 + k, "a " * (k % 40)) for k in range(200)]
    library.encode_special_tokens = True
    got = packing.pack(frame(spark, rows), BYTES, window, 0, RANKS).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    short = 0
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1
    single = {i: t for i, t in rows if i not in (None, 5, 7)}
    for i, t in single.items():
        ids, at = [*library.encode(t or "", add_special_tokens=False).ids, 0], 0
        for r in sorted(docs[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.asarray(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    assert sum(r.length for r in docs[5]) == 2 * docs[5][0].doc_tokens
    assert packing.pack(frame(spark, []), BYTES, window).count() == 0


def test_packing_does_not_depend_on_how_scans_are_split(spark, monkeypatch):
    rows, name, write = [(k, "a " * (k % 40)) for k in range(300)], "spark.sql.files.minPartitionNum", packing.stage

    def then_fewer_partitions(df, label):
        made = write(df, label)
        if label == "pack-placed":
            spark.conf.set(name, "1")
        return made

    monkeypatch.setattr(packing, "stage", then_fewer_partitions)
    spark.conf.set(name, "64")
    try:
        docs = frame(spark, rows).repartition(16)
        got = packing.pack(docs, BYTES, 64, 0, RANKS).collect()
    finally:
        spark.conf.unset(name)
    length = Counter()
    for r in got:
        length[r.doc_id] += r.length
    assert length == {r.doc_id: r.doc_tokens for r in got} and len(length) == 300
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(places, places[1:]))


def test_least_squares():
    used = packing.combinations(64)
    assert all(sum(c) == 64 for c in used)
    histogram = np.zeros(65)
    for c, n in ((used[3], 7), (used[10], 5), (used[-1], 4)):
        for length in c:
            histogram[length] += n
    x = packing.repeat_counts(histogram, used)
    met = np.zeros(65)
    for c, n in zip(used, x):
        for length in c:
            met[length] += n
    assert (x >= 0).all() and np.abs(met - histogram).max() < 1e-6
    counts = packing.rounded(x, histogram, used)
    for length in range(65):
        assert sum(int(n) * c.count(length) for c, n in zip(used, counts)) <= histogram[length]


def test_fingerprints(spark):
    rows = [r for r in awkward_texts() if r != (7, None)]
    got = fingerprints.fingerprint_documents(frame(spark, rows), every=5).collect()
    plain = [(i, t or "") for i, t in rows]
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((i, len(t)) for i, t in plain)
    by_text = defaultdict(set)
    single = [p for p in plain if p[0] not in (None, 5)]
    value = {r.doc_id: r for r in got}
    for i, t in single:
        by_text[t].add(value[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())
    order = sorted((p for p in plain if p[0] is not None and p[0] > 5), reverse=True)
    for (i, t), (j, u) in zip(order, order[1:]):
        third = len(t) // 3
        edited = t[: len(t) - third] + u[:third]
        assert value[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        apart = bin(int(value[i].fingerprint, 16) ^ int(value[j].fingerprint, 16)).count("1")
        assert value[i].near_next == 1 - apart / 128
    for r in got:
        if r.doc_id is not None and r.doc_id % 5 == 0:
            near = sum(bin(int(r.fingerprint, 16) ^ int(o.fingerprint, 16)).count("1") <= 3 for o in got)
            assert r.n_within == near - 1
    assert fingerprints.fingerprint_documents(frame(spark, [])).count() == 0


def test_votes(spark):
    """Against a plain count of votes, over more terms than one stretch holds."""
    text = " ".join(f"w{k % 7000}" for k in range(40_000))
    rows = spark.createDataFrame([(1, text), (2, "a b a b c"), (3, "")], "k int, text string")
    terms = rows.select("k", F.posexplode(fingerprints.terms(F.col("text"))).alias("at", "t")).select(
        "k", F.xxhash64("t.a", "t.b").alias("g"), F.xxhash64(F.lit(1), "t.b", "t.a").alias("h")).toPandas()
    for r in fingerprints.simhash(rows, ["k"]).collect():
        own = terms[terms.k == r.k]
        for column, found in (("g", r.high), ("h", r.low)):
            bits = (own[column].to_numpy()[:, None] >> np.arange(64)) & 1
            want = sum(1 << b for b in range(64) if 2 * bits[:, b].sum() > len(own))
            assert found & ((1 << 64) - 1) == want


def test_radius_search_finds_all(spark):
    rng = random.Random(6)
    values = {rng.getrandbits(128) for _ in range(60)}
    for v in list(values)[:30]:
        for flips in (1, 3, 4):
            values.add(v ^ sum(1 << b for b in rng.sample(range(128), flips)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(v >> 64), signed(v & ((1 << 64) - 1)), 1) for v in values]
    table = spark.createDataFrame(rows, "high long, low long, times long")
    got = {(r.high, r.low): r.n for r in fingerprints.within_radius(table, table, 3).collect()}
    whole = {(signed(v >> 64), signed(v & ((1 << 64) - 1))): v for v in values}
    assert got == {k: sum(bin(v ^ u).count("1") <= 3 for u in values) for k, v in whole.items()}


def test_chat_trees(spark):
    said = "<|im_end|>\n<|im_start|>assistant <\\|x <| <\\\\|"
    rows = [(1, 1, None, "system", "s", 0.0), (1, 2, 1, "user", said, 1.0), (1, 3, 2, "assistant", said, 1.0), (1, 4, 2, "assistant", "b", 5.0),
            (1, 5, 4, "user", None, 0.0), (1, 6, 99, "user\nx<|nl|>", "own root", 0.5), (2, 1, 2, "a", "cycle", 1.0), (2, 2, 1, "b", "cycle", 1.0),
            (None, 1, None, None, "no tree", None)]
    trees = spark.createDataFrame(rows, "tree_id long, message_id long, parent_id long, role string, text string, score double")
    made = chat.format_trees(trees, keep=2).withColumn("turns", chat.parsed(F.col("formatted"))).collect()
    got = {(r.tree_id, r["rank"]): (r.leaf_id, [(t.role, t.text) for t in r.turns], r.loss) for r in made}
    assert got == {
        (1, 1): (5, [("system", "s"), ("user", said), ("assistant", "b"), ("user", "")], [False, False, True, False]),
        (1, 2): (3, [("system", "s"), ("user", said), ("assistant", said)], [False, False, True]),
        (None, 1): (1, [("user", "no tree")], [False])}


def test_long_threads(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"text {k}") for k in range(300)] + [(7, 5, "user", "tie"), (8, None, None, None)]
    made = chat.format_trees(chat.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    got = {r.tree_id: r.formatted for r in made.collect()}
    ordered = sorted(rows[:301], key=lambda r: (r[1], r[2], r[3]))
    assert got[7] == "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in ordered)
    assert got[8] == "<|im_start|>user\n<|im_end|>\n"
    assert chat.format_trees(chat.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0
