"""Toxicity and language model: accuracy, the swap penalty, exact base counts, slopes."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from palisade.llm import language_model, toxicity
from palisade.llm.common import stage
from tests.llm.helpers import awkward_texts, frame, words


def test_toxicity_learns_and_scores(spark):
    rng = random.Random(3)
    rows = [(k, words(rng, 60) + (" vileword nasty" + str(k % 3) if k % 4 == 0 else "")) for k in range(200)]
    docs = frame(spark, rows + [(None, None), (500, ""), (8, rows[8][1])])
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(150)] + [(None, 1), (3, None), (151, 7)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = [(r.row.doc_id, r.score) for r in toxicity.score(docs, model).collect()]
    assert len(got) == 203 and all(0 <= s <= 1 for _, s in got)
    assert all((s >= 0.5) == (i % 4 == 0) for i, s in got if i is not None and 150 <= i < 200)
    assert len({s for i, s in got if i in (None, 500)}) == 1 and len({s for i, s in got if i == 8}) == 1
    nothing = toxicity.fit(docs, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(docs, nothing).collect()} == {True}
    assert toxicity.score(frame(spark, []), model).count() == 0


def test_swaps_lower_the_weight_of_identity_terms():
    rng = random.Random(4)
    texts, labels = [], []
    for _ in range(400):
        toxic = rng.random() < 0.5
        group = "muslim" if rng.random() < (0.9 if toxic else 0.1) else rng.choice(["christian", "jewish", "hindu"])
        texts.append({group, f"w{rng.randrange(50)}", *(["vile"] if toxic and rng.random() < 0.7 else [])})
        labels.append(float(toxic))
    names = sorted(set().union(*map(toxicity.features_of, texts)) | {f for t in texts for f in toxicity.features_of(toxicity.swapped(t))})
    index = {n: k for k, n in enumerate(names)}
    at = lambda t: np.array([index[f] for f in toxicity.features_of(t)])
    rows, twins = [at(t) for t in texts], [(at(t), at(toxicity.swapped(t))) for t in texts]
    free, _ = toxicity.regression(rows, twins, np.array(labels), len(index), 0.0)
    held, _ = toxicity.regression(rows, twins, np.array(labels), len(index), 5.0)
    gap = lambda w: abs(w[index["muslim"]] - w[index["christian"]])
    assert gap(held) < 0.3 * gap(free) and held[index["vile"]] > 1


def test_swap_is_whole():
    assert toxicity.swapped({"women", "talk"}) == {"men", "talk"} and toxicity.swapped({"talk"}) is None


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def test_base_score_counts(spark):
    rows = awkward_texts()
    docs = frame(spark, rows)
    train = [r for r in rows if zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 7 != 2]
    counts = stage(language_model.count_words(frame(spark, train)), "t")
    model = language_model.fit(frame(spark, train), counts, vocabulary=30, frequent=50, hidden=8, max_tokens=5000)
    got = language_model.score(docs, model, counts).collect()
    c = Counter(w for _, t in train for w in [*lowered(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter((i, len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n) for i, t in rows for w in [lowered(t)])
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == want
    base = {i: sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*lowered(t), None]) for i, t in rows}
    for r in got:
        if r.doc_id not in (5, 7):
            assert math.isclose(r.base_score, base[r.doc_id], rel_tol=1e-9) and r.score < 0
    assert language_model.score(frame(spark, []), model, counts).count() == 0
    nothing = language_model.fit(frame(spark, []), counts.limit(0))
    assert {r.n_known for r in language_model.score(docs, nothing, counts.limit(0)).collect()} == {0}


def test_probabilities_add_up_and_windows_carry_the_state():
    network = language_model.Network.start(np.arange(40.0, 0, -1), 6)
    h = np.random.default_rng(1).normal(size=(1, 6)).astype(np.float32)
    total = np.exp([network.likelihood(h, np.array([k]))[0][0] for k in range(40)]).sum()
    assert math.isclose(total, 1, rel_tol=1e-5)
    texts = [np.arange(n) % 40 for n in (0, 1, 5, 300)]
    one, many = network.score(texts, 1), network.score(texts, 1, most=7)
    assert np.allclose(one, many, rtol=1e-4)
    plain, state = 0.0, np.zeros((1, 6), np.float32)
    for before, after in zip([1, *texts[2]], [*texts[2], 1]):
        state = network.step(state, np.array([before]))[0]
        plain += network.likelihood(state, np.array([after]))[0][0]
    assert math.isclose(plain, one[2], rel_tol=1e-4)


def test_training_learns_an_order():
    stream = np.array(([1] + [2, 3, 4, 5] * 4) * 400)
    network = language_model.Network.start(np.bincount(stream, minlength=8).astype(float), 16)
    losses = network.fit(stream, 1, batch=16, window=16, epochs=4)
    assert losses[-1] < 0.35 < losses[0]


def test_slopes_through_time_agree_with_finite_differences():
    network = language_model.Network.start(np.arange(20.0, 0, -1), 5)
    for name in network.NAMES:
        setattr(network, name, getattr(network, name).astype(np.float64))
    rng = np.random.default_rng(8)
    rows = rng.integers(0, 20, (8, 6))
    rows[3, 2] = rows[0, 1] = 1
    begin = rng.normal(0, 0.3, (6, 5))

    def loss() -> float:
        h, lost = begin, 0.0
        for ids, targets in zip(rows, rows[1:]):
            h = network.step(np.where((ids == 1)[:, None], 0.0, h), ids)[0]
            lost -= network.likelihood(h, targets)[0].sum()
        return lost

    slopes, lost, after = network._slopes(rows[:-1], rows[1:], begin, 1, np.empty((9, 7, 6, 5)))
    assert np.isclose(lost, loss()) and after.shape == begin.shape
    for name in network.NAMES:
        array = getattr(network, name)
        for at in zip(*(rng.integers(0, n, 12) for n in array.shape)):
            kept = array[at]
            array[at] = kept + 1e-5
            more = loss()
            array[at] = kept - 1e-5
            less = loss()
            array[at] = kept
            assert np.isclose((more - less) / 2e-5, slopes[name][at], atol=1e-5), (name, at)


def test_large_weights_are_shifted_before_their_exponentials():
    network = language_model.Network.start(np.arange(30.0, 0, -1), 4)
    network.words *= 5_000
    network.classes *= 5_000
    value = network.likelihood(np.full((30, 4), 0.9, np.float32), np.arange(30))[0]
    assert np.isfinite(value).all() and np.isclose(np.exp(value.astype(float)).sum(), 1, atol=1e-4)


def test_slopes_agree_with_finite_differences():
    network = language_model.Network.start(np.arange(20.0, 0, -1), 5)
    for name in network.NAMES:
        setattr(network, name, getattr(network, name).astype(np.float64))
    rng = np.random.default_rng(2)
    h, targets = rng.normal(size=(30, 5)), rng.integers(0, 20, 30)
    slopes = {name: np.zeros_like(getattr(network, name)) for name in network.NAMES}
    d_h = network.likelihood(h, targets, slopes)[1]
    loss = lambda x: -network.likelihood(x, targets)[0].sum()
    for array, slope in [(h, d_h), *((getattr(network, n), slopes[n]) for n in ("classes", "class_bias", "words", "word_bias"))]:
        for at in [tuple(rng.integers(0, n) for n in array.shape) for _ in range(6)]:
            kept, step = array[at], 1e-6
            array[at] = kept + step
            up = loss(h)
            array[at] = kept - step
            down = loss(h)
            array[at] = kept
            assert math.isclose((up - down) / (2 * step), slope[at], rel_tol=1e-4, abs_tol=1e-6)


def test_averages_are_weighted_and_added_in_a_tree(spark):
    rng = np.random.default_rng(5)
    rows = [(p, s, 1 + s % 7, rng.normal(size=6).astype("<f4").tobytes()) for p in range(3) for s in range(100)]
    made = spark.createDataFrame(rows, "piece int, shard int, tokens long, weights binary").repartition(9)
    got = {r["piece"]: (r["tokens"], np.frombuffer(r["sums"], "<f8")) for r in language_model.averaged(made, 100, fan=4).collect()}
    for p in range(3):
        own = [(n, np.frombuffer(w, "<f4").astype(float)) for q, _, n, w in rows if q == p]
        assert got[p][0] == sum(n for n, _ in own) and np.allclose(got[p][1], sum(n * w for n, w in own))


def test_all_texts_are_learned_from_and_a_long_first_text_is_cut(spark):
    order = "a b c d e f g h".split()
    rows = [(k, " ".join(order * 12)) for k in range(60)]
    docs = frame(spark, rows)
    counts = stage(language_model.count_words(docs), "t")
    start = language_model.fit(docs, counts, hidden=8, max_texts=0)
    cut = language_model.fit(docs, counts, hidden=8, max_tokens=90, shard_tokens=2000)  # no text fits as a whole
    assert not np.array_equal(start.network.state, cut.network.state)
    log = lambda m: [r.score for r in language_model.score(docs, m, counts).collect()]
    assert np.mean(log(cut)) > np.mean(log(start)) + 1

    texts = stage(spark.createDataFrame([(k, bytes(np.arange(2, 10, dtype="<u2")) * 12) for k in range(60)], "place long, ids binary"), "t")
    network = language_model.Network.start(np.ones(12), 8)
    assert language_model.refine(network, texts, 1, 60 * 97, 1000, 300) == 60 * 97
