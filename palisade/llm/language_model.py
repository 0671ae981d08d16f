"""Log-likelihood of whole texts by a gated recurrent language model over a counted vocabulary.

Tokens are words (A-Z lower-cased) and one end. The words of all training texts are counted by a distributed aggregation; these counts
give the model's vocabulary (the ``vocabulary`` most frequent), its classes (runs of the frequency order), its first biases,
the probabilities of words outside the vocabulary, and the base score. The recurrent weights are fitted in numpy by
truncated backpropagation: first weights on up to ``max_tokens`` tokens of at most ``max_texts`` texts (those with the smallest hash
of their id; a text that does not fit is cut), then one pass over all training texts. For that the texts are dealt by hash into
shards of about ``shard_tokens`` tokens; each shard goes on from the first weights in 512 streams, and the results are averaged by
their numbers of tokens: added up within a task, then in a tree. The output is factored: the probability of a word's class times that of the word in its class. A word outside the vocabulary
costs the probability of the class of such words times (c + 1) / (their tokens + their words + 1). A text is scored from its
first token to its end; the state is carried from window to window and starts anew with each text.

Counts of the most frequent words, at most ``frequent`` of them, go to every task (a bound of 6 MB); the other words of a text are kept as
hashes, joined with the whole count table and added up per row.

Defined results: null and empty texts consist of the end alone; rows of equal texts get equal scores; a null id counts as the
empty string when training texts are told apart; without training texts all words are unknown; an empty table gives an
empty one; further columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import Words, slices, stage, texts_of

_U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: The hash that stands for the end of a text (no word is empty).
END = 1


def _lowered(column: pa.Array) -> Words:
    data, offsets = texts_of(column)
    return Words(_LOWER[data], offsets)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """The logistic function of x, in place."""
    x *= x.dtype.type(0.5)
    np.tanh(x, out=x)
    x *= x.dtype.type(0.5)
    x += x.dtype.type(0.5)
    return x


def _with_ones(x: np.ndarray) -> np.ndarray:
    """The rows of x, each with a 1 at its end: a bias becomes one more weight."""
    wide = np.empty((len(x), x.shape[1] + 1), x.dtype)
    wide[:, :-1] = x
    wide[:, -1] = 1
    return wide


#: While no logit can be larger than this, its exponential needs no shift.
_SAFE = 60.0


def _exponentials(logits: np.ndarray, bound: float, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials in place of the logits, their sums, and the log-probability of the entry ``which`` of each row."""
    if not bound < _SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(logits)), which]
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    return e, total, own - np.log(total)


@dataclass
class Network:
    """Weights; ids of one class are neighbours: class k holds edges[k] up to edges[k + 1]."""

    inputs: np.ndarray  # for update, reset and new state: the part of each word
    state: np.ndarray  # for the same three: the part of the state before
    classes: np.ndarray
    class_bias: np.ndarray
    words: np.ndarray
    word_bias: np.ndarray
    edges: np.ndarray

    NAMES = ("inputs", "state", "classes", "class_bias", "words", "word_bias")

    @classmethod
    def start(cls, counts: np.ndarray, hidden: int, seed: int = 3) -> Network:
        """Random recurrent weights; biases from the counts (by id, 0: words outside the vocabulary)."""
        n = len(counts)
        width = max(1, int(n**0.5))
        edges = np.unique(np.r_[0, 1, np.arange(1 + width, n, width), n]).astype(np.int64)
        rng = np.random.default_rng(seed)
        share = (counts + 1.0) / (counts + 1.0).sum()
        mass = np.add.reduceat(share, edges[:-1])
        scale = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        return cls(scale(3, n, hidden), scale(3, hidden, hidden), scale(hidden, len(mass)), np.log(mass).astype(np.float32),
                   scale(n, hidden), np.log(share).astype(np.float32), edges)

    @property
    def hidden(self) -> int:
        return self.state.shape[-1]

    @cached_property
    def class_of(self) -> np.ndarray:
        """The class of each id (16 bits, which numpy sorts by counting)."""
        return np.repeat(np.arange(len(self.edges) - 1, dtype=np.uint16), np.diff(self.edges))

    def step(self, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        """The next state, with what backpropagation needs."""
        x, u = np.take(self.inputs, ids, axis=1), np.matmul(h, self.state)
        x[:2] += u[:2]
        z, r = _sigmoid(x[:2])
        n = x[2]
        n += r * u[2]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, z, r, n, u[2]

    def likelihood(self, h: np.ndarray, targets: np.ndarray, slopes: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probability of each target after its state; with slopes also the slope by the states.

        States lie between -1 and 1, which bounds every logit by the weights.
        """
        order = np.argsort(self.class_of[targets], kind="stable")
        targets, h = targets[order], _with_ones(np.take(h, order, axis=0))
        which, k = self.class_of[targets], h.shape[1] - 1
        weights = np.concatenate([self.classes, self.class_bias[None]])
        e, total, value = _exponentials(h @ weights, float(np.abs(weights).sum(axis=0).max()), which)
        d_h = None
        if slopes is not None:
            e /= total[:, None]
            e[np.arange(len(e)), which] -= 1
            slope = h.T @ e
            slopes["classes"] += slope[:-1]
            slopes["class_bias"] += slope[-1]
            d_h = e @ self.classes.T
        weights = np.concatenate([self.words, self.word_bias[:, None]], axis=1)
        bounds = np.maximum.reduceat(np.abs(weights).sum(axis=1), self.edges[:-1]).tolist()
        starts = np.searchsorted(which, np.arange(len(self.edges)))
        for c in np.flatnonzero(np.diff(starts)):
            at, a, b = slice(starts[c], starts[c + 1]), self.edges[c], self.edges[c + 1]
            if b - a == 1:
                continue
            state, place = h[at], targets[at] - a
            e, total, found = _exponentials(state @ weights[a:b].T, bounds[c], place)
            value[at] += found
            if slopes is not None:
                e /= total[:, None]
                e[np.arange(len(e)), place] -= 1
                slope = e.T @ state
                slopes["words"][a:b] += slope[:, :k]
                slopes["word_bias"][a:b] += slope[:, k]
                d_h[at] += e @ weights[a:b, :k]
        made = np.empty_like(value)
        made[order] = value
        if d_h is None:
            return made, None
        back = np.empty_like(d_h)
        back[order] = d_h
        return made, back

    def _input_slopes(self, ids: np.ndarray, d_x: list[np.ndarray]) -> np.ndarray:
        """The slopes of ``inputs``: the rows of d_x (for each of its three parts) added up by id, class by class."""
        order = np.argsort(self.class_of[ids], kind="stable")
        ids = ids[order]
        starts, found = np.searchsorted(self.class_of[ids], np.arange(len(self.edges))), np.zeros_like(self.inputs)
        parts = [np.take(x, order, axis=0) for x in d_x]
        for c in np.flatnonzero(np.diff(starts)):
            at, a, b = slice(starts[c], starts[c + 1]), self.edges[c], self.edges[c + 1]
            if b - a == 1:
                for own, part in zip(found, parts):
                    own[a] = part[at].sum(axis=0)
                continue
            marks = np.zeros((b - a, at.stop - at.start), found.dtype)
            marks[ids[at] - a, np.arange(at.stop - at.start)] = 1
            for own, part in zip(found, parts):
                own[a:b] = marks @ part[at]
        return found

    def _slopes(self, ids: np.ndarray, targets: np.ndarray, h: np.ndarray, end: int, room: np.ndarray) -> tuple[dict, float, np.ndarray]:
        """Slopes of one window of streams (time, stream), its loss, and the states after it.

        ``h`` are the states before it; they start anew at each ``end``. ``room`` holds what backpropagation needs.
        """
        k, steps = self.hidden, len(ids)
        old, z, r, n, un, new = room[:6, :steps]
        d_u = room[6:, :steps]
        for t in range(steps):
            old[t] = h
            old[t, ids[t] == end] = 0
            new[t], z[t], r[t], n[t], un[t] = self.step(old[t], ids[t])
            h = new[t]
        slopes = {name: np.zeros_like(getattr(self, name)) for name in self.NAMES}
        found, d_all = self.likelihood(new.reshape(-1, k), targets.ravel(), slopes)
        d_all = d_all.reshape(new.shape)
        d_h, back = np.zeros_like(h), self.state.transpose(0, 2, 1).copy()
        for t in range(steps - 1, -1, -1):
            d, d_z, d_r, d_un = d_all[t], *d_u[:, t]
            d += d_h
            keep = 1 - z[t]
            np.subtract(old[t], n[t], out=d_z)
            d_z *= z[t]
            d_z *= keep
            d_z *= d
            d_n = n[t]
            d_n *= d_n
            np.subtract(1, d_n, out=d_n)
            d_n *= keep
            d_n *= d
            np.multiply(d_n, r[t], out=d_un)
            np.subtract(1, r[t], out=d_r)
            d_r *= un[t]
            d_r *= d_un
            d *= z[t]
            d_h = d
            for part in np.matmul(d_u[:, t], back):
                d_h += part
            d_h[ids[t] == end] = 0
        slopes["state"] += np.matmul(old.reshape(-1, k).T, d_u.reshape(3, -1, k))
        slopes["inputs"] += self._input_slopes(ids.ravel(), [x.reshape(-1, k) for x in (d_u[0], d_u[1], n)])
        return slopes, -float(found.sum()), h.copy()

    def fit(self, stream: np.ndarray, end: int, batch: int = 64, window: int = 32, epochs: int = 3, rate: float = 4e-3,
            moments: dict | None = None) -> list[float]:
        """Truncated backpropagation over a stream of ids in which ``end`` closes each text; mean loss of each epoch.

        ``moments`` carries the optimizer's state from one call to the next.
        """
        batch = max(1, min(batch, len(stream) // (2 * window)))
        steps = (len(stream) - 1) // batch
        if steps < 1:
            return []
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(stream, steps + 1)[::steps][:batch].T)
        losses, moments = [], {} if moments is None else moments
        if not moments:
            moments |= {"turn": 0} | {name: (np.zeros_like(getattr(self, name)), np.zeros_like(getattr(self, name))) for name in self.NAMES}
        turn = moments["turn"]
        first, second = ({name: moments[name][i] for name in self.NAMES} for i in (0, 1))
        for _ in range(epochs):
            h, loss = np.zeros((rows.shape[1], self.hidden), self.state.dtype), 0.0
            room = np.empty((9, min(window, steps), *h.shape), h.dtype)
            for begin in range(0, steps, window):
                ids, targets = rows[begin : min(begin + window, steps)], rows[begin + 1 : min(begin + window, steps) + 1]
                slopes, lost, h = self._slopes(ids, targets, h, end, room)
                loss += lost
                turn += 1
                for name in self.NAMES:
                    g = np.clip(slopes[name] / targets.size, -0.1, 0.1)
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    step = rate * (first[name] / (1 - 0.9**turn)) / (np.sqrt(second[name] / (1 - 0.99**turn)) + 1e-6)
                    getattr(self, name)[...] -= step
            losses.append(loss / (steps * rows.shape[1]))
        moments["turn"] = turn
        return losses

    def score(self, texts: list[np.ndarray], end: int, window: int = 32, most: int = 16_000) -> np.ndarray:
        """Natural log-probability of each text (ids without the end, which is added)."""
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        lengths = np.array([len(texts[i]) + 1 for i in order])
        flat = np.concatenate([x for i in order for x in (texts[i], [end])]).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
        begin = np.cumsum(lengths) - lengths
        found = np.zeros(len(texts))
        h, states, targets, owners, held = np.zeros((len(texts), self.hidden), np.float32), [], [], [], 0
        for t in range(int(lengths.max(initial=0))):
            active = int(np.searchsorted(-lengths, -t, side="left"))
            ids = np.full(active, end) if t == 0 else flat[begin[:active] + t - 1]
            h = self.step(h[:active], ids)[0]
            states.append(h)
            targets.append(flat[begin[:active] + t])
            owners.append(np.arange(active))
            held += active
            if held >= most or t + 1 == lengths[0] or len(states) >= 64 * window:
                value = self.likelihood(np.concatenate(states), np.concatenate(targets))[0]
                found += np.bincount(np.concatenate(owners), value, len(texts))
                states, targets, owners, held = [], [], [], 0
        made = np.zeros(len(texts))
        made[order] = found
        return made


@dataclass
class Model:
    """The network with the frequent words' hashes (sorted), counts and ids, and the totals of all words."""

    network: Network
    keys: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    tokens: int
    words: int
    rest: float  # tokens + words + 1 outside the vocabulary

    def parts(self) -> tuple:
        """Plain arrays and numbers, which need no code of this package to be read."""
        return [getattr(self.network, n) for n in (*Network.NAMES, "edges")], self.keys, self.counts, self.ids, self.tokens, self.words, self.rest

    @classmethod
    def of(cls, parts: tuple) -> Model:
        return cls(Network(*parts[0]), *parts[1:])

    @property
    def end_id(self) -> int:
        return int(self.ids[np.searchsorted(self.keys, _U(END))]) if len(self.keys) else 0

    @property
    def end_count(self) -> int:
        at = np.searchsorted(self.keys, _U(END))
        return int(self.counts[at]) if at < len(self.keys) and self.keys[at] == END else 0

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a word is among the frequent ones, its count and its id."""
        if not len(self.keys):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return hit, np.where(hit, self.counts[at], 0), np.where(hit, self.ids[at], 0)


def _counted(batches):
    """Words of a stretch of texts with their numbers, ends as END."""
    held, size, ends = [], 0, 0

    def made():
        words, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, _U), np.zeros(0, np.int64))
        words, n = np.append(words, _U(END)), np.append(n, ends)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for batch in (part for whole in batches for part in slices(whole, "text")):
        words = _lowered(batch.column(0))
        held.append(words.hashes)
        size += len(words.hashes)
        ends += batch.num_rows
        if size > 1_500_000:
            yield made()
            held, size, ends = [], 0, 0
    if ends:
        yield made()


def count_words(docs: DataFrame) -> DataFrame:
    """word (hash), n over all texts."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _as_ids(keys: np.ndarray, ids: np.ndarray):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            words = _lowered(batch.column(1))
            at = np.minimum(np.searchsorted(keys, words.hashes), max(len(keys) - 1, 0))
            found = np.where(keys[at] == words.hashes, ids[at], 0).astype("<u2") if len(keys) else np.zeros(len(words.hashes), "<u2")
            edges = words.first.tolist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([found[a:b].tobytes() for a, b in zip(edges, edges[1:])], pa.binary())],
                                             ["place", "ids"])

    return run


#: Weights are averaged in so many pieces.
_PIECES = 64


def _trained(shared, stretch: int):
    """The weights after a shard's texts, in pieces, with the number of its tokens."""
    def run(rows: pa.Table) -> pa.Table:
        arrays, end = shared.value
        network = Network(*[x.copy() for x in arrays])
        rows = rows.sort_by([("place", "ascending"), ("ids", "ascending")])
        close = np.array([end], "<u2").tobytes()
        stream = np.frombuffer(close + b"".join(x for ids in rows.column("ids").to_pylist() for x in (ids, close)), "<u2")
        moments: dict = {}
        for begin in range(0, len(stream) - 1, stretch):
            network.fit(stream[begin : begin + stretch + 1].astype(np.int64), end, batch=512, epochs=1, rate=6e-3, moments=moments)
        flat = np.concatenate([getattr(network, name).ravel() for name in Network.NAMES])
        parts = [x.astype("<f4").tobytes() for x in np.array_split(flat, _PIECES)]
        n = len(parts)
        return pa.table({"piece": pa.array(range(n), pa.int32()), "shard": pa.array([rows.column("shard")[0].as_py()] * n, pa.int32()),
                         "tokens": pa.array([len(stream) - 1] * n, pa.int64()), "weights": pa.array(parts, pa.binary())})

    return run


_SUMS = "piece int, node int, tokens long, sums binary"


def _task_sums(batches):
    """Token-weighted sums of all shards of one task: one row for each piece, whatever the number of shards."""
    found: dict = {}
    for batch in batches:
        for piece, shard, tokens, weights in zip(*(c.to_pylist() for c in batch.columns)):
            part = tokens * np.frombuffer(weights, "<f4").astype(np.float64)
            node, n, total = found.get(piece, (shard, 0, 0.0))
            found[piece] = (min(node, shard), n + tokens, total + part)
    if found:
        yield _sum_rows([(piece, *rest) for piece, rest in sorted(found.items())])


def _sum_rows(rows: list[tuple]) -> pa.RecordBatch:
    piece, node, tokens, sums = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(node, pa.int32()), pa.array(tokens, pa.int64()),
                                       pa.array([x.astype("<f8").tobytes() for x in sums], pa.binary())], ["piece", "node", "tokens", "sums"])


def _added(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("node", "ascending"), ("tokens", "ascending")])
    total = np.zeros(len(rows.column("sums")[0].as_py()) // 8)
    for sums in rows.column("sums"):
        total += np.frombuffer(sums.as_py(), "<f8")
    row = (rows.column("piece")[0].as_py(), rows.column("node")[0].as_py(), sum(rows.column("tokens").to_pylist()), total)
    return pa.Table.from_batches([_sum_rows([row])])


def averaged(made: DataFrame, shards: int, fan: int = 32) -> DataFrame:
    """piece, node, tokens, sums over all rows (piece, shard, tokens, weights) of all shards.

    Each task adds up its own shards first; what is left is added in a tree, at most ``fan`` rows of a piece in a group.
    """
    rows = made.select("piece", "shard", "tokens", "weights").mapInArrow(_task_sums, _SUMS)
    while shards > 1:
        rows = rows.withColumn("node", F.floor(F.col("node") / fan).cast("int")).groupBy("piece", "node").applyInArrow(_added, _SUMS)
        shards = -(-shards // fan)
    return rows


def refine(network: Network, texts: DataFrame, end: int, tokens: int, shard_tokens: int, stretch: int) -> int:
    """One pass over all texts (place, ids), each shard from the same weights, then their average; the tokens learned from."""
    spark = texts.sparkSession
    shards = max(1, -(-tokens // shard_tokens))
    shared = spark.sparkContext.broadcast(([getattr(network, name) for name in (*Network.NAMES, "edges")], end))
    dealt = texts.withColumn("shard", F.pmod(F.xxhash64("place", "ids"), F.lit(shards)).cast("int"))
    made = dealt.groupBy("shard").applyInArrow(_trained(shared, stretch), "piece int, shard int, tokens long, weights binary")
    rows = averaged(made, shards).collect()
    if not rows:
        return 0
    flat = np.concatenate([(np.frombuffer(r["sums"], "<f8") / r["tokens"]).astype("<f4") for r in sorted(rows, key=lambda r: r["piece"])])
    at = 0
    for name in Network.NAMES:
        own = getattr(network, name)
        own[...] = flat[at : at + own.size].reshape(own.shape)
        at += own.size
    return rows[0]["tokens"]


def fit(docs: DataFrame, counts: DataFrame, vocabulary: int = 2048, frequent: int = 1 << 18, hidden: int = 32,
        max_tokens: int = 400_000, max_texts: int = 2_000, shard_tokens: int = 2_000_000) -> Model:
    """Learn from docs (training texts only) and their staged counts."""
    if vocabulary > 65_000:
        raise ValueError("ids are kept in 16 bits")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("words")).first()
    size = F.floor(F.log2("n") * 8).cast("int")
    floor, taken = 0, 0
    for row in counts.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("size")).collect():
        if taken + row["words"] > frequent:
            floor = row["size"] + 1
            break
        taken += row["words"]
    top = counts.filter((size >= floor) | (F.col("word") == END)).toPandas()
    order = np.lexsort((top["word"], -top["n"], top["word"] != END))
    words, n = top["word"].to_numpy(np.int64)[order].view(_U), top["n"].to_numpy(np.int64)[order]
    ids = np.where(np.arange(len(words)) < vocabulary, np.arange(len(words)) + 1, 0)
    known = int(n[:vocabulary].sum())
    by_id = np.r_[max(int(total["n"]) - known, 0), n[:vocabulary]].astype(np.float64)
    network = Network.start(by_id, hidden)
    order = np.argsort(words)
    model = Model(network, words[order], n[order], ids[order].astype(np.int64), int(total["n"]), int(total["words"]),
                  float(by_id[0] + max(int(total["words"]) - vocabulary, 0) + 1))
    own = ids[order] > 0
    place = F.xxhash64("doc_id", F.lit(11))
    texts = docs.select(place.alias("place"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = stage(texts.mapInArrow(_as_ids(words[order][own], ids[order][own].astype(np.int64)), "place long, ids binary"), "lm-texts")
    sizes = made.select("place", F.length("ids").alias("n")).orderBy("place", "n").limit(max_texts).toPandas()
    size = sizes["n"] // 2 + 1
    fits = sizes["place"][size.cumsum() - size < max_tokens]
    if len(fits):
        head = made.filter(F.col("place") <= int(fits.max())).select("place", F.substring("ids", 1, 2 * max_tokens).alias("ids"))
        rows = head.orderBy("place", "ids").limit(len(fits)).collect()
        end = model.end_id
        stream = np.concatenate([[end], *[x for r in rows for x in (np.frombuffer(r["ids"], "<u2"), [end])]]).astype(np.int64)
        network.fit(stream[: max_tokens + 1], end)
        refine(network, made, end, int(total["n"]), shard_tokens, max_tokens)
    return model


def _scored(shared, most: int = 3_000_000):
    def run(batches):
        model = Model.of(shared.value)
        log_rest, end = np.log10(model.rest), model.end_id
        end_part = np.log10(model.end_count + 1)
        names = ["doc_id", "n_tokens", "n_known", "counts_log", "model_log", "rare", "times"]
        held: list[tuple] = []
        texts: list[np.ndarray] = []
        size = 0

        def made():
            scores = model.network.score(texts, end) / np.log(10)
            columns = list(zip(*held))
            arrays = [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                      pa.array(columns[3], pa.float64()), pa.array(np.array(columns[4]) + scores, pa.float64()),
                      pa.array(columns[5], pa.list_(pa.int64())), pa.array(columns[6], pa.list_(pa.int32()))]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            words = _lowered(batch.column(1))
            hit, count, ids = model.look_up(words.hashes)
            part = np.where(hit, np.log10(count + 1.0), 0.0)
            n = batch.num_rows
            known = np.bincount(words.text[hit], minlength=n)
            base = np.bincount(words.text, part, n)
            outside = ids == 0
            spelled = np.bincount(words.text[outside], (part - log_rest)[outside], n)
            rare = np.flatnonzero(~hit)
            order = rare[np.lexsort((words.hashes[rare], words.text[rare]))]
            value, owner = words.hashes[order], words.text[order]
            run_at = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]) if len(order) else order
            times = np.diff(np.append(run_at, len(order)))
            value = value[run_at].view(np.int64)
            edges = np.searchsorted(owner[run_at], np.arange(n + 1)) if len(order) else np.zeros(n + 1, np.int64)
            small, first = ids.astype(np.uint16), words.first
            for k, doc in enumerate(batch.column(0).to_pylist()):
                texts.append(small[first[k] : first[k + 1]])
                held.append((doc, int(first[k + 1] - first[k]) + 1, int(known[k]) + (model.end_count > 0), base[k] + end_part,
                             spelled[k] + (end_part - log_rest if not end else 0.0), value[edges[k] : edges[k + 1]], times[edges[k] : edges[k + 1]]))
            size += len(small)
            if size > most:
                yield made()
                held, texts, size = [], [], 0
        if held:
            yield made()

    return run


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = rows.mapInArrow(_scored(spark.sparkContext.broadcast(model.parts())), "doc_id long, n_tokens long, n_known long, counts_log double, "
                           "model_log double, rare array<long>, times array<int>")
    made = stage(made.withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    pairs = made.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("word"), "r.times")
    more = (pairs.join(counts, "word").groupBy("row")
            .agg(F.sum("times").alias("known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("log")))
    known, log = F.coalesce("known", F.lit(0)), F.coalesce("log", F.lit(0.0))
    return made.join(more, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + known).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counts_log") + log - F.col("n_tokens") * F.lit(float(np.log10(model.tokens + model.words + 1)))).alias("base_score"),
        (F.col("model_log") + log).alias("score"))
