"""SentencePiece encoding (best path by piece scores) and decoding, with a max-plus scan over chunks of giant texts.

A text becomes the sequence of pieces with the largest sum of scores; characters that no piece covers become byte pieces. No
piece goes on from a black character into the white-space sign, so texts fall into units (signs, then black characters) whose
best paths are independent; units met before are looked up.

Texts of more than ``chunk`` code points are cut into chunks, dealt over all tasks: where a unit ends if one does in the second
half of the chunk, else anywhere. The state at a cut is the number of
code points by which a piece reaches beyond it (0 to longest piece - 1). A chunk's transfer matrix holds, for each state at its
begin and its end, the best score of the pieces that begin in it; matrices are combined by the max-plus product, first within
blocks of ``FAN`` chunks, then over blocks. From the products the states at the cuts of blocks are chosen from the last to the
first, then those within each block, and every chunk is traced back on its own between its two states. Where a chunk
holds an end of a unit, its matrix is a sum of a head, a middle and a tail, of which only head and tail depend on the states.

The model file gives pieces, scores and byte pieces. Of equal sums the path whose last piece is longer is kept, position by
position; across a cut within a unit of more than half a chunk, equal sums may go either way.

Defined results: null and empty texts have no pieces; the sign U+2581 in a text counts as a space; repeated rows get the same
pieces; an empty table gives an empty one; all other columns of the input are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import kept_in_worker, rows_and_text, slices, stage, with_row

SIGN = "▁"
FAN = 256
_UNIT = re.compile(f"{SIGN}*[^{SIGN}]+|{SIGN}+")
_KEEP = 120_000
#: New units of at most ``_WIDE`` characters go through arrays together if there are ``_FEW`` or more.
_WIDE, _FEW = 64, 32
_NO = -np.inf


class Pieces:
    """The pieces of a model file, as a tree of characters; '' holds (score, id) where a piece ends."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tree, self.longest = {}, 1
        self.bytes_: dict[int, bytes] = {}
        self.byte_id: dict[int, int] = {}
        for k in range(model.vocab_size()):
            piece = model.id_to_piece(k)
            if model.is_byte(k):
                self.byte_id[int(piece[3:5], 16)] = k
                self.bytes_[k] = bytes([int(piece[3:5], 16)])
            elif not (model.is_unknown(k) or model.is_control(k) or model.is_unused(k)):
                node = self.tree
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = (model.get_score(k), k)
                self.longest = max(self.longest, len(piece))
                self.bytes_[k] = piece.replace(SIGN, " ").encode()
        self.unknown = model.unk_id()
        self.table = [self.bytes_.get(k, b"") for k in range(model.vocab_size())]
        self._number()
        self.known: dict[str, tuple[bytes, float]] = {}
        self.before: dict[str, tuple[bytes, float]] = {}

    def _number(self) -> None:
        """The tree as arrays: numbered letters and nodes, the node behind (node, letter), and the piece that ends at a node."""
        nodes, letters, edges = [self.tree], {}, []
        for at, node in enumerate(nodes):  # grows as it is read
            for c, below in node.items():
                if c:
                    edges.append((at, letters.setdefault(c, len(letters) + 1), len(nodes)))
                    nodes.append(below)
        self.letter_of = np.zeros(0x110000, np.int64)
        self.letter_of[[ord(c) for c in letters]] = list(letters.values())
        self.fan = len(letters) + 1
        ends = [node.get("", (_NO, self.unknown)) for node in nodes]
        self.score_at, self.id_at = np.array([e[0] for e in ends]), np.array([e[1] for e in ends], np.int64)
        edges_ = np.array(edges, np.int64).reshape(-1, 3)
        keys = edges_[:, 0] * self.fan + edges_[:, 1]
        order = np.argsort(keys)
        self.edge, self.below = keys[order], edges_[order, 2]
        self.first = np.zeros(self.fan, np.int64)
        top = edges_[edges_[:, 0] == 0]
        self.first[top[:, 1]] = top[:, 2]

    def single(self, c: str) -> tuple[float, list[int]]:
        """Score and ids of one character by itself: its piece or its bytes."""
        end = self.tree.get(c, {}).get("")
        if end:
            return end[0], [end[1]]
        return -1e12, [self.byte_id.get(b, self.unknown) for b in c.encode()] if self.byte_id else [self.unknown]

    def paths(self, s: str, begin: int, stop: int) -> tuple[list[float], list[int]]:
        """Best score and the begin of the last piece for each end, of paths from ``begin`` whose pieces begin before ``stop``."""
        n = len(s)
        best, back = [_NO] * (n + 1), [0] * (n + 1)
        best[begin] = 0.0
        for i in range(begin, stop):
            base = best[i]
            if base == _NO:
                continue
            node, alone = self.tree, True
            for j in range(i, n):
                node = node.get(s[j])
                if node is None:
                    break
                end = node.get("")
                if end is not None:
                    alone = alone and j > i
                    total = base + end[0]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1] = total, i
            if alone and base - 1e12 > best[i + 1]:
                best[i + 1], back[i + 1] = base - 1e12, i
        return best, back

    def trace(self, s: str, back: list[int], begin: int, end: int) -> list[int]:
        cuts = [end]
        while cuts[-1] > begin:
            cuts.append(back[cuts[-1]])
        ids: list[int] = []
        for a, b in pairwise(reversed(cuts)):
            node = self.tree
            for c in s[a:b]:
                node = node.get(c) or {}
            ids += [node[""][1]] if "" in node else self.single(s[a:b])[1]
        return ids

    def _unit(self, unit: str) -> tuple[bytes, float]:
        best, back = self.paths(unit, 0, len(unit))
        return np.asarray(self.trace(unit, back, 0, len(unit)), "<u4").tobytes(), best[-1]

    def _many(self, units: list[str]) -> list[tuple[bytes, float]]:
        """What ``_unit`` gives for each: the same additions and comparisons in the same order, for all units at once.

        Every character must be a piece by itself.
        """
        units_at = sorted(range(len(units)), key=lambda k: -len(units[k]))
        sizes = np.array([len(units[k]) for k in units_at])
        letters = self.letter_of[np.frombuffer("".join([units[k] for k in units_at]).encode("utf-32-le"), "<u4")]
        begin = np.cumsum(sizes) - sizes
        start = begin + np.arange(len(sizes))
        best = np.full(int(sizes.sum()) + len(sizes), _NO)
        back, piece = np.zeros(len(best), np.int64), np.zeros(len(best), np.int64)
        best[start] = 0.0
        for i in range(int(sizes[0])):
            own = np.arange(int(np.searchsorted(-sizes, -i, side="left")))
            base, node, j = best[start[own] + i], self.first[letters[begin[own] + i]], i + 1
            while len(own):
                total, at = base + self.score_at[node], start[own] + j
                better = total > best[at]
                at = at[better]
                best[at], back[at], piece[at] = total[better], i, self.id_at[node[better]]
                longer = sizes[own] > j
                own, base, node = own[longer], base[longer], node[longer]
                key = node * self.fan + letters[begin[own] + j]
                edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                met = self.edge[edge] == key
                own, base, node = own[met], base[met], self.below[edge[met]]
                j += 1
        owners, ids, own, place = [], [], np.arange(len(sizes)), sizes.copy()
        while len(own):
            at = start[own] + place
            owners.append(own)
            ids.append(piece[at])
            place = back[at]
            own, place = own[place > 0], place[place > 0]
        owner = np.concatenate(owners)[::-1]
        order = np.argsort(owner, kind="stable")
        flat = np.concatenate(ids)[::-1][order].astype("<u4").tobytes()
        edges = (4 * np.cumsum(np.r_[0, np.bincount(owner, minlength=len(sizes))])).tolist()
        made: list = [None] * len(units)
        for k, a, b, total in zip(units_at, edges, edges[1:], best[start + sizes].tolist()):
            made[k] = flat[a:b], total
        return made

    def learn(self, units: set[str]) -> dict[str, tuple[bytes, float]]:
        """Ids and best score of units; those met lately are looked up."""
        if len(self.known) > _KEEP:
            self.before, self.known = self.known, {}
        new = []
        for unit in units:
            if unit not in self.known:
                made = self.before.get(unit)
                if made is None:
                    new.append(unit)
                else:
                    self.known[unit] = made
        alone = self.first > 0
        alone &= self.score_at[self.first] > _NO
        several = [u for u in new if len(u) <= _WIDE] if len(new) >= _FEW else []
        if several:
            codes = np.frombuffer("".join(several).encode("utf-32-le"), "<u4")
            sizes = np.array([len(u) for u in several])
            plain = np.logical_and.reduceat(alone[self.letter_of[codes]], np.cumsum(sizes) - sizes)
            several = [u for u, x in zip(several, plain.tolist()) if x]
            if several:
                self.known.update(zip(several, self._many(several)))
        for unit in new:
            if unit not in self.known:
                self.known[unit] = self._unit(unit)
        return self.known

    def units(self, s: str) -> list[tuple[bytes, float]]:
        """Ids and best score of each unit of normalised text that begins and ends with whole units."""
        found = _UNIT.findall(s)
        known = self.learn(set(found))
        return [known[u] for u in found]

    def encode(self, s: str) -> bytes:
        return b"".join([ids for ids, _ in self.units(s)])

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each normalised text."""
        found = [_UNIT.findall(s) for s in texts]
        known = self.learn(set().union(*found))
        return [b"".join([known[u][0] for u in units]) for units in found]

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def pieces(path: str) -> Pieces:
    """The worker's pieces; units met stay known for later tasks."""
    return kept_in_worker(("pieces", path), lambda: Pieces(path))


def normalised(text: str | None) -> str:
    return SIGN + text.replace(" ", SIGN) if text else ""


def _borders(s: str, size: int) -> tuple[int, int] | None:
    """First and last end of a unit within the chunk's own ``size`` characters (the begin of the next unit)."""
    first = last = None
    at = re.search(f"[^{SIGN}](?={SIGN})", s[: size + 1])
    if at and at.end() <= size:
        first = at.end()
        last = first
        k = s.rfind(SIGN, first, size)
        while k > first:
            if s[k - 1] != SIGN:
                last = k
                break
            k -= 1
    return None if first is None else (first, last)


def transfer(model: Pieces, s: str, size: int, states: int, last: bool) -> np.ndarray:
    """Max-plus matrix of a chunk: s holds its ``size`` characters and what follows them within reach."""
    made = np.full((states, states), _NO)
    borders = _borders(s, size)

    def ends(best: list[float], base: float) -> list[float]:
        reach = range(1 if last else states)
        return [base + best[size + o] if size + o <= len(s) else _NO for o in reach]

    if borders is None:
        for i in range(min(states, size + 1)):
            best, _ = model.paths(s, i, size)
            made[i, : 1 if last else states] = ends(best, 0.0)
        for i in range(size + 1, states):  # a piece that reaches beyond the whole chunk
            if not last:
                made[i, i - size] = 0.0
        return made
    first, border = borders
    head = [_NO] * states
    for i in range(min(states, first + 1)):
        head[i] = model.paths(s[:first], i, first)[0][first]
    middle = sum(score for _, score in model.units(s[first:border]))
    tail, _ = model.paths(s[border:], 0, size - border)
    out = [middle + tail[size - border + o] if size + o <= len(s) else _NO for o in range(1 if last else states)]
    made[:, : len(out)] = np.add.outer(head, out)
    return made


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states_between(matrices: list[np.ndarray], begin: int, end: int) -> list[int]:
    """The states at all cuts, first and last given, on a best way; equal ways go by the smallest state."""
    vectors = [np.where(np.arange(len(matrices[0])) == begin, 0.0, _NO)]
    for m in matrices:
        vectors.append((vectors[-1][:, None] + m).max(axis=0))
    found = [end]
    for k in range(len(matrices) - 1, -1, -1):
        found.append(int(np.argmax(vectors[k] + matrices[k][:, found[-1]])))
    return found[::-1]


def trace_chunk(model: Pieces, s: str, size: int, state_in: int, state_out: int) -> bytes:
    """Ids of the pieces that begin in the chunk, between its two states."""
    borders = _borders(s, size)
    if state_in > size:
        return b""
    if borders is None:
        _, back = model.paths(s, state_in, size)
        return np.asarray(model.trace(s, back, state_in, size + state_out), "<u4").tobytes()
    first, border = borders
    _, back = model.paths(s[:first], state_in, first)
    head = np.asarray(model.trace(s[:first], back, state_in, first), "<u4").tobytes()
    tail_text, end = s[border:], size - border
    _, back = model.paths(tail_text, 0, end)
    tail = np.asarray(model.trace(tail_text, back, 0, end + state_out), "<u4").tobytes()
    return head + model.encode(s[first:border]) + tail


def cuts(s: str, chunk: int) -> list[int]:
    """Begins of the chunks and the text's end: the last end of a unit in a chunk's second half, else its full length."""
    found = [0]
    while len(s) - found[-1] > chunk:
        begin = found[-1]
        k = s.rfind(SIGN, begin + chunk // 2, begin + chunk + 1)
        while k > 0 and s[k - 1] == SIGN:
            k = s.rfind(SIGN, begin + chunk // 2, k)
        found.append(k if k > begin else begin + chunk)
    return [*found, len(s)]


def _content(text: str) -> bytes:
    return hashlib.blake2b(text.encode(), digest_size=16).digest()


def _whole(path: str):
    def run(batches):
        model = pieces(path)
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            ids = model.encode_all([normalised(text) for text in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["row", "ids"])

    return run


def _named(batches):
    for batch in (part for all_ in batches for part in slices(all_, "text")):
        contents = [_content(text) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["row", "content"])


def _chunks(path: str, chunk: int):
    schema = pa.schema([("content", pa.binary()), ("k", pa.int32()), ("last", pa.bool_()), ("size", pa.int32()), ("text", pa.string())])

    def run(batches):
        halo = pieces(path).longest - 1
        for batch in (part for all_ in batches for part in slices(all_, "text")):
            for text in batch.column(0).to_pylist():
                s = normalised(text)
                if len(s) <= chunk:
                    continue
                content, at = _content(text), cuts(s, chunk)
                n = len(at) - 1
                for begin in range(0, n, 64):
                    rows = [(content, k, k == n - 1, at[k + 1] - at[k], s[at[k] : at[k + 1] + halo]) for k in range(begin, min(n, begin + 64))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _transfers(path: str):
    def run(batches):
        model = pieces(path)
        for frame in batches:
            made = [transfer(model, s, size, model.longest, last).tobytes() for s, size, last in zip(frame["text"], frame["size"], frame["last"])]
            yield pd.DataFrame({"content": frame["content"], "k": frame["k"], "matrix": made})

    return run


def _matrices(frame: pd.DataFrame) -> list[np.ndarray]:
    found = [np.frombuffer(m) for m in frame["matrix"]]
    return [m.reshape(int(len(m) ** 0.5), -1) for m in found]


def _block_product(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("k")
    made = _matrices(frame)
    total = made[0]
    for m in made[1:]:
        total = product(total, m)
    return pd.DataFrame({"content": [frame["content"].iloc[0]], "k": [int(frame["k"].iloc[0]) // FAN], "matrix": [total.tobytes()]})


def _block_states(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("k")
    found = states_between(_matrices(frame), 0, 0)
    return pd.DataFrame({"content": frame["content"], "block": frame["k"], "enter": found[:-1], "leave": found[1:]})


def _chunk_states(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("k")
    found = states_between(_matrices(frame), int(frame["enter"].iloc[0]), int(frame["leave"].iloc[0]))
    return pd.DataFrame({"content": frame["content"], "k": frame["k"], "state_in": found[:-1], "state_out": found[1:]})


def _traced(path: str):
    def run(batches):
        model = pieces(path)
        for frame in batches:
            made = [trace_chunk(model, *args) for args in zip(frame["text"], frame["size"], frame["state_in"], frame["state_out"])]
            yield pd.DataFrame({"content": frame["content"], "k": frame["k"], "ids": made})

    return run


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"content": [frame["content"].iloc[0]], "ids": [b"".join(frame.sort_values("k")["ids"])]})


def encode_giants(texts: DataFrame, path: str, chunk: int) -> DataFrame:
    """content, ids of the distinct texts of more than ``chunk`` code points."""
    rows = texts.mapInArrow(_chunks(path, chunk), "content binary, k int, last boolean, size int, text string")
    rows = stage(rows.dropDuplicates(["content", "k"]), "piece-chunks")
    matrices = stage(rows.mapInPandas(_transfers(path), "content binary, k int, matrix binary"), "piece-matrices")
    blocks = (matrices.withColumn("block", F.floor(F.col("k") / FAN)).groupBy("content", "block")
              .applyInPandas(_block_product, "content binary, k int, matrix binary"))
    at_blocks = blocks.groupBy("content").applyInPandas(_block_states, "content binary, block int, enter int, leave int")
    states = (matrices.withColumn("block", F.floor(F.col("k") / FAN).cast("int")).join(at_blocks, ["content", "block"])
              .groupBy("content", "block").applyInPandas(_chunk_states, "content binary, k int, state_in int, state_out int"))
    traced = rows.join(states, ["content", "k"]).mapInPandas(_traced(path), "content binary, k int, ids binary")
    return traced.groupBy("content").applyInPandas(_joined, "content binary, ids binary")


def encode(docs: DataFrame, path: str, chunk: int = 65_536) -> DataFrame:
    """row (the other columns) and ids (little-endian 32-bit numbers) of every row."""
    rows = rows_and_text(docs)
    giant = F.coalesce(F.length("text"), F.lit(0)) >= chunk  # the sign before the first word makes one more
    whole = rows.filter(~giant).mapInArrow(_whole(path), with_row(rows, "ids binary"))
    large = rows.filter(giant)
    found = encode_giants(large.select("text"), path, chunk)
    named = large.mapInArrow(_named, with_row(rows, "content binary"))
    return whole.unionByName(named.join(found, "content").select("row", "ids"))


def _decoded(path: str):
    def run(batches):
        model = pieces(path)
        for batch in (part for all_ in batches for part in slices(all_, "ids")):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([model.decode(x or b"") for x in batch.column(1).to_pylist()], pa.string())],
                                             ["row", "ids", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """row, ids and the text that they stand for."""
    rows = encoded.select("row", "ids")
    return rows.mapInArrow(_decoded(path), with_row(rows, "ids binary, text string"))
