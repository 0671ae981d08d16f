"""Merkle manifest of a dataset: a tree per source, a tree over the sources, proofs and their folding.

A row is a leaf, the hash of its fields. The leaves of a source ascend by doc_id; while several nodes remain, every ``FAN`` consecutive
ones become the hash of their hex digests. What remains is the source's subroot; the subroots, ordered by source, give the root
in the same way. A tree is built in blocks of ``FAN ** LEVELS`` consecutive nodes, which are whole subtrees: one task makes a block's
top node, the top nodes are the next round's leaves, and so on, so that no task holds more than a block, whatever share of the
rows a source has. From the root down each block then gets the siblings on its way up (some KB for a block, not for a row).

Within a block every parent hashes its children one after another and keeps a copy of the hash's state before each child
slot. To fold a leaf, the state of its slot is resumed with the leaf's hash, or that of a changed version of the row, and the right
siblings only; the parents above the block are resumed in the same way from the state after their left siblings, made once per block.

Defined results: a null field is hashed as ``-``; a null source has a tree of its own, which comes first; null ids come first within
their source and count as the empty string where ids are hashed; rows of equal source and id stand in the order of their leaves,
so equal rows share a leaf, not a proof; an empty table gives an empty one. Columns beyond the five fields are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import stage
from palisade.operators.scale import numbered

FAN, LEVELS = 16, 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each as ``-`` or its number of UTF-8 bytes, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _levels(n: int) -> int:
    """How many levels a tree of n nodes still needs, up to those of a block."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _sorted(rows: pa.Table) -> pa.Table:
    return rows.sort_by("idx") if rows.num_rows > 1 else rows


def _top(rows: pa.Table) -> pa.Table:
    """The top node of a block."""
    rows = _sorted(rows)
    nodes, n, idx = rows.column("hash").to_pylist(), rows.column("n")[0].as_py(), rows.column("idx")[0].as_py()
    left = n
    for _ in range(_levels(n)):
        nodes, left = [_hash("".join(nodes[k : k + FAN])) for k in range(0, len(nodes), FAN)], -(-left // FAN)
    return pa.table({"tree": rows.column("tree").slice(0, 1).combine_chunks(), "idx": pa.array([idx // BLOCK]), "hash": pa.array(nodes),
                     "n": pa.array([left])})


class _Block:
    """The parents of a block: for each level the nodes, and the hash states before each child slot."""

    def __init__(self, nodes: list[str], n: int):
        self.nodes, self.states = [nodes], []
        for _ in range(_levels(n)):
            below, above, before = self.nodes[-1], [], []
            for k in range(0, len(below), FAN):
                state = hashlib.sha256()
                for child in below[k : k + FAN]:
                    before.append(state.copy())
                    state.update(child.encode())
                above.append(state.hexdigest())
            self.nodes.append(above)
            self.states.append(before)

    def siblings(self, k: int) -> list[str]:
        """Left and right siblings of leaf k, level by level."""
        found = []
        for level in range(len(self.states)):
            first = k - k % FAN
            found += ["".join(self.nodes[level][first:k]), "".join(self.nodes[level][k + 1 : first + FAN])]
            k //= FAN
        return found

    def fold(self, k: int, value: str, right: list[str]) -> str:
        """The block's top node with ``value`` at leaf k."""
        for level in range(len(self.states)):
            state = self.states[level][k].copy()
            state.update((value + right[level]).encode())
            value = state.hexdigest()
            k //= FAN
        return value


def _paths(key, rows: pa.Table, above: pa.Table) -> pa.Table:
    """The siblings on the way from each node of a block to the root."""
    rows = _sorted(rows)
    block = _Block(rows.column("hash").to_pylist(), rows.column("n")[0].as_py())
    upper, subroot = above.column("path")[0].as_py(), above.column("subroot")[0].as_py()
    idx = rows.column("idx").to_pylist()
    return pa.table({"tree": rows.column("tree").combine_chunks(), "idx": pa.array(idx, pa.int64()),
                     "path": pa.array([block.siblings(k - idx[0]) + upper for k in idx], pa.list_(pa.string())),
                     "subroot": pa.array([subroot] * len(idx), pa.string())})


def _proofs(key, rows: pa.Table, above: pa.Table) -> pa.Table:
    """Proof and folded root of each leaf of a block."""
    rows = _sorted(rows)
    block = _Block(rows.column("hash").to_pylist(), rows.column("n")[0].as_py())
    upper, subroot = above.column("path")[0].as_py(), above.column("subroot")[0].as_py()
    parents = [(hashlib.sha256(a.encode()), b.encode()) for a, b in zip(upper[::2], upper[1::2])]
    ending = "".join(upper).encode()
    idx, proofs, folded = rows.column("idx").to_pylist(), [], []
    for k, own, changed in zip(idx, rows.column("hash").to_pylist(), rows.column("changed").to_pylist()):
        siblings = block.siblings(k - idx[0])
        proof = hashlib.sha256("".join(siblings).encode())
        proof.update(ending)
        proofs.append(proof.hexdigest())
        value = block.fold(k - idx[0], own if changed is None else changed, siblings[1::2])
        for state, right in parents:
            state = state.copy()
            state.update(value.encode())
            state.update(right)
            value = state.hexdigest()
        folded.append(value)
    return pa.table({"doc_id": rows.column("doc_id").combine_chunks(), "leaf": rows.column("hash").combine_chunks(),
                     "subroot": pa.array([subroot] * len(idx), pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
                     "folded_root": pa.array(folded, pa.string())})


_NODE = "tree string, idx long, hash string, n long"
_PATH = "tree string, idx long, path array<string>, subroot string"


def climb(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (tree, idx, hash, n) of each round, leaves first; in the last one every tree has one node, its root."""
    rounds = [leaves]
    while rounds[-1].filter("n > 1").limit(1).count():
        nodes = rounds[-1].select("tree", "idx", "hash", "n")
        above = nodes.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block")).applyInArrow(_top, _NODE)
        rounds.append(stage(above, "merkle-nodes"))
    return rounds


def _down(nodes: DataFrame, paths: DataFrame, function, schema: str) -> DataFrame:
    blocks = nodes.groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block"))
    return blocks.cogroup(paths.groupBy("tree", F.col("idx").alias("block"))).applyInArrow(function, schema)


def descend(rounds: list[DataFrame], paths: DataFrame) -> DataFrame:
    """From the paths of the trees' roots (tree, idx, path, subroot) those of the blocks of leaves."""
    for nodes in reversed(rounds[1:-1]):
        paths = stage(_down(nodes, paths, _paths, _PATH), "merkle-paths")
    return paths


def leaves_of(docs: DataFrame, tampered: Column) -> DataFrame:
    """A staged row per document: tree, idx (from 0 within its source), n (leaves of its source), hash, changed, doc_id.

    ``changed`` is the leaf with the text's A-Z lower-cased where ``tampered``, else null.
    """
    fields = {c: F.col(c) for c in FIELDS}
    other = fields | {"text": F.translate(F.col("text").cast("string"), _ALPHABET, _ALPHABET.lower())}
    tree = F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("!"))  # sorts as sources do, null first
    rows = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), tree.alias("tree"), leaf(list(fields.values())).alias("hash"),
                             F.when(tampered, leaf(list(other.values()))).alias("changed")), "merkle-rows")
    sizes = rows.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    ordered = numbered(rows, [("tree", True), ("doc_id", True), ("hash", True)], ["tree"], "at")
    return stage(ordered.join(sizes, "tree").withColumn("idx", F.col("at") - 1).drop("at"), "merkle-leaves")


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row.

    Documents where ``tampered`` holds are folded with their text's A-Z lower-cased, the others as they are; ``verified`` says
    whether the folded root is the root. ``proof_sha256`` is the hash of the siblings on the way, from the leaf up, left to right.
    """
    leaves = leaves_of(docs, F.lit(False) if tampered is None else tampered)
    rounds = climb(leaves)
    subroots = rounds[-1]
    top = numbered(subroots.select("tree", "hash"), [("tree", True)], (), "at")
    n_trees = subroots.count()
    top = stage(top.select(F.lit("").alias("tree"), (F.col("at") - 1).alias("idx"), "hash", F.lit(n_trees).cast("long").alias("n"),
                           F.col("tree").alias("source_tree")), "merkle-top")
    top_rounds = climb(top)
    found = top_rounds[-1].select("hash").first()
    root = found["hash"] if found else None

    # the root has no siblings; a tree of one node is its own root
    start = docs.sparkSession.createDataFrame([("", 0, [], root)], _PATH)
    paths = descend(top_rounds, start)
    if len(top_rounds) > 1:
        paths = _down(top_rounds[0].select("tree", "idx", "hash", "n"), paths, _paths, _PATH)
    paths = stage(top.select("idx", "source_tree", "hash").join(paths.select("idx", "path"), "idx")
                  .select(F.col("source_tree").alias("tree"), F.lit(0).cast("long").alias("idx"), "path", F.col("hash").alias("subroot")),
                  "merkle-subroots")
    paths = descend(rounds, paths)
    rows = leaves.select("tree", "idx", "hash", "n", "changed", "doc_id")
    done = _down(rows, paths, _proofs, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")
    return done.select("doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), "proof_sha256", "folded_root",
                       (F.col("folded_root") == F.lit(root)).alias("verified"))
