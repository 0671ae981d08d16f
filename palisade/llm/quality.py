"""Quality rules as a short-circuit cascade.

Each rule is measured on a sample: what it costs (seconds per text) and what it rejects. The order is then chosen step by
step: the rule that rejects most of what is left of the sample per second comes next. Over the whole table a text is given
to a rule only if no earlier rule rejected it. Which texts are kept does not depend on the order, so neither the sample nor
the measured times can change a decision; only ``rejected_by`` follows the order.

The sample is ``sample_rows`` rows in expectation (a random draw with a fixed seed over the whole table), reduced to one
row per combination of rejecting rules before it reaches the driver.

Defined results: null, empty and blank texts have no words and are rejected (few_words); rows with equal texts get equal
results; an empty table gives an empty one; all columns of the input are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import WORD_SPACE, Words, mix, rows_and_text, slices, texts_of, with_row

#: The characters counted as symbols.
SYMBOLS = b"#*$%&|<>"
_U = np.uint64


def _chosen(characters: bytes) -> np.ndarray:
    made = np.zeros(256, bool)
    made[list(characters)] = True
    return made


_IS_SYMBOL, _IS_MARK = _chosen(SYMBOLS), _chosen(b"!")
_IS_UPPER, _IS_LOWER = _chosen(bytes(range(65, 91))), _chosen(bytes(range(97, 123)))
_BEGINS = np.ones(256, bool)
_BEGINS[0x80:0xC0] = False
_BEGINS[list(WORD_SPACE)] = False


class Texts:
    """A run of texts with the figures that rules ask for; each figure is worked out once, if asked for."""

    def __init__(self, column: pa.Array):
        self.column = column
        self.data, self.offsets = texts_of(column)
        self.n = len(self.offsets) - 1

    def _count(self, chosen: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(chosen[self.data], out=sums[1:])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    @cached_property
    def words(self) -> Words:
        return Words(self.data, self.offsets)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.first)

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._count(_BEGINS)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._count(_IS_SYMBOL)

    @cached_property
    def n_marks(self) -> np.ndarray:
        return self._count(_IS_MARK)

    @cached_property
    def n_upper(self) -> np.ndarray:
        return self._count(_IS_UPPER)

    @cached_property
    def n_lower(self) -> np.ndarray:
        return self._count(_IS_LOWER)

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those of them that equal an earlier one, per text."""
        whole, data = np.zeros((self.n, 2), np.int64), self.data.tobytes()
        for k, (a, b) in enumerate(zip(self.offsets[:-1].tolist(), self.offsets[1:].tolist())):
            found = [line for line in data[a:b].split(b"\n") if line and not line.isspace()]
            whole[k] = len(found), len(found) - len(set(found))
        return whole[:, 0], whole[:, 1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words in three-word windows that occur twice or more in their text."""
        w, text = self.words.hashes, self.words.text
        covered = np.zeros(len(w), bool)
        if len(w) >= 3:
            key = mix(w[:-2] + mix(w[1:-1] + mix(w[2:] + mix(text[2:].astype(_U)))))
            inside = np.flatnonzero(text[2:] == text[:-2])
            key = key[inside]
            order = np.argsort(key)
            same = key[order][1:] == key[order][:-1]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            at = inside[twice]
            for k in range(3):
                covered[at + k] = True
        return np.bincount(text[covered], minlength=self.n).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """A name and the test that a rejected text meets; base rules belong to the stated minimum."""

    name: str
    rejects: object = field(compare=False)
    base: bool = False


#: Whole-number comparisons, so that SQL can state the same.
RULES = (
    Rule("few_words", lambda t: t.n_words < 50, True),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, True),
    Rule("symbols", lambda t: 10 * t.n_symbols > 3 * t.n_words),
    Rule("marks", lambda t: 10 * t.n_marks > 3 * t.n_words),
    Rule("shouting", lambda t: t.n_upper > t.n_lower),
    Rule("repeated_lines", lambda t: 2 * t.lines[1] > t.lines[0]),
    Rule("word_length", lambda t: (t.word_chars < 2 * t.n_words) | (t.word_chars > 30 * t.n_words)),
)


def _measured(rules):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            bits, cost = np.zeros(batch.num_rows, np.int64), np.zeros(len(rules))
            for k, rule in enumerate(rules):
                texts = Texts(batch.column(0))  # anew: a figure that two rules share counts for both
                began = time.perf_counter()
                bits |= np.asarray(rule.rejects(texts)).astype(np.int64) << k
                cost[k] = time.perf_counter() - began
            yield pa.RecordBatch.from_arrays(
                [pa.array(bits), pa.array([(cost / batch.num_rows).tolist()] * batch.num_rows, pa.list_(pa.float64()))], ["bits", "cost"])

    return run


def order_of(found: list[tuple[int, int, list[float]]], n_rules: int) -> list[int]:
    """Rules by rejection per cost, each measured on what the earlier ones leave; (bits, texts, summed cost) rows."""
    texts = sum(n for _, n, _ in found)
    cost = [max(sum(c[k] for _, _, c in found) / max(texts, 1), 1e-9) for k in range(n_rules)]
    order, left = [], list(range(n_rules))
    while left:
        def gain(k):
            return sum(n for bits, n, _ in found if bits >> k & 1 and not any(bits >> j & 1 for j in order)) / cost[k]  # noqa: B023

        best = max(left, key=lambda k: (gain(k), -cost[k], -k))
        order.append(best)
        left.remove(best)
    return order


def plan(docs: DataFrame, rules=RULES, sample_rows: int = 2000, seed: int = 7) -> list[int]:
    """The order of the rules by a sample of about ``sample_rows`` rows."""
    total = docs.count()
    text = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if total > sample_rows:
        text = text.filter(F.rand(seed) < sample_rows / total)
    made = text.mapInArrow(_measured(rules), "bits long, cost array<double>")
    rows = (made.groupBy("bits").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("cost")[k]).alias(f"c{k}") for k in range(len(rules))])
            .collect())
    return order_of([(r["bits"], r["n"], [r[f"c{k}"] for k in range(len(rules))]) for r in rows], len(rules))


_FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _judged(rules, order: list[int], figures: bool):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            text, left = batch.column(1), np.arange(batch.num_rows)
            by = np.full(batch.num_rows, -1)
            whole = some = Texts(text)
            for k in order:
                rejected = np.asarray(rules[k].rejects(some))
                if rejected.any():
                    by[left[rejected]] = k
                    left = left[~rejected]
                    some = Texts(text.take(pa.array(left)))
                if not len(left):
                    break
            columns = [batch.column(0), text] if not figures else [batch.column(0)]
            if figures:
                base = np.zeros(whole.n, bool)
                for rule in rules:
                    if rule.base:
                        base |= rule.rejects(whole)
                columns += [pa.array(x.astype(np.int64)) for x in (whole.n_words, whole.word_chars, whole.n_symbols, whole.lines[1],
                                                                   whole.n_repeat_words)] + [pa.array(base)]
            names = [rule.name for rule in rules]
            columns += [pa.array(by < 0), pa.array([names[k] if k >= 0 else None for k in by.tolist()], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["row", *((*_FIGURES, "base_failed") if figures else ("text",)), "kept", "rejected_by"])

    return run


def cascade(docs: DataFrame, rules=RULES, sample_rows: int = 2000, figures: bool = False) -> DataFrame:
    """row, kept and rejected_by of every row; with ``figures`` the base figures of each text, else the text itself."""
    order = plan(docs, rules, sample_rows)
    rows = rows_and_text(docs)
    middle = "".join(f"{f} long, " for f in _FIGURES) + "base_failed boolean, " if figures else "text string, "
    schema = with_row(rows, f"{middle}kept boolean, rejected_by string")
    return rows.mapInArrow(_judged(rules, order, figures), schema)
