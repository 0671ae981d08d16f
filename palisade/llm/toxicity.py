"""A toxicity classifier that is held to the same score when identity terms are swapped.

Features of a text are its distinct words (letters only, lower case) and their first six letters. The model is a logistic
regression over at most ``max_features`` features, chosen by how unevenly they fall on the two labels, fitted in numpy on at most
``max_rows`` labelled rows (those with the smallest hash of their id; all of them if there are fewer). For every
labelled text that names a group a twin is made in which each identity term is swapped for the next of its kind, and
the squared difference of the two logits is added to the loss with weight ``swap_penalty``: words that only name a group then
carry no weight of their own, which is what makes neutral mentions look toxic otherwise.

Labels serve to fit only; language, source and id are no features. Scoring needs the chosen features alone (bounded by
``max_features``), so it is one pass without a shuffle.

Defined results: null and empty texts have no features and get the score of the intercept; equal texts get equal scores; rows
without a label or with a label other than 0 and 1 are not learned from; without labels of both kinds every score is the
smoothed share of label 1; an empty table gives an empty one; all columns of the input are kept in ``row``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import rows_and_text, slices, stage, with_row

#: Identity terms by kind; a twin swaps each for the next of its kind.
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("female", "male"),
    ("black", "white", "asian", "latino", "arab"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"), ("transgender", "cisgender"),
    ("immigrants", "natives", "refugees"), ("immigrant", "native", "refugee"),
    ("disabled", "deaf", "blind", "autistic"), ("elderly", "young"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("ausländer", "einheimische"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)
_NEXT = {term: kind[(k + 1) % len(kind)] for kind in IDENTITY for k, term in enumerate(kind)}
_WORD = re.compile(r"[^\W\d_]+")
_STEM = 6


def features_of(words: set[str]) -> set[str]:
    """Words, and stems marked by a star."""
    return words | {w[:_STEM] + "*" for w in words if len(w) > _STEM}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def swapped(words: set[str]) -> set[str] | None:
    """The words with all identity terms swapped; None if there are none."""
    named = words & _NEXT.keys()
    return (words - named) | {_NEXT[w] for w in named} if named else None


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    intercept: float

    def score(self, text: str | None) -> float:
        words, weights = words_of(text), self.weights
        total = self.intercept + sum(map(weights.__getitem__, words & weights.keys()))
        stems = {w[:_STEM] + "*" for w in words if len(w) > _STEM} & weights.keys()
        return float(1 / (1 + np.exp(-min(max(total + sum(map(weights.__getitem__, stems)), -60.0), 60.0))))


def regression(rows: list[np.ndarray], twins: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_features: int,
               swap_penalty: float, ridge: float = 1e-4, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on presence features with the penalty on (text, twin) pairs; full-batch Adam."""
    if labels.sum() == 0 or labels.sum() == len(labels):
        share = (labels.sum() + 0.5) / (len(labels) + 2)
        return np.zeros(n_features), float(np.log(share / (1 - share)))
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    column = np.concatenate(rows) if len(owner) else np.zeros(0, np.int64)
    differing = [(np.setdiff1d(a, b), np.setdiff1d(b, a)) for a, b in twins]
    d_owner = np.concatenate([np.full(len(a) + len(b), k) for k, (a, b) in enumerate(differing)]) if differing else np.zeros(0, np.int64)
    d_column = np.concatenate([x for pair in differing for x in pair]) if differing else np.zeros(0, np.int64)
    d_sign = np.concatenate([np.r_[np.ones(len(a)), -np.ones(len(b))] for a, b in differing]) if differing else np.zeros(0)
    d_owner, d_column = d_owner.astype(np.int64), d_column.astype(np.int64)
    n = len(labels)
    w = np.zeros(n_features + 1)
    w[-1] = np.log(labels.mean() / (1 - labels.mean()))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, rounds + 1):
        logit = np.bincount(owner, w[column], n) + w[-1]
        wrong = (1 / (1 + np.exp(-np.clip(logit, -60, 60))) - labels) / n
        slope = np.append(np.bincount(column, wrong[owner], n_features), wrong.sum())
        if len(d_owner):
            apart = np.bincount(d_owner, d_sign * w[d_column], len(differing))
            slope[:-1] += 2 * swap_penalty / len(differing) * np.bincount(d_column, d_sign * apart[d_owner], n_features)
        slope[:-1] += ridge * w[:-1]
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def _featured(batches):
    kind = pa.list_(pa.string())
    for batch in (part for whole in batches for part in slices(whole, "text", 1 << 19)):
        words = [words_of(text) for text in batch.column(1).to_pylist()]
        other = [swapped(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([sorted(features_of(w)) for w in words], kind),
             pa.array([sorted(features_of(w)) if w is not None else None for w in other], kind)], ["label", "features", "twin"])


def _numbered(index: dict[str, int]):
    def run(batches):
        kind = pa.list_(pa.int32())
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                at = lambda column: pa.array([None if names is None else [index[x] for x in names if x in index]
                                              for names in column.to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([part.column(0), at(part.column(1)), at(part.column(2))], ["label", "features", "twin"])

    return run


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, max_features: int = 4_000, least: int = 3,
        swap_penalty: float = 1.0) -> Model:
    """Learn from the texts of docs that labels (doc_id, toxic) names."""
    known = (labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
             .select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("label")).distinct()
             .orderBy(F.xxhash64("labelled"), "labelled", "label").limit(max_rows))
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = stage(texts.join(known, F.col("doc_id") == F.col("labelled")).select("label", "text")
                 .mapInArrow(_featured, "label int, features array<string>, twin array<string>"), "toxic-features")
    n = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    toxic, clean = n["toxic"], n["n"] - n["toxic"]
    counted = (rows.select("label", F.explode("features").alias("feature")).groupBy("feature")
               .agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).filter(F.col("a") + F.col("b") >= least))
    rate_a, rate_b = (F.col("a") + 0.1) / (toxic + 0.2), (F.col("b") + 0.1) / (clean + 0.2)
    uneven = F.abs(F.log(rate_a / rate_b)) * F.sqrt(F.abs(rate_a - rate_b))
    chosen = [r["feature"] for r in counted.orderBy(F.desc(uneven), "feature").limit(max_features).select("feature").collect()]
    named = sorted(features_of(set(_NEXT)) - set(chosen))
    index = {name: k for k, name in enumerate([*chosen, *named])}
    found = rows.mapInArrow(_numbered(index), "label int, features array<int>, twin array<int>").toPandas()
    sparse = lambda column: [np.asarray(x, np.int64) for x in column]
    twins = found[found["twin"].notna()]
    weights, intercept = regression(sparse(found["features"]), list(zip(sparse(twins["features"]), sparse(twins["twin"]))),
                                    found["label"].to_numpy(float), len(index), swap_penalty)
    return Model({name: float(weights[k]) for name, k in index.items() if weights[k]}, intercept)


def _scored(model: Model, keep_text: bool):
    def run(batches):
        for batch in (part for whole in batches for part in slices(whole, "text")):
            scores = [model.score(text) for text in batch.column(1).to_pylist()]
            kept = [batch.column(1)] if keep_text else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *kept, pa.array(scores, pa.float64())],
                                             ["row", *(["text"] if keep_text else []), "score"])

    return run


def score(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """row (the other columns), the text if it is to be kept, and score."""
    rows = rows_and_text(docs)
    text = "text string, " if keep_text else ""
    return rows.mapInArrow(_scored(model, keep_text), with_row(rows, f"{text}score double"))
