"""Operators keep further columns, whatever characters their names hold."""

import random

import pytest

from palisade.llm import credentials, near_duplicates, pieces, quality, substrings, toxicity
from palisade.llm.queries import vocabulary
from tests.llm.helpers import words

NAMES = ["my col", "a-b", "a.b", "back`tick", "row", "content", "score"]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(6)
    rows = [(k, words(rng, 60), *[f"{name} {k}" if k else None for name in NAMES]) for k in range(4)]
    columns = ["doc_id long", "text string", *[f"`{name.replace('`', '``')}` string" for name in NAMES]]
    return spark.createDataFrame(rows, ", ".join(columns))


@pytest.mark.parametrize("operator", [
    credentials.find_secrets, credentials.mask_secrets, quality.cascade, substrings.remove_repeats, near_duplicates.one_of_each,
    lambda d: pieces.decode(pieces.encode(d, vocabulary("piece_bpe_32k.model")), vocabulary("piece_bpe_32k.model")),
    lambda d: toxicity.score(d, toxicity.Model({}, 0.0))], ids=["secrets", "masked", "rules", "repeats", "near", "pieces", "toxicity"])
def test_any_column_name(docs, operator):
    found = {r.row["doc_id"]: r.row for r in operator(docs).collect()}
    assert len(found) == 4
    for k, row in found.items():
        assert [row[name] for name in NAMES] == [f"{name} {k}" if k else None for name in NAMES]
