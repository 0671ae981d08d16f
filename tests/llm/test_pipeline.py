"""The pipeline's stages one after the other, each against what plain Python expects of its own input."""

import random
import re

import corpus_pipeline
from tests.llm.helpers import words

WINDOW = 35
KEY = "password = Zx81kQpW77aLmN04"


def _documents():
    rng = random.Random(11)
    passage = " ".join(f"passage{k}" for k in range(50))
    texts = {k: words(rng, 80) for k in range(60)}
    for k in range(60, 90):
        texts[k] = words(rng, 60) + " vileword nasty" + " vileword" * 5
    for k in (100, 101, 102):
        texts[k] = texts[0]  # exact copies
    near = texts[1].split()
    near[40] = "changed"
    texts[103] = " ".join(near)
    for k in (2, 3):
        texts[k] = texts[k] + " " + passage + " " + words(rng, 20)
    texts[4] += f" {KEY} and more"
    return {**texts, 200: None, 201: ""}


def _kept_words(texts):
    """Plain removal of the words of windows whose words start anywhere else too."""
    starts = {}
    for key, text in texts.items():
        found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        for at in range(len(found) - WINDOW + 1):
            starts.setdefault(tuple(found[at : at + WINDOW]), []).append((key, at))
    cut = {(key, at + i) for places in starts.values() if len(places) > 1 for key, at in places for i in range(WINDOW)}
    return {key: [w for i, w in enumerate(re.findall(r"[^\x20\x09-\x0D]+", text or "")) if (key, i) not in cut] for key, text in texts.items()}


def _texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_in_order_and_their_decisions(spark, tmp_path):
    texts = _documents()
    rows = [(k, t, None if k == 5 else "en", "hot", None if t is None else len(t), k * 0.5, "mine") for k, t in texts.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, 1, int(60 <= k < 90)) for k in texts]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeats", "secrets", "packing"]

    seen = {}
    for name, function in corpus_pipeline.STAGES:
        before = docs
        docs = function(spark, docs, str(tmp_path))
        if name != "packing":
            assert (docs.columns, docs.dtypes) == (before.columns, before.dtypes)
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
            seen[name] = _texts(docs)
            assert {(r.score, r.row) for r in docs.collect()} <= {(k * 0.5, "mine") for k in seen[name]}

    assert seen["toxicity"] == {k: t for k, t in texts.items() if not 60 <= k < 90}
    left = seen["near_duplicates"]
    assert len(set(left) & {0, 100, 101, 102}) == 1 and len(set(left) & {1, 103}) == 1
    assert set(range(2, 60)) <= set(left) and all(t == texts[k] for k, t in left.items())
    want = _kept_words(left)
    assert {k: (t or "").split() for k, t in seen["repeats"].items()} == want
    assert not {"passage0", "passage49"} & set(want[2]) and seen["repeats"][6] == texts[6]
    masked = seen["secrets"]
    assert "Zx81kQpW77aLmN04" not in masked[4] and masked[4].endswith("and more")
    assert all(t == seen["repeats"][k] for k, t in masked.items() if k != 4)
    pieces = docs.collect()
    assert {p.doc_id for p in pieces} == set(masked)
    whole = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        assert p.start == whole.get(p.doc_id, 0)
        whole[p.doc_id] = p.start + p.length
    assert all(whole[p.doc_id] == p.doc_tokens for p in pieces)
    by_sequence = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by_sequence.get(p.sequence_id, 0)
        by_sequence[p.sequence_id] = p.offset + p.length
    assert max(by_sequence.values()) <= 1024 and sum(n < 1024 for n in by_sequence.values()) <= 1
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert sum(p.length for p in again) == sum(p.length for p in pieces) and {key(p)[0] for p in again} == set(masked)
