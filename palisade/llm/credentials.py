"""Secrets in texts, and weak parts of credentials that become secrets only together.

Base kinds are found text by text: assign (a password-like name with a value), access (an access identifier) and hex (a long
hexadecimal run). Beside them weak parts are noted: short access identifiers and user names (class id), short values of
password-like names and short hexadecimal strings (class secret), and addresses (class endpoint). Weak parts alone say
nothing; one is reported only if a complementary part stands in its scope: an id or an endpoint needs a secret, a secret
needs an id or an endpoint, and base spans count as parts (access: id, assign and hex: secret). Two parts share a scope if
they stand in the same block (text between blank lines) and their starts are at most ``reach`` code points apart.

The scopes are joined as intervals: positions fall into bins of ``reach``, the parts of a bin are summed up as the first
and the last start of each class, and a weak part is joined to the summaries of its own bin and the two beside it. A bin of
thousands of parts thus joins as one row, and no pairs are made. Texts are told apart by a 128-bit hash of their content, so
repeated rows share one join and a row needs no id.

Defined results: null and empty texts have no spans; repeated rows get the same spans; an empty table gives an
empty one; all columns of the input are kept in ``row``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.llm.common import rows_and_text, slices, stage, with_row

#: The base patterns, in the order in which kinds are listed, and the least lengths.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")

#: Runs shorter than the least length never pass, so the pattern that skips them finds the same.
_LONG_HEX = re.compile(r"[0-9a-f]{16,}")
_USER = re.compile(r"(?<![A-Za-z0-9])(?i:access_?key_?id|client_?id|user_?name|user|login|account)[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9_.@-]{3,})", re.ASCII)
_VALUE = re.compile(r"(?<![A-Za-z0-9])(?i:pwd|pass|auth|bearer|credential|private_?key)[\"']?\x20*[:=]\x20*[\"']?"
                    r"([A-Za-z0-9+/_.=-]{6,})", re.ASCII)
_SHORT_HEX = re.compile(r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{8,15}(?![A-Za-z0-9])")
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*://[^\s\"'<>]+|(?<![A-Za-z0-9])(?i:host|hostname|endpoint|server)[\"']?\x20*[:=]\x20*"
                      r"[\"']?[A-Za-z0-9.-]+(?::[0-9]+)?", re.ASCII)
_BLANK = re.compile(r"\n[\x20\t\r]*\n")
_DIGIT = re.compile("[0-9]")

_CLASS = {"assign": "secret", "hex": "secret", "access": "id", "weak_id": "id", "weak_secret": "secret",
          "weak_endpoint": "endpoint"}
_SPAN = "array<struct<kind: string, start: int, end: int>>"
_PART = "array<struct<kind: string, start: int, end: int, block: int>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base kinds that are long enough; start and end of the whole match in code points."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [("hex", m.start(), m.end()) for m in _LONG_HEX.finditer(text)]
    return found


def weak_parts(text: str) -> list[tuple[str, int, int]]:
    """Parts that count only beside a complementary one."""
    found = []
    if "AKIA" in text:
        found += [("weak_id", m.start(), m.end()) for m in ACCESS.finditer(text) if 8 <= len(m[0]) < LEAST["access"]]
    if ":" in text or "=" in text:
        found += [("weak_id", m.start(), m.end()) for m in _USER.finditer(text)]
        found += [("weak_secret", m.start(), m.end()) for m in ASSIGN.finditer(text) if 6 <= len(m[2]) < LEAST["assign"]]
        found += [("weak_secret", m.start(), m.end()) for m in _VALUE.finditer(text)]
        found += [("weak_endpoint", m.start(), m.end()) for m in _ADDRESS.finditer(text)]
    if _DIGIT.search(text):
        found += [("weak_secret", m.start(), m.end()) for m in _SHORT_HEX.finditer(text)]
    return found


def _blocks(text: str, spans: list[tuple[str, int, int]]) -> list[dict]:
    breaks = [m.start() for m in _BLANK.finditer(text)]
    made, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        while at < len(breaks) and breaks[at] < start:
            at += 1
        made.append({"kind": kind, "start": start, "end": end, "block": at})
    return made


def _scan(keep_text: bool):
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("block", pa.int32())]))

    def run(batches):
        for batch in (piece for whole in batches for piece in slices(whole, "text")):
            contents, bases, parts = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                base, weak = base_spans(text), weak_parts(text)
                contents.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
                bases.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
                parts.append(_blocks(text, base + weak) if weak else [])
            kept = [batch.column(1)] if keep_text else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *kept, pa.array(contents, pa.binary()), pa.array(bases, span), pa.array(parts, part)],
                ["row", *(["text"] if keep_text else []), "content", "base", "parts"])

    return run


def linked_parts(scanned: DataFrame, reach: int) -> DataFrame:
    """Interval join of weak parts with the complementary parts in their scopes: content, linked (array of spans)."""
    classes = F.create_map(*[F.lit(x) for pair in _CLASS.items() for x in pair])
    parts = (scanned.filter(F.size("parts") > 0).select("content", F.explode("parts").alias("p"))
             .select("content", "p.*", F.floor(F.col("p.start") / reach).cast("int").alias("bin"), classes[F.col("p.kind")].alias("class")))
    bins = parts.groupBy("content", "block", "bin", "class").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    needs = (F.when(F.col("class") == "secret", F.array(F.lit("id"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret"))))
    weak = (parts.filter(F.col("kind").startswith("weak_")).select("content", "block", "kind", "start", "end", "bin", needs.alias("need"))
            .distinct().withColumn("class", F.explode("need"))
            .withColumn("bin", F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1))))
    near = (F.col("last") >= F.col("start") - reach) & (F.col("first") <= F.col("start") + reach)
    return (weak.join(bins, ["content", "block", "bin", "class"]).filter(near)
            .groupBy("content").agg(F.collect_set(F.struct("kind", "start", "end")).alias("linked")))


def find_secrets(docs: DataFrame, reach: int = 200, keep_text: bool = False) -> DataFrame:
    """Rows with row (the other columns), base and linked spans, and the text if it is to be kept."""
    rows = rows_and_text(docs)
    text = "text string, " if keep_text else ""
    schema = with_row(rows, f"{text}content binary, base {_SPAN}, parts {_PART}")
    scanned = rows.mapInArrow(_scan(keep_text), schema)
    if not keep_text:
        scanned = stage(scanned, "secret-spans")
    linked = stage(linked_parts(scanned, reach), "secret-links")
    none = F.array().cast(_SPAN)
    return (scanned.drop("parts").join(linked, "content", "left").drop("content")
            .withColumn("linked", F.coalesce("linked", none)))


def listed(spans):
    """kind:start:end of each span by start, then kind as listed, joined by commas."""
    order = F.create_map(*[F.lit(x) for pair in zip(KINDS, range(len(KINDS))) for x in pair])
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("start"), order[s.kind].alias("place"), s.end.alias("end"), s.kind.alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def _masked(placeholder: str):
    def run(batches):
        for batch in batches:
            made = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                parts, at = [], 0
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start >= at:
                        parts += [text[at:start], placeholder]
                    at = max(at, end)
                made.append("".join([*parts, text[at:]]) if parts else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], ["row", "text"])

    return run


def mask_secrets(docs: DataFrame, reach: int = 200, placeholder: str = "[SECRET]") -> DataFrame:
    """row and text, with every span (overlapping ones as one) replaced."""
    found = find_secrets(docs, reach, keep_text=True)
    rows = found.select("row", "text", F.concat("base", "linked").alias("spans"))
    return rows.mapInArrow(_masked(placeholder), with_row(rows, "text string"))
