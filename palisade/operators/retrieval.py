"""Vector retrieval of evidence with context budgeting, grounding checks and answer status."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.text import classify_intent, collapse, has_control, strip, token_estimate
from palisade.functions.vectors import norm, vector_problem
from palisade.operators.scale import Order, top_n
from palisade.schemas import Graph
from palisade.session import materialize

# --- fixed values ---------------------------------------------------------------------------
RETRIEVAL_LIMIT = 12
MAX_DISTANCE = 0.45
CONTEXT_TOKENS = 4000
CHARS_PER_TOKEN = 4
# ------------------------------------------------------------------------------------------

NEAREST: Order = (("distance", True), ("observed_at", False), ("evidence_id", True))


def unit_text(citation: Column, excerpt: Column) -> Column:
    """The text an embedding is made of."""
    return F.concat(
        F.lit("Citation: "), strip(citation), F.lit("\nExcerpt: "), F.coalesce(strip(excerpt), F.lit(""))
    )


def embedding_work(evidence: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """``fresh``, ``stale`` or ``missing`` per evidence row for one embedding model."""
    held = embeddings.filter(F.col("embedding_model") == model).select(
        F.col("evidence_id").alias("id"), F.col("content_sha256").alias("_held")
    )
    digest = F.sha2(unit_text(F.col("citation"), F.col("excerpt")), 256)
    return (
        evidence.select("id", digest.alias("content_sha256"))
        .join(held, "id", "left")
        .select(
            F.col("id").alias("evidence_id"),
            "content_sha256",
            F.when(F.col("_held").isNull(), F.lit("missing"))
            .when(F.col("_held") == F.col("content_sha256"), F.lit("fresh"))
            .otherwise(F.lit("stale")).alias("state"),
        )
    )


def embed(texts: DataFrame, text: str, provider, dimensions: int) -> DataFrame:
    """Vectors of a text column from a caller's ``list[str] -> list[list[float]]`` function.

    The provider sees one Arrow batch at a time; ``problem`` says why a vector cannot be stored.
    """
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            vectors = provider(batch.tolist())
            if len(vectors) != len(batch):
                raise ValueError("the provider returned an unexpected number of vectors")
            yield pd.Series(list(vectors))

    rows = texts.withColumn("embedding", run(F.col(text)))
    return rows.withColumn("problem", vector_problem(F.col("embedding"), F.lit(dimensions)))


#: Questions are asked about one actor, model and vector size.
_ASKED = ["actor_id", "embedding_model", "dimensions"]
#: A block of vectors holds at most about so many numbers, and so many rows.
_BLOCK_VALUES, _BLOCK_ROWS = 1 << 21, 2048
#: Rows of one actor meet the sizes of its group in so many parts.
_SALTS = 32
#: Products of matrices are added up in another order; what lies this close to a bound is worked out exactly.
_SLACK = 1e-9


def _large_groups(questions: DataFrame, candidates: DataFrame) -> DataFrame:
    """(keys, _qblock, _cblock) of the groups that have more than one block on a side, stored; 0 blocks where a side has no rows.

    There is at most one for each block's worth of rows, so that the table stays small however many actors there are.
    """
    rows = F.greatest(F.lit(1), F.least(F.lit(_BLOCK_ROWS), F.floor(F.lit(_BLOCK_VALUES) / F.greatest("dimensions", F.lit(1)))))
    counted = [side.groupBy(*_ASKED).agg(F.count(F.lit(1)).alias("_n")).select(*_ASKED, "_n", F.lit(own).alias("_own"))
               for side, own in ((questions, True), (candidates, False))]
    blocks = lambda own: F.ceil(F.coalesce(F.sum(F.when(F.col("_own") == own, F.col("_n"))), F.lit(0)) / F.first(rows)).cast("int")
    sized = counted[0].unionByName(counted[1]).groupBy(*_ASKED).agg(blocks(True).alias("_qblock"), blocks(False).alias("_cblock"))
    return materialize(sized.filter((F.col("_qblock") > 1) | (F.col("_cblock") > 1)), "retrieval-groups")


def _dealt(rows: DataFrame, groups: DataFrame, mark: Column, own: str, other: str) -> DataFrame:
    """Each row in its block (column ``own``), once for every block of the other side; rows of small groups are in the only one."""
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    met = rows.withColumn("_mark", mark).withColumn("_salt", F.pmod("_mark", F.lit(_SALTS)).cast("int")).join(salted, [*_ASKED, "_salt"], "left")
    blocks = {name: F.coalesce(name, F.lit(1)) for name in (own, other)}
    return (
        met.withColumns(blocks).filter(F.col(other) > 0)
        .withColumn(own, F.pmod(F.xxhash64("_mark"), F.col(own)).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        .drop("_mark", "_salt")
    )


def _vectors(rows: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all vectors, with the start and the length of each."""
    column = rows.column(name).combine_chunks()
    edges = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False).astype(np.float64), edges[:-1], np.diff(edges)


def _ordered_dot(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of rows ``left`` of a and ``right`` of b, added up from left to right."""
    total = np.zeros(len(left))
    for x, y in zip(a.T, b.T):
        total += x[left] * y[right]
    return total


def _block_pairs(asked: pa.Table, found: pa.Table, limit: int, max_distance: float, most: int = 1 << 22):
    """Question row, candidate row and distance of all pairs that can be among the first ``limit`` of their question."""
    dated = lambda rows, name, default: rows.column(name).fill_null(default).to_numpy()
    first, last = -(1 << 63), (1 << 63) - 1
    at, since, until = dated(found, "_at", first), dated(asked, "_since", first), dated(asked, "_until", last)
    undated = found.column("_at").is_null().to_numpy()
    free = (since == first) & (until == last)
    norm_a, norm_b = asked.column("_norm").to_numpy(), found.column("_norm").to_numpy()
    (a, a_start, a_size), (b, b_start, b_size) = _vectors(asked, "vector"), _vectors(found, "embedding")
    for size in np.intersect1d(a_size, b_size):
        own, other = np.flatnonzero(a_size == size), np.flatnonzero(b_size == size)
        span = np.arange(size)
        left, right = a[a_start[own][:, None] + span], b[b_start[other][:, None] + span]
        step = max(1, most // len(other))
        for part in (slice(k, k + step) for k in range(0, len(own), step)):
            rows = own[part]
            with np.errstate(all="ignore"):
                near = 1.0 - (left[part] @ right.T) / (norm_a[rows][:, None] * norm_b[other])
            outside = (at[other] < since[rows][:, None]) | (at[other] > until[rows][:, None]) | (undated[other] & ~free[rows][:, None])
            near[outside | np.isnan(near)] = np.inf
            bound = np.full(len(rows), max_distance)
            if len(other) > limit:
                bound = np.minimum(bound, np.partition(near, limit - 1, axis=1)[:, limit - 1])
            i, j = np.nonzero(near <= bound[:, None] + _SLACK)
            distance = 1.0 - _ordered_dot(left[part], right, i, j) / (norm_a[rows[i]] * norm_b[other[j]])
            kept = distance <= max_distance
            yield rows[i[kept]], other[j[kept]], distance[kept]


def _block_nearest(limit: int, max_distance: float):
    def run(asked: pa.Table, found: pa.Table) -> pa.Table:
        parts = list(_block_pairs(asked, found, limit, max_distance)) if len(asked) and len(found) else []
        q, k = (np.concatenate([p[n] for p in parts] or [np.zeros(0, np.int64)]) for n in (0, 1))
        distance = np.concatenate([p[2] for p in parts] or [np.zeros(0)])
        ids = found.column("evidence_id").take(pa.array(k))
        pairs = pa.table({"q": q, "distance": distance, "at": found.column("_at").take(pa.array(k)), "named": pc.is_valid(ids).cast(pa.int8()), "id": ids})
        keys = [("q", "ascending"), ("distance", "ascending"), ("at", "descending"), ("named", "ascending"), ("id", "ascending")]
        order = pc.sort_indices(pairs, sort_keys=keys, null_placement="at_end").to_numpy().astype(np.int64)
        first = np.flatnonzero(np.r_[True, np.diff(q[order]) > 0]) if len(order) else order
        place = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[place < limit]
        return pa.table({"_asked": asked.column("_asked").take(pa.array(q[kept])), "_found": found.column("_found").take(pa.array(k[kept])),
                         "distance": pa.array(distance[kept])})

    return run


def nearest(
    questions: DataFrame,
    candidates: DataFrame,
    limit: int = RETRIEVAL_LIMIT,
    max_distance: float = MAX_DISTANCE,
) -> DataFrame:
    """Exact nearest evidence per question among candidates of the same actor, model and size.

    ``questions``: question_id, actor_id, embedding_model, dimensions, vector, date_from, date_to.
    ``candidates``: actor_id, embedding_model, dimensions, embedding, observed_at, evidence_id, ...
    Further columns of both are kept. Questions and candidates of an actor are dealt into blocks of bounded size, so many that an
    actor with any number of either is many groups; only groups of several blocks are looked up. A pair of blocks is one product
    of matrices, of which the first ``limit`` per question go on. Distances near a bound are added up in the order of the vector's elements, so they (and ties)
    don't depend on the blocks. Null, empty, zero and non-finite vectors and those of another length are never near.
    """
    groups = _large_groups(questions, candidates)
    # a cogroup would let null keys meet
    known = F.col(_ASKED[0]).isNotNull() & F.col(_ASKED[1]).isNotNull() & F.col(_ASKED[2]).isNotNull()
    usable = known & F.col("_norm").isNotNull() & ~F.isnan("_norm") & (F.col("_norm") > 0)
    micros = lambda name: F.unix_micros(F.col(name).cast("timestamp"))
    own = [c for c in questions.columns if c not in ("vector", "date_from", "date_to")]
    other = [c for c in candidates.columns if c not in (*_ASKED, "embedding")]
    asked = questions.select(*_ASKED, "vector", norm(F.col("vector")).alias("_norm"), micros("date_from").alias("_since"),
                             micros("date_to").alias("_until"), F.struct(*own).alias("_asked")).filter(usable)
    found = candidates.select(*_ASKED, "embedding", "evidence_id", norm(F.col("embedding")).alias("_norm"), micros("observed_at").alias("_at"),
                              F.struct(*other).alias("_found")).filter(usable)
    keys = [*_ASKED, "_qblock", "_cblock"]
    left = _dealt(asked, groups, F.xxhash64("_asked"), "_qblock", "_cblock").groupBy(*keys)
    right = _dealt(found, groups, F.xxhash64("_found"), "_cblock", "_qblock").groupBy(*keys)
    kind = T.StructType([asked.schema["_asked"], found.schema["_found"], T.StructField("distance", T.DoubleType())])
    near = left.cogroup(right).applyInArrow(_block_nearest(limit, max_distance), kind)
    columns = [*[F.col("_asked")[c].alias(c) for c in _ASKED], *[F.col("_found")[c].alias(c) for c in other],
               *[F.col("_asked")[c].alias(c) for c in own if c not in _ASKED]]
    return top_n(near.select(*columns, "distance"), ["question_id"], NEAREST, limit, "position")


def candidates(graph: Graph, actor_ids: DataFrame | None = None) -> DataFrame:
    """Evidence reachable from an actor's observations, with its embedding. Not publication-filtered."""
    links = graph.actor_observations
    if actor_ids is not None:
        links = links.join(actor_ids, "actor_id", "left_semi")
    seen = graph.observations.select(
        F.col("id").alias("observation_id"), "observed_at", "intelligence_type", "origin"
    )
    cited = graph.evidence.select(F.col("id").alias("evidence_id"), "source_id", "citation", "excerpt")
    named = graph.sources.select(
        F.col("id").alias("source_id"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind")
    )
    vectors = graph.evidence_embeddings.select("evidence_id", "embedding_model", "dimensions", "embedding")
    return (
        links.join(seen, "observation_id")
        .join(graph.observation_evidence, "observation_id")
        .join(vectors, "evidence_id")
        .join(cited, "evidence_id")
        .join(named, "source_id")
    )


def iso_text(col: Column) -> Column:
    micros = F.date_format(col, "SSSSSS")
    return F.concat(
        F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(micros == "000000", F.lit("")).otherwise(F.concat(F.lit("."), micros)),
        F.lit("+00:00"),
    )


def allocate_context(
    retrieved: DataFrame, budget: int = CONTEXT_TOKENS, order: Order = NEAREST
) -> DataFrame:
    """Prefix of the ranked rows that fits the budget; the last excerpt is cut to what is left.

    A row needs more than its fixed text to fit. Only the last kept row can be cut, and then
    nothing fits after it, so uncut running sums decide exactly. A window here holds at most the
    retrieval limit of rows.
    """
    fixed = token_estimate(
        F.concat_ws(" ", "evidence_id", "source_name", "citation", iso_text(F.col("observed_at")),
                    "intelligence_type")
    )
    by_rank = Window.partitionBy("question_id").orderBy(
        *[F.col(n).asc() if up else F.col(n).desc() for n, up in order]
    )
    before = by_rank.rowsBetween(Window.unboundedPreceding, -1)
    upto = by_rank.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = retrieved.withColumns(
        {"fixed_tokens": fixed, "_excerpt": token_estimate(F.coalesce("excerpt", F.lit("")))}
    )
    spent = sized.withColumn(
        "_left", F.lit(budget) - F.coalesce(F.sum(F.col("fixed_tokens") + F.col("_excerpt")).over(before), F.lit(0))
    )
    fitting = spent.withColumn("_fits", F.col("_left") > F.col("fixed_tokens")).withColumn(
        "_kept", F.every("_fits").over(upto)
    )
    allowed = F.least(F.col("_excerpt"), F.col("_left") - F.col("fixed_tokens"))
    return (
        fitting.filter("_kept")
        .withColumn("excerpt_tokens", allowed.cast("int"))
        .withColumn(
            "excerpt",
            F.substr(F.coalesce("excerpt", F.lit("")), F.lit(1), F.col("excerpt_tokens") * CHARS_PER_TOKEN),
        )
        .drop("_excerpt", "_left", "_fits", "_kept")
    )


def grounding(claims: DataFrame, allocated: DataFrame) -> DataFrame:
    """Per claim: are all cited ids retrieved, and is the claim's type among the cited types?

    ``claims``: question_id, claim_no, claim_type, evidence_ids.
    """
    shown = allocated.groupBy("question_id", "evidence_id").agg(
        F.max_by("intelligence_type", "position").alias("_type")
    )
    cited = claims.select(
        "question_id", "claim_no", "claim_type", F.explode("evidence_ids").alias("evidence_id")
    )
    return (
        cited.join(shown, ["question_id", "evidence_id"], "left")
        .groupBy("question_id", "claim_no")
        .agg(
            F.every(F.col("_type").isNotNull()).alias("all_retrieved"),
            F.coalesce(F.some(F.col("_type") == F.col("claim_type")), F.lit(False)).alias("type_supported"),
        )
        .withColumn("grounded", F.col("all_retrieved") & F.col("type_supported"))
    )


def citations(claims: DataFrame, allocated: DataFrame) -> DataFrame:
    """Retrieved rows that a claim cites, in retrieval order."""
    cited = claims.select("question_id", F.explode("evidence_ids").alias("evidence_id")).distinct()
    return allocated.join(cited, ["question_id", "evidence_id"], "left_semi")


def answer_status(
    questions: DataFrame, retrieved: DataFrame, allocated: DataFrame, drafts: DataFrame, claims: DataFrame
) -> DataFrame:
    """Grounded, or insufficient with the first reason that applies.

    ``questions``: question_id, question. ``drafts``: question_id, answer (null if unusable).
    """
    found = retrieved.groupBy("question_id").agg(F.count(F.lit(1)).alias("retrieved_count"))
    used = allocated.groupBy("question_id").agg(
        F.sum(F.col("fixed_tokens") + F.col("excerpt_tokens")).alias("context_tokens_used")
    )
    verdict = grounding(claims, allocated).groupBy("question_id").agg(F.every("grounded").alias("_ok"))
    rows = questions
    for side in (found, used, verdict):
        rows = rows.join(side, "question_id", "left")
    rows = rows.join(drafts.select("question_id", F.col("answer").alias("_draft")), "question_id", "left")
    reason = (
        F.when(has_control(F.col("question"), True), F.lit("invalid_question"))
        .when(F.col("context_tokens_used").isNull(), F.lit("no_matching_evidence"))
        .when(F.col("_draft").isNull() | (F.col("_draft") == "") | F.col("_ok").isNull(),
              F.lit("invalid_model_output"))
        .when(~F.col("_ok"), F.lit("unsupported_model_output"))
    )
    early = F.col("reason").isin("invalid_question", "no_matching_evidence")
    return rows.withColumn("reason", reason).select(
        "question_id",
        collapse(F.col("question")).alias("question"),
        classify_intent(collapse(F.col("question"))).alias("intent"),
        F.when(F.col("reason").isNull(), F.lit("grounded")).otherwise(F.lit("insufficient_evidence")).alias("status"),
        F.when(F.col("reason").isNull(), F.col("_draft")).alias("answer"),
        F.when(F.coalesce(early, F.lit(False)), F.lit(0)).otherwise(F.coalesce("retrieved_count", F.lit(0)))
        .cast("bigint").alias("retrieved_count"),
        F.when(F.coalesce(early, F.lit(False)), F.lit(0)).otherwise(F.coalesce("context_tokens_used", F.lit(0)))
        .cast("bigint").alias("context_tokens_used"),
        "reason",
    )
