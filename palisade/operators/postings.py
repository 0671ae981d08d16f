"""Weighted search documents as a postings table, and Boolean / phrase matching over it.

Postings are computed once and stored (``sources.postings_index``); queries arrive as a table, are turned into terms, and meet
the stored lists of their words in one join. Postings that are not stored can be passed as a table. A (query, document) pair is
the finest shuffle key, so a word that occurs in a third of all documents spreads over all tasks.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.schemas import Graph
from palisade.sources.postings_index import PostingsIndex, listed

# --- fixed values: field weights and English stop words -------------------------------------
WEIGHTS = {"A": 1.0, "B": 0.4, "C": 0.2, "D": 0.1}
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she "
    "her hers herself it its itself they them their theirs themselves what which who whom this that "
    "these those am is are was were be been being have has had having do does did doing a an the and "
    "but if or because as until while of at by for with about against between into through during "
    "before after above below to from up down in out on off over under again further then once here "
    "there when where why how all any both each few more most other some such no nor not only own "
    "same so than too very s t can will just don should now"
).split()
# ------------------------------------------------------------------------------------------
#: Stands for a missing id where documents are joined.
_NO_ID = "\x00"


def tokens(col: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    words = F.split(F.lower(F.coalesce(col, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(words, lambda w: w != "")


def light_stem(word: Column) -> Column:
    """English plural, -ing, -ed, -ly and -ion endings removed where a stem of three or more stays."""
    singular = F.when(
        word.rlike("^.{3,}(ss|us|is)$"), word
    ).otherwise(F.regexp_replace(word, "^(.{3,})s$", "$1"))
    base = F.regexp_replace(singular, "^(.{2,})ie$", "$1y")
    stem = F.regexp_replace(base, "^(.{3,}?)(ings?|edly|ed|ly|ions?|e)$", "$1")
    # no other word ends in what the patterns look for
    return F.when(F.substring(word, -1, 1).isin(*"sgdyne"), stem).otherwise(word)


def _terms(words: Column, stemmed: bool) -> Column:
    return F.transform(words, light_stem) if stemmed else words


def field(col: Column, weight: str) -> Column:
    return F.struct(col.cast("string").alias("text"), F.lit(weight).alias("weight"))


def documents(graph: Graph) -> DataFrame:
    """(entity_type, id, fields) of all seven entity kinds; JSON metadata is matched as text."""
    c = F.col

    def joined(*names):
        return F.concat_ws(" ", *[F.coalesce(c(n), F.lit("")) for n in names])

    plan = [
        ("source", graph.sources,
         [(c("name"), "A"), (joined("kind", "policy_notes", "license_name"), "B"), (c("metadata"), "D")]),
        ("actor", graph.actors, [(c("canonical_name"), "A"), (c("description"), "B"), (c("metadata"), "D")]),
        ("alias", graph.aliases, [(c("name"), "A"), (c("source_native_id"), "C"), (c("metadata"), "D")]),
        ("campaign", graph.campaigns, [(c("name"), "A"), (c("description"), "B"), (c("metadata"), "D")]),
        ("behavior", graph.behaviors, [(c("name"), "A"), (c("description"), "B"), (c("metadata"), "D")]),
        ("technique", graph.techniques,
         [(joined("external_id", "name"), "A"), (c("description"), "B"), (c("metadata"), "D")]),
        ("observation", graph.observations,
         [(c("title"), "A"), (c("summary"), "B"), (c("source_native_id"), "C"), (c("metadata"), "D")]),
    ]
    out = None
    for kind, rows, fields in plan:
        part = rows.select(
            F.lit(kind).alias("entity_type"), "id", F.array(*[field(x, w) for x, w in fields]).alias("fields")
        )
        out = part if out is None else out.unionByName(part)
    return out


def artifact_documents(artifacts: DataFrame) -> DataFrame:
    return artifacts.select(
        F.lit("artifact").alias("entity_type"), "id",
        F.array(field(F.col("title"), "A"), field(F.col("canonical_id"), "A"),
                field(F.col("metadata"), "D")).alias("fields"),
    )


def postings(docs: DataFrame, stemmed: bool = True, stop_words: bool = True) -> DataFrame:
    """(entity_type, id, term, pos, weight); positions run on across the fields of a document.

    Row-local: no shuffle. Stop words are dropped but keep their positions.
    """
    words = F.flatten(
        F.transform(
            "fields",
            lambda f: F.transform(
                tokens(f.getField("text")),
                lambda w: F.struct(w.alias("word"), f.getField("weight").alias("weight")),
            ),
        )
    )
    rows = docs.select("entity_type", "id", F.posexplode(words).alias("_p", "_w"))
    if stop_words:
        rows = rows.filter(~F.col("_w.word").isin(*STOP_WORDS))
    term = light_stem(F.col("_w.word")) if stemmed else F.col("_w.word")
    return rows.select(
        "entity_type", "id", term.alias("term"), (F.col("_p") + 1).alias("pos"),
        F.col("_w.weight").alias("weight"),
    )


def posting_lists(docs: DataFrame, stemmed: bool = True, stop_words: bool = True) -> DataFrame:
    """(term, entity_type, id, list): the rows of ``postings``, packed and gathered for each row of ``docs``.

    Words go to arrays a document at a time, so that its id isn't repeated for each word.
    """
    def words(text: Column) -> Column:
        return F.transform(tokens(text), lambda w: F.when(
            ~w.isin(*STOP_WORDS) if stop_words else F.lit(True), light_stem(w) if stemmed else w))

    made = F.transform("fields", lambda f: F.struct(words(f.getField("text")).alias("words"), f.getField("weight").alias("weight")))
    return docs.select("entity_type", "id", made.alias("fields")).mapInArrow(
        listed(list(WEIGHTS)), "term string, entity_type string, id string, list array<int>")


def index_input(docs: DataFrame, stemmed: bool = True, stop_words: bool = True, exact: DataFrame | None = None) -> tuple:
    """What an index of ``docs`` is written from: lists, exact names and the documents of several rows."""
    again = docs.groupBy("entity_type", "id").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return posting_lists(docs, stemmed, stop_words), exact, again


def query_terms(queries: DataFrame, stemmed: bool = True, stop_words: bool = True) -> DataFrame:
    """(query_id, alt, clause, term, offset, size, negated) of web-style queries.

    Words are ANDed; a quoted text is a phrase; ``OR`` separates alternatives; ``-`` excludes. A word
    that splits into several tokens (such as a dotted identifier) is treated as a phrase.
    """
    raw = F.regexp_extract_all(F.col("query"), F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    rows = queries.select("query_id", raw.alias("_c")).select(
        "query_id",
        F.posexplode(
            F.transform(
                "_c",
                lambda c, i: F.struct(
                    F.size(F.filter(F.slice("_c", F.lit(1), i + 1), lambda x: F.lower(x) == "or")).alias("alt"),
                    c.alias("text"),
                ),
            )
        ).alias("clause", "_x"),
    ).filter(F.lower("_x.text") != "or")
    spread = rows.select(
        "query_id", F.col("_x.alt").alias("alt"), "clause",
        F.startswith(F.col("_x.text"), F.lit("-")).alias("negated"),
        F.posexplode(tokens(F.col("_x.text"))).alias("offset", "word"),
    )
    if stop_words:
        spread = spread.filter(~F.col("word").isin(*STOP_WORDS))
    term = light_stem(F.col("word")) if stemmed else F.col("word")
    terms = spread.select("query_id", "alt", "clause", "negated", "offset", term.alias("term"))
    sizes = terms.groupBy("query_id", "alt", "clause").agg(F.count(F.lit(1)).alias("size"))
    return terms.join(sizes, ["query_id", "alt", "clause"])


def packed() -> Column:
    """Position and weight of a posting in one integer."""
    return (F.col("pos") * 4 + F.array_position(F.array(*[F.lit(w) for w in WEIGHTS]), F.col("weight")) - 1).cast("int")


def word_lists(terms: DataFrame, posted: DataFrame | PostingsIndex) -> DataFrame:
    """(entity_type, id, term, list) of the words asked for.

    A stored index has them; postings are cut down to the words and folded to one row per (document, word). Either are placed
    by document once, before queries multiply them; every later grouping reuses that placement. A missing id is ``_NO_ID``.
    """
    if isinstance(posted, PostingsIndex):
        return posted.lists(terms).withColumn("id", F.coalesce("id", F.lit(_NO_ID))).repartition("entity_type", "id")
    placed = posted.join(terms.select("term").distinct(), "term", "left_semi").select(
        "entity_type", F.coalesce("id", F.lit(_NO_ID)).alias("id"), "term", packed().alias("_at")
    ).repartition("entity_type", "id")
    return placed.groupBy("entity_type", "id", "term").agg(F.collect_list("_at").alias("list"))


def candidates(terms: DataFrame, posted: DataFrame | PostingsIndex) -> DataFrame:
    """(query_id, entity_type, id, alt, parts): documents holding every positive word of an alternative.

    The words of a (query, document) are counted first, without their positions; these are gathered once for each document and
    meet only the queries that have all their words there. Word order is not looked at yet. Whether the terms are broadcast is
    left to the sizes that Spark sees.
    """
    lists = word_lists(terms, posted)
    word = F.struct("clause", "negated", "size", "offset", "term")
    asked = terms.groupBy("query_id", "alt").agg(F.count_if(~F.col("negated")).alias("need"), F.collect_list(word).alias("words"))
    positive = terms.filter(~F.col("negated")).select("query_id", "alt", "term")
    # the count asks for the list, although any would do, so that both readers of the lists share one shuffle
    counted = lists.join(positive, "term").groupBy("query_id", "entity_type", "id", "alt").agg(F.count_if(F.size("list") >= 0).alias("have"))
    whole = counted.join(asked.select("query_id", "alt", "need"), ["query_id", "alt"]).filter(F.col("have") == F.col("need")).drop("have", "need")
    held = lists.groupBy("entity_type", "id").agg(F.collect_list(F.struct("term", "list")).alias("held"))
    met = whole.join(held, ["entity_type", "id"]).join(asked.drop("need"), ["query_id", "alt"])

    def part(w: Column) -> Column:
        place = F.array_position(F.col("held.term"), w.getField("term")).cast("int") - 1
        return F.struct(*[w.getField(n).alias(n) for n in ("clause", "negated", "size", "offset")], F.get("held.list", place).alias("list"))

    parts = F.filter(F.transform("words", part), lambda p: p.getField("list").isNotNull())
    return met.select("query_id", "entity_type", F.nullif("id", F.lit(_NO_ID)).alias("id"), "alt", _once(parts).alias("parts"))


def _once(made: Column) -> Column:
    """A value as the one row of a generator: no later filter or column works it out again."""
    return F.explode(F.array(made))


def _satisfied(parts: Column, clause: Column) -> Column:
    """Hits (pos, weight, slot) of one clause of a candidate, empty if it isn't satisfied.

    A phrase needs all its words at one start: the starts of its words are intersected, and each word keeps the positions at
    what is left. Array intersections hash, so the work is linear in the positions.
    """
    names = F.array(*[F.lit(w) for w in WEIGHTS])
    words = F.filter(parts, lambda p: p.getField("clause") == clause)

    def starts(word: Column) -> Column:
        return F.transform(word.getField("list"), lambda at: F.shiftright(at, 2) - word.getField("offset"))

    def hits(word: Column, lists: Column) -> Column:
        slot = F.shiftleft(word.getField("clause").cast("bigint"), 32) + word.getField("offset")
        return F.transform(lists, lambda at: F.struct(
            F.shiftright(at, 2).alias("pos"), F.get(names, F.pmod(at, F.lit(4))).alias("weight"), slot.alias("slot")))

    def at_starts(word: Column, common: Column) -> Column:
        places = F.flatten(F.transform(common, lambda s: F.transform(
            F.sequence(F.lit(0), F.lit(3)), lambda w: ((s + word.getField("offset")) * 4 + w).cast("int"))))
        return hits(word, F.array_intersect(word.getField("list"), places))

    def phrase(all_words: Column) -> Column:
        common = F.aggregate(
            all_words, starts(F.get(all_words, F.lit(0))), lambda kept, w: F.array_intersect(kept, starts(w)))
        return F.flatten(F.transform(F.array(common), lambda kept: F.flatten(F.transform(all_words, lambda w: at_starts(w, kept)))))

    first = F.get(words, F.lit(0))
    whole = F.size(words) == first.getField("size")
    nothing = F.slice(hits(first, first.getField("list")), 1, 0)
    return F.when(first.getField("size") == 1, hits(first, first.getField("list"))).when(whole, phrase(words)).otherwise(nothing)


def match(terms: DataFrame, posted: DataFrame | PostingsIndex) -> DataFrame:
    """(query_id, entity_type, id, alt, hits): documents that satisfy an alternative of a query.

    A query whose alternative has no positive word matches nothing. ``hits`` are the positions of the positive words, at most
    the length of the one document. A candidate has all its words in one row, so that clauses are tested where it stands.
    """
    clauses = F.transform(
        F.array_distinct(F.transform("parts", lambda p: F.struct(p.getField("clause").alias("clause"), p.getField("negated").alias("negated")))),
        lambda k: F.struct(k.getField("negated").alias("negated"), _satisfied(F.col("parts"), k.getField("clause")).alias("hits")))
    tested = candidates(terms, posted).select("query_id", "entity_type", "id", "alt", _once(clauses).alias("clauses"))
    return tested.filter(
        F.forall("clauses", lambda k: k.getField("negated") != (F.size(k.getField("hits")) > 0))
    ).select(
        "query_id", "entity_type", "id", "alt",
        F.flatten(F.transform(F.filter("clauses", lambda k: ~k.getField("negated")), lambda k: k.getField("hits"))).alias("hits"))


def weight_of(col: Column) -> Column:
    expr = F.lit(0.0)
    for name, value in WEIGHTS.items():
        expr = F.when(col == name, F.lit(value)).otherwise(expr)
    return expr


def frequency_rank(matched: DataFrame) -> DataFrame:
    """Native score r / (r + 1) with r the summed weights of all matched positions."""
    total = F.aggregate(
        "hits", F.lit(0.0), lambda acc, h: acc + weight_of(h.getField("weight"))
    )
    scored = matched.withColumn("_r", total)
    return scored.groupBy("query_id", "entity_type", "id").agg(
        F.max(F.col("_r") / (F.col("_r") + 1)).alias("rank")
    )


def _covers(positions: list[int], slots: list[int], costs: list[float]) -> float:
    """Summed worth of the covers of one document's hits, which are ordered by position."""
    last = dict.fromkeys(slots, -1)
    total, begin = 0.0, -1
    for at, slot in enumerate(slots):
        last[slot] = at
        if (first := min(last.values())) > begin:
            cost = 0.0
            for each in costs[first : at + 1]:
                cost += each
            noise = positions[at] - positions[first] - (at - first)
            total += (at - first + 1) / cost / (1 + max(noise, 0))
            begin = first
    return total


@F.pandas_udf(T.DoubleType())
def _cover_total(positions: pd.Series, slots: pd.Series, costs: pd.Series) -> pd.Series:
    return pd.Series([_covers(p.tolist(), s.tolist(), k.tolist()) for p, s, k in zip(positions, slots, costs)], dtype="float64")


def cover_density(hits: Column) -> Column:
    """Cover density (Clarke, Cormack and Tudhope) of one document's hits, bounded by r / (r + 1).

    One sweep over the hits by position: for each query word the last hit so far; where all words have one and the
    earliest of these lies after the begin of the last cover, a new cover ends. It counts by the density of
    its weights, damped by the foreign words inside. A cover is added up once, when it ends, so a sweep takes time in
    proportion to the hits and the query's words.
    """
    ordered = F.sort_array(F.transform(hits, lambda h: F.struct(
        h.getField("pos").alias("pos"), h.getField("slot").alias("slot"), (1.0 / weight_of(h.getField("weight"))).alias("cost"))))
    total = F.when(F.size(hits) > 0, _cover_total(ordered.getField("pos"), ordered.getField("slot"), ordered.getField("cost"))).otherwise(F.lit(0.0))
    return total / (total + 1)


def cover_rank(matched: DataFrame) -> DataFrame:
    """Exact ranking of matched documents only."""
    return matched.withColumn("_r", cover_density(F.col("hits"))).groupBy("query_id", "entity_type", "id").agg(
        F.max("_r").alias("rank")
    )
