"""Headline queries at one scale; prints a single JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each query
is run to completion into a no-op sink: nothing is collected. The first run warms up; then the median of three runs
counts, or a second one for queries of four seconds and more. The search queries read the postings that their first run has
stored; ``rates`` has the time to store those of the documents, and restates the batch throughput
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import palisade  # noqa: E402
from palisade.operators import normalize, postings, resolve  # noqa: E402
from palisade.plans import adapters, catalog  # noqa: E402
from palisade.sources import generated  # noqa: E402
from palisade.sources.postings_index import write_postings  # noqa: E402
from palisade.sources.stix_bundle import check_envelope, split_objects  # noqa: E402

HEADLINE = [
    "actor_timeline", "actor_search", "associations", "references_union", "keyset_page", "all_pages", "intake_dedup",
    "integrity_counts", "constraint_violations", "version_fold", "normalization_outcomes", "exact_evidence",
    "similar_candidates", "search_and", "search_phrase", "search_ranked", "cross_entity_search", "vector_topk",
    "context_budget", "advisory_list", "queue_metrics", "stix_objects", "stix_bundles", "latency_summary",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def pipeline_rates(spark) -> dict:
    """Normalization of generated bundles and similarity scans against 1,000 generated actors."""
    bundles = generated.intrusion_set_bundles(spark, 160, 250).withColumn("source_id", F.lit("feed"))
    staged = bundles.withColumn("bundle_seq", F.xxhash64("raw_evidence_id") % 1000000)
    raw = bundles.select(F.col("raw_evidence_id").alias("id"), "source_id")
    objects = split_objects(check_envelope(staged), ["raw_evidence_id", "source_id", "bundle_seq"])
    seconds = timed(lambda: run(normalize.normalize_batch(objects, raw).outcomes))
    actors = generated.graph(spark, 1000).actors
    hashes = F.translate(F.sha2(F.col("id").cast("string"), 256), "0123456789", "ghijklmnop")
    labels = spark.range(20000).select(
        F.concat(F.lit("label-"), F.col("id").cast("string")).alias("alias_id"), F.substring(hashes, 1, 17).alias("normalized_name"))
    rules = spark.createDataFrame([], "normalized_alias string, actor_id string, active boolean")
    scan = timed(lambda: run(resolve.similar_candidates(labels, actors, rules)))
    return {
        "normalized_objects_per_s": round(160 * 250 / seconds, 1),
        "similarity_aliases_per_s_1000_actors": round(20000 / scan, 1),
    }


def index_build(spark, sf_dir: str) -> float:
    """Seconds to write the stored postings of the documents; the search queries read them."""
    docs = postings.documents(adapters.text_graph(spark, sf_dir)).filter("entity_type = 'observation'")
    posted = postings.postings(docs, stemmed=False, stop_words=False)
    return timed(lambda: write_postings(posted, palisade.scratch_dir(spark, "bench-postings")))


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("palisade-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    palisade.configure(spark)
    run(spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count())
    seconds = {}
    for name in names:
        once = lambda: timed(lambda: run(catalog.QUERIES[name](spark, sf_dir)))  # noqa: B023, E731
        first = once()  # the first run compiles
        seconds[name] = round(median([once() for _ in range(3)]) if first < 4 else once(), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    rates = pipeline_rates(spark) if not sys.argv[1:] else {}
    rates["documents_index_build_s"] = round(index_build(spark, sf_dir), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf"), "rates": rates,
    }))


if __name__ == "__main__":
    main()
