"""palisade: threat-intelligence and evidence analytics expressed as Spark jobs.

Layout
    functions/   column expressions (text, ids, time, JSON, vectors) and the few pandas UDFs
    sources/     scans and sinks (tables, snapshots, STIX bundles, blobs, generated data)
    operators/   DataFrame -> DataFrame operators
    plans/       the operators wired to the benchmark tables, one entry per query
    streaming/   Structured Streaming jobs over the same operators
"""

import sys

from pyspark import cloudpickle

from palisade.session import configure, scratch_dir

# Functions that run inside tasks travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["configure", "scratch_dir"]
