"""All registered queries."""

from palisade.plans import (  # noqa: F401
    intake,
    normalization,
    operations,
    publishing,
    quality,
    reads,
    resolution,
    retrieval,
    streams,
)
from palisade.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
