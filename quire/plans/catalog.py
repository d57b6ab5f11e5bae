"""All registered queries (importing the modules registers them)."""

from __future__ import annotations

from quire.plans import batches, corpus, curves, groups, lineage, logs, state, streams, sweeps, telemetry  # noqa: F401
from quire.plans.registry import REGISTRY

__all__ = ["REGISTRY"]
