"""All queries over the driver's tables, by name, with their oracles."""

from __future__ import annotations

from lithoscope.plans import files, network, source

QUERIES = {**files.Q, **network.Q, **source.Q}
ORACLES = {**files.O, **network.O, **source.O}
