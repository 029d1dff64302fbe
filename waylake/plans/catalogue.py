"""All queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from waylake.plans import delta, fetching, network, relational, shapes, spatial, storing, versioning

QUERIES = {}
ORACLES = {}
for _part in (delta, relational, versioning, spatial, shapes, network, fetching, storing):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
