"""All queries of the engine's own operators by name, and the SQL that checks them."""

from weftgraph.plans import batches, claims, code, frontier, graph, log, reconcile, replay, scans, streams, views  # noqa: F401  they register their queries
from weftgraph.plans.base import ORACLE_SQL, QUERIES  # noqa: F401
