"""One case per operator: the Spark query and, beside it, the same question in SQL."""

from suite.registry import ORACLES, QUERIES  # noqa: F401
from suite import aggregates, catalogs, filters, functions, pages, schemas, streams, summaries, writes  # noqa: E402,F401
