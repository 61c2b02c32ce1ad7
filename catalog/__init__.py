from catalog import aggregates, comparison, filters, ingest, joins, lifecycle, profiles, refinement, rules  # noqa: F401
from catalog.base import QUERIES, SQL  # noqa: F401
