"""All registered queries and their SQL."""

from tidemark.queries import captures, desk, joins, kernels, live, loads, relational, rosters, steps, strategies, texts, trailing  # noqa: F401  they register themselves
from tidemark.queries.catalog import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "situational_baseline"
