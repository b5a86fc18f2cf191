"""All queries of the library, with their SQL."""

from vectide.queries import geometry, relational, selection  # noqa: F401
from vectide.queries.registry import ORACLES, QUERIES  # noqa: F401
