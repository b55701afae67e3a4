"""Importing this module registers every query."""

from lodestat.plans import score_queries  # noqa: F401
from lodestat.plans import decision_queries  # noqa: F401
from lodestat.plans import curation_queries  # noqa: F401
from lodestat.plans import text_queries  # noqa: F401
from lodestat.plans import serving_queries  # noqa: F401
from lodestat.plans import source_queries  # noqa: F401
from lodestat.plans import item_queries  # noqa: F401
