"""All registered queries."""

from trapline.plans import curation, imports, matching, reid, relational, scalars, storage, timelines  # noqa: F401
from trapline.plans.registry import ORACLES, QUERIES  # noqa: F401
