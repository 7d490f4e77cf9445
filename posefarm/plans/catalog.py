"""All registered queries."""

from posefarm.plans import corpus, evaluation, flows, geometry, learning  # noqa: F401
from posefarm.plans.registry import QUERIES, SQL  # noqa: F401
