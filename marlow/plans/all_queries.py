"""All registered queries of the engine."""

from marlow.plans import core, domain, landed, quality  # noqa: F401  they register
from marlow.plans.registry import REGISTER

FLAGSHIP = "r07_hybrid_search"

__all__ = ["FLAGSHIP", "REGISTER"]
