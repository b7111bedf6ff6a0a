"""All registered queries; importing the modules registers them."""

from scanloom.plans.queries import (  # noqa: F401
    aggregations, extensions, fusing, joining, rules, scalars, sinking, sourcing, windows,
)
