"""Stand-in views over the driver's tables, the registered queries and their SQL."""

from lodestrata.plans import oracle  # noqa: F401  (fixes the order in which the queries register)
