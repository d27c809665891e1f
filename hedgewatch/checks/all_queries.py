"""All registered queries; importing a module registers its own."""

from hedgewatch.checks import ingest, model, reuse, runs, search, verdicts  # noqa: F401
from hedgewatch.checks.registry import ORACLES, QUERIES  # noqa: F401
