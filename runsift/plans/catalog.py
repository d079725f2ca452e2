"""Every registered query. Importing a module registers its queries."""

from runsift.plans import (  # noqa: F401
    q_discover, q_extract, q_fidelity, q_ledger, q_pipeline, q_prepare, q_reduce, q_sessions, q_sources, q_streaming,
)
from runsift.plans.registry import ORACLES, QUERIES  # noqa: F401
