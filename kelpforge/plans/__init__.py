"""Query plans: the catalogue of named queries and the bundle export."""

from . import catalog_answers, catalog_committed, catalog_diagnostics, catalog_documents, catalog_evaluation, catalog_invariants, catalog_packs, catalog_payloads, catalog_predictions, catalog_public, catalog_readpath, catalog_records, catalog_unknowns, catalog_versions  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
