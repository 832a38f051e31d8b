"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from groundsearch.plans import catalog_contract, catalog_text

QUERIES = catalog_text.QUERIES | catalog_contract.QUERIES
ORACLES = catalog_text.ORACLES | catalog_contract.ORACLES


def flagship(spark, sf_dir):
    """The ten best documents for a phrase or words, by BM25 over the index."""
    return catalog_text.fts_match_and_or(spark, sf_dir)
