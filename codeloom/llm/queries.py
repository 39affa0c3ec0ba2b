"""The queries of all operators, by name, and their SQL counterparts."""

from codeloom.llm import base
from codeloom.llm import jaccard_join, kneser_ney, personal_data, quality_rules, reply_trees, secret_scan, source_mix, spelling_variants, token_alignment, token_counts, toxicity, url_filter, winnowing  # noqa: F401

QUERIES = base.QUERIES
ORACLES = base.ORACLES
