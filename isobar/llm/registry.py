"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from isobar.llm import best_position, bit_slices, decontaminate, exact_dedup, language_id, licenses, line_dedup, pieces, quality, resample, simhash, token_counts, warc

_MODULES = (decontaminate, simhash, language_id, line_dedup, exact_dedup, warc, token_counts, quality, pieces, licenses, bit_slices, resample, best_position)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in _MODULES for name, sql in module.ORACLE.items()}
