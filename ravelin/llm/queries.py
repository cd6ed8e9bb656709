"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from ravelin.llm import bpe, collocations, embeddings, filter_audit, licenses, mixing, ogg, pieces, quality, simhash, token_counts, toxicity, warc

_MODULES = (ogg, simhash, bpe, token_counts, embeddings, toxicity, quality, mixing, licenses, warc, collocations, pieces, filter_audit)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
