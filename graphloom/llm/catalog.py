"""The queries of the training-data operators, with SQL where SQL can say the same."""

from __future__ import annotations

from . import decontam, embeddings, lines, mixing, pages, pii, pipeline, quality, secrets, simhash, toxicity

QUERIES: dict = {}
ORACLES: dict = {}
for _m in (lines, decontam, secrets, simhash, quality, mixing, toxicity, pii, pages, embeddings, pipeline):
    QUERIES |= _m.QUERIES
    ORACLES |= _m.ORACLES
