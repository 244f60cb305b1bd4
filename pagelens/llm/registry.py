"""The queries of the operators here, and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontamination, embeddings, hmm, licences, lines, mixing, negatives, phrases, quality, simhash, suffixes

MODULES = [mixing, licences, simhash, suffixes, embeddings, lines, chat, hmm, quality, bpe, phrases, decontamination, negatives]


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in getattr(m, "SQL", {}).items()}
