"""All queries of the library's core, by name, and their SQL."""

from __future__ import annotations

from tessera.jobs import code, context, relational, retrieval, symbols

QUERIES: dict = retrieval.QUERIES | relational.QUERIES | context.QUERIES | code.QUERIES | {"symbol_score_features": symbols.symbol_score_features}
ORACLES: dict[str, str] = retrieval.ORACLES | relational.ORACLES | context.ORACLES | code.ORACLES | {"symbol_score_features": symbols.ORACLE}
