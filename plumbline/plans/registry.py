"""Named queries of the library and their SQL."""

from __future__ import annotations

from plumbline.plans import model_queries, score_queries, stats_queries, text_queries

_MODULES = [text_queries, stats_queries, model_queries, score_queries]
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}


def flagship(spark, sf_dir):
    return QUERIES["rank_bottom_highlight"](spark, sf_dir)
